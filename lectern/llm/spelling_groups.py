"""Spelling variants: words one edit apart, found through an index of variable-length grams.

1. Words are counted over whole texts (see `count_words`).
2. The gram dictionary: grams of 2 to LONGEST code points (a mark ends each word) that stand in more than T
   places are the frequent ones; a gram is grown until it is no longer frequent, so the frequency tree is
   pruned below every rare gram. T follows the number of places, which bounds the frequent grams by
   LONGEST * places / T <= DICTIONARY: that many reach the driver and the tasks, whatever the corpus.
3. A word is decomposed into the variable gram of each of its places: the shortest that isn't frequent, but
   half of the word at most. Which gram starts at a place depends on its own characters only.
4. One edit changes the grams around it. Per word, the affected-gram bound says which lists must be merged: of any
   two grams that don't overlap one is unaffected, and the grams between the edit and it are too.
   So each word opens two lists only, the pair without overlap whose lists are shortest by the dictionary:
   for an equally long word both, at their places; for a word longer by one the first at its place and the second one place later.
5. What a list gives is verified: by a mask of the characters, then by edit distance.

Both sides of the merge are dealt by (gram, place, length); Spark's skew join splits a list that is long for its partition,
and a join holds no list whole.

Nulls: a null text has no word; a null id counts as empty text before the colon. Texts without letters give nothing. Equal rows
count each time. Other columns don't matter. A very long run of letters is a word like others.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import discard, in_task, mix, powers, save, shuffle_width, signed, span_hash, table

SHORTEST = 5
LEAST = 3
#: Of a gram, in code points; a word uses grams of half its length at most.
LONGEST = 8
#: Frequent grams in the dictionary at most.
DICTIONARY = 500_000
MODULUS = 97
_WAITING = 200_000
_END = np.uint32(0x110000)  # behind a word: no code point
_PLACE = 24  # bits of a place within a word, where it shares a number with a cost
_RUN = re.compile("[A-Za-zÀ-ÿ]+")


def _lower(run: str) -> str:
    return run.lower() if run.isascii() else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)


def count_words(documents: DataFrame, shortest: int = SHORTEST, least: int = LEAST, modulus: int = MODULUS) -> DataFrame:
    """(word, n): runs of letters, A-Z in lower case, one code point deleted where `modulus` divides the run's checksum.

    A task sums what it has met and passes it on whenever that is _WAITING words: its memory doesn't follow the corpus.
    """

    def run(batches):
        total: Counter = Counter()
        known: dict[str, tuple[str, bytes]] = {}

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            known.clear()
            return batch

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                start = zlib.crc32(f"{'' if key is None else key}:".encode())
                for form, k in Counter(_RUN.findall(text.as_py() or "")).items():
                    found = known.get(form)
                    if found is None:
                        word = _lower(form)
                        found = known[form] = word, word.encode()
                    word, raw = found
                    h = zlib.crc32(raw, start)
                    if h % modulus == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    if len(word) >= shortest:
                        total[word] += k
                if len(known) >= _WAITING:
                    yield out()
        yield out()

    parts = documents.select("doc_id", "text").mapInArrow(in_task(run), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


class _Words:
    """The words of a batch as code points, each with the end mark behind it."""

    def __init__(self, words: list[str]):
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        at = np.cumsum(self.size + 1)
        codes = np.full(int(at[-1]) if len(at) else 0, _END, np.uint32)
        inside = np.ones(len(codes), bool)
        inside[at - 1] = False
        codes[inside] = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        self.begin = at - self.size - 1
        values = mix(codes.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)
        self.prefix = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(values * powers(len(codes) + 1)[0][: len(codes)], out=self.prefix[1:])
        bits = np.uint64(1) << (values >> np.uint64(58))
        self.mask = np.bitwise_or.reduceat(np.where(inside, bits, np.uint64(0)), self.begin) if len(words) else np.zeros(0, np.uint64)
        # every place of every word: its word, its start, and how far it is to behind the end mark
        self.word = np.repeat(np.arange(len(words)), self.size)
        self.start = np.flatnonzero(inside)
        self.left = self.begin[self.word] + self.size[self.word] + 1 - self.start

    def hashed(self, at: np.ndarray, length) -> np.ndarray:
        return signed(span_hash(self.prefix, self.start[at], self.start[at] + length))


def gram_dictionary(words: DataFrame, places: int, most: int = DICTIONARY, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, int]:
    """(grams sorted, their places, T): the grams that stand in more than T places of words, `most` at most."""
    limit = max(16, -(-longest * places // most))

    def run(batches):
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for batch in batches:
            w = _Words(batch.column(0).to_pylist())
            found = [held[0]]
            for length in range(2, longest + 1):
                found.append(w.hashed(np.flatnonzero(w.left >= length), length))
            n = np.concatenate([held[1], np.ones(sum(map(len, found[1:])), np.int64)])
            grams, back = np.unique(np.concatenate(found), return_inverse=True)
            held = grams, np.bincount(back, n, len(grams)).astype(np.int64)
            if len(grams) >= 2_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], names=["gram", "n"])
                held = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], names=["gram", "n"])

    counted = words.select("word").mapInArrow(in_task(run), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    frequent = counted.where(F.col("n") > limit).toArrow()
    grams, n = np.asarray(frequent["gram"]), np.asarray(frequent["n"])
    order = np.argsort(grams)
    return grams[order], n[order], limit


def decompose(w: _Words, grams: np.ndarray, places: np.ndarray, limit: int, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """(length, cost) of the variable gram of each place: grown while frequent, to half of the word at most."""
    most = np.minimum(np.minimum(w.left, longest), (w.size[w.word] + 1) // 2)
    length, cost = np.minimum(2, most), np.full(len(most), limit, np.int64)
    open_ = np.arange(len(most))
    while len(open_) and len(grams):
        h = w.hashed(open_, length[open_])
        at = np.minimum(np.searchsorted(grams, h), len(grams) - 1)
        often = grams[at] == h
        cost[open_] = np.where(often, places[at], limit)
        open_ = open_[often & (length[open_] < most[open_])]
        length[open_] += 1
    return length, cost


def two_lists(size: int, length: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word of one size, the places of the two grams without overlap whose lists are shortest; arrays of words x places."""
    place = np.arange(size)
    packed = (cost << _PLACE) | place
    # the cheapest gram that ends at a place or before it
    ended = np.full((len(cost), size + 2), np.iinfo(np.int64).max)
    np.minimum.at(ended, (np.arange(len(cost))[:, None], place + length), packed)
    ended = np.minimum.accumulate(ended, axis=1)[:, :size]
    both = np.where(ended < np.iinfo(np.int64).max, (ended >> _PLACE) + cost, np.iinfo(np.int64).max)
    second = both.argmin(1)
    return ended[np.arange(len(cost)), second] & ((1 << _PLACE) - 1), second


#: How a list entry is met: by words as long, or by shorter ones from before or from behind the inserted character.
_SAME, _BEFORE, _BEHIND = 1, 2, 3


def _key(gram, place, size, how):
    x = gram.view(np.uint64) + np.asarray(place).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return signed(mix(mix(x) + np.asarray(size).astype(np.uint64) * np.uint64(4) + np.uint64(how)))


def near_words(words: DataFrame, places: int, most: int = DICTIONARY, longest: int = LONGEST) -> DataFrame:
    """(a, na, b, nb): each pair of distinct words (word, n) one edit apart, once, the shorter (or smaller) first."""
    grams, counts, limit = gram_dictionary(words, places, most, longest)

    def entries(probing):
        def run(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                w = _Words(batch.column(0).to_pylist())
                length, cost = decompose(w, grams, counts, limit, longest)
                size, place = w.size[w.word], w.start - w.begin[w.word]
                every = np.arange(len(size))
                if probing:
                    chosen = []
                    for m in np.unique(w.size):
                        own = np.flatnonzero(size == m)
                        lo, hi = two_lists(int(m), length[own].reshape(-1, m), cost[own].reshape(-1, m))
                        first = own.reshape(-1, m)[:, 0]
                        chosen.append((first + lo, first + hi))
                    lo, hi = (np.concatenate(c) for c in zip(*chosen))
                    met = [(lo, place[lo], size[lo], length[lo], _SAME), (hi, place[hi], size[hi], length[hi], _SAME)]
                    met += [(lo, place[lo], size[lo], length[lo], _BEFORE), (hi, place[hi], size[hi], length[hi], _BEHIND)]
                else:
                    # a shorter word has cut its grams at half of its own length
                    short = np.minimum(length, size // 2)
                    met = [(every, place, size, length, _SAME), (every, place, size - 1, short, _BEFORE), (every, place - 1, size - 1, short, _BEHIND)]
                at = np.concatenate([x[0] for x in met])
                key = np.concatenate([_key(w.hashed(i, n), p, s, how) for i, p, s, n, how in met])
                row = pa.array(w.word[at])
                yield pa.RecordBatch.from_arrays([pa.array(key), batch.column(0).take(row), batch.column(1).take(row), pa.array(signed(w.mask)[w.word[at]])], names=["key", "word", "n", "mask"])

        return run

    width = 2 * shuffle_width(words.sparkSession)
    # few words are few files; their lists are many times as large
    dealt = words.select("word", "n").repartition(width)
    shape = "key long, word string, n long, mask long"
    ask = dealt.mapInArrow(in_task(entries(True)), shape).toDF("key", "a", "na", "mask_a")
    lists = dealt.mapInArrow(in_task(entries(False)), shape).toDF("key", "b", "nb", "mask_b")
    alike = (F.bit_count(F.col("mask_a").bitwiseXOR(F.col("mask_b"))) <= 2) & (F.levenshtein("a", "b", 1) == 1)
    met = ask.hint("shuffle_merge").join(lists, (ask["key"] == lists["key"]) & alike)
    swap = (F.char_length("a") == F.char_length("b")) & (F.col("a") > F.col("b"))
    pick = lambda x, y, name: F.when(swap, F.col(y)).otherwise(F.col(x)).alias(name)
    pairs = met.select(pick("a", "b", "a"), pick("na", "nb", "na"), pick("b", "a", "b"), pick("nb", "na", "nb"))
    return pairs.distinct()


def variants(words: DataFrame, most: int = DICTIONARY, longest: int = LONGEST) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every row of (word, n), whose words are distinct.

    A form stands at least twice as often as its word, so chains have no circle and their ends are
    reached by doubling: as many rounds as the logarithm of the longest chain.
    """
    spark = words.sparkSession
    words = save(spark, words.select("word", "n"), "words")
    places = words.agg(F.sum(F.char_length("word"))).first()[0] or 0
    pairs = save(spark, near_words(words, places, most, longest), "near")
    both = pairs.select("a", "na", "b", "nb").union(pairs.select("b", "nb", "a", "na"))
    # the near word of largest n, the smallest of those that tie
    best = F.min(F.struct((-F.col("nb")).alias("n"), F.col("b").alias("word")))
    found = both.groupBy(F.col("a").alias("word"), F.col("na").alias("n")).agg(F.count("*").alias("n_near"), best.alias("best"))
    formed = -F.col("best.n") >= 2 * F.col("n")
    found = save(spark, found.select("word", "n_near", F.when(formed, F.col("best.word")).alias("form"), F.when(formed, -F.col("best.n")).alias("form_n")), "forms")
    ends = save(spark, found.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    moved = not ends.isEmpty()
    while moved:
        onward = ends.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        nxt = save(spark, ends.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")), "roots")
        discard(ends)
        moved = not nxt.where("moved").isEmpty()
        ends = nxt
    out = words.join(found, "word", "left").join(ends.select("word", "root"), "word", "left")
    out = save(spark, out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"), "variants")
    discard(words, pairs, found, ends)
    return out


def op11_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(count_words(table(spark, sf_dir, "documents")))
