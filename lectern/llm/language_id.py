"""Language ID by rank-order profiles of byte n-grams of words.

A profile lists the PROFILE most frequent n-grams (n = 1, 2, 3 over letters with
word boundaries), most frequent first. A document's profile is held against each
language's: an n-gram costs the distance of its two ranks, one that the language
lacks costs PROFILE. The language with the least sum wins, the first by name on
ties; the score is how far the next one lies behind, relative to it.

Profiles are counted over all learning documents. Only letters count (Unicode's, of any script): A-Z in lower
case and the bytes of every other letter, in 7-bit symbols; all other characters, punctuation and digits of any script
and signs included, bound words.

A task holds the counts of the n-grams that it has met, and of the profiles just the
n-grams they list: memory follows the languages' profiles, not the space of codes.

Nulls: a null text, or one without a letter, is `und` with score 0. Rows with a null
language or id teach nothing. Without any learning text all documents are `und`.
Repeated rows are predicted each for itself; other columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.common import held_out, in_task, slices, table, text_bytes

PROFILE = 300
_SLICE = 500_000
#: Counted n-grams that wait in a task before they are summed into what it holds.
_PENDING = 400_000
#: 0 bounds words; 1-26 letters; 27-127 the bytes from 0x80 on, folded.
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[65:91] = _SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[128:] = 27 + np.arange(128) % 101
_CODE_BITS = 23  # two bits for n, 21 for three symbols


def letters(text: str = "text"):
    """A text's letters, with a space for each run of anything else."""
    return F.regexp_replace(text, r"[^\p{L}]+", " ").alias("text")


def ngram_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, count) of the distinct n-grams of every row."""
    rows = len(offsets) - 1
    # a boundary in front of each row, so that no n-gram crosses rows; runs of boundaries are one
    sizes = np.diff(offsets)
    body = np.zeros(len(data) + rows + 1, np.int64)
    row = np.repeat(np.arange(rows), sizes)
    body[np.arange(len(data)) + row + 1] = _SYMBOL[data]
    owner = np.append(np.repeat(np.arange(rows), sizes + 1), rows - 1)
    keep = np.ones(len(body), bool)
    keep[1:] = (body[1:] != 0) | (body[:-1] != 0)
    keep[offsets[:-1] + np.arange(rows)] = True
    s, owner = body[keep], owner[keep]
    code1 = s[s > 0] | (1 << 21)
    keys = [(owner[s > 0] << _CODE_BITS) | code1]
    two = (s[:-1] << 7) | s[1:]
    ok = two > 0
    # the boundary behind a row's last letter stands in front of the next row
    keys.append((np.where(s[1:] > 0, owner[1:], owner[:-1])[ok] << _CODE_BITS) | two[ok] | (2 << 21))
    three = (two[:-1] << 7) | s[2:]
    ok = s[1:-1] > 0
    keys.append((owner[1:-1][ok] << _CODE_BITS) | three[ok] | (3 << 21))
    keys = np.sort(np.concatenate(keys))
    if not len(keys):
        z = np.zeros(0, np.int64)
        return z, z, z
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at] >> _CODE_BITS, keys[at] & ((1 << _CODE_BITS) - 1), np.diff(np.append(at, len(keys)))


def top_ranks(row: np.ndarray, code: np.ndarray, count: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, rank) of each row's k most frequent n-grams; ties by code."""
    most = np.minimum(count, (1 << 20) - 1)
    if len(row) and row[-1] < 1 << 20:
        order = np.argsort((row << 43) | (((1 << 20) - 1 - most) << 23) | code)
    else:
        order = np.lexsort((code, -count, row))
    row, code = row[order], code[order]
    begin = np.searchsorted(row, row)
    rank = np.arange(len(row)) - begin
    ok = rank < k
    return row[ok], code[ok], rank[ok]


def fit(documents: DataFrame, profile: int = PROFILE) -> dict[str, np.ndarray]:
    """Codes of each language's profile by rank, from all rows of (text, lang): one short list a language reaches the driver."""

    def count(batches):
        names: dict[str, int] = {}
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        waiting, total = [], 0

        def settle():
            keys, n = (np.concatenate(c) for c in zip(held, *waiting))
            order = np.argsort(keys)
            keys, n = keys[order], n[order]
            at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
            return keys[at], np.add.reduceat(n, at) if len(at) else n

        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            lang = np.array([names.setdefault(x, len(names)) for x in batch.column(1).to_pylist()], np.int64)
            for i, j in slices(offsets, _SLICE):
                row, code, n = ngram_counts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                waiting.append(((lang[i:j][row] << _CODE_BITS) | code, n))
                total += len(n)
                if total >= _PENDING:
                    held, waiting, total = settle(), [], 0
        keys, n = settle()
        known = np.array(list(names), object)
        yield pa.RecordBatch.from_arrays([pa.array(known[keys >> _CODE_BITS] if len(keys) else [], pa.string()), pa.array(keys & ((1 << _CODE_BITS) - 1)), pa.array(n)], names=["lang", "code", "n"])

    counts = documents.select(letters(), "lang").mapInArrow(in_task(count), "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    # Spark keeps the first rows of each language before the shuffle, so a task gets profile rows from each at most
    first = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))).where(F.col("rank") <= profile)
    out: dict[str, list] = {}
    for r in first.select("lang", "code", "rank").orderBy("lang", "rank").collect():
        out.setdefault(r["lang"], []).append(r["code"])
    return {lang: np.array(codes, np.int64) for lang, codes in out.items()}


def predict(documents: DataFrame, profiles: dict[str, np.ndarray], profile: int = PROFILE) -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    names = sorted(profiles)
    # the n-grams that any profile lists, and each language's rank of them (-1: not listed)
    listed = np.unique(np.concatenate([np.zeros(0, np.int64), *profiles.values()]))
    padded = np.append(listed, -1)
    ranks = np.full((len(names), len(padded)), -1, np.int32)
    for k, name in enumerate(names):
        ranks[k, np.searchsorted(listed, profiles[name])] = np.arange(len(profiles[name]))

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for i, j in slices(offsets, _SLICE):
                n = j - i
                row, code, rank = top_ranks(*ngram_counts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), profile)
                size = np.bincount(row, minlength=n)
                far = np.zeros((len(names), n))
                at = np.searchsorted(listed, code)
                at = np.where(padded[at] == code, at, len(listed))
                for k in range(len(names)):
                    r = ranks[k, at]
                    far[k] = np.bincount(row, np.where(r >= 0, np.abs(r - rank), profile), n)
                label, score = np.full(n, "und", object), np.zeros(n)
                some = np.flatnonzero(size)
                if len(names) and len(some):
                    order = np.sort(far[:, some], axis=0)
                    label[some] = np.array(names, object)[far[:, some].argmin(0)]
                    second = order[1] if len(names) > 1 else size[some] * float(profile)
                    score[some] = np.where(second > 0, 1 - order[0] / np.maximum(second, 1), 0.0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n).cast(pa.int64()), pa.array(label, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return documents.select("doc_id", letters()).mapInArrow(in_task(run), "doc_id long, lang_pred string, score double")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    profiles = fit(documents.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id", 5, 0)))
    return predict(documents, profiles).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "lang_pred", "score")
