"""Order-dependent operators against plain versions, and their edge cases."""

from __future__ import annotations

import itertools
import math
import random

from pyspark.sql import functions as F

from lectern.functions import maths as M
from lectern.functions import text as T
from lectern.operators.intervals import nearest_in_time, within_intervals
from lectern.operators.ranking import pagerank
from lectern.operators.sequence import best_path, decode_labels, merge_rows, merge_short, pack_windows
from lectern.plans.frame_queries import greedy_dedup, online_segments


def all_paths(probs):
    """The best score over all allowed label sequences."""
    n, k = len(probs), len(probs[0])
    best = -math.inf
    for path in itertools.product(range(k), repeat=n):
        if any(b - a not in (0, 1) for a, b in itertools.pairwise(path)) or n >= k and (path[0] != 0 or path[-1] != k - 1):
            continue
        s = sum(math.log(max(probs[i][j], 1e-9)) for i, j in enumerate(path)) + sum(0.08 if a == b else -0.02 for a, b in itertools.pairwise(path))
        best = max(best, s - (0 if n >= k else 0.4 * path[0]))
    return best


def score(path, probs):
    n, k = len(probs), len(probs[0])
    s = sum(math.log(max(probs[i][j], 1e-9)) for i, j in enumerate(path)) + sum(0.08 if a == b else -0.02 for a, b in itertools.pairwise(path))
    return s - (0 if n >= k else 0.4 * path[0])


def test_best_path_is_the_best_of_all():
    r = random.Random(3)
    for _ in range(60):
        n, k = r.randint(1, 6), r.randint(2, 4)
        probs = [[r.random() for _ in range(k)] for _ in range(n)]
        path = best_path(probs)
        assert all(b - a in (0, 1) for a, b in itertools.pairwise(path))
        assert math.isclose(score(path, probs), all_paths(probs), abs_tol=1e-9)
    assert best_path([[0.3]] * 4) == [0] * 4


def test_decode_labels(spark):
    rows = [(d, w, [0.1 + 0.1 * ((d + w + k) % 5) for k in range(3)]) for d in range(3) for w in range(5)]
    got = {(x.doc_id, x.win): x.label for x in decode_labels(spark.createDataFrame(rows, "doc_id long, win long, probs array<double>"), 3).collect()}
    for d in range(3):
        assert [got[d, w] for w in range(5)] == best_path([p for x, _, p in rows if x == d])


def test_pack_windows(spark):
    r = random.Random(5)
    rows, want = [], []
    for d in range(4):
        t, items = 0.0, []
        for i in range(r.randint(1, 40)):
            n = r.randint(1, 500)
            items.append((d, i, n, t, t + n / 15))
            t += n / 15
        rows += items
        win, start, size, begin = 1, None, 0, 0
        for _, i, n, a, b in items:
            start = a if start is None else start
            size = n if size == 0 else size + 1 + n
            if (b - start >= 20 and size >= 350) or b - start >= 55 or size >= 1400 or i == len(items) - 1:
                want.append((d, win, begin, i))
                win, start, size, begin = win + 1, None, 0, i + 1
    got = pack_windows(spark.createDataFrame(rows, "doc_id long, i long, n long, a double, b double")).select("doc_id", "win", "first", "last").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_merge_short(spark):
    rows = [{"first": i, "last": i, "start": s, "fin": e, "text": t} for i, (s, e, t) in enumerate([(0, 10, "alpha beta"), (10, 60, "alpha beta"), (60, 70, "gamma delta"), (70, 130, "gamma delta")])]
    out = merge_rows(rows, 30)
    assert [(x["first"], x["last"]) for x in out] == [(0, 1), (2, 3)]
    df = spark.createDataFrame([(7, i + 1, r["first"], r["last"], float(r["start"]), float(r["fin"]), r["text"]) for i, r in enumerate(rows)], "doc_id long, win long, first long, last long, start double, fin double, text string")
    assert [tuple(x) for x in merge_short(df, 30).orderBy("seg").collect()] == [(7, 1, 0, 1), (7, 2, 2, 3)]
    assert merge_rows(rows[:1], 30) == rows[:1]


def test_greedy_dedup_keeps_a_chain_apart(spark):
    bits = lambda n: f"{(1 << n) - 1:016x}"
    rows = [(1, 0, 10, bits(0)), (1, 1, 11, bits(6)), (1, 2, 12, bits(7)), (1, 3, 13, bits(12))]
    got = greedy_dedup(spark.createDataFrame(rows, "video long, seg long, event_id long, phash string"), ["video"], 6)
    assert [x.event_id for x in got.orderBy("seg").collect()] == [10, 12]


def test_intervals_and_neighbours(spark):
    spans = spark.createDataFrame([(1, 0, 0.0, 5.0), (1, 1, 10.0, 20.0)], "video long, seg long, a double, b double")
    points = spark.createDataFrame([(1, 1, 0.0), (1, 2, 5.0), (1, 3, 7.5), (1, 4, 7.6), (1, 5, 20.0), (1, 6, 99.0), (1, 7, -3.0), (2, 8, 1.0)], "video long, event_id long, t double")
    assert {x.event_id: x.seg for x in within_intervals(points, spans).collect()} == {1: 0, 2: 0, 3: 0, 4: 1, 5: 1, 6: 1, 7: 0, 8: None}
    rows = spark.createDataFrame([(1, k, t, k) for k, t in enumerate([0.0, 0.0, 4.0, 6.0, 8.0])], "video long, event_id long, t double, idx long")
    assert {x.event_id: x.idx for x in nearest_in_time(rows, rows).collect()} == {0: 1, 1: 0, 2: 3, 3: 2, 4: 3}


def test_pagerank_against_plain_iteration(spark):
    edges = [(1, 2, 1.0), (2, 1, 1.0), (2, 3, 2.0), (3, 2, 2.0), (3, 4, 1.0), (4, 3, 1.0)]
    rank = {n: 0.25 for n in range(1, 5)}
    out = {s: sum(w for a, _, w in edges if a == s) for s in rank}
    for _ in range(12):
        rank = {n: 0.15 / 4 + 0.85 * sum(rank[a] * w / out[a] for a, b, w in edges if b == n) for n in rank}
    got = {x.node: x.rank for x in pagerank(spark.createDataFrame(edges, "src long, dst long, weight double")).collect()}
    assert all(math.isclose(got[n], rank[n], rel_tol=1e-9) for n in rank)


def test_text_functions(spark):
    one = lambda f, *v: spark.createDataFrame([(x,) for x in v], "s string").select(f(F.col("s")).alias("r")).collect()
    got = lambda f, *v: [x.r for x in one(f, *v)]
    assert got(T.clean_text, None, "  ", "a  b\r\n\r\n\r\nc") == ["", "", "a b\n\nc"]
    assert got(T.binary_label, "1", "0", "1.0", "1,0", "да", "FALSE", " tp ", "2", "", None) == [1, 0, 1, 1, 1, 0, 1, None, None, None]
    assert got(lambda c: T.truncate(c, 5), "abcde", "abc def") == ["abcde", "abc …"]
    assert got(T.tokens, "The Ёлка C++ and x") == [["елка", "c++"]]
    assert got(T.safe_stem, "a/b: c. ", "con", "") == ["a_b_ c", "con_file", "file"]
    stamps = spark.createDataFrame([(0.5,), (1.5,), (3599.5,), (-2.0,)], "s double").select(T.format_ts(F.col("s")).alias("r"))
    assert [x.r for x in stamps.collect()] == ["00:00", "00:02", "01:00:00", "00:00"]


def test_math_functions(spark):
    row = spark.range(1).select(
        M.iou(*[F.lit(float(x)) for x in (0, 0, 2, 2, 1, 1, 2, 2)]).alias("iou"),
        M.iou(*[F.lit(0.0)] * 8).alias("none"),
        M.polygon_area(F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (4, 3), (0, 3))])).alias("area"),
        M.hamming64(F.lit("ffffffffffffffff"), F.lit("0" * 16)).alias("bits"),
        M.frame_limit(F.lit(300.0), F.lit(4)).alias("limit"),
        M.section_count(F.lit(450.0)).alias("sections"),
    ).first()
    assert math.isclose(row.iou, 1 / 7) and row.none == 0 and row.area == 12 and row.bits == 64 and row.limit == 2 and row.sections == 3


def test_streaming_sessions_equal_the_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = online_segments(stream).writeStream.format("memory").queryName("sessions").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    batch = {(r.user_id, r.session_window.start): r.n for r in online_segments(events).collect()}
    live = {(r.user_id, r.session_window.start): r.n for r in spark.table("sessions").collect()}
    assert live and live.items() <= batch.items()
