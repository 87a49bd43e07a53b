"""SentencePiece coding: exact round trips and shortest paths; the pipeline: each stage's decisions take effect."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.llm import pieces
from lectern.llm.common import text_bytes

ODD_LONG, ODD_MARK = "x" * 60_000, "\x00\x01 null bytes ▁ mark"


@pytest.fixture(scope="module")
def model():
    return pieces.compile_model()


def cheapest(t, body: bytes):
    """Least cost of any way through the bytes, by plain dynamic programming."""
    cost = {}
    for k, i in enumerate(t.ids):
        cost[t.data[t.offsets[i] : t.offsets[i + 1]].tobytes()] = t.costs[k]
    best = [0.0] + [float("inf")] * len(body)
    for e in range(1, len(body) + 1):
        best[e] = best[e - 1] + pieces.FALLBACK
        for s in range(max(0, e - int(t.lengths.max())), e):
            if body[s:e] in cost:
                best[e] = min(best[e], best[s] + cost[body[s:e]])
    return best[-1]


def test_paths_are_shortest_and_round_trip(model):
    texts = ["Hello  world\n a\t🙂x", " x", "▁a b", "   ", "a" * 50, "naïve ﬁ ① é ", "", None, "The quick brown fox."]
    data, offsets = text_bytes(pa.array(texts))
    ids, at = pieces.encode_bytes(model, data, offsets)
    back, ends = pieces.decode_bytes(model, ids, at)
    price = dict(zip(model.ids.tolist(), model.costs.tolist()))
    for k, t in enumerate(texts):
        assert bytes(back[ends[k] : ends[k + 1]]).decode() == (t or "")
        if t:
            body = b"\xff" + t.encode().replace(b" ", b"\xff")
            got = sum(price.get(int(i), pieces.FALLBACK) for i in ids[at[k] : at[k + 1]])
            assert np.isclose(got, cheapest(model, body), rtol=1e-12)


def test_encode_and_decode_frames(odd):
    encoded = pieces.encode(odd)
    assert encoded.where("NOT round_trip").count() == 0
    texts = {r.doc_id: r.text for r in pieces.decode(encoded.where("doc_id IS NOT NULL")).collect()}
    assert texts[0] is None and texts[1] == "" and texts[4] == ODD_LONG and texts[8] == ODD_MARK


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for k, (name, stage) in enumerate(p.STAGES):
        out = p.save(spark, stage(spark, docs, sf), f"stage{k}")
        m = out.count()
        assert 0 < m <= n
        if k < len(p.STAGES) - 1:
            assert out.columns == columns, name
        docs, n = out, m
    assert docs.where("NOT round_trip").count() == 0


def test_pipeline_catches_and_keeps(spark, docs):
    import corpus_pipeline as p

    clean = " ".join(f"clean{k} word{k}" for k in range(60))
    near = clean.replace("clean59", "other59")
    d = docs([clean, near, clean, "something quite different " * 3])
    kept = {r.doc_id for r in p.near_duplicates(spark, d, "").collect()}
    assert kept == {0, 3}
    lines = docs(["a line of more than thirty bytes\nown line one", "a line of more than thirty bytes\nown line two", "a line of more than thirty bytes"])
    out = {r.doc_id: r.text for r in p.lines(spark, lines, "").collect()}
    assert out == {0: "a line of more than thirty bytes\nown line one", 1: "own line two"}
    assert p.encoded(spark, d, "").where(F.col("n_ids") == 0).count() == 0


def test_pipeline_drops_copies_with_short_lines(spark, docs):
    import corpus_pipeline as p

    first, second = "a first line of more than thirty bytes", "a second line of more than thirty bytes"
    texts = [f"{first}\nLes.\n\n{second}\nFin", f"{second} too, and more of it\nElse"]
    texts += [texts[0], f"{first}s\nFin\nLes.", f"{first}\nOwn.", f"{first}\nElse", "Les.\nFin", f"{first}\n\n", None, ""]
    d = docs(texts).union(docs([(None, texts[0])]))
    kept = sorted(-1 if r.doc_id is None else r.doc_id for r in p.lines(spark, d, "").collect())
    # 2 and 7 are copies, 3 a near copy; 4 and 5 have a short line that the keeper of their long one lacks; 6 lost nothing
    assert kept == [-1, 0, 1, 4, 5, 6, 8, 9]
