"""Documents as whole rows: the same results as over rows of words, and nothing shuffled on the way."""

from __future__ import annotations

import contextlib
import io
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_oracle import rows

from lectern import registry
from lectern.operators import lecture as L
from lectern.operators import whole as W
from lectern.operators.sequence import pack_windows
from lectern.plans import lecture_queries as plans

WORDS = "alpha beta gamma delta epsilon internationalisation zeta eta theta iota kappa lambda".split()


@pytest.fixture(scope="module")
def folder(tmp_path_factory, spark):
    r = random.Random(5)
    text = lambda n: ". ".join(" ".join(r.choices(WORDS, k=r.randint(1, 14))) for _ in range(n))
    docs = [(k, text(n)) for k, n in enumerate([1, 2, 3, 40, 90])] + [(5, None), (6, ""), (7, "The. And."), (8, "итак alpha beta. Теперь, alpha")]
    path = tmp_path_factory.mktemp("whole")
    spark.createDataFrame(docs, "doc_id long, text string").repartition(8).write.parquet(f"{path}/documents.parquet")
    return str(path)


def plan_of(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def same_as_sql(spark, folder, key):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    got, want = registry.queries()[key](spark, folder), con.sql(registry.oracle_sql()[key])
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


SUMMARIES = ["txt_text_rank", "txt_rouge_matrix", "txt_rouge_l", "txt_frequency_summary"]


LECTURES = ["seq_refined_segments", "seq_recursive_split", "seq_segments", "jn_frames_to_segments", "win_window_boundaries", "seq_rough_segments"]


@pytest.mark.parametrize("key", SUMMARIES + LECTURES)
def test_nothing_is_shuffled(spark, folder, key):
    """Each of these wrote words or pairs of sentences many times the size of the texts; a scan of enough partitions now goes straight through."""
    df = registry.queries()[key](spark, folder)
    assert "hashpartitioning" not in plan_of(df) and "SinglePartition" not in plan_of(df)
    if key in registry.oracle_sql():
        same_as_sql(spark, folder, key)


def test_long_documents_rank_the_same_by_stretches(monkeypatch):
    r = random.Random(3)
    tokens = [[r.randrange(30) for _ in range(r.randint(0, 9))] for _ in range(50)]
    codes = W.Codes()
    doc = W.Document(1, ["x"] * 50, codes, [[codes[f"w{t}"] for t in ts] for ts in tokens])
    text, lex = W.text_ranks(doc), W.lex_ranks(doc)
    monkeypatch.setattr(W, "KEPT", 0)
    monkeypatch.setattr(W, "STRETCH", 120)
    assert np.allclose(W.text_ranks(doc), text, atol=2e-6) and np.allclose(W.lex_ranks(doc), lex, atol=2e-6)


def test_a_lecture_as_a_whole_row_equals_rows(spark, folder):
    """Plans, splits, segments, refinement and frames against the operators over rows."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id IN (1, 3, 4, 8)")
    items = plans.lecture_items(spark, folder).join(docs.select("doc_id"), "doc_id", "left_semi").persist()
    windows = pack_windows(items, with_text=True).persist()
    plan = L.fallback_plan(items).persist()
    split = L.classify(items, windows.select("doc_id", "first"), plan).persist()
    rough = L.rough_segments(items, windows).persist()
    frames = items.select("doc_id", F.col("i").alias("frame"), F.col("a").alias("t"), "text")
    later = lambda bounds: bounds.select("doc_id", "seg", (F.col("time") + 20).alias("chosen"))
    want = {
        "seq_recursive_split": split,
        "seq_segments": L.build_segments(items, split, plan),
        "seq_rough_segments": rough,
        "seq_refined_segments": L.refine_boundaries(items, rough, windows, later),
        "jn_frames_to_segments": L.attach_frames(windows.select("doc_id", F.col("win").alias("seg"), "start", "fin", "text"), frames),
    }
    for key, df in want.items():
        got = registry.queries()[key](spark, folder).where("doc_id IN (1, 3, 4, 8)")
        assert rows(got.columns, got.collect()) == rows(got.columns, df.select(*got.columns).collect()), key
