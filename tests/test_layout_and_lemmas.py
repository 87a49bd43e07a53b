"""Laid out tables need no exchange; lemmas equal the rules one by one."""

from __future__ import annotations

import random

from lectern.operators.lemmas import EXCEPTIONS, RULES, lemmas
from lectern.plans.library_queries import newest, owner_tables

SF = "/root/testdata/sf0.001"


def test_queries_by_owner_move_no_row(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        notes, owners = owner_tables(spark, SF, 4)
        plan = newest(notes, owners, 3)._jdf.queryExecution().executedPlan().toString()
        grouped = notes.groupBy("owner").count()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert "Exchange" not in plan and "SortMergeJoin" in plan and "Window" in plan
    assert "Exchange" not in grouped
    assert notes.count() == spark.read.parquet(f"{SF}/orders.parquet").count()


def test_lemmas(spark):
    r = random.Random(9)
    rules = [("s", "", 3), ("es", "e", 2), ("ies", "y", 2), ("ing", "", 3), ("ing", "e", 5), ("ёнок", "ята", 1)]
    odd = {"was": "be", "sing": "sing", "жи": "жить"}
    words = ["", "s", "es", "котёнок", "ёнок", "жи", "was", "sing", "flies", "dies", "making", "sitting", None] + ["".join(r.choices("ieshng", k=r.randint(1, 8))) for _ in range(300)]

    def plain(w):
        if w in odd:
            return odd[w]
        fits = [(-len(s), e, s) for s, e, n in rules if w.endswith(s) and len(w) - len(s) >= n]
        return w[: len(w) + min(fits)[0]] + min(fits)[1] if fits else w

    got = lemmas(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame(rules, RULES), spark.createDataFrame(list(odd.items()), EXCEPTIONS)).collect()
    assert {(x.word, x.lemma) for x in got} == {(w, plain(w)) for w in words if w is not None} and len(got) == len(set(words)) - 1
    none = lemmas(spark.createDataFrame([("dogs",)], "word string"), spark.createDataFrame([], RULES), spark.createDataFrame([], EXCEPTIONS))
    assert [tuple(x) for x in none.collect()] == [("dogs", "dogs")]
