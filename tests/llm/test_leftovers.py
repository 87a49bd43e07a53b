"""What queries leave in the shared folder: nothing but a result."""

from __future__ import annotations

import os

import pytest

from lectern.llm import common
from lectern.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture
def shared(tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda spark: str(tmp_path))
    return tmp_path


@pytest.mark.parametrize("key", ["op1_line_dedup", "op2_suffix_dedup", "op4_decontamination", "op5_quality", "op8_embedding_dedup", "op10_jaccard_join", "op11_spelling_groups", "op12_hard_negatives", "op13_source_mix"])
def test_one_table_is_left(spark, shared, key):
    assert QUERIES[key](spark, SF).count() >= 0
    assert len(os.listdir(shared)) == 1


def test_a_query_that_fails_leaves_nothing(spark, shared):
    def broken(spark, sf_dir):
        common.save(spark, spark.range(3), "half")
        raise ValueError("no result")

    with pytest.raises(ValueError, match="no result"):
        common.owner(broken)(spark, SF)
    assert os.listdir(shared) == []
