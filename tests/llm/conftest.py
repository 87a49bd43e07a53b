from __future__ import annotations

import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from texts (or (doc_id, text) pairs); ids count up from 0."""

    def make(texts, lang="en"):
        pairs = [x if isinstance(x, tuple) else (i, x) for i, x in enumerate(texts)]
        return spark.createDataFrame([(i, t, lang, "src", len(t or "")) for i, t in pairs], DOCUMENTS)

    return make


#: Texts that every operator must take: null, empty, blank, very long without a space, ties and repeated rows.
ODD = [None, "", "   ", "\n\n", "x" * 60_000, "é" * 500, "same text here", "same text here", "\x00\x01 null bytes ▁ mark"]


@pytest.fixture(scope="session")
def odd(docs):
    return docs([*ODD, (None, "an id that is null"), (6, "same text here")])
