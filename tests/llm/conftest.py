"""Small corpora with the awkward cases that every operator must take."""

from __future__ import annotations

import pytest
from samples import SCHEMA, texts

@pytest.fixture(scope="session")
def corpus(spark):
    """Documents in several partitions. doc_id 5 stands twice, alike; one doc_id is null; other columns have clashing names."""
    rows = [(i, t, ["en", None, "de"][i % 3], ["b", "a", None, "é"][i * 7 % 4], None) for i, t in enumerate(texts())]
    rows += [rows[5], (None, rows[12][1], None, "a", 3)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    extra = {n: frame["lang"] for n in ("row", "key", "pos", "hits", "spans", "h1", "size", "start", "gram", "node", "fragment", "chunk", "held_out", "score")}
    return frame.withColumns(extra).cache()


@pytest.fixture(scope="session")
def plain(corpus):
    """The same rows as Python values."""
    return [(r["doc_id"], r["text"] or "", r["source"]) for r in corpus.collect()]


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
