"""Connected components of a graph whose links never meet in one place."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relfeat.llm.common import materialize

_PAIR = pa.schema([("u", pa.int64()), ("v", pa.int64())])
#: Nodes whose links one task contracts at a time.
_HELD = 200_000
#: Links up to which one task joins them all: it then holds at most two nodes a link.
FEW_LINKS = 90_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace links by fewer that join the same nodes: each node to the least of those it is joined to here."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def stars() -> pa.RecordBatch:
        links = [(x, find(x)) for x in list(parent)]
        links = [(x, r) for x, r in links if x != r]
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([r for _, r in links], pa.int64())], schema=_PAIR)

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            a, b = find(u), find(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) >= _HELD:
            yield stars()
    if parent:
        yield stars()


def _least(links: DataFrame, spark: SparkSession) -> DataFrame:
    """Of each u the least v. Written, so that the join with the links has two plain inputs, whose large partitions Spark splits."""
    return materialize(links.groupBy("u").agg(F.min("v").alias("least")), spark)


def components(links: DataFrame, spark: SparkSession) -> DataFrame:
    """(node, component) of every node of the links (u, v): component is the least node that it is joined to.

    Each task first contracts its own links. If few are left, one task joins them; else large-star and small-star steps
    alternate, whose rounds grow in number as the logarithm of the longest chain. Links of a node with itself and repeated
    links change nothing; no links give an empty result.
    """
    links = materialize(links.select("u", "v").where("u <> v").mapInArrow(_contract, "u long, v long").distinct(), spark)
    seen, few = None, links.count() <= FEW_LINKS
    if few:
        links = materialize(links.repartition(1).mapInArrow(_contract, "u long, v long"), spark)
    while not few:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both, spark).withColumn("least", F.least("least", "u"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()
        large = materialize(large, spark)  # every u is above its v
        least = _least(large, spark)
        small = large.join(least, "u").where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
        links = materialize(small.unionByName(least.withColumnRenamed("least", "v")).distinct(), spark)
        now = links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if now == seen:
            break
        seen = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
