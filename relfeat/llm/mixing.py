"""Sources mixed to target weights by a low-discrepancy schedule.

Slot i of the schedule belongs to the source in whose part of the cumulative targets the golden-ratio point frac(i * phi) falls,
so that every stretch of the schedule holds the sources in their proportions. Slots are ranked per source; the source's
documents, shuffled by a hash and laid end to end, are cut into blocks of equally many words, and the slot of rank r takes
block r. The stream is laid out twice, so a source gives each word at most twice. A source that is small has shorter blocks, so
that its target is some hundreds of them or single words; each source takes as many blocks as its target has, and those few that
the schedule's rounding leaves without a slot come at its end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relfeat.llm.common import materialize, partitions, slices, text_bytes

#: The fractional part of the golden ratio, and of 2**20 times it: i = a * 2**20 + b keeps double precision for large i.
PHI, PHI_20 = (math.sqrt(5) - 1) / 2, math.fmod(2**20 * ((math.sqrt(5) - 1) / 2), 1)
#: Slots whose ranks one step counts together.
_CHUNK = 1 << 16
#: Words of a block, and blocks that a source's target has at least (down to blocks of one word).
BLOCK, LEAST_BLOCKS = 256, 512


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "row", "source")), pa.array([len(t.split()) for t in batch.column("text").to_pylist()], pa.int64())], ["doc_id", "row", "source", "size"])


def targets(sizes: Sequence[int], weights: Sequence[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """What each source gives: share of all sizes by weight, at most `most` times its own size; what a capped source can't give
    the others do, by weight, until none is above its cap."""
    out, left, free = [0.0] * len(sizes), share * sum(sizes), set(range(len(sizes)))
    while free:
        total = sum(weights[i] for i in free)
        full = {i for i in free if left * weights[i] / total >= most * sizes[i]}
        if not full:
            for i in free:
                out[i] = left * weights[i] / total
            break
        for i in full:
            out[i] = most * sizes[i]
        left -= sum(out[i] for i in full)
        free -= full
    return out


def schedule(spark: SparkSession, slots: int, ends: Sequence[float]) -> DataFrame:
    """Rows (slot, s, rank): the source index of each slot and its rank among the source's slots. ends: cumulative targets."""
    bounds = np.array(ends) / ends[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in batch.column("chunk").to_pylist():
                i = np.arange(chunk * _CHUNK, min((chunk + 1) * _CHUNK, slots))
                point = np.mod((i >> 20) * PHI_20 + (i & 0xFFFFF) * PHI, 1.0)
                s = np.minimum(np.searchsorted(bounds, point, "right"), len(bounds) - 1)
                order = np.argsort(s, kind="stable")
                own = np.bincount(s, minlength=len(bounds))
                local = np.empty(len(i), np.int64)
                local[order] = np.arange(len(i)) - np.repeat(np.cumsum(own) - own, own)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), chunk)), pa.array(i), pa.array(s.astype(np.int32)), pa.array(local)], ["chunk", "slot", "s", "local"])

    chunks = math.ceil(slots / _CHUNK)
    drawn = spark.range(chunks).select(F.col("id").alias("chunk")).repartition(min(chunks, partitions(spark))).mapInArrow(run, "chunk long, slot long, s int, local long")
    counts = drawn.groupBy("chunk", "s").agg(F.count("*").alias("n"))
    before = Window.partitionBy("s").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("chunk", "s", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return drawn.join(offsets, ["chunk", "s"]).select("slot", "s", (F.col("before") + F.col("local")).alias("rank"))


def plan_mix(docs: DataFrame, spark: SparkSession, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """The pieces of the mix and the documents without one: doc_id, row (the text's hash), source, size, source_size, target,
    bucket and nth (which name a row within its source), start (the document's place in its source's stream), slot (order in
    the mix, null without a piece), words (of the piece).

    Sources in code point order, null last, weigh `weights` in turn. A document's size is its number of words parted by ASCII
    white space; null and empty texts have none. Rows of one doc_id are documents of their own. Other columns are not carried.
    An empty table, or one without any word, gives targets of 0. The same input and seed give the same mix.
    One row a source comes to the driver.
    """
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("row"), "source", text_bytes())
    rows = materialize(rows.mapInArrow(_sizes, "doc_id long, row long, source string, size long"), spark)
    found = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")).collect()
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["source_size"] for r in found]
    goals = targets(sizes, [weights[i % len(weights)] for i in range(len(found))], share, most)
    blocks = [max(1, min(BLOCK, int(g // LEAST_BLOCKS))) for g in goals]
    slots = [round(g / b) for g, b in zip(goals, blocks, strict=True)]
    ends = np.cumsum(slots).tolist()
    total = sum(slots)
    names = spark.createDataFrame([(r["source"], i, z, g, b, n, e - n) for i, (r, z, g, b, n, e) in enumerate(zip(found, sizes, goals, blocks, slots, ends, strict=True))], "name string, s int, source_size long, target double, block long, slots long, slots_before long")
    rows = rows.join(names, rows["source"].eqNullSafe(names["name"])).drop("name")

    # Places in the shuffled stream: sums within buckets of about sqrt(n) documents, then over a source's buckets.
    buckets = math.isqrt(sum(r["n"] for r in found)) + 1
    rows = rows.withColumn("key", F.xxhash64(F.lit(seed), "doc_id", "row")).withColumn("bucket", F.pmod("key", F.lit(buckets)))
    inside = Window.partitionBy("s", "bucket").orderBy("key", "doc_id", "row")
    # (source, bucket, nth) names a row, even among rows that are alike.
    rows = rows.withColumn("nth", F.row_number().over(inside)).withColumn("within", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    sums = rows.groupBy("s", "bucket").agg(F.sum("size").alias("sum"))
    over = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("s", "bucket", F.coalesce(F.sum("sum").over(over), F.lit(0).cast("long")).alias("before"))
    rows = rows.join(sums, ["s", "bucket"]).withColumn("start", F.col("before") + F.col("within")).drop("key", "before", "within")
    if not total:
        return rows.drop("s", "block", "slots", "slots_before").withColumns({"slot": F.lit(None).cast("long"), "words": F.lit(0).cast("long")})

    first = lambda lo: F.expr(f"({lo}) div block")
    rows = rows.withColumn("lap", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("lo", F.col("start") + F.col("lap") * F.col("source_size"))
    pieces = rows.withColumn("rank", F.explode_outer(F.when(F.col("size") > 0, F.sequence(first("lo"), first("lo + size - 1")))))
    low, high = F.col("rank") * F.col("block"), (F.col("rank") + 1) * F.col("block")
    pieces = pieces.withColumn("words", F.when(F.col("rank") < F.col("slots"), F.least(F.col("lo") + F.col("size"), high) - F.greatest("lo", low)).otherwise(0).cast("long"))
    # The schedule grows with the corpus, so it is never broadcast.
    met = pieces.join(schedule(spark, total, ends).hint("merge"), ["s", "rank"], "left")
    order = F.when(F.col("rank") < F.col("slots"), F.coalesce("slot", F.lit(total) + F.col("slots_before") + F.col("rank")))
    return met.select("doc_id", "row", "source", "size", "source_size", "target", "bucket", "nth", "start", order.alias("slot"), "words")


def mix_sources(docs: DataFrame, spark: SparkSession, **options: object) -> DataFrame:
    """Every row of docs with what the mix takes of it: doc_id, row, source, size, source_size, target, taken. See plan_mix."""
    row = ["doc_id", "row", "source", "size", "source_size", "target", "bucket", "nth"]
    return plan_mix(docs, spark, **options).groupBy(*row).agg(F.sum("words").alias("taken")).drop("bucket", "nth")


def op2_mixing(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return mix_sources(docs, spark).select("doc_id", "size", "source_size", "target", "taken")
