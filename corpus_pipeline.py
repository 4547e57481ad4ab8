"""Corpus preparation as a chain of stages, each written as Parquet and read again as the next one's documents.

Every stage but the last returns the columns of its documents. Rows that share a doc_id and a text share their fate; a null
doc_id is a document like others, a null text an empty one. Empty tables pass through.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relfeat.llm.common import BATCH_BYTES, BATCH_SETTING, materialize, table
from relfeat.llm.decontaminate import benchmark_hits, contaminated
from relfeat.llm.jaccard import similar_documents
from relfeat.llm.mixing import mix_sources
from relfeat.llm.token_files import op7_token_files
from relfeat.llm.toxicity import held_out, reject_toxic, train


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _bounded(stage: Stage) -> Stage:
    """The stage, with Python getting some MB of documents at a time. Its result is lazy, so the setting stays with the session."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc, key, row): each row of docs as one column, whatever names its columns have; its doc_id and its text's hash."""
    return docs.select(F.struct("*").alias("doc"), F.col("doc_id").alias("key"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("row"))


@_bounded
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go. It learns from the labels that its own query learns from."""
    labels = table(spark, sf_dir, "labels").where(~held_out())
    return reject_toxic(docs, train(docs, labels, spark), spark)


@_bounded
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links join, the one with the least doc_id stays. Documents without words all stay."""
    alike = similar_documents(docs, spark)
    gone = alike.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("gone")).distinct()
    rows = _keyed(docs)
    return rows.join(gone, rows["key"].eqNullSafe(gone["gone"]), "left_anti").select("doc.*")


@_bounded
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages cover a twentieth or more go."""
    hits = benchmark_hits(docs, table(spark, sf_dir, "benchmark"), spark)
    gone = hits.where(contaminated()).select(F.col("doc_id").alias("gone"), F.col("row").alias("gone_row")).distinct()
    rows = _keyed(docs)
    return rows.join(gone, rows["key"].eqNullSafe(gone["gone"]) & (rows["row"] == gone["gone_row"]), "left_anti").select("doc.*")


@_bounded
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes their words: taken / size, 0 to 2 times. Without words: once.

    A share of a copy becomes a whole one or none by the document's hash, with that share as its chance, so that a source's
    words come near its target whichever parts of documents the schedule took.
    """
    plan = mix_sources(docs, spark).groupBy(F.col("doc_id").alias("mixed"), F.col("row").alias("mixed_row")).agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    chance = F.pmod(F.xxhash64(F.lit("mix"), "mixed", "mixed_row"), F.lit(1 << 30)) / float(1 << 30)
    plan = plan.select("mixed", "mixed_row", F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + chance)).otherwise(1).cast("int").alias("times"))
    rows = _keyed(docs)
    met = rows.join(plan.hint("shuffle_hash"), rows["key"].eqNullSafe(plan["mixed"]) & (rows["row"] == plan["mixed_row"]))
    return met.select("doc", F.explode(F.array_repeat(F.lit(1), F.col("times")))).select("doc.*")


@_bounded
def write_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents, read back: one row a document."""
    return op7_token_files(spark, docs)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_copies), ("decontamination", drop_contaminated), ("mixing", mix), ("token_files", write_ids)]
#: The stages learn a model, follow a schedule and write token files; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), spark)
    return docs
