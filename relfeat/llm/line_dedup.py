"""Lines that many documents share are kept in one document only.

The lines' hashes are range-partitioned with a secondary sort by document and position; each hash's rows stream past in
that order and give first occurrences. What comes back to the documents is a sparse keep bitmap, never text.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relfeat.llm.common import ascii_lower, materialize, partitions

#: U+0020 and U+0009 to U+000D.
_TRIM = " \t\n\x0b\x0c\r"
#: Bits of one word of a bitmap; the sign bit stays free.
_BITS = 63


def dedup_lines(docs: DataFrame, spark: SparkSession, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Every row of docs with n_lines, n_dropped and kept_text.

    A line's key is the line stripped of ASCII white space with A-Z lower-cased. Keys of min_chars code points or more
    found in min_docs documents or more lose all their lines but those of the largest doc_id holding the key.

    Null text: as an empty one, which is one empty line. Null doc_id: counts as one document, smaller than all others.
    Rows that share a doc_id are one document where documents are counted or kept; each row is returned. Other columns of
    docs, whatever their names, are not carried. An empty table gives an empty result. Line order is kept.
    """
    base = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    keyed = base.select("doc_id", F.xxhash64("text").alias("row"), F.posexplode(F.split(ascii_lower(F.col("text")), "\n", -1)).alias("pos", "line"))
    key = F.btrim(F.col("line"), F.lit(_TRIM))
    lines = keyed.select("doc_id", "row", "pos", key.alias("key")).where(F.length("key") >= min_chars)
    # 128 bits stand for a key; the second hash starts from another seed. Rows alike in all columns need one entry.
    lines = materialize(lines.select("doc_id", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")), spark)

    # A very common line's rows are salted by document into blocks, so that no task gets them all.
    blocks = 4 * partitions(spark)
    ranges = ["h1", "h2", "block"]
    dealt = lines.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks))).repartitionByRange(partitions(spark), *ranges)
    stream = Window.partitionBy(*ranges).orderBy(F.desc_nulls_last("doc_id"), "pos")
    place = F.row_number().over(stream)
    new_doc = (place == 1) | ~F.lag("doc_id").over(stream).eqNullSafe(F.col("doc_id"))
    firsts = dealt.select(*ranges, "doc_id", new_doc.alias("first")).where("first")
    common = firsts.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs)
    common = materialize(common.select("h1", "h2", "keeper"), spark)

    dropped = lines.join(common, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    # Rows that are alike in doc_id and text give the same bits, so or-ing them is idempotent.
    words = dropped.groupBy("doc_id", "row", (F.col("pos") / _BITS).cast("int").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, pos % {_BITS})")).alias("bits"))
    bitmaps = words.groupBy("doc_id", "row").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("drop_bits"))
    bitmaps = bitmaps.select(F.col("doc_id").alias("b_doc"), F.col("row").alias("b_row"), "drop_bits")

    left = base.withColumn("row", F.xxhash64("text"))
    both = left.join(bitmaps.hint("shuffle_hash"), left["doc_id"].eqNullSafe(bitmaps["b_doc"]) & (left["row"] == bitmaps["b_row"]), "left")
    split = F.split("text", "\n", -1)
    bit = lambda i: F.coalesce(F.getbit(F.element_at("drop_bits", (i / _BITS).cast("int")), (i % _BITS).cast("int")), F.lit(0).cast("byte"))
    kept = F.when(F.col("drop_bits").isNull(), F.col("text")).otherwise(F.array_join(F.filter(split, lambda x, i: bit(i) == 0), "\n"))
    n_dropped = F.coalesce(F.aggregate(F.map_values("drop_bits"), F.lit(0).cast("long"), lambda n, b: n + F.bit_count(b)), F.lit(0).cast("long"))
    return both.select("doc_id", F.size(split).cast("long").alias("n_lines"), n_dropped.alias("n_dropped"), kept.alias("kept_text"))


def op1_line_dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return dedup_lines(docs, spark).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
