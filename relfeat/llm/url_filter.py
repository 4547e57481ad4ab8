"""URLs judged by host and path rules.

Each URL expands into host-suffix and path-prefix expressions. Expressions and rules meet in an equi-join on a short prefix
of their digests; the whole digest confirms a meeting, and the longest rule wins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relfeat.llm.common import ascii_lower

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Hex digits of a digest that the join compares.
_SHORT = 8


def rules_frame(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Every row of pages (page_id, url) with host, path, rule and verdict.

    The host is what follows the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; the path then goes up to "?",
    "#" or the end. A rule fits its own host and all subdomains if the path starts with the rule's path; the longest
    host + path wins, then the longer host, then "block". Without a fitting rule the verdict is `default`.

    Null urls and urls without "://" have an empty host and path. Repeated rows are judged once and returned as often as
    they came. Rules that repeat count once. Other columns of pages are not carried. Empty tables give an empty result
    (no rules: all get the default). Only path prefixes of a length that some rule has are expanded.
    """
    spark = pages.sparkSession
    rows = pages.groupBy("page_id", "url").agg(F.count("*").alias("n"))
    rest = F.regexp_extract("url", r"(?s)^.*?://(.*)$", 1)
    rows = rows.withColumn("rest", F.coalesce(rest, F.lit("")))
    rows = rows.select("page_id", "url", "n", ascii_lower(F.regexp_extract("rest", r"(?s)^([^/?#]*)", 1)).alias("host"), F.regexp_extract("rest", r"(?s)^[^/?#]*([^?#]*)", 1).alias("path"))

    # One row for each different length, so a bounded list: no path of a rule is longer than a url.
    lengths = [r[0] for r in rules.select(F.length("path").alias("k")).where("path is not null and host is not null").distinct().orderBy("k").collect()]
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*[F.when(F.length("path") >= k, F.substring("path", 1, k)) for k in lengths]) if lengths else F.array().cast("array<string>"), lambda p: p.isNotNull())
    pairs = F.flatten(F.transform(F.array_distinct(suffixes), lambda h: F.transform(prefixes, lambda p: F.struct(h.alias("h"), p.alias("p")))))
    digest = lambda h, p: F.sha2(F.concat_ws("\n", h, p), 256)
    asked = rows.select("page_id", "url", "n", "host", "path", F.explode_outer(pairs).alias("e"))
    asked = asked.select("page_id", "url", "n", "host", "path", digest(F.col("e.h"), F.col("e.p")).alias("digest"), F.col("e").isNotNull().alias("any"))
    asked = asked.withColumn("short", F.when(F.col("any"), F.substring("digest", 1, _SHORT)))

    known = rules.where("host is not null and path is not null").select("verdict", F.concat("host", "path").alias("rule"), F.length("host").alias("host_n"), digest(F.col("host"), F.col("path")).alias("full"))
    known = known.groupBy("full", "rule", "host_n").agg(F.max("verdict").alias("rule_verdict")).withColumn("key", F.substring("full", 1, _SHORT))
    met = asked.join(known, asked["short"] == known["key"], "left")
    best = F.max(F.when(F.col("digest") == F.col("full"), F.struct(F.length("rule").alias("size"), "host_n", "rule_verdict", "rule")))
    judged = met.groupBy("page_id", "url", "n", "host", "path").agg(best.alias("best"))
    judged = judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"), F.explode(F.array_repeat(F.lit(1), F.col("n").cast("int"))).alias("copy"))
    return judged.drop("copy")


def op9_url_filter(spark: SparkSession, pages: DataFrame) -> DataFrame:
    return filter_urls(pages, rules_frame(spark, RULES))
