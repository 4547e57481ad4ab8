"""One query for each operator of the feature engine over the test tables, with the SQL that gives the same rows.

Durations are compared as microseconds, real numbers rounded to 6 digits, integers as bigint. The tables hold no nulls, so both
sides derive nullable columns by the same expressions.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import relfeat
from relfeat import primitives as P
from relfeat.functions import instant, named

Query = Callable[[SparkSession, str], DataFrame]

#: Derived columns of events and orders, in SQL that Spark and DuckDB read alike.
EVENT = {
    "event_id": "event_id",
    "user_id": "user_id",
    "ts": "ts",
    "value": "CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 13 = 0 THEN 0.0 WHEN event_id % 4 = 0 THEN -value ELSE value END",
    "k": "CASE WHEN event_id % 9 = 0 THEN NULL ELSE CAST(event_id % 23 AS INT) - 7 END",
    "flag": "CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 3 = 0 END",
    "mark": "event_id % 2 = 0",
    "kind": "CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END",
    "due": "CASE WHEN event_id % 6 = 0 THEN NULL WHEN event_id % 2 = 0 THEN ts - INTERVAL '45' DAY ELSE ts END",
}
ORDER = {
    "o_orderkey": "o_orderkey",
    "o_custkey": "o_custkey",
    "o_totalprice": "o_totalprice",
    "o_orderpriority": "o_orderpriority",
    "o_orderdate": "o_orderdate",
    "o_orderstatus": "o_orderstatus",
    "changed": "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate + INTERVAL '400' DAY END",
}
CUTOFF, EVENT_CUTOFF = datetime(1998, 1, 1), datetime(2024, 1, 15)
_EV = "ev AS (SELECT {} FROM events)".format(", ".join(f"{e} AS {n}" for n, e in EVENT.items()))
_ORD = "ord AS (SELECT {} FROM orders)".format(", ".join(f"{e} AS {n}" for n, e in ORDER.items()))


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _derived(frame: DataFrame, columns: dict[str, str]) -> DataFrame:
    return frame.selectExpr(*(f"{e} AS {n}" for n, e in columns.items()))


def database(spark: SparkSession, sf: str) -> relfeat.Database:
    """All test tables with their keys and times."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")  # lineitem has no key
        db = relfeat.Database("shop")
        for name, key, time, labels in (("region", "r_regionkey", None, ()), ("nation", "n_nationkey", None, ()), ("customer", "c_custkey", None, ("c_mktsegment",)), ("supplier", "s_suppkey", None, ()), ("part", "p_partkey", None, ("p_brand",)), ("lineitem", None, "l_shipdate", ("l_returnflag", "l_linestatus"))):
            db.add_table(name, _table(spark, sf, name), key, time, categorical=labels)
        db.add_table("orders", _derived(_table(spark, sf, "orders"), ORDER), "o_orderkey", "o_orderdate", {"changed": {"o_orderstatus": "P", "changed": None}}, where={"large": F.col("o_totalprice") >= 200000}, when={"recent": lambda cutoff: F.col("o_orderdate") > instant(cutoff) - F.expr("INTERVAL '365' DAY")}, categorical=["o_orderpriority"])
        db.add_table("events", _derived(_table(spark, sf, "events"), EVENT), "event_id", "ts", where={"marked": F.col("mark")})
        for link in (("region", "nation", "n_regionkey"), ("nation", "customer", "c_nationkey"), ("nation", "supplier", "s_nationkey"), ("customer", "orders", "o_custkey"), ("customer", "events", "user_id"), ("orders", "lineitem", "l_orderkey"), ("part", "lineitem", "l_partkey"), ("supplier", "lineitem", "l_suppkey")):
            db.add_relationship(*link)
    return db


def plain(matrix: DataFrame, names: list[str] | None = None) -> DataFrame:
    """A matrix whose values compare across engines."""
    out = []
    for field in matrix.schema:
        c = named(field.name)
        if isinstance(field.dataType, T.DayTimeIntervalType):
            c = (c.cast("decimal(20,6)") * 1000000).cast("bigint")
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        elif isinstance(field.dataType, T.IntegralType):
            c = c.cast("bigint")
        if names is None or field.name in names:
            out.append(c.alias(field.name))
    return matrix.select(*out)


def _pair(spark: SparkSession, sf: str, labels: tuple[str, ...] = ()) -> relfeat.Database:
    """Customers and their events."""
    return (
        relfeat.Database("pair")
        .add_table("customer", _table(spark, sf, "customer"), "c_custkey")
        .add_table("events", _derived(_table(spark, sf, "events"), EVENT), "event_id", "ts", where={"marked": F.col("mark")}, categorical=labels)
        .add_relationship("customer", "events", "user_id")
    )


def _dfs(db: relfeat.Database, target: str, agg: object = (), trans: object = (), cond: object = (), depth: int = 1, cutoff: datetime | None = None, names: list[str] | None = None) -> DataFrame:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        matrix, _ = relfeat.deep_feature_synthesis(db, target, agg, trans, cond, depth, cutoff)
    key = matrix.columns[0]
    return plain(matrix, None if names is None else [key, *names])


# Aggregations: the value over a group of ev rows e that isn't empty, and the default of an empty one.

_R, _I = "round({}, 6) + 0.0", "CAST({} AS BIGINT)"
_SECONDS = "epoch_us(TIMESTAMP '2024-01-15') - epoch_us({})"
_DISTINCT = "count(DISTINCT {0}) + max(CASE WHEN {0} IS NULL THEN 1 ELSE 0 END)"
_AGGREGATIONS: list[tuple[object, str, str, str]] = [
    ("count", "COUNT__events", _I.format("count(*)"), "0"),
    ("sum", "SUM__events__value", _R.format("coalesce(sum(value), 0)"), "0"),
    ("mean", "MEAN__events__value", _R.format("avg(value)"), "NULL"),
    ("min", "MIN__events__k", _I.format("min(k)"), "NULL"),
    ("max", "MAX__events__value", _R.format("max(value)"), "NULL"),
    ("std", "STD__events__value", _R.format("stddev_samp(value)"), "NULL"),
    ("variance", "VARIANCE__events__k", _R.format("var_samp(k)"), "NULL"),
    ("median", "MEDIAN__events__value", _R.format("median(value)"), "NULL"),
    (P.Quantiles((0.1, 0.5, 0.75)), "QUANTILES__events__value__0", _R.format("quantile_cont(value, 0.1)"), "NULL"),
    ("skew", "SKEW__events__value", _R.format("CASE WHEN stddev_samp(value) > 0 THEN (avg(value*value*value) - 3*avg(value)*avg(value*value) + 2*avg(value)*avg(value)*avg(value)) / power(var_pop(value), 1.5) END"), "NULL"),
    ("kurtosis", "KURTOSIS__events__k", _R.format("CASE WHEN stddev_samp(k) > 0 THEN kurtosis_pop(k) END"), "NULL"),
    ("n_unique", "N_UNIQUE__events__k", _I.format(_DISTINCT.format("k")), "0"),
    ("is_unique", "IS_UNIQUE__events__k", f"({_DISTINCT.format('k')}) = count(*)", "NULL"),
    ("percent_unique", "PERCENT_UNIQUE__events__kind", _R.format(f"CAST({_DISTINCT.format('kind')} AS DOUBLE) / count(*)"), "NULL"),
    ("max_min_delta", "MAX_MIN_DELTA__events__k", _I.format("max(k) - min(k)"), "NULL"),
    ("percent_true", "PERCENT_TRUE__events__flag", _R.format("avg(CASE WHEN flag THEN 1.0 ELSE 0.0 END)"), "NULL"),
    ("all_true", "ALL_TRUE__events__flag", "coalesce(bool_and(flag), true)", "NULL"),
    ("any_true", "ANY_TRUE__events__flag", "coalesce(bool_or(flag), false)", "false"),
    ("n_true", "N_TRUE__events__flag", _I.format("count_if(coalesce(flag, false))"), "0"),
    ("time_since_first", "TIME_SINCE_FIRST__events__ts", _SECONDS.format("min(ts)"), "NULL"),
    ("time_since_last", "TIME_SINCE_LAST__events__due", _SECONDS.format("max(due)"), "NULL"),
    ("time_since_last_true", "TIME_SINCE_LAST_TRUE__events__ts__events__flag", _SECONDS.format("max(CASE WHEN flag THEN ts END)"), "NULL"),
    ("time_since_last_false", "TIME_SINCE_LAST_FALSE__events__ts__events__flag", _SECONDS.format("max(CASE WHEN NOT flag THEN ts END)"), "NULL"),
    ("first_last_time_delta", "FIRST_LAST_TIME_DELTA__events__due", "epoch_us(max(due)) - epoch_us(min(due))", "NULL"),
    ("n_unique_days", "N_UNIQUE_DAYS__events__due", _I.format(_DISTINCT.format("CAST(due AS DATE)")), "0"),
    ("n_unique_days_of_calendar_year", "N_UNIQUE_DAYS_OF_CALENDAR_YEAR__events__due", _I.format(_DISTINCT.format("(month(due) * 100 + day(due))")), "0"),
    ("n_unique_days_of_month", "N_UNIQUE_DAYS_OF_MONTH__events__due", _I.format(_DISTINCT.format("day(due)")), "0"),
    ("n_unique_months", "N_UNIQUE_MONTHS__events__due", _I.format(_DISTINCT.format("(year(due) * 12 + month(due))")), "0"),
    ("mode", "MODE__events__kind", "(SELECT x.kind FROM rows x WHERE x.user_id = e.user_id AND x.kind IS NOT NULL GROUP BY x.kind ORDER BY count(*) DESC, x.kind LIMIT 1)", "NULL"),
    ("entropy", "ENTROPY__events__kind", _R.format("(SELECT sum(c / n * ln(n / c)) FROM (SELECT CAST(count(*) AS DOUBLE) AS c, CAST(sum(count(*)) OVER () AS DOUBLE) AS n FROM rows x WHERE x.user_id = e.user_id GROUP BY x.kind))"), "NULL"),
    ("first", "FIRST__events__k", _I.format("max(CASE WHEN up = 1 THEN k END)"), "NULL"),
    ("last", "LAST__events__k", _I.format("max(CASE WHEN down = 1 THEN k END)"), "NULL"),
    ("count_above_mean", "COUNT_ABOVE_MEAN__events__k", _I.format("count_if(coalesce(k > k_mean, false))"), "0"),
    ("count_below_mean", "COUNT_BELOW_MEAN__events__k", _I.format("count_if(coalesce(k < k_mean, false))"), "0"),
    ("count_inside_nth_std", "COUNT_INSIDE_1_STD__events__k", _I.format("count_if(coalesce(abs(k - k_mean) <= k_std, false))"), "0"),
    (P.CountOutsideNthStd(1.5), "COUNT_OUTSIDE_1_5_STD__events__k", _I.format("count_if(coalesce(abs(k - k_mean) > 1.5 * k_std, false))"), "0"),
]


def _group_sql(name: str, value: str, default: str, keep: str, public: str) -> str:
    """Customers with the value of their events; only of those that `keep` holds for."""
    return f"""
WITH {_EV}, rows AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS up, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS down,
         avg(k) OVER (PARTITION BY user_id) AS k_mean, stddev_pop(k) OVER (PARTITION BY user_id) AS k_std
  FROM ev WHERE {keep}
), g AS (SELECT user_id, {value} AS v FROM rows e GROUP BY user_id)
SELECT c_custkey, CASE WHEN g.user_id IS NULL THEN {default} ELSE g.v END AS "{public}" FROM customer LEFT JOIN g ON g.user_id = c_custkey
"""


# Row-wise transforms of events and of texts.

_ON_EVENTS: list[tuple[str, str, str]] = [
    ("year", "YEAR__due", _I.format("year(due)")),
    ("month", "MONTH__due", _I.format("month(due)")),
    ("day", "DAY__due", _I.format("day(due)")),
    ("hour", "HOUR__due", _I.format("hour(due)")),
    ("weekday", "WEEKDAY__due", _I.format("isodow(due)")),
    ("is_weekend", "IS_WEEKEND__due", "isodow(due) >= 6"),
    ("minute", "MINUTE__due", _I.format("minute(due)")),
    ("second", "SECOND__due", _I.format("second(due)")),
    ("day_of_year", "DAY_OF_YEAR__due", _I.format("dayofyear(due)")),
    ("is_leap_year", "IS_LEAP_YEAR__due", "(year(due) % 4 = 0 AND year(due) % 100 <> 0) OR year(due) % 400 = 0"),
    ("time_since", "TIME_SINCE__due", _SECONDS.format("due")),
    ("absolute", "ABSOLUTE__k", _I.format("abs(k)")),
    ("natural_log", "NATURAL_LOG__value", _R.format("CASE WHEN value = 0 THEN CAST('-inf' AS DOUBLE) WHEN value > 0 THEN ln(value) END")),
    ("is_null", "IS_NULL__value", "value IS NULL"),
    ("negate", "NEGATE__k", _R.format("CAST(-k AS DOUBLE)")),
    ("square_root", "SQUARE_ROOT__value", _R.format("CASE WHEN value >= 0 THEN sqrt(value) END")),
    ("sine", "SINE__value", _R.format("sin(value)")),
    ("cosine", "COSINE__value", _R.format("cos(value)")),
    ("subtract_numeric", "SUBTRACT_NUMERIC__value__k", _R.format("value - k")),
    ("divide_numeric", "DIVIDE_NUMERIC__value__k", _R.format("CASE WHEN k = 0 THEN CASE WHEN value = 0 THEN CAST('nan' AS DOUBLE) ELSE sign(value) * CAST('inf' AS DOUBLE) END ELSE value / k END")),
    ("add_numeric", "ADD_NUMERIC__value__k", _R.format("value + k")),
    ("multiply_numeric", "MULTIPLY_NUMERIC__value__k", _R.format("value * k")),
    ("modulo_numeric", "MODULO_NUMERIC__value__k", _R.format("CASE WHEN k <> 0 THEN value - k * floor(value / k) END")),
    ("multiply_numeric_boolean", "MULTIPLY_NUMERIC_BOOLEAN__k__flag", _I.format("k * CAST(flag AS INT)")),
    ("greater_than", "GREATER_THAN__value__k", "value > k"),
    ("greater_than_equal_to", "GREATER_THAN_EQUAL_TO__ts__due", "ts >= due"),
    ("less_than", "LESS_THAN__value__k", "value < k"),
    ("less_than_equal_to", "LESS_THAN_EQUAL_TO__due__ts", "due <= ts"),
    ("equal", "EQUAL__flag__mark", "flag = mark"),
    ("not_equal", "NOT_EQUAL__ts__due", "ts <> due"),
    ("not", "NOT__flag", "NOT flag"),
    ("and", "AND__flag__mark", "flag AND mark"),
    ("or", "OR__flag__mark", "flag OR mark"),
]
_PUNCTUATION = r"[!-/:-@\x5B-\x60{-~]"


def _words(text: str) -> str:
    return rf"list_filter(list_transform(string_split_regex({text}, '\s+'), lambda w: regexp_replace(w, '^{_PUNCTUATION}+|{_PUNCTUATION}+$', '', 'g')), lambda w: w <> '')"


_DOMAIN = r"nullif(regexp_extract(trim(url, ' ' || chr(9) || chr(10) || chr(13)), '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/?]*@)?(?:www\.)?([^:/?]*)', 1), '')"
_ON_TEXTS: list[tuple[str, str, str, str, str]] = [
    ("n_characters", "documents", "doc_id", "N_CHARACTERS__text", _I.format("length(text)")),
    ("n_words", "documents", "doc_id", "N_WORDS__text", _I.format(f"len({_words('text')})")),
    ("n_unique_words", "documents", "doc_id", "N_UNIQUE_WORDS__text", _I.format(f"len(list_distinct({_words('lower(text)')}))")),
    ("domain", "pages", "page_id", "DOMAIN__url", _DOMAIN),
    ("top_level_domain", "pages", "page_id", "TOP_LEVEL_DOMAIN__url", rf"nullif(regexp_extract({_DOMAIN}, '\.([^.]+)$', 1), '')"),
    ("url_to_protocol", "pages", "page_id", "URL_TO_PROTOCOL__url", "CASE WHEN url LIKE 'https:%' THEN 'https' WHEN url LIKE 'http:%' THEN 'http' END"),
]
_LABELS = [("equal_categorical", "EQUAL_CATEGORICAL__l_returnflag__l_linestatus", "l_returnflag = l_linestatus"), ("not_equal_categorical", "NOT_EQUAL_CATEGORICAL__l_returnflag__l_linestatus", "l_returnflag <> l_linestatus")]

# Group and ordered transforms of events by customer. w: the group in order; so: its rows up to this one.

_BY_GROUP: list[tuple[str, str, str]] = [
    ("percentile", "PERCENTILE__value__by__user_id", _R.format("CASE WHEN value IS NOT NULL THEN (rank() OVER (PARTITION BY user_id, value IS NULL ORDER BY value) + (count(*) OVER (PARTITION BY user_id, value) - 1) / 2.0) / count(value) OVER (PARTITION BY user_id) END")),
    ("cum_sum", "CUM_SUM__k__by__user_id", _I.format("CASE WHEN k IS NOT NULL THEN sum(k) OVER so END")),
    ("cum_count", "CUM_COUNT__k__by__user_id", _I.format("count(k) OVER so")),
    ("cum_min", "CUM_MIN__value__by__user_id", _R.format("CASE WHEN value IS NOT NULL THEN min(value) OVER so END")),
    ("cum_max", "CUM_MAX__value__by__user_id", _R.format("CASE WHEN value IS NOT NULL THEN max(value) OVER so END")),
    ("cum_mean", "CUM_MEAN__value__by__user_id", _R.format("CASE WHEN value IS NOT NULL THEN avg(value) OVER so END")),
    ("diff", "DIFF__k__by__user_id", _I.format("k - lag(k) OVER w")),
    ("time_since_previous", "TIME_SINCE_PREVIOUS__ts__by__user_id", "epoch_us(ts) - epoch_us(lag(ts) OVER w)"),
    ("same_as_previous", "SAME_AS_PREVIOUS__k__by__user_id", "k = lag(k) OVER w"),
    ("absolute_diff", "ABSOLUTE_DIFF__value__by__user_id", _R.format("abs(value - lag(value) OVER w)")),
    ("percent_change", "PERCENT_CHANGE__k__by__user_id", _R.format("CASE WHEN lag(k) OVER w = 0 THEN CASE WHEN k = 0 THEN CAST('nan' AS DOUBLE) ELSE sign(k) * CAST('inf' AS DOUBLE) END ELSE CAST(k AS DOUBLE) / lag(k) OVER w END - 1")),
    ("cumulative_time_since_last_true", "CUMULATIVE_TIME_SINCE_LAST_TRUE__ts__flag__by__user_id", "epoch_us(ts) - epoch_us(max(CASE WHEN flag THEN ts END) OVER so)"),
    ("cumulative_time_since_last_false", "CUMULATIVE_TIME_SINCE_LAST_FALSE__ts__flag__by__user_id", "epoch_us(ts) - epoch_us(max(CASE WHEN NOT flag THEN ts END) OVER so)"),
]
_WINDOWS = "WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id), so AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"


def _of(primitive: object) -> str:
    return primitive if isinstance(primitive, str) else primitive.name


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Customers two levels deep, with the default primitives: orders and line items below, nations and regions above."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return relfeat.deep_feature_synthesis(database(spark, sf), "customer", max_depth=2, cutoff_time=CUTOFF)[0]


#: Columns of the flagship's matrix, one of each way that features cross tables in it, with their SQL over the tables below.
_FLAGSHIP = {
    "c_custkey": "c.c_custkey",
    "c_acctbal": _R.format("c.c_acctbal"),
    "nation__n_name": "n.n_name",
    "nation__region__r_name": "r.r_name",
    "nation__COUNT__supplier": _I.format("coalesce(s.n, 0)"),
    "COUNT__orders": _I.format("coalesce(o.n, 0)"),
    "SUM__orders__o_totalprice": _R.format("coalesce(o.total, 0)"),
    "STD__orders__o_totalprice": _R.format("o.std"),
    "N_UNIQUE__orders__o_orderpriority": _I.format("coalesce(o.priorities, 0)"),
    "N_UNIQUE__orders__changed": _I.format("coalesce(o.changes, 0)"),
    "MODE__orders__o_orderstatus": "o.status",
    "COUNT__orders__WHERE__large": _I.format("coalesce(o.large, 0)"),
    "SUM__orders__o_totalprice__WHERE__large": _R.format("coalesce(o.large_total, 0)"),
    "COUNT__orders__WHEN__recent": _I.format("coalesce(o.recent, 0)"),
    "MAX__orders__COUNT__lineitem": _I.format("o.most_lines"),
    "MEAN__orders__SUM__lineitem__l_extendedprice": _R.format("o.mean_sum"),
    "SUM__orders__N_UNIQUE__lineitem__l_returnflag": _I.format("coalesce(o.flags, 0)"),
    "COUNT__events": _I.format("0"),
    "SUM__events__value": _R.format("0"),
}
_FLAGSHIP_SQL = f"""
WITH {_ORD}, line AS (
  SELECT l_orderkey, count(*) AS n, sum(l_extendedprice) AS price, count(DISTINCT l_returnflag) AS flags FROM lineitem WHERE l_shipdate <= DATE '1998-01-01' GROUP BY l_orderkey
), seen AS (
  SELECT o_custkey, o_totalprice, o_orderpriority, o_orderdate,
         CASE WHEN changed > TIMESTAMP '1998-01-01' THEN 'P' ELSE o_orderstatus END AS status, CASE WHEN changed > TIMESTAMP '1998-01-01' THEN NULL ELSE changed END AS changed,
         coalesce(line.n, 0) AS lines, coalesce(line.price, 0) AS price, coalesce(line.flags, 0) AS flags
  FROM ord LEFT JOIN line ON l_orderkey = o_orderkey WHERE o_orderdate <= TIMESTAMP '1998-01-01'
), o AS (
  SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total, stddev_samp(o_totalprice) AS std, count(DISTINCT o_orderpriority) AS priorities,
         {_DISTINCT.format("changed")} AS changes, count_if(o_totalprice >= 200000) AS large, sum(CASE WHEN o_totalprice >= 200000 THEN o_totalprice END) AS large_total,
         count_if(o_orderdate > TIMESTAMP '1998-01-01' - INTERVAL '365' DAY) AS recent, max(lines) AS most_lines, avg(price) AS mean_sum, sum(flags) AS flags,
         (SELECT x.status FROM seen x WHERE x.o_custkey = seen.o_custkey GROUP BY x.status ORDER BY count(*) DESC, x.status LIMIT 1) AS status
  FROM seen GROUP BY o_custkey
), s AS (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY s_nationkey)
SELECT {", ".join(f'{sql} AS "{name}"' for name, sql in _FLAGSHIP.items())}
FROM customer c LEFT JOIN nation n ON c_nationkey = n_nationkey LEFT JOIN region r ON n_regionkey = r_regionkey LEFT JOIN s ON s_nationkey = n_nationkey LEFT JOIN o ON o.o_custkey = c.c_custkey
"""


def _text_table(spark: SparkSession, sf: str, table: str, key: str) -> relfeat.Database:
    return relfeat.Database("texts").add_table(table, _table(spark, sf, table), key)


def _collected(spark: SparkSession, sf: str) -> DataFrame:
    """A matrix collected in blocks of columns, as a table again."""
    matrix = _dfs(_pair(spark, sf), "customer", ["count", "sum", "max"], names=["COUNT__events", "SUM__events__value", "MAX__events__k"])
    return spark.createDataFrame(relfeat.collect_feature_matrix(matrix, "pyarrow", batch_size=2))


def _written(spark: SparkSession, sf: str) -> DataFrame:
    """A matrix written as Parquet and read again."""
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None) or "/tmp"
    path = f"{base.rstrip('/')}/relfeat-matrix-{uuid.uuid4().hex}"
    relfeat.write_feature_matrix(_dfs(_pair(spark, sf), "customer", ["count"], names=["COUNT__events"]), path)
    return spark.read.parquet(path)


def _keys_in_order(spark: SparkSession, sf: str) -> DataFrame:
    """Features of requested keys, by the pipeline stage."""
    from relfeat.ml import DFSTransformer

    keys = [9, 3, 70, 1]
    stage = DFSTransformer("customer", ["count", "sum"], [], [], 1)
    return plain(stage.fit_transform(keys, database=_pair(spark, sf)), ["COUNT__events", "SUM__events__value", "c_acctbal"])


def _encoded(spark: SparkSession, sf: str) -> DataFrame:
    """Customers encoded by type."""
    from relfeat.ml import TableEncoder

    frame = _table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    return plain(TableEncoder(string="drop").fit(frame, categorical=["c_mktsegment"]).transform(frame))


_MACHINERY: dict[str, tuple[Query, str]] = {
    "scan_register_table": (lambda s, d: plain(database(s, d).get_table("supplier").select("s_suppkey", "s_nationkey", "s_acctbal")), "SELECT s_suppkey, CAST(s_nationkey AS BIGINT) AS s_nationkey, round(s_acctbal, 6) + 0.0 AS s_acctbal FROM supplier"),
    "cutoff_scan": (lambda s, d: plain(database(s, d).as_of(CUTOFF).get_table("orders").select("o_orderkey", "o_custkey", "o_totalprice")), "SELECT o_orderkey, o_custkey, round(o_totalprice, 6) + 0.0 AS o_totalprice FROM orders WHERE o_orderdate <= TIMESTAMP '1998-01-01'"),
    "row_update_times": (lambda s, d: database(s, d).as_of(CUTOFF).get_table("orders").select("o_orderkey", "o_orderstatus", "changed"), f"WITH {_ORD} SELECT o_orderkey, CASE WHEN changed IS NULL OR changed <= TIMESTAMP '1998-01-01' THEN o_orderstatus ELSE 'P' END AS o_orderstatus, CASE WHEN changed IS NULL OR changed <= TIMESTAMP '1998-01-01' THEN changed END AS changed FROM ord WHERE o_orderdate <= TIMESTAMP '1998-01-01'"),
    "get_keys": (lambda s, d: database(s, d).as_of(CUTOFF).get_keys("orders"), "SELECT o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '1998-01-01' ORDER BY 1"),
    "direct_join": (lambda s, d: _dfs(database(s, d), "customer", names=["nation__n_name", "nation__region__r_name"], depth=2), 'SELECT c_custkey, n_name AS "nation__n_name", r_name AS "nation__region__r_name" FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey'),
    "where_condition": (lambda s, d: _dfs(database(s, d), "customer", cond=["count", "sum", "mode"], names=["COUNT__orders__WHERE__large", "SUM__orders__o_totalprice__WHERE__large", "MODE__orders__o_orderpriority__WHERE__large"], cutoff=CUTOFF), f"""
WITH {_ORD}, kept AS (SELECT * FROM ord WHERE o_orderdate <= TIMESTAMP '1998-01-01' AND o_totalprice >= 200000),
votes AS (SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderpriority) AS place FROM kept GROUP BY 1, 2)
SELECT c_custkey, count(o_orderkey) AS "COUNT__orders__WHERE__large", round(coalesce(sum(o_totalprice), 0), 6) + 0.0 AS "SUM__orders__o_totalprice__WHERE__large", max(votes.o_orderpriority) AS "MODE__orders__o_orderpriority__WHERE__large"
FROM customer LEFT JOIN kept ON kept.o_custkey = c_custkey LEFT JOIN votes ON votes.o_custkey = c_custkey AND place = 1 GROUP BY c_custkey"""),
    "when_condition": (lambda s, d: _dfs(database(s, d), "customer", cond=["count", "sum"], names=["COUNT__orders__WHEN__recent", "SUM__orders__o_totalprice__WHEN__recent"], cutoff=CUTOFF), """
SELECT c_custkey, count(o_orderkey) AS "COUNT__orders__WHEN__recent", round(coalesce(sum(o_totalprice), 0), 6) + 0.0 AS "SUM__orders__o_totalprice__WHEN__recent"
FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderdate <= TIMESTAMP '1998-01-01' AND o_orderdate > TIMESTAMP '1998-01-01' - INTERVAL '365' DAY GROUP BY c_custkey"""),
    "stacked_aggregations": (lambda s, d: _dfs(database(s, d), "customer", ["mean", "count"], names=["MEAN__orders__COUNT__lineitem", "MEAN__orders__MEAN__lineitem__l_quantity"], depth=2, cutoff=CUTOFF), """
WITH l AS (SELECT l_orderkey, count(*) AS n, avg(l_quantity) AS q FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-01-01' GROUP BY 1),
o AS (SELECT o_custkey, coalesce(n, 0) AS n, q FROM orders LEFT JOIN l ON l_orderkey = o_orderkey WHERE o_orderdate <= TIMESTAMP '1998-01-01')
SELECT c_custkey, round(avg(n), 6) + 0.0 AS "MEAN__orders__COUNT__lineitem", round(avg(q), 6) + 0.0 AS "MEAN__orders__MEAN__lineitem__l_quantity" FROM customer LEFT JOIN o ON o_custkey = c_custkey GROUP BY c_custkey"""),
    "aggregation_of_direct": (lambda s, d: _dfs(database(s, d), "orders", ["max", "mean"], names=["MAX__lineitem__part__p_retailprice", "MEAN__lineitem__supplier__s_acctbal"], depth=2), """
SELECT o_orderkey, round(max(p_retailprice), 6) + 0.0 AS "MAX__lineitem__part__p_retailprice", round(avg(s_acctbal), 6) + 0.0 AS "MEAN__lineitem__supplier__s_acctbal"
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey GROUP BY o_orderkey"""),
    "direct_of_aggregation": (lambda s, d: _dfs(database(s, d), "customer", ["mean"], names=["nation__MEAN__supplier__s_acctbal"], depth=2), 'SELECT c_custkey, m AS "nation__MEAN__supplier__s_acctbal" FROM customer LEFT JOIN (SELECT s_nationkey, round(avg(s_acctbal), 6) + 0.0 AS m FROM supplier GROUP BY 1) ON s_nationkey = c_nationkey'),
    "transform_of_aggregation": (lambda s, d: _dfs(_pair(s, d), "customer", ["count", "sum"], ["divide_numeric"], names=["DIVIDE_NUMERIC__SUM__events__k__c_acctbal"], depth=2), f'WITH {_EV} SELECT c_custkey, round(coalesce(sum(k), 0) / c_acctbal, 6) + 0.0 AS "DIVIDE_NUMERIC__SUM__events__k__c_acctbal" FROM customer LEFT JOIN ev ON user_id = c_custkey GROUP BY c_custkey, c_acctbal'),
    "collect_in_batches": (_collected, f'WITH {_EV} SELECT c_custkey, count(event_id) AS "COUNT__events", round(coalesce(sum(value), 0), 6) + 0.0 AS "SUM__events__value", CAST(max(k) AS BIGINT) AS "MAX__events__k" FROM customer LEFT JOIN ev ON user_id = c_custkey GROUP BY c_custkey'),
    "parquet_sink": (_written, 'SELECT c_custkey, count(event_id) AS "COUNT__events" FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY c_custkey'),
    "dfs_transformer": (_keys_in_order, f'WITH {_EV} SELECT count(event_id) AS "COUNT__events", round(coalesce(sum(value), 0), 6) + 0.0 AS "SUM__events__value", round(c_acctbal, 6) + 0.0 AS c_acctbal FROM customer LEFT JOIN ev ON user_id = c_custkey WHERE c_custkey IN (9, 3, 70, 1) GROUP BY c_custkey, c_acctbal'),
    "table_encoder": (_encoded, 'SELECT CAST(c_custkey AS DOUBLE) AS "numeric__c_custkey", round(c_acctbal, 6) + 0.0 AS "numeric__c_acctbal", ' + ", ".join(f"CAST(c_mktsegment = '{v}' AS DOUBLE) AS \"categorical__c_mktsegment_{v}\"" for v in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM customer"),
    "any_family_arrays": (lambda s, d: _dfs(relfeat.Database("v").add_table("embeddings", _table(s, d, "embeddings"), "vec_id"), "embeddings", trans=["is_null"], names=["IS_NULL__embedding", "IS_NULL__label"]), 'SELECT vec_id, embedding IS NULL AS "IS_NULL__embedding", label IS NULL AS "IS_NULL__label" FROM embeddings'),
}


def all_queries() -> dict[str, tuple[Query, str | None]]:
    """Every query by name, with its SQL."""
    out: dict[str, tuple[Query, str | None]] = {"dfs_customer_depth2": (flagship, None), "dfs_customer_depth2_columns": (lambda s, d: plain(flagship(s, d), list(_FLAGSHIP)), _FLAGSHIP_SQL)}
    for primitive, name, value, default in _AGGREGATIONS:
        keep = "ts <= TIMESTAMP '2024-01-15'" if issubclass(type(P.resolve(primitive)), P.NeedsCutoffTime) else "true"
        cutoff = EVENT_CUTOFF if keep != "true" else None
        multi = name.rpartition("__")
        masked = f"{multi[0]}__WHERE__marked__{multi[2]}" if name.startswith("QUANTILES") else f"{name}__WHERE__marked"
        out[f"agg_{_of(primitive)}"] = (lambda s, d, p=primitive, n=name, c=cutoff: _dfs(_pair(s, d), "customer", [p], names=[n], cutoff=c), _group_sql(name, value, default, keep, name))
        out[f"agg_where_{_of(primitive)}"] = (lambda s, d, p=primitive, n=masked, c=cutoff: _dfs(_pair(s, d), "customer", cond=[p], names=[n], cutoff=c), _group_sql(name, value, default, f"{keep} AND mark", masked))
    for primitive, name, value in _ON_EVENTS:
        cutoff = EVENT_CUTOFF if primitive == "time_since" else None
        keep = "ts <= TIMESTAMP '2024-01-15'" if cutoff else "true"
        out[f"trans_{primitive}"] = (lambda s, d, p=primitive, n=name, c=cutoff: _dfs(_pair(s, d), "events", trans=[p], names=[n], cutoff=c), f'WITH {_EV} SELECT event_id, {value} AS "{name}" FROM ev WHERE {keep}')
    for primitive, table, key, name, value in _ON_TEXTS:
        out[f"trans_{primitive}"] = (lambda s, d, p=primitive, t=table, k=key, n=name: _dfs(_text_table(s, d, t, k), t, trans=[p], names=[n]), f'SELECT {key}, {value} AS "{name}" FROM {table}')
    for primitive, name, value in _LABELS:
        frame = lambda s, d: _table(s, d, "lineitem").select(F.expr("l_orderkey * 1000000000 + l_partkey * 10000 + l_suppkey").alias("id"), "l_returnflag", "l_linestatus")
        out[f"trans_{primitive}"] = (lambda s, d, p=primitive, n=name, f=frame: _dfs(relfeat.Database("x").add_table("lineitem", f(s, d), "id", categorical=["l_returnflag", "l_linestatus"]), "lineitem", trans=[p], names=[n]), f'SELECT l_orderkey * 1000000000 + l_partkey * 10000 + l_suppkey AS id, {value} AS "{name}" FROM lineitem')
    for primitive, name, value in _BY_GROUP:
        out[f"group_{primitive}"] = (lambda s, d, p=primitive, n=name: _dfs(_pair(s, d), "events", trans=[p], names=[n]), f'WITH {_EV} SELECT event_id, {value} AS "{name}" FROM ev {_WINDOWS}')
    return out | _MACHINERY
