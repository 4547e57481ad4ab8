"""Feature matrices against values worked out by hand, and the shape of their plans."""

from __future__ import annotations

import datetime as dt
import math
import shutil
import warnings
from dataclasses import dataclass
from fractions import Fraction

import pytest
from helpers import column, day
from pyspark.sql import functions as F

import relfeat
from relfeat import errors
from relfeat import primitives as P


@pytest.fixture(autouse=True)
def silent():
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        yield


def matrix(db, target, agg=(), trans=(), cond=(), depth=2, cutoff=None):
    return relfeat.deep_feature_synthesis(db, target, agg, trans, cond, depth, cutoff)[0]


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_defaults_of_empty_groups(shop):
    got = matrix(shop, "buyers", ["count", "sum", "mean", "any_true", "all_true", "n_unique"])
    assert column(got, "COUNT__orders") == [2, 1, 0]
    assert column(got, "SUM__orders__amount") == [15.0, 7.5, 0]
    assert column(got, "MEAN__orders__amount") == [7.5, 7.5, None]
    assert column(got, "ANY_TRUE__orders__paid") == [True, False, False]
    assert column(got, "ALL_TRUE__orders__paid") == [False, True, None]
    assert column(got, "SUM__orders__COUNT__lines") == [3, 2, 0]
    assert column(got, "N_UNIQUE__orders__closed") == [2, 1, 0]


def test_directs_follow_nulls(shop):
    got = matrix(shop, "orders", [], [], depth=1)
    assert column(got, "buyers__age") == [30, 30, 40, None]
    assert got.schema["buyers__area"].metadata == {"logical": "categorical"}


def test_conditions(shop):
    got = matrix(shop, "buyers", ["count"], [], ["count", "sum", "mean", "n_unique", "first", "entropy", "count_above_mean", "percent_true", "is_unique"], cutoff=day(8))
    assert column(got, "COUNT__orders__WHERE__large") == [1, 1, 0]
    assert column(got, "COUNT__orders__WHERE__never") == [0, 0, 0]
    assert column(got, "COUNT__orders__WHEN__open") == [2, 0, 0]
    assert column(got, "MEAN__orders__amount__WHERE__large") == [10.0, 7.5, None]
    assert column(got, "FIRST__orders__amount__WHEN__open") == [10.0, None, None]
    assert column(got, "N_UNIQUE__orders__paid__WHERE__never") == [0, 0, 0]
    assert column(got, "PERCENT_TRUE__orders__paid__WHERE__large") == [1.0, 0.0, None]


def test_a_masked_aggregate_is_a_filtered_one(spark):
    """Every built-in aggregation, over rows that a condition keeps, equals itself over the kept rows alone."""
    rows = [(i, i % 7 if i % 11 else None, (i * 37 % 19) / 2 if i % 5 else None, i % 3 == 0 if i % 4 else None, "abc"[i * 7 % 3] if i % 6 else None, day(1) + dt.timedelta(hours=i * 13 % 500), day(1) + dt.timedelta(hours=i * 29 % 700)) for i in range(200)]
    child = spark.createDataFrame(rows, "id long, p long, v double, flag boolean, label string, seen timestamp_ntz, made timestamp_ntz")
    parent = spark.createDataFrame([(i,) for i in range(9)], "id long")
    keep = (F.col("id") * 7 % 10) < 4
    every = [n for n, cls in P.known().items() if issubclass(cls, P.AggregationPrimitive)]

    def made(frame, where):
        return relfeat.Database("x").add_table("a", parent, "id").add_table("b", frame, "id", "made", where=where).add_relationship("a", "b", "p")

    masked = matrix(made(child, {"kept": keep & (F.col("p") != 3)}), "a", [], [], every, 1, day(30))
    filtered = matrix(made(child.where(keep & (F.col("p") != 3)), {}), "a", every, [], [], 1, day(30))
    assert len(filtered.columns) > 60
    for name in filtered.columns[1:]:
        condition = name.rsplit("__", 1)[0] + "__WHERE__kept__" + name.rsplit("__", 1)[1] if name.startswith("QUANTILES") else name + "__WHERE__kept"
        for got, wanted in zip(column(masked, condition), column(filtered, name), strict=True):
            assert got == (pytest.approx(wanted) if isinstance(wanted, float) else wanted), name


def test_one_join_and_shuffle_of_a_child_whatever_crosses_it(shop):
    few = matrix(shop, "buyers", ["count"], depth=1)
    many = matrix(shop, "buyers", ["count", "sum", "mean", "first", "last", "median", "skew"], [], ["count", "sum", "max"], depth=1, cutoff=day(9))
    assert plan(many).count("Join") == plan(few).count("Join") == 1
    relative = matrix(shop, "buyers", ["entropy", "count_above_mean", "count_inside_nth_std", "mean"], depth=1)
    text = plan(relative)
    assert text.count("Exchange hashpartitioning") + text.count("REPARTITION_BY_COL") <= 2 * text.count("REPARTITION_BY_COL") + 1


def test_cutoff_filters_all_tables_and_reaches_the_scan(shop, spark, tmp_path):
    got = matrix(shop, "buyers", ["count"], cutoff=day(2))
    assert column(got, "id") == [1, 2] and column(got, "COUNT__orders") == [0, 0]
    path = str(tmp_path / "orders")
    shop.get_table("orders").write.parquet(path)
    db = relfeat.Database("x").add_table("orders", path, "id", "placed")
    text = plan(matrix(db, "orders", [], ["hour"], cutoff=day(5)))
    assert "LessThanOrEqual(placed" in text and "paid" in text and "buyer_id" not in text.split("ReadSchema")[0].split("PushedFilters")[-1]


def test_nothing_is_read_before_an_action(shop, spark, tmp_path):
    path = str(tmp_path / "orders")
    shop.get_table("orders").write.parquet(path)
    db = relfeat.Database("x").add_table("orders", path, "id", "placed")
    shutil.rmtree(path)
    got = matrix(db, "orders", [], ["hour"])
    with pytest.raises(Exception, match="exist|not found|PATH"):
        got.collect()


def test_row_update_times(spark):
    orders = spark.createDataFrame([(1, 1, "done", day(1), day(9)), (2, 1, "done", day(1), None), (3, 2, "done", day(1), day(3))], "id long, b long, state string, placed timestamp_ntz, changed timestamp_ntz")
    db = relfeat.Database("x").add_table("b", spark.createDataFrame([(1,), (2,)], "id long"), "id").add_table("orders", orders, "id", "placed", {"changed": {"state": "open", "changed": None}}).add_relationship("b", "orders", "b")
    at = db.as_of(day(5)).get_table("orders").orderBy("id").collect()
    assert [r["state"] for r in at] == ["open", "done", "done"] and [r["changed"] for r in at] == [None, None, day(3)]
    assert column(matrix(db, "b", ["mode"], cutoff=day(5)), "MODE__orders__state") == ["done", "done"]
    assert [r["state"] for r in db.get_table("orders").collect()] == ["done"] * 3


def test_transforms_by_hand(spark):
    rows = [(1, 1, 0.0, 3, day(1), True), (2, 1, -4.0, 0, day(2), None), (3, 1, None, -2, day(3), False), (4, 1, 9.0, 5, day(3), True)]
    child = spark.createDataFrame(rows, "id long, p long, x double, k int, made timestamp_ntz, flag boolean")
    db = relfeat.Database("x").add_table("p", spark.createDataFrame([(1,)], "id long"), "id").add_table("c", child, "id", "made").add_relationship("p", "c", "p")
    got = matrix(db, "c", [], ["natural_log", "square_root", "divide_numeric", "modulo_numeric", "cum_sum", "cum_count", "diff", "percentile", "cum_mean", "is_weekend", "weekday", "time_since", "and", "not", "multiply_numeric_boolean", "negate"], depth=1, cutoff=day(4))
    assert column(got, "NATURAL_LOG__x") == [-math.inf, None, None, math.log(9)]
    assert column(got, "SQUARE_ROOT__x") == [0.0, None, None, 3.0]
    assert column(got, "DIVIDE_NUMERIC__x__k")[:3] == [0.0, -math.inf, None]
    assert column(got, "MODULO_NUMERIC__k__x")[1] == 0 and column(got, "MODULO_NUMERIC__x__k") == [0.0, None, None, 4.0]
    assert column(got, "CUM_SUM__x__by__p") == [0.0, -4.0, None, 5.0]
    assert column(got, "CUM_COUNT__x__by__p") == [1, 2, 2, 3]
    assert column(got, "DIFF__k__by__p") == [None, -3, -2, 7]
    assert column(got, "PERCENTILE__x__by__p") == pytest.approx([2 / 3, 1 / 3, None, 1.0])
    assert column(got, "WEEKDAY__made") == [1, 2, 3, 3] and got.schema["WEEKDAY__made"].dataType.simpleString() == "tinyint"
    assert column(got, "TIME_SINCE__made") == [dt.timedelta(days=n) for n in (3, 2, 1, 1)]
    assert column(got, "MULTIPLY_NUMERIC_BOOLEAN__k__flag") == [3, None, 0, 5]


def test_integer_arithmetic_does_not_overflow(spark):
    top = 2**31 - 1
    db = relfeat.Database("x").add_table("t", spark.createDataFrame([(1, top, top, -(2**31))], "id long, a int, b int, c int"), "id")
    got = matrix(db, "t", [], ["add_numeric", "subtract_numeric", "multiply_numeric", "negate"], depth=1)
    assert column(got, "ADD_NUMERIC__a__b") == [2 * top] and column(got, "SUBTRACT_NUMERIC__a__c") == [top + 2**31] and column(got, "NEGATE__c") == [2.0**31]


def test_texts(spark):
    rows = [(1, "One two, (two)!", "https://u:p@www.a.co.uk:80/x?y"), (2, " - ", "me@b.org"), (3, None, None), (4, "", "nohost"), (5, "tab\tnew\nline", "www.")]
    db = relfeat.Database("x").add_table("t", spark.createDataFrame(rows, "id long, s string, u string"), "id")
    got = matrix(db, "t", [], ["n_words", "n_unique_words", "n_characters", "domain", "top_level_domain", "url_to_protocol"], depth=1)
    assert column(got, "N_WORDS__s") == [3, 0, None, 0, 3] and column(got, "N_UNIQUE_WORDS__s") == [2, 0, None, 0, 3]
    assert column(got, "DOMAIN__u") == ["a.co.uk", "b.org", None, "nohost", None]
    assert column(got, "TOP_LEVEL_DOMAIN__u") == ["uk", "org", None, None, None]
    assert column(got, "URL_TO_PROTOCOL__u") == ["https", None, None, None, None]


def test_names_that_collide(spark):
    db = relfeat.Database("x").add_table("a", spark.createDataFrame([(1,)], "id long"), "id").add_table("b", spark.createDataFrame([(1, 1, 2.0, 3.0)], "id long, a long, v double, V__x double"), "id").add_relationship("a", "b", "a")
    both = relfeat.FeatureList([f for f in relfeat.synthesize(db, "a", ["mean"], [], [])] + [f for f in relfeat.synthesize(db, "a", ["max"], [], [])])
    assert len(both.apply(db).columns) == 5
    twin = relfeat.Database("y").add_table("t", spark.createDataFrame([(1, 2, dt.date(2024, 1, 1))], "id long, year__d long, d date"), "id")
    with pytest.raises(errors.SchemaError, match="both compile to column"):
        matrix(twin, "t", [], ["year"])


def test_odd_column_names(spark):
    db = relfeat.Database("x").add_table("a", spark.createDataFrame([(1,)], "`my id` long"), "my id").add_table("b", spark.createDataFrame([(1, 1, 2.0)], "id long, `a.b` long, `v``1` double"), "id").add_relationship("a", "b", "a.b")
    assert column(matrix(db, "a", ["sum"]), "SUM__b__v`1") == [2.0]


def test_self_reference_computes(spark):
    staff = spark.createDataFrame([(1, None, 5.0), (2, 1, 3.0), (3, 1, 4.0)], "id long, boss long, pay double")
    got = matrix(relfeat.Database("s").add_table("staff", staff, "id").add_relationship("staff", "staff", "boss"), "staff", ["sum", "count"], depth=1)
    assert column(got, "SUM__staff__pay") == [7.0, 0.0, 0.0] and column(got, "staff__pay") == [None, 5.0, 5.0]


def test_feature_lists_apply_elsewhere(shop, spark):
    features = relfeat.deep_feature_synthesis(shop, "buyers", ["count"], [], ["count"], 1, features_only=True)
    other = relfeat.Database("o").add_table("buyers", shop.get_table("buyers").where("id < 3"), "id", "joined").add_table("orders", shop.get_table("orders"), "id", "placed", where={"large": F.col("amount") >= 100, "never": F.lit(False)}, when={"open": lambda c: F.lit(True)}).add_relationship("buyers", "orders", "buyer_id")
    got = features.apply(other, day(5))
    assert column(got, "COUNT__orders__WHERE__large") == [0, 0] and column(got, "COUNT__orders__WHEN__open") == [2, 0]
    with pytest.raises(errors.ValidationError, match="needs a cutoff_time"):
        relfeat.apply_features(list(features), other)
    bare = relfeat.Database("b").add_table("buyers", shop.get_table("buyers"), "id").add_table("orders", shop.get_table("orders"), "id").add_relationship("buyers", "orders", "buyer_id")
    with pytest.raises(errors.SchemaError, match="is not declared"):
        features.apply(bare, day(5))


@P.register
@dataclass(frozen=True)
class Range(P.AggregationPrimitive):
    """Largest less smallest, without support for masks."""

    name = "test_range"
    input_dtypes = (P.DtypeFamily.NUMERIC,)

    def build(self, column):
        return F.max(column) - F.min(column)


@P.register
@dataclass(frozen=True)
class AboveShare(P.GroupTransformPrimitive):
    """A value as a share of its group's sum."""

    name = "test_share"
    input_dtypes = (P.DtypeFamily.NUMERIC,)

    def build(self, column, *, group):
        return column / group.over(F.sum(column))


def test_custom_primitives(shop):
    got = matrix(shop, "buyers", ["test_range"], [], ["test_range"], 1, day(9))
    assert column(got, "TEST_RANGE__orders__amount") == [5.0, 0.0, None]
    assert column(got, "TEST_RANGE__orders__amount__WHERE__large") == [0.0, 0.0, None]
    assert column(matrix(shop, "orders", [], ["test_share"], depth=1), "TEST_SHARE__amount__by__buyer_id")[:3] == pytest.approx([2 / 3, 1 / 3, 1.0])


def test_sinks(shop, tmp_path, spark):
    got = matrix(shop, "buyers", ["count", "sum", "max"])
    whole, blocks = (relfeat.collect_feature_matrix(got, "pandas", n) for n in (None, 2))
    assert list(whole.columns) == list(blocks.columns) and blocks["id"].tolist() == [1, 2, 3]
    assert whole.sort_values("id", ignore_index=True).equals(blocks)
    assert relfeat.collect_feature_matrix(got, "pyarrow", 3).num_rows == 3 and relfeat.collect_feature_matrix(got, "numpy").shape == (3, len(got.columns))
    with pytest.raises(errors.RelfeatError, match="not known"):
        relfeat.collect_feature_matrix(got, "nope")
    with pytest.raises(TypeError, match="not an integer"):
        relfeat.collect_feature_matrix(got, "pandas", "2")
    paths = relfeat.write_feature_matrix(got, str(tmp_path / "m"), 3)
    assert sum(len(spark.read.parquet(p).columns) - 1 for p in paths) == len(got.columns) - 1


def test_values_just_n_deviations_away(spark):
    """They are inside, though rounding would tell some of them from the bound."""
    groups = [(7, 4), (3, 3, 3), (-6, -6, 1, 1), (10, 10, 11, 11), (5, 8, 6, 9, 9, 8), (13, 9, 12, 13, 10, 15), (10, 13, 8, 12, 9, 14, 11), (1 << 40, 1 << 41), (0.1, 0.9), (None, 5, 8)]
    parents = spark.range(len(groups))
    rows = [(100 * g + i, g, None if x is None else float(x)) for g, xs in enumerate(groups) for i, x in enumerate(xs)]
    db = relfeat.Database("d").add_table("a", parents, "id").add_table("b", spark.createDataFrame(rows, "k long, a_id long, x double"), "k").add_relationship("a", "b", "a_id")
    for n in (1, 1.5):
        matrix, _ = relfeat.deep_feature_synthesis(db, "a", [P.CountInsideNthStd(n), P.CountOutsideNthStd(n)], [], [], 1)
        expected = []
        for xs in groups[:7]:
            gap = [(len(xs) * x - sum(xs)) ** 2 - Fraction(n) ** 2 * (len(xs) * sum(v * v for v in xs) - sum(xs) ** 2) for x in xs]
            expected.append(sum(v <= 0 for v in gap))
        stem = str(n).replace(".", "_")
        assert column(matrix, f"COUNT_INSIDE_{stem}_STD__b__x")[:7] == expected
        assert column(matrix, f"COUNT_OUTSIDE_{stem}_STD__b__x")[:7] == [len(xs) - e for xs, e in zip(groups, expected, strict=False)]
        inside, outside = (column(matrix, f"COUNT_{side}_{stem}_STD__b__x") for side in ("INSIDE", "OUTSIDE"))
        assert [i + o for i, o in zip(inside, outside, strict=True)] == [sum(x is not None for x in xs) for xs in groups]
