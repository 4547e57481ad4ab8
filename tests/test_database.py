"""Databases, their checks and diagrams."""

from __future__ import annotations

import datetime as dt
import warnings

import pytest
from helpers import day

import relfeat
from relfeat import errors
from relfeat.sources import checks
from relfeat.types import Categorical, DtypeFamily, Enumerated, matches


@pytest.fixture
def frame(spark):
    return spark.createDataFrame([(1, "a", day(1), day(2)), (2, "b", day(2), None)], "id long, s string, made timestamp_ntz, changed timestamp_ntz")


def add(frame, **options):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return relfeat.Database("x").add_table("t", frame, **{"primary_key": "id", **options})


@pytest.mark.parametrize(
    ("options", "message"),
    [
        ({"primary_key": ["id", "s"]}, "composite primary_key"),
        ({"primary_key": "no"}, "primary_key 'no' is not a column"),
        ({"row_creation_time": "no"}, "row_creation_time 'no' is not a column"),
        ({"row_update_times": ["changed"]}, "must map each update time column"),
        ({"row_update_times": {"changed": ["s"]}}, "must map each column it updates"),
        ({"row_update_times": {"no": {}}}, "row_update_time 'no' is not a column"),
        ({"row_update_times": {"changed": {"no": 1}}}, "'no', listed under"),
        ({"categorical": ["no"]}, "categorical 'no' is not a column"),
    ],
)
def test_declarations_that_do_not_fit(frame, options, message):
    with pytest.raises(errors.SchemaError, match=message):
        add(frame, **options)


@pytest.mark.parametrize(
    ("options", "message"),
    [
        ({"row_creation_time": "s"}, "expected a timestamp"),
        ({"row_update_times": {"s": {"s": None}}}, "expected a timestamp"),
        ({"row_update_times": {"changed": {"id": 0}}}, "a key names a row"),
        ({"row_creation_time": "made", "row_update_times": {"changed": {"made": None}}}, "visible rows were created"),
        ({"row_update_times": {"changed": {"made": None}, "made": {"made": None}}}, "itself listed under"),
        ({"row_update_times": {"changed": {"s": "x"}, "made": {"s": "y"}}}, "listed under both"),
        ({"row_update_times": {"changed": {"s": 3}}}, "is not a string value"),
        ({"row_update_times": {"changed": {"s": True}}}, "is not a string value"),
        ({"where": {"k": lambda c: True}}, "belongs in when"),
        ({"when": {"k": 3}}, "belongs in where"),
        ({"when": {"a__b": lambda c: True}}, "contains '__'"),
    ],
)
def test_checks_that_read_no_rows(frame, options, message):
    with pytest.raises(errors.ValidationError, match=message):
        add(frame, **options)
    assert add(frame, **options, validate=False).table_names == ("t",)


def test_checks_that_read_rows(spark, frame):
    null = spark.createDataFrame([(1, day(3), day(2)), (None, day(1), None), (1, day(1), None)], "id long, made timestamp_ntz, changed timestamp_ntz")
    with pytest.raises(errors.ValidationError, match="1 null values"):
        add(null, validate="non_null_primary_key")
    with pytest.raises(errors.ValidationError, match="3 rows, 2 distinct"):
        add(null, validate=["unique_primary_key"])
    with pytest.raises(errors.ValidationError, match="before row_creation_time 'made' in 1 rows"):
        add(null, row_creation_time="made", row_update_times={"changed": {}}, validate="ordered_row_times")
    assert add(frame, row_creation_time="made", row_update_times={"changed": {}}, validate=True).validate()
    with pytest.raises(ValueError, match="unknown check 'x'"):
        add(frame, validate="x")
    with pytest.raises(ValueError, match="invalid checks selector"):
        add(frame, validate=3)
    assert len(checks.TABLE_CHECKS) == 13 and len(checks.DEFAULT_TABLE_CHECKS) == 10


def test_a_failed_addition_changes_nothing(frame):
    db = relfeat.Database("x")
    with pytest.raises(errors.ValidationError):
        db.add_table("t", frame, "id", "s")
    assert db.table_names == ()
    db.add_table("t", frame, "id")
    with pytest.raises(errors.SchemaError, match="already"):
        db.add_table("t", frame, "id")
    with pytest.raises(TypeError, match="Spark DataFrame"):
        db.add_table("u", [1, 2])


def test_warnings(frame):
    with pytest.warns(errors.MissingPrimaryKeyWarning):
        relfeat.Database("x").add_table("t", frame)
    with pytest.warns(errors.ImplicitEarlierValueWarning, match="read as null"):
        db = relfeat.Database("x").add_table("t", frame, "id", row_update_times={"changed": {"s": "z"}})
    assert db.get_schema("t").row_update_times == {"changed": {"s": "z", "changed": None}}


def test_relationships(spark, frame):
    child = spark.createDataFrame([(7, 9, 1), (8, None, 1)], "id long, t_id long, small int")
    db = add(frame).add_table("c", child, "id")
    for arguments, message in ((("t", "no", "t_id"), "unknown table"), (("t", "c", "no"), "missing foreign_key"), (("t", "c", ["t_id"]), "composite")):
        with pytest.raises(errors.SchemaError, match=message):
            db.add_relationship(*arguments)
    with pytest.raises(errors.ValidationError, match="is int, but primary_key"):
        db.add_relationship("t", "c", "small")
    with pytest.raises(errors.ValidationError, match="matches any"):
        db.add_relationship("t", "c", "t_id", validate="overlapping_keys")
    assert db.relationships == ()
    db.add_relationship("t", "c", "t_id")
    assert db.children_of("t") == db.parents_of("c") == list(db.relationships)
    with pytest.raises(errors.ValidationError, match="matches any"):
        db.validate()
    assert db.validate(relationships=False) is db
    assert db.input_excluded_columns("c") == {"id", "t_id"}


def test_cutoff_times(frame, spark):
    db = add(frame, row_creation_time="made")
    with pytest.raises(TypeError, match="datetime"):
        db.as_of(dt.date(2024, 1, 1))
    with pytest.raises(errors.ValidationError, match="tz-aware, but"):
        db.as_of(dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc))
    early = db.as_of(day(1))
    assert [r[0] for r in early.get_keys("t").collect()] == [1] and db.cutoff_time is None
    with pytest.warns(errors.OverwrittenCutoffTimeWarning):
        assert early.as_of(None).get_table("t").count() == 2
    aware = spark.createDataFrame([(1, day(1)), (2, day(5))], "id long, at timestamp")
    zoned = relfeat.Database("z").add_table("t", aware, "id", "at")
    moment = dt.datetime(2024, 1, 2, 1, tzinfo=dt.timezone(dt.timedelta(hours=2)))
    assert zoned.as_of(moment).get_table("t").count() == 1
    with pytest.raises(errors.ValidationError, match="tz-naive"):
        zoned.as_of(day(2))
    with pytest.raises(errors.ValidationError, match="mixes"):
        db.add_table("u", aware, "id").validate()


def test_families(spark):
    T = __import__("pyspark.sql.types", fromlist=["x"])
    assert matches(T.DecimalType(5, 2), DtypeFamily.NUMERIC) and matches(T.DateType(), DtypeFamily.HAS_DATE) and not matches(T.DateType(), DtypeFamily.HAS_TIME)
    assert matches(T.TimestampNTZType(), DtypeFamily.TEMPORAL) and matches(T.DayTimeIntervalType(), DtypeFamily.DURATION) and not matches(T.DayTimeIntervalType(), DtypeFamily.HAS_TIME)
    assert not matches(Categorical(), DtypeFamily.STRING) and matches(Enumerated(("a",)), DtypeFamily.CATEGORICAL) and matches(T.MapType(T.StringType(), T.StringType()), DtypeFamily.ANY)
    with pytest.raises(ValueError, match="unknown"):
        matches(T.StringType(), "string")


def test_diagrams(shop, tmp_path):
    text = str(shop.plot(config={"theme": "forest"}))
    assert text.startswith('---\ntitle: "shop"\nconfig: {"theme": "forest"}\n---\nerDiagram\n')
    assert '  "buyers" {\n    Long id PK\n    Long age\n    Categorical area\n    TimestampNTZ joined "row creation time"\n  }\n' in text
    assert '    Long buyer_id FK "-> buyers"\n' in text and '  "buyers" 1 to 0+ "orders" : ""\n' in text
    assert "age" not in shop.plot("structural").source and "{" not in shop.plot(False).source
    shop.plot().save(tmp_path / "d.md")
    assert (tmp_path / "d.md").read_text() == shop._repr_markdown_()
    with pytest.raises(ValueError, match="unsupported suffix"):
        shop.plot().save(tmp_path / "d.txt")
    with pytest.raises(ValueError, match="columns must be"):
        shop.plot("some")
    with pytest.raises(ImportError):
        shop.plot().save(tmp_path / "d.svg")
    from relfeat.diagram import column_token, table_token

    assert column_token("1 a:b") == "_1 a_b" and table_token('a"%') == '"a_"' and column_token("") == "_"


def test_one_to_one_edge(spark):
    a, b = (spark.createDataFrame([(1,)], "id long") for _ in range(2))
    db = relfeat.Database("x").add_table("a", a, "id").add_table("b", b, "id").add_relationship("a", "b", "id")
    assert '"a" 1 to zero or one "b" : ""' in db.plot().source


def test_reserved_names_are_refused(spark):
    frame = spark.createDataFrame([(1, 2.0)], "id long, __rf_1 double")
    with pytest.raises(errors.SchemaError, match="reserved"):
        relfeat.Database("x").add_table("t", frame, "id")
