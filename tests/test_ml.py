"""Pipeline stages: matrices for keys, table encoding, selection."""

from __future__ import annotations

import datetime as dt
import warnings
from decimal import Decimal

import numpy as np
import pytest
from helpers import day

from relfeat import errors
from relfeat.ml import DateEncoder, DatetimeEncoder, DFSSelector, DFSTransformer, DurationEncoder, OneHotColumns, TableEncoder, TfIdfSvdEncoder, TopVarianceSelector, UnivariateSelector
from relfeat.ml.encoders import char_grams


@pytest.fixture(autouse=True)
def silent():
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        yield


def test_rows_come_in_the_order_of_keys(shop, spark):
    stage = DFSTransformer("buyers", ["count", "sum"], [], (), 1).fit(database=shop)
    assert [tuple(r) for r in stage.transform([3, 1]).select("COUNT__orders", "age").collect()] == [(0, 50), (2, 30)]
    assert [r["age"] for r in stage.transform(spark.createDataFrame([(2,), (1,)], "id long").coalesce(1)).collect()] == [40, 30]
    assert stage.get_feature_names_out() == stage.transform([1]).columns and "id" not in stage.get_feature_names_out()
    assert stage.transform(np.array([2])).count() == 1


def test_keys_that_cannot_be_served(shop):
    stage = DFSTransformer("buyers", ["count"], [], (), 1)
    with pytest.raises(errors.SchemaError, match="not fitted"):
        stage.transform([1])
    with pytest.raises(errors.SchemaError, match="no database"):
        stage.fit([1])
    stage.fit(database=shop, cutoff_time=day(2))
    for keys, kind, message in (([1, 1], errors.SchemaError, "repeat"), ([[1], [2]], TypeError, "one-dimensional"), (7, TypeError, "iterable"), ([1, 3], errors.SchemaError, r"no row for 1 of 2 keys, e.g. \[3\]")):
        with pytest.raises(kind, match=message):
            stage.transform(keys)
    assert [r[0] for r in stage.transform([1, 3], cutoff_time=day(9)).select("COUNT__orders").collect()] == [2, 0]


@pytest.fixture
def kinds(spark):
    rows = [(1, Decimal("1.5"), True, "red fox", "x", "b", dt.date(2024, 2, 3), dt.datetime(2024, 5, 6, 7, 8, 9, 123456), dt.timedelta(seconds=-90), [1]), (2, None, None, None, None, None, None, None, None, None), (3, Decimal("2.5"), False, "red dog", "y", "a", dt.date(2023, 12, 31), dt.datetime(2023, 1, 2), dt.timedelta(days=1), [])]
    frame = spark.createDataFrame(rows, "n long, x decimal(5,2), b boolean, s string, c string, e string, d date, w timestamp_ntz, u interval day to second, l array<long>")
    return frame.withMetadata("c", {"logical": "categorical"}).withMetadata("e", {"logical": "enum", "categories": ["b", "a"]})


def test_every_kind_is_encoded(kinds):
    encoder = TableEncoder(string=TfIdfSvdEncoder(2)).fit(kinds)
    got = encoder.transform(kinds).orderBy("numeric__n")
    assert got.columns == encoder.get_feature_names_out() == ["numeric__n", "numeric__x", "boolean__b", "string__s_svd_0", "string__s_svd_1", "categorical__c_x", "categorical__c_y", "categorical__c_None", "enum__e", "date__d_month", "date__d_day", "datetime__w_month", "datetime__w_day", "datetime__w_hour", "datetime__w_minute", "duration__u_total_seconds"]
    rows = got.collect()
    assert [rows[0][c] for c in ("numeric__x", "boolean__b", "categorical__c_x", "categorical__c_y", "enum__e", "date__d_month", "datetime__w_minute", "duration__u_total_seconds")] == [1.5, 1.0, 1.0, 0.0, 0.0, 2.0, 8.0, -90.0]
    assert rows[2]["enum__e"] == 1.0 and rows[1]["enum__e"] is None and rows[1]["categorical__c_None"] == 1.0 and rows[1]["numeric__x"] is None
    assert rows[1]["string__s_svd_0"] == 0.0
    assert got.schema["string__s_svd_1"].metadata["sources"] == ["s"]
    other = TableEncoder(string="drop", other="passthrough").fit(kinds)
    assert "other__l" in other.get_feature_names_out()


def test_components(kinds):
    schema = {"w": kinds.schema["w"].dataType}
    fitted = DatetimeEncoder(["year", "weekday", "ordinal_day", "millisecond", "microsecond", "nanosecond"]).fit(kinds, schema)
    assert list(kinds.where("n = 1").select(*(c for _, _, c in fitted.columns())).first()) == [2024, 1, 127, 123, 123456, 123456000]
    total = DurationEncoder(["total_minutes", "total_milliseconds"]).fit(kinds, {"u": kinds.schema["u"].dataType})
    assert list(kinds.where("n = 1").select(*(c for _, _, c in total.columns())).first()) == [-1, -90000]
    with pytest.raises(ValueError, match="no component 'hour'"):
        DateEncoder(["hour"]).fit(kinds, {"d": kinds.schema["d"].dataType})
    with pytest.raises(TypeError, match="as a list"):
        DateEncoder("month").fit(kinds, {"d": kinds.schema["d"].dataType})
    with pytest.raises(errors.EncoderError, match="encodes date columns; column 'w'"):
        DateEncoder().fit(kinds, schema)
    with pytest.raises(ValueError, match="is not an encoder"):
        TableEncoder(numeric="other").fit(kinds)
    with pytest.raises(errors.EncoderError, match="more than 1 labels"):
        OneHotColumns(1).fit(kinds, {"c": __import__("relfeat.types", fromlist=["x"]).Categorical()})
    with pytest.raises(errors.EncoderError, match="are missing"):
        TableEncoder(string="drop").fit(kinds).transform(kinds.drop("x"))


def test_text_directions_keep_distances(spark):
    texts = ["red fox", "red dog", "blue whale", "a blue whale", "grey", "", None, "fox dog", "whale fox", "red red"]
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, s string")
    fitted = TfIdfSvdEncoder(40).fit(frame, {"s": frame.schema["s"].dataType})
    got = np.array([list(r[0]) for r in fitted.prepare(frame).orderBy("id").select("__rf_svd_s").collect()])
    model = fitted.models_["s"]
    whole = np.zeros((len(texts), len(model.places)))
    for row, text in zip(whole, texts, strict=True):
        at, x = model.weights(text)
        row[at] = x
    assert np.allclose(got @ got.T, whole @ whole.T, atol=1e-6)
    assert char_grams("Ab c") == [" ab", "ab ", " ab ", " c "]


def test_selection_prunes_features(shop):
    stage = DFSSelector("buyers", TopVarianceSelector(0.0), TableEncoder(string="drop"), ["count", "sum", "n_unique"], ["year", "month"], (), 1)
    got = stage.fit_transform([1, 2, 3], database=shop)
    names = stage.get_feature_names_out()
    assert got.columns == names and "numeric__age" in names
    assert not any("YEAR" in n or "MONTH" in n for n in names)  # all in one month
    assert not any("YEAR" in n for n in stage.features_.output_names) and len(stage.features_) < len(DFSTransformer("buyers", ["count", "sum", "n_unique"], ["year", "month"], (), 1).fit(database=shop).features_)
    assert [r["numeric__age"] for r in stage.transform([2, 1]).collect()] == [40.0, 30.0]


def test_selection_by_labels(shop, spark):
    stage = DFSSelector("buyers", UnivariateSelector(1, mode="numTopFeatures"), TableEncoder(string="drop"), ["count"], [], (), 1)
    stage.fit([1, 2, 3], [0, 0, 1], database=shop)
    assert len(stage.get_feature_names_out()) == 1
    with pytest.raises(errors.SchemaError, match="needs labels"):
        stage.fit([1, 2, 3], database=shop)
    with pytest.raises(errors.EncoderError, match="selector must have"):
        DFSSelector("buyers", 3).fit([1], database=shop)

    class Nothing:
        def select(self, frame, columns, label):
            return []

    with pytest.raises(errors.SchemaError, match="eliminated every feature"):
        DFSSelector("buyers", Nothing(), TableEncoder(string="drop"), ["count"], [], (), 1).fit([1, 2], database=shop)
