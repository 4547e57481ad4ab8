"""Feature synthesis with selection: features that feed no selected column are never computed again.

fit computes the whole matrix once, encodes it, selects encoded columns, traces them to features by the columns' metadata, and
refits the encoder on those features alone. transform computes and encodes only them.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime
from typing import Any

from pyspark.ml.feature import UnivariateFeatureSelector, VarianceThresholdSelector, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relfeat.errors import EncoderError, LineageError, LineageWarning, SchemaError, UnencodedFeatureWarning
from relfeat.functions import named
from relfeat.ml.encoders import TableEncoder, find_group, schema_of
from relfeat.ml.transformer import POSITION, DFSTransformer, requested
from relfeat.plans.features import Feature, FeatureList
from relfeat.plans.synthesis import Specs
from relfeat.sources.database import Database
from relfeat.types import metadata


@dataclass
class TopVarianceSelector:
    """Keeps columns whose variance is above the threshold."""

    threshold: float = 0.0

    def select(self, frame: DataFrame, columns: Sequence[str], label: str | None) -> list[str]:
        model = VarianceThresholdSelector(featuresCol="__rf_vector", outputCol="__rf_out", varianceThreshold=self.threshold).fit(_vectors(frame, columns))
        return [columns[i] for i in model.selectedFeatures]


@dataclass
class UnivariateSelector:
    """Keeps the columns that a univariate test against the label scores best. label_type and mode as in Spark ML."""

    threshold: float = 10
    label_type: str = "categorical"
    mode: str = "numTopFeatures"

    def select(self, frame: DataFrame, columns: Sequence[str], label: str | None) -> list[str]:
        if label is None:
            raise SchemaError("this selector needs labels; pass y to fit")
        selector = UnivariateFeatureSelector(featuresCol="__rf_vector", outputCol="__rf_out", labelCol=label, selectionMode=self.mode).setFeatureType("continuous").setLabelType(self.label_type).setSelectionThreshold(self.threshold)
        return [columns[i] for i in selector.fit(_vectors(frame, columns)).selectedFeatures]


def _vectors(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """With columns as one vector. Nulls and NaN become 0, which the tests can't take otherwise. Names may hold any character."""
    plain = {f"__rf_c{i}": F.coalesce(F.nanvl(named(c), F.lit(0.0)), F.lit(0.0)) for i, c in enumerate(columns)}
    return VectorAssembler(inputCols=list(plain), outputCol="__rf_vector").transform(frame.withColumns(plain)).drop(*plain)


class DFSSelector(DFSTransformer):
    """Deep feature synthesis, encoding and selection as one stage.

    encoder: anything with fit(frame), transform(frame, keep) and get_feature_names_out(); a TableEncoder if None. Its columns'
    metadata name their sources. selector: anything with select(frame, columns, label), giving the names to keep.
    """

    def __init__(self, target_table: str, selector: Any = None, encoder: Any = None, agg_primitives: Specs = None, trans_primitives: Specs = None, conditional_primitives: Specs = None, max_depth: int = 2) -> None:
        super().__init__(target_table, agg_primitives, trans_primitives, conditional_primitives, max_depth)
        self.selector, self.encoder = selector, encoder
        self.kept_names_: list[str] | None = None

    def fit(self, keys: Any = None, y: Any = None, *, database: Database | None = None, cutoff_time: datetime | None = None) -> DFSSelector:
        """keys: the rows to learn from; y: their labels, as a list for a list of keys or a DataFrame of (key, label)."""
        selector = TopVarianceSelector() if self.selector is None else self.selector
        if not hasattr(selector, "select"):
            raise EncoderError(f"selector must have select(frame, columns, label); got {type(selector).__name__}")
        encoder = TableEncoder() if self.encoder is None else self.encoder
        for needed in ("fit", "transform", "get_feature_names_out"):
            if not hasattr(encoder, needed):
                raise EncoderError(f"encoder {type(encoder).__name__} has no {needed}(); selection must know the names of encoded columns")
        super().fit(keys, database=database, cutoff_time=cutoff_time)
        # Read several times: by the encoder, the selector and the encoder again.
        matrix = self._typed(self._matrix(keys, None, None)).persist()
        try:
            matrix, label = self._labelled(matrix, keys, y)
            features = matrix.select(*map(named, self.features_.output_names))
            fitted = encoder.fit(features)
            encoded = fitted.transform(matrix, keep=[POSITION, *([label] if label else [])])
            names = list(fitted.get_feature_names_out())
            sources = {n: encoded.schema[n].metadata.get("sources", []) for n in names}
            numbers = [n for n in names if encoded.schema[n].dataType.typeName() == "double"]
            kept = [n for n in selector.select(encoded, numbers, label)]
            self.features_ = FeatureList(self._feeding(kept, sources))
            columns = list(self.features_.output_names)
            self.encoder_ = encoder.fit(features.select(*map(named, columns)))
            again = set(self.encoder_.get_feature_names_out())
            if lost := [n for n in kept if n not in again]:
                raise LineageError(f"{len(lost)} selected columns vanished when the encoder was refit on the kept features, e.g. {lost[:3]}; their metadata named too few sources")
            self.kept_names_ = [n for n in self.encoder_.get_feature_names_out() if n in set(kept)]
        finally:
            matrix.unpersist()
        return self

    def _typed(self, matrix: DataFrame) -> DataFrame:
        """With metadata on outputs whose feature is categorical."""
        meta = {n: m for f in self.features_ for n in f.output_names if (m := metadata(f.dtype))}
        return matrix.select(*(named(c).alias(c, metadata=meta[c]) if c in meta else named(c) for c in matrix.columns))

    def _labelled(self, matrix: DataFrame, keys: Any, y: Any) -> tuple[DataFrame, str | None]:
        if y is None:
            return matrix, None
        label = "__rf_label"
        if isinstance(y, DataFrame):
            asked = requested(keys, self.database_, self.target_table)
            key, value = y.columns
            y = asked.join(y.select(named(key).alias("key"), named(value).cast("double").alias(label)), "key").select(POSITION, label)
        else:
            if isinstance(keys, DataFrame):
                raise TypeError("labels of keys in a DataFrame are a DataFrame of (key, label)")
            listed = [float(v) for v in y]
            y = matrix.sparkSession.createDataFrame(list(enumerate(listed)), f"{POSITION} long, {label} double")
        return matrix.join(y, POSITION), label

    def _feeding(self, kept: Sequence[str], sources: dict[str, list[str]]) -> list[Feature]:
        """The features that feed a kept column; all of them if a kept column doesn't tell."""
        if not kept:
            raise SchemaError("feature selection eliminated every feature")
        if opaque := [n for n in kept if not sources[n]]:
            warnings.warn(f"{len(opaque)} selected columns do not name their inputs (e.g. {opaque[:3]}), so no feature has been dropped. Selection still applies.", LineageWarning, stacklevel=3)
            return list(self.features_)
        touched = {s for found in sources.values() for s in found}
        if idle := [n for n in self.features_.output_names if n not in touched]:
            warnings.warn(f"{len(idle)} features fed no encoded column (e.g. {idle[:3]}) and have been dropped; the encoder has no use for their kinds.", UnencodedFeatureWarning, stacklevel=3)
        live = {s for n in kept for s in sources[n]}
        return [f for f in self.features_ if live.intersection(f.output_names)]

    def transform(self, keys: Any, *, database: Database | None = None, cutoff_time: datetime | None = None) -> DataFrame:
        """The kept encoded columns of the keys, in their order."""
        if self.kept_names_ is None:
            raise SchemaError("this DFSSelector is not fitted yet")
        matrix = self._typed(self._matrix(keys, database, cutoff_time))
        encoded = self.encoder_.transform(matrix, keep=[POSITION])
        return encoded.orderBy(POSITION).select(*map(named, self.kept_names_))

    def get_feature_names_out(self) -> list[str]:
        if self.kept_names_ is None:
            raise SchemaError("this DFSSelector is not fitted yet")
        return list(self.kept_names_)


def groups(frame: DataFrame) -> dict[str, str]:
    """The kind of each column of a table."""
    return {n: find_group(d) for n, d in schema_of(frame).items()}
