"""Feature matrices for requested keys, in their order.

fit reads a schema and no rows; transform computes. Keys are a DataFrame whose first column holds them, or a Python list.
Both work on a database, which is given to fit and, if other rows are meant, to transform again.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relfeat.errors import SchemaError
from relfeat.functions import named
from relfeat.plans.features import FeatureList
from relfeat.plans.synthesis import Specs, synthesize
from relfeat.sources.checks import check_cutoff_time
from relfeat.sources.database import Database

#: Where a requested key stands among the others; the matrix is sorted by it.
POSITION = "__rf_position"


def requested(keys: Any, database: Database, target: str) -> DataFrame:
    """(key, position) of the keys asked for, of the target's own key type. No key may be asked for twice."""
    primary = database.require_primary_key(target)
    table = database.get_table(target)
    kind = table.schema[primary].dataType
    if isinstance(keys, DataFrame):
        if len(keys.columns) != 1:
            raise TypeError(f"keys must be one column; got {keys.columns}")
        # An order that Spark keeps: by partition, then by row within it.
        frame = keys.select(named(keys.columns[0]).cast(kind).alias("key"), F.monotonically_increasing_id().alias(POSITION))
        again = frame.groupBy("key").count().where("count > 1").limit(1)
        if not again.isEmpty():
            raise SchemaError("keys repeat; the matrix has one row a key, so ask for each once")
        return frame
    try:
        listed = list(keys)
    except TypeError:
        raise TypeError(f"keys must be a DataFrame or an iterable of key values; got {type(keys).__name__}") from None
    if listed and hasattr(listed[0], "__len__") and not isinstance(listed[0], (str, bytes)):
        raise TypeError(f"keys must be one-dimensional, but elements are {type(listed[0]).__name__}; pass the keys themselves")
    if len(set(listed)) != len(listed):
        raise SchemaError("keys repeat; the matrix has one row a key, so ask for each once")
    plain = [k.item() if hasattr(k, "item") else k for k in listed]
    schema = T.StructType([T.StructField("key", kind), T.StructField(POSITION, T.LongType())])
    return table.sparkSession.createDataFrame([(k, i) for i, k in enumerate(plain)], schema)


class DFSTransformer:
    """Deep feature synthesis as a stage: fit chooses features, transform gives their matrix for keys."""

    def __init__(self, target_table: str, agg_primitives: Specs = None, trans_primitives: Specs = None, conditional_primitives: Specs = None, max_depth: int = 2) -> None:
        self.target_table, self.max_depth = target_table, max_depth
        self.agg_primitives, self.trans_primitives, self.conditional_primitives = agg_primitives, trans_primitives, conditional_primitives
        self.features_: FeatureList | None = None

    def fit(self, keys: Any = None, y: Any = None, *, database: Database | None = None, cutoff_time: datetime | None = None) -> DFSTransformer:
        """Synthesize. Keys and y aren't read."""
        if database is None:
            raise SchemaError("no database supplied; pass database=... to fit")
        check_cutoff_time(database, cutoff_time)
        self.database_, self.cutoff_time_ = database, cutoff_time
        self.features_ = synthesize(database, self.target_table, self.agg_primitives, self.trans_primitives, self.conditional_primitives, self.max_depth)
        return self

    def _matrix(self, keys: Any, database: Database | None, cutoff_time: datetime | None) -> DataFrame:
        """Position, key and features of the keys asked for; keys that aren't there at the cutoff time are an error."""
        if self.features_ is None:
            raise SchemaError(f"this {type(self).__name__} is not fitted yet")
        database = self.database_ if database is None else database
        cutoff_time = self.cutoff_time_ if cutoff_time is None else cutoff_time
        primary = database.require_primary_key(self.target_table)
        asked = requested(keys, database, self.target_table)
        visible = database.as_of(cutoff_time).get_keys(self.target_table, sort=False).select(named(primary).alias("key"))
        missing = asked.join(visible, "key", "left_anti")
        if some := [r[0] for r in missing.limit(5).collect()]:
            raise SchemaError(f"no row for {missing.count()} of {asked.count()} keys, e.g. {some}; they are absent from {primary!r} or were created after the cutoff time")
        rows = self.features_.apply(database, cutoff_time)
        # An inner join on the key filters the matrix; Spark broadcasts the keys if they are few.
        return asked.join(rows, named("key") == named(primary)).drop("key")

    def transform(self, keys: Any, *, database: Database | None = None, cutoff_time: datetime | None = None) -> DataFrame:
        """The features of the keys, in their order, without the key."""
        rows = self._matrix(keys, database, cutoff_time)
        return rows.orderBy(POSITION).select(*(named(n) for n in self.get_feature_names_out()))

    def fit_transform(self, keys: Any, y: Any = None, *, database: Database | None = None, cutoff_time: datetime | None = None) -> DataFrame:
        return self.fit(keys, y, database=database, cutoff_time=cutoff_time).transform(keys, database=database, cutoff_time=cutoff_time)

    def get_feature_names_out(self) -> list[str]:
        if self.features_ is None:
            raise SchemaError(f"this {type(self).__name__} is not fitted yet")
        return list(self.features_.output_names)


def check_columns(names: Iterable[str], frame: DataFrame) -> None:
    missing = [n for n in names if n not in frame.columns]
    if missing:
        raise SchemaError(f"columns {missing[:3]} are not in the table")
