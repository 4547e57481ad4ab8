"""Compilation of feature definitions into one lazy DataFrame.

For each relationship there is one group-by and one join, however many features cross it and whatever conditions they have:
a condition masks the aggregates' inputs instead of filtering rows. Aggregations that can't take a mask get a group-by of
their own. Distinct values are counted for all columns together: each row gives narrow ones, (key, which column, 128 bits of
hash), whose repeats go before the shuffle and whose hot keys spread by the hash. Transforms are added by levels of depth, one
projection each, so that windows of one group share their sort. Inside the plan, computed columns have names of their own; the final projection gives them their
public ones. Tables that several features reach by different ways are built once.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import datetime
from itertools import groupby
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relfeat.errors import PrimitiveError, SchemaError, ValidationError
from relfeat.functions import instant, named, truth
from relfeat.operators.base import AggregationPrimitive, Group, GroupRelativeAggregationPrimitive, GroupTransformPrimitive, NeedsCutoffTime, OrderedAggregationPrimitive, OrderedTransformPrimitive, Primitive, ValueCountAggregationPrimitive
from relfeat.plans.features import Feature, Kind
from relfeat.sources.checks import time_zone_awareness
from relfeat.sources.schema import RESERVED, Relationship
from relfeat.types import metadata

if TYPE_CHECKING:
    from relfeat.plans.features import FeatureList
    from relfeat.sources.database import Database

_NARROW = (T.ByteType, T.ShortType, T.IntegerType)


def compile_features(features: FeatureList, database: Database, cutoff_time: datetime | None = None) -> DataFrame:
    """The target's primary key and a column for each feature output; a row for each target row visible at the cutoff time."""
    database = database.as_of(cutoff_time)
    key = database.require_primary_key(features.target_table)
    _reject_collisions(features, key)
    needed = closure(features)
    _require_cutoff_time(needed, cutoff_time)
    plan = _Planner(database)
    table = plan.table(features.target_table, needed)
    outputs = {key: named(key)}
    for f in features:
        for name, column in zip(f.output_names, plan.columns(f), strict=True):
            outputs.setdefault(name, named(column).alias(name, metadata=meta) if (meta := metadata(f.dtype)) else named(column).alias(name))
    return table.select(*outputs.values())


def closure(features: Iterable[Feature]) -> frozenset[Feature]:
    """The features and all that they are computed from: layer by layer, until a layer brings nothing new."""
    layer = frozenset(features)
    whole = layer
    while layer := frozenset(i for f in layer for i in f.inputs) - whole:
        whole |= layer
    return whole


def _reject_collisions(features: FeatureList, key: str) -> None:
    """Names must differ, in more than case, as Spark resolves them without regard to it. The key itself may be asked for."""
    made = [(key.lower(), "the primary key", None)]
    made += [(n.lower(), f.display_name, f) for f in dict.fromkeys(features) for n in f.output_names if f.kind is not Kind.RAW or n != key]
    for name, group in groupby(sorted(made, key=lambda m: m[0]), key=lambda m: m[0]):
        if len(same := list(group)) > 1:
            raise SchemaError(f"column {name!r} would stand for {' and for '.join(repr(shown) for _, shown, _ in same)}: both compile to column names that Spark can't tell apart, so rename a source column")


def _require_cutoff_time(features: Iterable[Feature], cutoff_time: datetime | None) -> None:
    if cutoff_time is not None:
        return
    measuring = {f.primitive.name for f in features if isinstance(f.primitive, NeedsCutoffTime)}
    measuring |= {f"when condition {f.condition[1]!r}" for f in features if f.condition and f.condition[0] == "when"}
    if measuring:
        raise ValidationError(f"{', '.join(sorted(measuring))} needs a cutoff_time; pass one when applying the features")


class _Planner:
    def __init__(self, database: Database) -> None:
        self.database = database
        self.cutoff = None if database.cutoff_time is None else instant(database.cutoff_time)
        self.midnight = "timestamp" if time_zone_awareness(database) else "timestamp_ntz"
        self._columns: dict[Feature, tuple[str, ...]] = {}
        self._built: dict[tuple[str, frozenset[Feature]], DataFrame] = {}
        self._made = 0

    def _new(self) -> str:
        self._made += 1
        return f"{RESERVED}{self._made}"

    def columns(self, feature: Feature) -> tuple[str, ...]:
        """The feature's columns inside the plan."""
        if feature.kind is Kind.RAW:
            return (feature.column,)
        if feature not in self._columns:
            self._columns[feature] = tuple(self._new() for _ in feature.output_names)
        return self._columns[feature]

    def table(self, name: str, needed: frozenset[Feature]) -> DataFrame:
        """The table at the cutoff time, with columns for all needed features that are on it."""
        own = frozenset(f for f in needed if f.table == name)
        if (name, own) not in self._built:
            self._built[name, own] = self._build(name, own)
        return self._built[name, own]

    def _build(self, name: str, own: frozenset[Feature]) -> DataFrame:
        table = self.database.get_table(name)
        ordered = sorted(own, key=lambda f: (f.depth, f.name))
        of = lambda kind, link: [f for f in ordered if f.kind is kind and f.link == link]
        lost = [f for f in ordered if f.link is not None and f.kind is not Kind.GROUP and f.link not in self.database.relationships]
        if lost:
            raise SchemaError(f"feature {lost[0].display_name!r} needs {lost[0].link}, which this database lacks")
        for link in self.database.children_of(name):
            if batch := of(Kind.CHILDREN, link):
                table = self._aggregated(table, link, batch)
        for link in self.database.parents_of(name):
            if batch := of(Kind.PARENT, link):
                table = self._direct(table, link, batch)
        transforms = [f for f in ordered if f.kind in (Kind.ROW, Kind.GROUP)]
        for _, level in groupby(transforms, key=lambda f: f.depth):
            table = table.select("*", *(c.alias(n) for f in level for c, n in zip(self._transformed(f), self.columns(f), strict=True)))
        return table

    # Inputs and contexts of primitives

    def _inputs(self, primitive: Primitive, bases: Sequence[Feature]) -> list[Column]:
        out = []
        for base in bases:
            column = named(self.columns(base)[0])
            if primitive.widen and isinstance(base.dtype, _NARROW):
                column = column.cast("bigint")
            if primitive.as_timestamps and isinstance(base.dtype, T.DateType):
                column = column.cast(self.midnight)
            out.append(column)
        return out

    def _measure(self, primitive: Primitive) -> dict[str, Any]:
        return {"cutoff": self.cutoff} if isinstance(primitive, NeedsCutoffTime) else {}

    def _order(self, table: str, primitive: Primitive) -> list[Column]:
        """Creation time, then the primary key to part equal times."""
        schema = self.database.get_schema(table)
        if schema.row_creation_time is None:
            raise PrimitiveError(f"primitive {primitive.name!r} is order-dependent, so table {table!r} needs a row_creation_time")
        return [named(c) for c in (schema.row_creation_time, schema.primary_key) if c is not None]

    # Transforms

    def _transformed(self, feature: Feature) -> tuple[Column, ...]:
        primitive = feature.primitive
        context = self._measure(primitive)
        if isinstance(primitive, GroupTransformPrimitive):
            key = named(feature.link.foreign_key)
            order = Window.partitionBy(key).orderBy(*self._order(feature.table, primitive)) if isinstance(primitive, OrderedTransformPrimitive) else None
            context["group"] = Group(lambda *more: Window.partitionBy(key, *more), order)
        return primitive.outputs(*self._inputs(primitive, feature.inputs), **context)

    # Joins

    def _direct(self, table: DataFrame, link: Relationship, batch: Sequence[Feature]) -> DataFrame:
        parent, key = self.table(link.parent, closure(f.inputs[0] for f in batch)), self._new()
        carried = (named(self.columns(f.inputs[0])[0]).alias(self.columns(f)[0]) for f in batch)
        parent = parent.select(named(self.database.require_primary_key(link.parent)).alias(key), *carried)
        return table.join(parent, named(link.foreign_key) == named(key), "left").drop(key)

    def _aggregated(self, table: DataFrame, link: Relationship, batch: Sequence[Feature]) -> DataFrame:
        child = self.table(link.child, closure(b for f in batch for b in f.inputs))
        # A null foreign key has no parent, so its rows would be grouped for nothing.
        child = child.where(named(link.foreign_key).isNotNull())
        masks = {c: self._mask(link.child, c) for c in dict.fromkeys(f.condition for f in batch) if c}
        takes_rows = lambda f: isinstance(f.primitive, AggregationPrimitive) and f.primitive.takes_rows
        together = [f for f in batch if f.condition is None or takes_rows(f)]
        distinct = [f for f in together if hasattr(f.primitive, "from_distinct")]
        if rest := [f for f in together if f not in distinct]:
            table = self._joined(table, link, child, rest, masks)
        if distinct:
            table = self._joined_distinct(table, link, child, distinct, masks)
        for condition, mask in masks.items():
            if apart := [f for f in batch if f.condition == condition and not takes_rows(f)]:
                table = self._joined(table, link, child.where(mask), apart, {})
        return table

    def _mask(self, table: str, condition: tuple[str, str]) -> Column:
        kind, key = condition
        schema = self.database.get_schema(table)
        declared = schema.where if kind == "where" else schema.when
        if key not in declared:
            raise SchemaError(f"{kind} condition {key!r} is not declared on table {table!r}; declare it in add_table({kind}=...) or drop the feature")
        return truth(declared[key] if kind == "where" else declared[key](self.database.cutoff_time))

    def _joined(self, table: DataFrame, link: Relationship, child: DataFrame, batch: Sequence[Feature], masks: dict[tuple[str, str], Column]) -> DataFrame:
        """The table with the child's aggregates. masks: of the conditions that are computed without filtering."""
        used = {f.condition: self._new() for f in batch if f.condition in masks}
        if used:
            child = child.select("*", *(masks[c].alias(n) for c, n in used.items()))
        rows = {c: named(n) for c, n in used.items()}
        child, compared = self._compared(child, link, batch, rows)
        outputs: list[Column] = []
        defaults: dict[str, Any] = {}
        for f in batch:
            primitive, mask = f.primitive, rows.get(f.condition)
            context = self._measure(primitive)
            if takes := isinstance(primitive, AggregationPrimitive) and primitive.takes_rows:
                context["rows"] = mask
            if isinstance(primitive, OrderedAggregationPrimitive):
                context["order"] = F.struct(*self._order(link.child, primitive))
            inputs = [named(compared[f])] if f in compared else self._inputs(primitive, f.inputs)
            for column, name in zip(primitive.outputs(*inputs, **context), self.columns(f), strict=True):
                # A group without any row that the condition keeps is an absent one.
                outputs.append((F.when(F.count_if(mask) > 0, column) if takes and mask is not None else column).alias(name))
                if primitive.default_value is not None:
                    defaults[name] = primitive.default_value
        key = self._new()
        grouped = child.groupBy(named(link.foreign_key).alias(key)).agg(*outputs)
        return self._filled(table, link, grouped, key, batch, defaults)

    def _joined_distinct(self, table: DataFrame, link: Relationship, child: DataFrame, batch: Sequence[Feature], masks: dict[tuple[str, str], Column]) -> DataFrame:
        """The table with the aggregates that count distinct values of the child's columns."""
        which: dict[tuple, int] = {}
        values: list[Column] = []
        of: dict[Feature, int] = {}
        for f in batch:
            value = f.primitive.distinct(*self._inputs(f.primitive, f.inputs))
            counted = (type(f.primitive).distinct, f.inputs, f.condition)
            if counted not in which:
                which[counted] = len(values)
                # Null is a value; both hashes skip nulls, so whether there is one is hashed along.
                row = F.struct(F.lit(len(values)).alias("c"), F.xxhash64(value.isNull(), value).alias("a"), F.xxhash64(value, F.lit(1), value.isNull()).alias("b"))
                values.append(F.when(masks[f.condition], row) if f.condition else row)
            of[f] = which[counted]
        key, one, rows = self._new(), self._new(), self._new()
        narrow = child.select(named(link.foreign_key).alias(key), F.explode(F.array(*values)).alias(one)).where(named(one).isNotNull())
        counted = narrow.groupBy(key, f"{one}.c", f"{one}.a", f"{one}.b").agg(F.count("*").alias(rows))
        sums = [(F.count_if(F.col("c") == i), F.sum(F.when(F.col("c") == i, named(rows)))) for i in range(len(values))]
        outputs, defaults = [], {}
        for f in batch:
            n, total = sums[of[f]]
            (name,) = self.columns(f)
            built = f.primitive.from_distinct(n, total)
            outputs.append(F.when(total > 0, built).alias(name))  # without rows, the group is an absent one
            if f.primitive.default_value is not None:
                defaults[name] = f.primitive.default_value
        return self._filled(table, link, counted.groupBy(key).agg(*outputs), key, batch, defaults)

    def _filled(self, table: DataFrame, link: Relationship, grouped: DataFrame, key: str, batch: Sequence[Feature], defaults: dict[str, Any]) -> DataFrame:
        """The table with the groups of its rows, and defaults where there is none."""
        own = named(self.database.require_primary_key(link.parent))
        before = table.columns
        table = table.join(grouped, own == named(key), "left")
        filled = (F.coalesce(named(n), F.lit(defaults[n])).alias(n) if n in defaults else named(n) for f in batch for n in self.columns(f))
        return table.select(*(named(c) for c in before), *filled)

    def _compared(self, child: DataFrame, link: Relationship, batch: Sequence[Feature], rows: dict[Any, Column]) -> tuple[DataFrame, dict[Feature, str]]:
        """The child with the columns that compare its rows with their groups, and which feature has which."""
        relative = [f for f in batch if isinstance(f.primitive, GroupRelativeAggregationPrimitive)]
        if not relative:
            return child, {}
        key = named(link.foreign_key)
        # Windows and group-by all work within foreign keys: dealt by it once, no more shuffles are needed.
        child = child.repartition(key)

        def window(f: Feature, *more: Column) -> WindowSpec:
            return Window.partitionBy(key, *([rows[f.condition]] if f.condition in rows else []), *more)

        counts = {f: self._new() for f in relative if isinstance(f.primitive, ValueCountAggregationPrimitive)}
        if counts:
            value = {f: named(self.columns(f.inputs[0])[0]) for f in counts}
            child = child.select("*", *(F.when(value[f].isNotNull(), F.count("*").over(window(f, value[f]))).alias(n) for f, n in counts.items()))
        compared = {f: self._new() for f in relative}
        columns = []
        for f, name in compared.items():
            inputs = self._inputs(f.primitive, f.inputs) + ([named(counts[f])] if f in counts else [])
            columns.append(f.primitive.compare_with_group(*inputs, group=Group(lambda *more, f=f: window(f, *more))).alias(name))
        return child.select("*", *columns), compared
