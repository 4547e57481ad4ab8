"""Columns of any type turned into numbers.

An encoder is fitted on a table's schema (and, where it must, on its rows) and then gives a list of named double columns, so that a
whole table is encoded by one projection. Encoded columns name the column they come from in their metadata
({"sources": [...]}), which selection reads.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any, ClassVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relfeat.errors import EncoderError
from relfeat.functions import named
from relfeat.types import Categorical, Enumerated, TimeType, describe, logical

#: Kinds of column, in the order of their blocks.
GROUPS = ("numeric", "boolean", "string", "categorical", "enum", "date", "time", "datetime", "duration", "other")


def schema_of(frame: DataFrame, categorical: Sequence[str] = ()) -> dict[str, Any]:
    labels = frozenset(categorical)
    return {f.name: logical(f, labels) for f in frame.schema}


def find_group(dtype: Any) -> str:
    """The kind of a type."""
    kinds: tuple[tuple[str, tuple[type, ...]], ...] = (
        ("numeric", (T.NumericType,)),
        ("boolean", (T.BooleanType,)),
        ("categorical", (Categorical,)),
        ("enum", (Enumerated,)),
        ("string", (T.StringType,)),
        ("date", (T.DateType,)),
        ("time", (TimeType,) if TimeType else ()),
        ("datetime", (T.TimestampType, T.TimestampNTZType)),
        ("duration", (T.DayTimeIntervalType,)),
    )
    return next((name for name, types in kinds if isinstance(dtype, types)), "other")


class Encoder:
    """Base of encoders: fit takes the columns to encode, columns() gives what they become."""

    accepts: ClassVar[str] = ""
    names_: list[str]

    def fit(self, frame: DataFrame, schema: Mapping[str, Any]) -> Encoder:
        """A fitted copy."""
        fitted = replace(self) if hasattr(self, "__dataclass_fields__") else type(self)()
        for name, dtype in schema.items():
            if find_group(dtype) != self.accepts:
                raise EncoderError(f"{type(self).__name__} encodes {self.accepts} columns; column {name!r} is {describe(dtype)}")
        fitted.schema_ = dict(schema)
        fitted.learn(frame)
        return fitted

    def learn(self, frame: DataFrame) -> None:
        """Read rows, if the encoder must."""

    def prepare(self, frame: DataFrame) -> DataFrame:
        """Add columns that columns() reads, if a single expression can't do."""
        return frame

    def columns(self) -> list[tuple[str, str, Column]]:
        """(new name, source column, expression) of each encoded column."""
        raise NotImplementedError


def _seconds(duration: Column) -> Column:
    return duration.cast("interval day to second").cast("decimal(20,6)")


_DATE: dict[str, Callable[[Column], Column]] = {"year": F.year, "month": F.month, "day": F.dayofmonth, "weekday": lambda c: F.weekday(c) + 1, "ordinal_day": F.dayofyear, "timestamp": lambda c: F.unix_micros(c.cast("timestamp"))}
_TIME: dict[str, Callable[[Column], Column]] = {
    "hour": F.hour,
    "minute": F.minute,
    "second": F.second,
    "millisecond": lambda c: F.floor(_fraction(c) * 1000),
    "microsecond": lambda c: F.floor(_fraction(c) * 1000000),
    "nanosecond": lambda c: F.floor(_fraction(c) * 1000000) * 1000,
}


def _fraction(moment: Column) -> Column:
    return F.date_part(F.lit("second"), moment) % 1


_TOTAL: dict[str, Callable[[Column], Column]] = {"total_minutes": lambda c: _whole(_seconds(c) / 60), "total_seconds": lambda c: _whole(_seconds(c)), "total_milliseconds": lambda c: _whole(_seconds(c) * 1000), "total_microseconds": lambda c: _whole(_seconds(c) * 1000000), "total_nanoseconds": lambda c: _whole(_seconds(c) * 1000000) * 1000}


def _whole(number: Column) -> Column:
    """Without its fraction, towards zero."""
    return F.when(number < 0, F.ceil(number)).otherwise(F.floor(number))


class _Components(Encoder):
    known: ClassVar[Mapping[str, Callable[[Column], Column]]]
    components: Sequence[str]

    def learn(self, frame: DataFrame) -> None:
        if isinstance(self.components, str):
            raise TypeError(f"{type(self).__name__} takes components as a list, such as [{next(iter(self.known))!r}], not the string {self.components!r}")
        for c in self.components:
            if c not in self.known:
                raise ValueError(f"{type(self).__name__} has no component {c!r}; choose from {list(self.known)}")

    def columns(self) -> list[tuple[str, str, Column]]:
        return [(f"{name}_{c}", name, self.known[c](named(name))) for name in self.schema_ for c in self.components]


@dataclass
class DateEncoder(_Components):
    """Calendar components of dates."""

    components: Sequence[str] = ("month", "day")
    accepts, known = "date", _DATE


@dataclass
class TimeEncoder(_Components):
    """Components of times of day."""

    components: Sequence[str] = ("hour", "minute")
    accepts, known = "time", _TIME


@dataclass
class DatetimeEncoder(_Components):
    """Components of timestamps."""

    components: Sequence[str] = ("month", "day", "hour", "minute")
    accepts, known = "datetime", {**_DATE, **_TIME}


@dataclass
class DurationEncoder(_Components):
    """Durations in whole units, cut towards zero."""

    components: Sequence[str] = ("total_seconds",)
    accepts, known = "duration", _TOTAL


@dataclass
class EnumOrdinalEncoder(Encoder):
    """A label's place among its enumeration's; null stays null, and so does a label that isn't there."""

    accepts = "enum"

    def columns(self) -> list[tuple[str, str, Column]]:
        place = lambda name, labels: F.nullif(F.array_position(F.array(*map(F.lit, labels)), named(name)), F.lit(0)) - 1 if labels else F.lit(None)
        return [(name, name, place(name, dtype.categories)) for name, dtype in self.schema_.items()]


@dataclass
class OneHotColumns(Encoder):
    """A column for each label seen, null being one; labels not seen give zeros.

    most: labels of a column that are told apart at most, the commonest; a column with more is an error, not cut.
    """

    most: int = 1000
    accepts = "categorical"

    def learn(self, frame: DataFrame) -> None:
        self.labels_: dict[str, list[str | None]] = {}
        for name in self.schema_:
            found = [r[0] for r in frame.select(named(name).alias("label")).distinct().limit(self.most + 1).collect()]
            if len(found) > self.most:
                raise EncoderError(f"column {name!r} has more than {self.most} labels; raise most, or drop the column")
            self.labels_[name] = sorted(found, key=lambda v: (v is None, v or ""))

    def columns(self) -> list[tuple[str, str, Column]]:
        return [(f"{name}_{label}", name, named(name).eqNullSafe(F.lit(label)).cast("double")) for name, labels in self.labels_.items() for label in labels]


def char_grams(text: str | None) -> list[str]:
    """Runs of 3 and 4 characters of a text's lower-cased words, each word with a space on both sides."""
    out = []
    for word in (text or "").lower().split():
        padded = f" {word} "
        for n in (3, 4):
            out += [padded[i : i + n] for i in range(len(padded) - n + 1)]
    return out


@dataclass(frozen=True)
class _TextModel:
    """Places of known n-grams, their inverse document frequencies, and directions (n-grams by components)."""

    places: dict[str, int]
    idf: np.ndarray
    basis: np.ndarray | None = None

    def weights(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Places and weights of a text's n-grams; the weights' squares sum to 1."""
        counts = Counter(p for g in char_grams(text) if (p := self.places.get(g)) is not None)
        at = np.fromiter(counts.keys(), np.int64, len(counts))
        x = np.fromiter(counts.values(), np.float64, len(counts)) * self.idf[at]
        return at, x / max(float(np.sqrt(x @ x)), 1e-300)


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = Counter(g for text in batch.column(0).to_pylist() for g in set(char_grams(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["gram", "n"])


@dataclass
class TfIdfSvdEncoder(Encoder):
    """Texts by n-grams of 3 and 4 characters within words: TF-IDF, then n_components singular directions, zeros where there are
    fewer. vocabulary bounds the n-grams that count: those in most texts."""

    n_components: int = 30
    vocabulary: int = 1 << 14
    seed: int = 7
    accepts = "string"

    def learn(self, frame: DataFrame) -> None:
        self.models_ = {name: self._fit_column(frame.select(named(name).alias("text"))) for name in self.schema_}

    def _fit_column(self, texts: DataFrame) -> _TextModel | None:
        counts = texts.mapInArrow(_gram_counts, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
        kept = counts.orderBy(F.desc("n"), "gram").limit(self.vocabulary).collect()
        if not kept:
            return None
        idf = np.log((1 + texts.count()) / (1 + np.array([r["n"] for r in kept], float))) + 1
        model = _TextModel({r["gram"]: i for i, r in enumerate(kept)}, idf)
        if len(kept) < 2:
            return replace(model, basis=np.eye(1, self.n_components))
        return replace(model, basis=_right_singular(texts, model, min(self.n_components, len(kept)), self.seed, self.n_components))

    def prepare(self, frame: DataFrame) -> DataFrame:
        for name, model in self.models_.items():
            target = f"__rf_svd_{name}"
            if model is None:
                frame = frame.withColumn(target, F.array_repeat(F.lit(0.0), self.n_components))
                continue
            spread = frame.sparkSession.sparkContext.broadcast(model)

            def project(texts: Any, spread: Any = spread) -> Any:
                found = (spread.value.weights(t) for t in texts)
                return type(texts)([x @ spread.value.basis[at] for at, x in found])

            frame = frame.withColumn(target, F.pandas_udf(project, "array<double>", F.PandasUDFType.SCALAR)(named(name)))
        return frame

    def columns(self) -> list[tuple[str, str, Column]]:
        return [(f"{name}_svd_{i}", name, named(f"__rf_svd_{name}")[i]) for name in self.models_ for i in range(self.n_components)]


def _right_singular(texts: DataFrame, model: _TextModel, k: int, seed: int, pad: int) -> np.ndarray:
    """Leading right singular vectors of the texts' weights, by subspace iteration. Each pass sums products of rows on the
    executors and in a tree, so the driver holds a table of n-grams by components and no text."""
    width = len(model.places)
    size = min(width, k + 8)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, size)))[0]
    context, triangle = texts.sparkSession.sparkContext, np.eye(size)
    for _ in range(4):
        spread = context.broadcast((model, basis))

        def products(rows: Any, spread: Any = spread) -> Any:
            known, directions = spread.value
            out = np.zeros_like(directions)
            for (text,) in rows:
                at, x = known.weights(text)
                out[at] += np.outer(x, x @ directions[at])
            return [out]

        total = texts.rdd.mapPartitions(products).treeReduce(lambda a, b: a + b)
        basis, triangle = np.linalg.qr(total)
    left = np.linalg.svd(triangle)[0]
    return np.pad((basis @ left)[:, :k], ((0, 0), (0, pad - k)))


@dataclass
class TableEncoder:
    """Every column by its kind: an encoder, "passthrough" or "drop" for each of GROUPS. Columns are {group}__{name}."""

    numeric: Any = "passthrough"
    boolean: Any = "passthrough"
    string: Any = field(default_factory=TfIdfSvdEncoder)
    categorical: Any = field(default_factory=OneHotColumns)
    enum: Any = field(default_factory=EnumOrdinalEncoder)
    date: Any = field(default_factory=DateEncoder)
    time: Any = field(default_factory=TimeEncoder)
    datetime: Any = field(default_factory=DatetimeEncoder)
    duration: Any = field(default_factory=DurationEncoder)
    other: Any = "drop"

    def fit(self, frame: DataFrame, y: Any = None, *, categorical: Sequence[str] = ()) -> TableEncoder:
        """Read the schema, and rows where an encoder must."""
        self.schema_ = schema_of(frame, categorical)
        self.fitted_: dict[str, tuple[Any, list[str]]] = {}
        for group in GROUPS:
            columns = {n: d for n, d in self.schema_.items() if find_group(d) == group}
            chosen = getattr(self, group)
            if isinstance(chosen, str) and chosen not in ("passthrough", "drop") or not isinstance(chosen, (str, Encoder)):
                raise ValueError(f"{group}={chosen!r} is not an encoder, 'passthrough' or 'drop'")
            if columns and chosen != "drop":
                self.fitted_[group] = (chosen if chosen == "passthrough" else chosen.fit(frame, columns), list(columns))
        return self

    def _outputs(self) -> list[tuple[str, str, Column]]:
        out = []
        for group, (encoder, columns) in self.fitted_.items():
            if encoder == "passthrough":
                cast = "double" if group in ("numeric", "boolean") else None
                out += [(f"{group}__{n}", n, _as_number(named(n), self.schema_[n]) if cast else named(n)) for n in columns]
            else:
                out += [(f"{group}__{n}", source, column.cast("double")) for n, source, column in encoder.columns()]
        return out

    def get_feature_names_out(self) -> list[str]:
        return [name for name, _, _ in self._outputs()]

    def transform(self, frame: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """The encoded columns, after those to keep as they are."""
        if (now := {n: d for n, d in schema_of(frame).items() if n in self.schema_}).keys() != self.schema_.keys():
            raise EncoderError(f"columns {sorted(self.schema_.keys() - now.keys())[:3]} that the encoder was fitted on are missing")
        for encoder, _ in self.fitted_.values():
            if isinstance(encoder, Encoder):
                frame = encoder.prepare(frame)
        return frame.select(*map(named, keep), *(c.alias(n, metadata={"sources": [s]}) for n, s, c in self._outputs()))

    def fit_transform(self, frame: DataFrame, y: Any = None, *, categorical: Sequence[str] = ()) -> DataFrame:
        return self.fit(frame, y, categorical=categorical).transform(frame)


def _as_number(column: Column, dtype: Any) -> Column:
    return column.cast("int").cast("double") if isinstance(dtype, T.BooleanType) else column.cast("double")
