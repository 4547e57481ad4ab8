"""Column types: Spark's own, categorical and enumerated strings, and the families that primitives accept.

Spark has no categorical type. A string column is categorical or an enumeration by its field's metadata
({"logical": "categorical"}, or {"logical": "enum", "categories": [...]}), or by declaration. A feature's type
comes from its definition, as metadata don't survive expressions.
"""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum
from typing import Any

from pyspark.sql import types as T

#: Absent from some builds, and off by default where present.
TimeType: type | None = getattr(T, "TimeType", None)


@dataclass(frozen=True)
class Categorical:
    """A string column whose values are labels."""

    def simpleString(self) -> str:
        return "categorical"


@dataclass(frozen=True)
class Enumerated:
    """A string column of known labels in order."""

    categories: tuple[str, ...]

    def simpleString(self) -> str:
        return f"enum[{len(self.categories)}]"


class DtypeFamily(Enum):
    """What a primitive's input slot accepts."""

    NUMERIC = "numeric"
    TEMPORAL = "temporal"
    HAS_DATE = "has_date"
    HAS_TIME = "has_time"
    DURATION = "duration"
    STRING = "string"
    CATEGORICAL = "categorical"
    BOOLEAN = "boolean"
    ANY = "any"


_INSTANTS = (T.TimestampType, T.TimestampNTZType)
_TIMES = (TimeType,) if TimeType else ()
_MEMBERS: dict[DtypeFamily, tuple[type, ...]] = {
    DtypeFamily.NUMERIC: (T.NumericType,),
    DtypeFamily.TEMPORAL: (T.DateType, *_INSTANTS, *_TIMES, T.DayTimeIntervalType),
    DtypeFamily.HAS_DATE: (T.DateType, *_INSTANTS),
    DtypeFamily.HAS_TIME: (*_INSTANTS, *_TIMES),
    DtypeFamily.DURATION: (T.DayTimeIntervalType,),
    DtypeFamily.STRING: (T.StringType,),
    DtypeFamily.CATEGORICAL: (Categorical, Enumerated),
    DtypeFamily.BOOLEAN: (T.BooleanType,),
}


def matches(dtype: Any, family: DtypeFamily) -> bool:
    """Whether a type belongs to a family. Strings and categoricals are disjoint."""
    if family is DtypeFamily.ANY:
        return True
    if family not in _MEMBERS:
        raise ValueError(f"unknown dtype family {family!r}")
    return isinstance(dtype, _MEMBERS[family])


def is_datetime(dtype: Any) -> bool:
    return isinstance(dtype, _INSTANTS)


def is_aware(dtype: Any) -> bool:
    return isinstance(dtype, T.TimestampType)


def logical(field: T.StructField, categorical: frozenset[str] = frozenset()) -> Any:
    """A field's type, with what its metadata or a declaration say about a string column."""
    if isinstance(field.dataType, T.StringType):
        meta = field.metadata or {}
        if meta.get("logical") == "enum":
            return Enumerated(tuple(meta.get("categories", ())))
        if meta.get("logical") == "categorical" or field.name in categorical:
            return Categorical()
    return field.dataType


def physical(dtype: Any) -> T.DataType:
    return T.StringType() if isinstance(dtype, (Categorical, Enumerated)) else dtype


def metadata(dtype: Any) -> dict[str, Any] | None:
    """The metadata that say of a string column what the type says."""
    if isinstance(dtype, Categorical):
        return {"logical": "categorical"}
    if isinstance(dtype, Enumerated):
        return {"logical": "enum", "categories": list(dtype.categories)}
    return None


def describe(dtype: Any) -> str:
    return dtype.simpleString()
