"""The primitives and the classes to write more of them."""

from __future__ import annotations

from relfeat.operators import aggregation as _aggregation
from relfeat.operators import transform as _transform
from relfeat.operators.aggregation import AGG_DEFAULTS, CONDITIONAL_DEFAULTS
from relfeat.operators.base import (
    AggregationPrimitive,
    Group,
    GroupRelativeAggregationPrimitive,
    GroupTransformPrimitive,
    NeedsCutoffTime,
    OrderedAggregationPrimitive,
    OrderedTransformPrimitive,
    Primitive,
    TransformPrimitive,
    ValueCountAggregationPrimitive,
)
from relfeat.operators.registry import known, register, resolve, resolve_all
from relfeat.operators.transform import TRANS_DEFAULTS
from relfeat.types import DtypeFamily

_BUILT_IN = {v.__name__: v for m in (_aggregation, _transform) for v in vars(m).values() if isinstance(v, type) and issubclass(v, Primitive) and v.__module__ == m.__name__ and "name" in vars(v)}
globals().update(_BUILT_IN)

__all__ = [
    "AGG_DEFAULTS",
    "CONDITIONAL_DEFAULTS",
    "TRANS_DEFAULTS",
    "AggregationPrimitive",
    "DtypeFamily",
    "Group",
    "GroupRelativeAggregationPrimitive",
    "GroupTransformPrimitive",
    "NeedsCutoffTime",
    "OrderedAggregationPrimitive",
    "OrderedTransformPrimitive",
    "Primitive",
    "TransformPrimitive",
    "ValueCountAggregationPrimitive",
    "known",
    "register",
    "resolve",
    "resolve_all",
    *sorted(_BUILT_IN),
]
