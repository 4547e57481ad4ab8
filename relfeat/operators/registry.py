"""Primitives by name."""

from __future__ import annotations

import dataclasses
from collections.abc import Iterable
from typing import TypeVar

from relfeat.errors import PrimitiveError
from relfeat.operators.base import Primitive

_KNOWN: dict[str, type[Primitive]] = {}
P = TypeVar("P", bound=type[Primitive])


def register(cls: P) -> P:
    """Class decorator that makes a primitive known by its name."""
    if _KNOWN.setdefault(cls.name, cls) is not cls:
        raise PrimitiveError(f"primitive name {cls.name!r} is already registered")
    return cls


def known() -> dict[str, type[Primitive]]:
    return dict(_KNOWN)


def resolve(spec: str | Primitive) -> Primitive:
    """A primitive from its name (with its default parameters), or an instance itself."""
    if not isinstance(spec, Primitive):
        if spec not in _KNOWN:
            raise PrimitiveError(f"unknown primitive {spec!r}; available: {', '.join(sorted(_KNOWN))}")
        spec = _KNOWN[spec]()
    made = getattr(type(spec), "__dataclass_params__", None) if "__dataclass_params__" in vars(type(spec)) else None
    if made is None or not (made.frozen and made.eq) or not dataclasses.is_dataclass(spec):
        raise PrimitiveError(f"primitive {type(spec).__name__!r} needs @dataclass(frozen=True): features are compared by value")
    return spec


def resolve_all(specs: Iterable[str | Primitive]) -> tuple[Primitive, ...]:
    return tuple(resolve(s) for s in specs)
