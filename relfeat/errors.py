"""Errors and warnings."""

from __future__ import annotations


class RelfeatError(Exception):
    """Base of the library's errors."""


class SchemaError(RelfeatError):
    """A declaration doesn't fit the tables, or a request doesn't fit the schema."""


class PrimitiveError(RelfeatError):
    """A primitive is unknown, malformed or used in the wrong place."""


class ValidationError(RelfeatError):
    """A validation check failed."""


class LineageError(RelfeatError):
    """Selected columns can no longer be traced to features."""


class EncoderError(RelfeatError):
    """An encoder can't encode what it was given."""


class MissingPrimaryKeyWarning(UserWarning):
    """A table has no primary key."""


class ImplicitEarlierValueWarning(UserWarning):
    """A row update time doesn't say what it held before; null is assumed."""


class OverwrittenCutoffTimeWarning(UserWarning):
    """A cutoff time replaced another one."""


class CategoricalDtypeWarning(UserWarning):
    """A text primitive skipped a categorical column."""


class UnmatchedPrimitiveWarning(UserWarning):
    """A requested primitive matched no columns anywhere."""


class UnmatchedConditionWarning(UserWarning):
    """Conditional primitives were requested, but no table declares a condition."""


class UnencodedFeatureWarning(UserWarning):
    """Features fed no encoded column and were dropped."""


class LineageWarning(UserWarning):
    """Encoded columns don't name their inputs, so no feature could be dropped."""
