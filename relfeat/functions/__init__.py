"""Column expressions with the library's rules for nulls, zeros and infinities. They hold with ANSI mode on and off."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII punctuation as a character class.
PUNCTUATION = r"!-/:-@\x5B-\x60{-~"


def named(name: str) -> Column:
    """A column by its exact name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def instant(moment: datetime) -> Column:
    """A literal of the timestamp type that fits the value: with time zone if it has one, else without."""
    if moment.utcoffset() is None:
        return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")
    return F.lit(moment.astimezone(timezone.utc).isoformat(sep=" ")).cast("timestamp")


def truth(flag: Column) -> Column:
    """Null as false."""
    return F.coalesce(flag, F.lit(False))


def divide(left: Column, right: Column) -> Column:
    """Division by IEEE rules: x / 0 is infinite with x's sign, 0 / 0 is NaN."""
    left, right = left.cast("double"), right.cast("double")
    return F.when(right == 0, left * F.lit(float("inf"))).otherwise(left / right)


def natural_log(value: Column) -> Column:
    """Null below 0, -inf at 0."""
    value = value.cast("double")
    return F.when(value == 0, F.lit(float("-inf"))).when(value > 0, F.log(value))


def square_root(value: Column) -> Column:
    """Null below 0."""
    value = value.cast("double")
    return F.when(value >= 0, F.sqrt(value))


def floored_modulo(left: Column, right: Column) -> Column:
    """The remainder with the divisor's sign; null for a divisor of 0."""
    rest = F.try_mod(left, right)
    return F.when((rest != 0) & ((rest < 0) != (right < 0)), rest + right).otherwise(rest)


def words(text: Column) -> Column:
    """The words of a text: parted by white space, punctuation around them taken off, what is then empty left out."""
    bare = F.transform(F.split(text, r"\s+", -1), lambda w: F.regexp_replace(w, f"^[{PUNCTUATION}]+|[{PUNCTUATION}]+$", ""))
    return F.filter(bare, lambda w: w != "")


def domain(address: Column) -> Column:
    """The host of a URL or an e-mail address without scheme, user, "www.", port, path or query; null if empty."""
    bare = F.regexp_replace(address, r"^\s+|\s+$", "")
    return F.nullif(F.regexp_extract(bare, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/?]*@)?(?:www\.)?([^:/?]*)", 1), F.lit(""))


def any_null(value: Column) -> Column:
    """1 if the group holds a null, as an aggregate."""
    return F.max(value.isNull().cast("bigint"))


def n_unique(value: Column, rows: Column | None = None) -> Column:
    """Distinct values as an aggregate, null being one of them; only of rows where `rows` holds."""
    if rows is None:
        return F.count_distinct(value) + F.coalesce(any_null(value), F.lit(0).cast("bigint"))
    return F.count_distinct(F.when(rows, value)) + F.coalesce(F.max((rows & value.isNull()).cast("bigint")), F.lit(0).cast("bigint"))
