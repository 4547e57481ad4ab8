"""Built-in aggregations."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relfeat.errors import PrimitiveError
from relfeat.functions import n_unique, truth
from relfeat.operators.base import AggregationPrimitive, Group, GroupRelativeAggregationPrimitive, NeedsCutoffTime, OrderedAggregationPrimitive, ValueCountAggregationPrimitive
from relfeat.operators.registry import register
from relfeat.types import DtypeFamily as D

#: What a request without agg_primitives, or without conditional_primitives, gets. Fixed values.
AGG_DEFAULTS = ("count", "sum", "mean", "min", "max", "std", "n_unique", "skew", "percent_true", "mode")
CONDITIONAL_DEFAULTS = ("count", "sum")

LONG, DOUBLE, BOOLEAN = T.LongType(), T.DoubleType(), T.BooleanType()


def _where(column: Column, rows: Column | None) -> Column:
    """The column where the condition holds, else null."""
    return column if rows is None else F.when(rows, column)


class _Reduced(AggregationPrimitive):
    """An aggregate that skips nulls: a condition may turn other rows' values into nulls."""

    takes_rows = True

    def build(self, column: Column, *, rows: Column | None = None) -> Column | Sequence[Column]:
        return self.reduce(_where(column, rows))

    def reduce(self, column: Column) -> Column | Sequence[Column]:
        raise NotImplementedError


@register
@dataclass(frozen=True)
class Count(AggregationPrimitive):
    """Rows."""

    name, output_dtype, default_value, stack_on_self, takes_rows = "count", LONG, 0, False, True

    def build(self, *, rows: Column | None = None) -> Column:
        return F.count("*") if rows is None else F.count_if(rows)


@register
@dataclass(frozen=True)
class Sum(_Reduced):
    """Sum; 0 without values."""

    name, input_dtypes, default_value = "sum", (D.NUMERIC,), 0

    def reduce(self, column: Column) -> Column:
        return F.sum(column)


@register
@dataclass(frozen=True)
class Mean(_Reduced):
    """Mean."""

    name, input_dtypes, output_dtype = "mean", (D.NUMERIC,), DOUBLE

    def reduce(self, column: Column) -> Column:
        return F.avg(column)


@register
@dataclass(frozen=True)
class Min(_Reduced):
    """Smallest value."""

    name, input_dtypes = "min", (D.NUMERIC,)

    def reduce(self, column: Column) -> Column:
        return F.min(column)


@register
@dataclass(frozen=True)
class Max(_Reduced):
    """Largest value."""

    name, input_dtypes = "max", (D.NUMERIC,)

    def reduce(self, column: Column) -> Column:
        return F.max(column)


@register
@dataclass(frozen=True)
class Std(_Reduced):
    """Sample standard deviation; null for one value."""

    name, input_dtypes, output_dtype = "std", (D.NUMERIC,), DOUBLE

    def reduce(self, column: Column) -> Column:
        return F.stddev_samp(column)


@register
@dataclass(frozen=True)
class Variance(_Reduced):
    """Sample variance; null for one value."""

    name, input_dtypes, output_dtype = "variance", (D.NUMERIC,), DOUBLE

    def reduce(self, column: Column) -> Column:
        return F.var_samp(column)


@register
@dataclass(frozen=True)
class Median(_Reduced):
    """Exact median."""

    name, input_dtypes, output_dtype = "median", (D.NUMERIC,), DOUBLE

    def reduce(self, column: Column) -> Column:
        return F.median(column)


@register
@dataclass(frozen=True)
class Quantiles(_Reduced):
    """Exact quantiles by linear interpolation, one output each."""

    qs: tuple[float, ...] = (0.25, 0.5, 0.75)
    name, input_dtypes, output_dtype = "quantiles", (D.NUMERIC,), DOUBLE

    @property
    def number_of_outputs(self) -> int:
        return len(self.qs)

    def reduce(self, column: Column) -> Sequence[Column]:
        # One aggregate: Spark computes equal expressions once.
        found = F.percentile(column, F.array(*[F.lit(float(q)) for q in self.qs]))
        return [found[i] for i in range(len(self.qs))]


@register
@dataclass(frozen=True)
class Skew(_Reduced):
    """Skewness of the population; null without spread."""

    name, input_dtypes, output_dtype = "skew", (D.NUMERIC,), DOUBLE

    def reduce(self, column: Column) -> Column:
        return F.when(F.stddev_samp(column) > 0, F.skewness(column))


@register
@dataclass(frozen=True)
class Kurtosis(_Reduced):
    """Excess kurtosis of the population; null without spread."""

    name, input_dtypes, output_dtype = "kurtosis", (D.NUMERIC,), DOUBLE

    def reduce(self, column: Column) -> Column:
        return F.when(F.stddev_samp(column) > 0, F.kurtosis(column))


@register
@dataclass(frozen=True)
class MaxMinDelta(_Reduced):
    """Largest value less the smallest."""

    name, input_dtypes, widen = "max_min_delta", (D.NUMERIC,), True

    def reduce(self, column: Column) -> Column:
        return F.max(column) - F.min(column)


@register
@dataclass(frozen=True)
class FirstLastTimeDelta(_Reduced):
    """Latest moment less the earliest."""

    name, input_dtypes, output_dtype, as_timestamps = "first_last_time_delta", (D.HAS_DATE,), T.DayTimeIntervalType, True

    def return_dtype(self, input_dtypes: Sequence[object]) -> T.DataType:
        return T.DayTimeIntervalType()

    def reduce(self, column: Column) -> Column:
        return F.max(column) - F.min(column)


@register
@dataclass(frozen=True)
class Mode(_Reduced):
    """Most frequent value, the smallest of equals; null only without values."""

    name, input_dtypes = "mode", ((D.STRING,), (D.CATEGORICAL,))

    def reduce(self, column: Column) -> Column:
        return F.mode(column, True)


@register
@dataclass(frozen=True)
class AllTrue(AggregationPrimitive):
    """Whether no flag is false; true if all are null."""

    name, input_dtypes, output_dtype, takes_rows = "all_true", (D.BOOLEAN,), BOOLEAN, True

    def build(self, flag: Column, *, rows: Column | None = None) -> Column:
        return F.coalesce(F.bool_and(_where(flag, rows)), F.lit(True))


@register
@dataclass(frozen=True)
class AnyTrue(_Reduced):
    """Whether a flag is true."""

    name, input_dtypes, output_dtype, default_value = "any_true", (D.BOOLEAN,), BOOLEAN, False

    def reduce(self, flag: Column) -> Column:
        return F.bool_or(flag)


@register
@dataclass(frozen=True)
class NTrue(_Reduced):
    """True flags."""

    name, input_dtypes, output_dtype, default_value = "n_true", (D.BOOLEAN,), LONG, 0

    def reduce(self, flag: Column) -> Column:
        return F.count_if(truth(flag))


@register
@dataclass(frozen=True)
class PercentTrue(AggregationPrimitive):
    """Share of true flags among all rows; null counts as false."""

    name, input_dtypes, output_dtype, takes_rows = "percent_true", (D.BOOLEAN,), DOUBLE, True

    def build(self, flag: Column, *, rows: Column | None = None) -> Column:
        return F.avg(_where(truth(flag).cast("bigint"), rows))


@register
@dataclass(frozen=True)
class NUnique(AggregationPrimitive):
    """Distinct values, null being one."""

    name, input_dtypes, output_dtype, default_value, stack_on_self, takes_rows = "n_unique", (D.ANY,), LONG, 0, False, True

    def build(self, column: Column, *, rows: Column | None = None) -> Column:
        return n_unique(column, rows)

    def distinct(self, column: Column) -> Column:
        return column

    def from_distinct(self, n: Column, rows: Column) -> Column:
        return n


def _n(rows: Column | None) -> Column:
    return F.count("*") if rows is None else F.count_if(rows)


@register
@dataclass(frozen=True)
class IsUnique(AggregationPrimitive):
    """Whether no value repeats, null being one."""

    name, input_dtypes, output_dtype, takes_rows = "is_unique", (D.ANY,), BOOLEAN, True

    def build(self, column: Column, *, rows: Column | None = None) -> Column:
        return n_unique(column, rows) == _n(rows)

    def distinct(self, column: Column) -> Column:
        return column

    def from_distinct(self, n: Column, rows: Column) -> Column:
        return n == rows


@register
@dataclass(frozen=True)
class PercentUnique(AggregationPrimitive):
    """Distinct values, null being one, as a share of the rows."""

    name, input_dtypes, output_dtype, takes_rows = "percent_unique", (D.ANY,), DOUBLE, True

    def build(self, column: Column, *, rows: Column | None = None) -> Column:
        return n_unique(column, rows) / F.nullif(_n(rows), F.lit(0))

    def distinct(self, column: Column) -> Column:
        return column

    def from_distinct(self, n: Column, rows: Column) -> Column:
        return n / rows


class _NUniqueOf(AggregationPrimitive):
    """Distinct calendar positions, null being one."""

    takes_rows = True

    def build(self, moment: Column, *, rows: Column | None = None) -> Column:
        return n_unique(self.distinct(moment), rows)

    def distinct(self, moment: Column) -> Column:
        raise NotImplementedError

    def from_distinct(self, n: Column, rows: Column) -> Column:
        return n


@register
@dataclass(frozen=True)
class NUniqueDays(_NUniqueOf):
    """Distinct dates."""

    name, input_dtypes, output_dtype, default_value = "n_unique_days", (D.HAS_DATE,), LONG, 0

    def distinct(self, moment: Column) -> Column:
        return F.to_date(moment)


@register
@dataclass(frozen=True)
class NUniqueDaysOfCalendarYear(_NUniqueOf):
    """Distinct month and day pairs."""

    name, input_dtypes, output_dtype, default_value = "n_unique_days_of_calendar_year", (D.HAS_DATE,), LONG, 0

    def distinct(self, moment: Column) -> Column:
        return F.month(moment) * 100 + F.dayofmonth(moment)


@register
@dataclass(frozen=True)
class NUniqueDaysOfMonth(_NUniqueOf):
    """Distinct days of the month."""

    name, input_dtypes, output_dtype, default_value = "n_unique_days_of_month", (D.HAS_DATE,), LONG, 0

    def distinct(self, moment: Column) -> Column:
        return F.dayofmonth(moment)


@register
@dataclass(frozen=True)
class NUniqueMonths(_NUniqueOf):
    """Distinct months of distinct years."""

    name, input_dtypes, output_dtype, default_value = "n_unique_months", (D.HAS_DATE,), LONG, 0

    def distinct(self, moment: Column) -> Column:
        return F.year(moment) * 12 + F.month(moment)


class _TimeSince(NeedsCutoffTime, AggregationPrimitive):
    """The cutoff time less a moment of the group."""

    output_dtype, as_timestamps, takes_rows = T.DayTimeIntervalType, True, True

    def return_dtype(self, input_dtypes: Sequence[object]) -> T.DataType:
        return T.DayTimeIntervalType()

    def build(self, *inputs: Column, cutoff: Column, rows: Column | None = None) -> Column:
        first, *rest = inputs
        return cutoff - self.moment(_where(first, rows), *rest)

    def moment(self, *inputs: Column) -> Column:
        raise NotImplementedError


@register
@dataclass(frozen=True)
class TimeSinceFirst(_TimeSince):
    """Time since the earliest moment."""

    name, input_dtypes = "time_since_first", (D.HAS_DATE,)

    def moment(self, moment: Column) -> Column:
        return F.min(moment)


@register
@dataclass(frozen=True)
class TimeSinceLast(_TimeSince):
    """Time since the latest moment."""

    name, input_dtypes = "time_since_last", (D.HAS_DATE,)

    def moment(self, moment: Column) -> Column:
        return F.max(moment)


@register
@dataclass(frozen=True)
class TimeSinceLastTrue(_TimeSince):
    """Time since the latest moment with a true flag."""

    name, input_dtypes = "time_since_last_true", (D.HAS_DATE, D.BOOLEAN)

    def moment(self, moment: Column, flag: Column) -> Column:
        return F.max(F.when(flag, moment))


@register
@dataclass(frozen=True)
class TimeSinceLastFalse(_TimeSince):
    """Time since the latest moment with a false flag."""

    name, input_dtypes = "time_since_last_false", (D.HAS_DATE, D.BOOLEAN)

    def moment(self, moment: Column, flag: Column) -> Column:
        return F.max(F.when(~flag, moment))


class _Extreme(OrderedAggregationPrimitive):
    """A row's value, null too, chosen by order. Rows whose order is null don't count."""

    takes_rows = True
    pick: Callable[..., Column]

    def build(self, column: Column, *, order: Column, rows: Column | None = None) -> Column:
        return type(self).pick(column, _where(order, rows))


@register
@dataclass(frozen=True)
class First(_Extreme):
    """The earliest row's value."""

    name, input_dtypes, stack_on_self, pick = "first", (D.ANY,), False, staticmethod(F.min_by)


@register
@dataclass(frozen=True)
class Last(_Extreme):
    """The latest row's value."""

    name, input_dtypes, stack_on_self, pick = "last", (D.ANY,), False, staticmethod(F.max_by)


@register
@dataclass(frozen=True)
class Entropy(ValueCountAggregationPrimitive):
    """Entropy of the values' shares, with natural logarithms, null being a value."""

    name, input_dtypes, output_dtype, stack_on_self, takes_rows = "entropy", ((D.STRING,), (D.CATEGORICAL,)), DOUBLE, False, True

    def compare_with_group(self, column: Column, counts: Column, *, group: Group) -> Column:
        # A value's part of the entropy, dealt evenly to its rows. Nulls have no count of their own.
        n = group.over(F.count("*"))
        same = F.coalesce(counts, group.over(F.count_if(column.isNull())))
        return F.log(n / same) / n

    def build(self, compared: Column, *, rows: Column | None = None) -> Column:
        return F.sum(_where(compared, rows))


class _CountRelative(GroupRelativeAggregationPrimitive):
    """How many rows' comparisons hold."""

    takes_rows = True

    def build(self, compared: Column, *, rows: Column | None = None) -> Column:
        return F.count_if(truth(_where(compared, rows)))


@register
@dataclass(frozen=True)
class CountAboveMean(_CountRelative):
    """Values above the group's mean."""

    name, input_dtypes, output_dtype, default_value, stack_on_self = "count_above_mean", (D.NUMERIC,), LONG, 0, False

    def compare_with_group(self, column: Column, *, group: Group) -> Column:
        return column > group.over(F.avg(column))


@register
@dataclass(frozen=True)
class CountBelowMean(_CountRelative):
    """Values below the group's mean."""

    name, input_dtypes, output_dtype, default_value, stack_on_self = "count_below_mean", (D.NUMERIC,), LONG, 0, False

    def compare_with_group(self, column: Column, *, group: Group) -> Column:
        return column < group.over(F.avg(column))


class _NthStd(_CountRelative):
    n: float

    def __post_init__(self) -> None:
        if self.n < 0:
            raise PrimitiveError(f"primitive {self.name!r} needs n >= 0; got {self.n}")

    @property
    def stem(self) -> str:
        number = int(self.n) if self.n == int(self.n) else self.n
        return f"COUNT_{self.side}_{str(number).replace('.', '_')}_STD"

    side: str

    def inside(self, column: Column, group: Group) -> Column:
        """Whether |x - mean| <= n * std. Where whole numbers make both sides times the count, squared, exact in doubles, that
        is what is compared: a value just n deviations away is inside, in whatever order rows come. Else rounded as they are."""
        x, n = column.cast("double"), float(self.n)
        rounded = F.abs(column - group.over(F.avg(column))) <= group.over(F.stddev_pop(column)) * F.lit(n)
        count, total = group.over(F.count(x)).cast("double"), group.over(F.sum(x))
        away, spread = count * x - total, count * group.over(F.sum(x * x)) - total * total
        exact = group.over(F.min(x == F.rint(x))) & (16 * max(1.0, n * n) * (count * group.over(F.max(F.abs(x)))) * (count * group.over(F.max(F.abs(x)))) < float(1 << 50))
        return F.when(exact, away * away <= spread * F.lit(n * n)).otherwise(rounded)


@register
@dataclass(frozen=True)
class CountInsideNthStd(_NthStd):
    """Values within n standard deviations (of the population) of the group's mean."""

    n: float = 1
    name, side, input_dtypes, output_dtype, default_value, stack_on_self = "count_inside_nth_std", "INSIDE", (D.NUMERIC,), LONG, 0, False

    def compare_with_group(self, column: Column, *, group: Group) -> Column:
        return self.inside(column, group)


@register
@dataclass(frozen=True)
class CountOutsideNthStd(_NthStd):
    """Values beyond n standard deviations (of the population) from the group's mean."""

    n: float = 1
    name, side, input_dtypes, output_dtype, default_value, stack_on_self = "count_outside_nth_std", "OUTSIDE", (D.NUMERIC,), LONG, 0, False

    def compare_with_group(self, column: Column, *, group: Group) -> Column:
        return ~self.inside(column, group)
