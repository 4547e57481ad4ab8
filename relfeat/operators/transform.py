"""Built-in transforms: of rows, and of the rows of a foreign-key group."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relfeat.functions import divide, domain, floored_modulo, natural_log, square_root, words
from relfeat.operators.base import Group, GroupTransformPrimitive, NeedsCutoffTime, OrderedTransformPrimitive, TransformPrimitive
from relfeat.operators.registry import register
from relfeat.types import DtypeFamily as D

#: What a request without trans_primitives gets. Fixed values.
TRANS_DEFAULTS = ("year", "month", "day", "weekday")

BYTE, SHORT, INT, LONG, DOUBLE, BOOLEAN, STRING = T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.StringType()
_COMPARABLE = ((D.NUMERIC, D.NUMERIC), (D.HAS_DATE, D.HAS_DATE))
_EQUATABLE = (*_COMPARABLE, (D.BOOLEAN, D.BOOLEAN), (D.STRING, D.STRING))


def _row_wise(primitive: str, inputs: tuple, output: T.DataType | None, expression: Callable[..., Column], doc: str, *, commutative: bool = False, stack_on_self: bool = True, widen: bool = False) -> type[TransformPrimitive]:
    """Declare a row-wise primitive that is one expression."""

    class Made(TransformPrimitive):
        def build(self, *columns: Column) -> Column:
            return expression(*columns)

    Made.__name__ = Made.__qualname__ = "".join(part.title() for part in primitive.split("_"))
    Made.__doc__, Made.__module__ = doc, __name__
    Made.name, Made.input_dtypes, Made.output_dtype = primitive, inputs, output
    Made.commutative, Made.stack_on_self, Made.widen = commutative, stack_on_self, widen
    return register(dataclass(frozen=True)(Made))


# Dates and times
Year = _row_wise("year", (D.HAS_DATE,), INT, F.year, "Year.")
Month = _row_wise("month", (D.HAS_DATE,), BYTE, F.month, "Month, from 1.")
Day = _row_wise("day", (D.HAS_DATE,), BYTE, F.dayofmonth, "Day of the month, from 1.")
Hour = _row_wise("hour", (D.HAS_TIME,), BYTE, F.hour, "Hour.")
Weekday = _row_wise("weekday", (D.HAS_DATE,), BYTE, lambda c: F.weekday(c) + 1, "Day of the week, Monday being 1.")
IsWeekend = _row_wise("is_weekend", (D.HAS_DATE,), BOOLEAN, lambda c: F.weekday(c) >= 5, "Whether it is a Saturday or Sunday.")
Minute = _row_wise("minute", (D.HAS_TIME,), BYTE, F.minute, "Minute.")
Second = _row_wise("second", (D.HAS_TIME,), BYTE, F.second, "Second.")
DayOfYear = _row_wise("day_of_year", (D.HAS_DATE,), SHORT, F.dayofyear, "Day of the year, from 1.")
IsLeapYear = _row_wise("is_leap_year", (D.HAS_DATE,), BOOLEAN, lambda c: F.dayofyear(F.make_date(F.year(c), F.lit(12), F.lit(31))) == 366, "Whether the year has 366 days.")

# Numbers
Absolute = _row_wise("absolute", (D.NUMERIC,), None, F.abs, "Absolute value.")
NaturalLog = _row_wise("natural_log", (D.NUMERIC,), DOUBLE, natural_log, "Natural logarithm; null below 0, -inf at 0.")
IsNull = _row_wise("is_null", (D.ANY,), BOOLEAN, F.isnull, "Whether the value is null.")
Negate = _row_wise("negate", (D.NUMERIC,), DOUBLE, lambda c: c.cast("double") * -1, "Negative value.")
SquareRoot = _row_wise("square_root", (D.NUMERIC,), DOUBLE, square_root, "Square root; null below 0.")
Sine = _row_wise("sine", (D.NUMERIC,), DOUBLE, F.sin, "Sine.")
Cosine = _row_wise("cosine", (D.NUMERIC,), DOUBLE, F.cos, "Cosine.")

# Texts
NCharacters = _row_wise("n_characters", (D.STRING,), LONG, F.length, "Code points.")
NWords = _row_wise("n_words", (D.STRING,), LONG, lambda c: F.when(c.isNotNull(), F.size(words(c))), "Words.")
NUniqueWords = _row_wise("n_unique_words", (D.STRING,), LONG, lambda c: F.when(c.isNotNull(), F.size(F.array_distinct(words(F.lower(c))))), "Distinct words, whatever their case.")
Domain = _row_wise("domain", (D.STRING,), STRING, domain, "Domain of a URL or e-mail address; null if there is none.")
TopLevelDomain = _row_wise("top_level_domain", (D.STRING,), STRING, lambda c: F.nullif(F.regexp_extract(domain(c), r"\.([^.]+)\z", 1), F.lit("")), "Last label of the domain, if it has several.")
UrlToProtocol = _row_wise("url_to_protocol", (D.STRING,), STRING, lambda c: F.when(c.startswith("https:"), "https").when(c.startswith("http:"), "http"), "Protocol, if it is http or https.")

# Pairs of numbers
SubtractNumeric = _row_wise("subtract_numeric", (D.NUMERIC, D.NUMERIC), None, lambda x, y: x - y, "Difference.", widen=True)
DivideNumeric = _row_wise("divide_numeric", (D.NUMERIC, D.NUMERIC), DOUBLE, divide, "Quotient, by IEEE rules.")
AddNumeric = _row_wise("add_numeric", (D.NUMERIC, D.NUMERIC), None, lambda x, y: x + y, "Sum.", commutative=True, widen=True)
MultiplyNumeric = _row_wise("multiply_numeric", (D.NUMERIC, D.NUMERIC), None, lambda x, y: x * y, "Product.", commutative=True, widen=True)
ModuloNumeric = _row_wise("modulo_numeric", (D.NUMERIC, D.NUMERIC), None, floored_modulo, "Remainder with the divisor's sign; null for a divisor of 0.", widen=True)
MultiplyNumericBoolean = _row_wise("multiply_numeric_boolean", (D.NUMERIC, D.BOOLEAN), None, lambda x, flag: x * flag.cast("tinyint"), "The number where the flag is true, 0 where it is false.", widen=True)

# Comparisons and flags
GreaterThan = _row_wise("greater_than", _COMPARABLE, BOOLEAN, lambda x, y: x > y, "Whether the first is above the second.")
GreaterThanEqualTo = _row_wise("greater_than_equal_to", _COMPARABLE, BOOLEAN, lambda x, y: x >= y, "Whether the first is the second or above.")
LessThan = _row_wise("less_than", _COMPARABLE, BOOLEAN, lambda x, y: x < y, "Whether the first is below the second.")
LessThanEqualTo = _row_wise("less_than_equal_to", _COMPARABLE, BOOLEAN, lambda x, y: x <= y, "Whether the first is the second or below.")
Equal = _row_wise("equal", _EQUATABLE, BOOLEAN, lambda x, y: x == y, "Whether both are equal.", commutative=True)
NotEqual = _row_wise("not_equal", _EQUATABLE, BOOLEAN, lambda x, y: x != y, "Whether both differ.", commutative=True)
EqualCategorical = _row_wise("equal_categorical", (D.CATEGORICAL, D.CATEGORICAL), BOOLEAN, lambda x, y: x == y, "Whether both labels are equal.", commutative=True)
NotEqualCategorical = _row_wise("not_equal_categorical", (D.CATEGORICAL, D.CATEGORICAL), BOOLEAN, lambda x, y: x != y, "Whether both labels differ.", commutative=True)
Not = _row_wise("not", (D.BOOLEAN,), BOOLEAN, lambda c: ~c, "The opposite.", stack_on_self=False)
And = _row_wise("and", (D.BOOLEAN, D.BOOLEAN), BOOLEAN, lambda x, y: x & y, "Whether both are true; null where that is open.", commutative=True)
Or = _row_wise("or", (D.BOOLEAN, D.BOOLEAN), BOOLEAN, lambda x, y: x | y, "Whether one is true; null where that is open.", commutative=True)


@register
@dataclass(frozen=True)
class TimeSince(NeedsCutoffTime, TransformPrimitive):
    """The cutoff time less the moment."""

    name, input_dtypes, output_dtype, as_timestamps = "time_since", (D.HAS_DATE,), T.DayTimeIntervalType, True

    def return_dtype(self, input_dtypes: Sequence[object]) -> T.DataType:
        return T.DayTimeIntervalType()

    def build(self, moment: Column, *, cutoff: Column) -> Column:
        return cutoff - moment


@register
@dataclass(frozen=True)
class Percentile(GroupTransformPrimitive):
    """Average rank among the group's values, as a share of them."""

    name, input_dtypes, output_dtype = "percentile", (D.NUMERIC,), DOUBLE

    def build(self, column: Column, *, group: Group) -> Column:
        # Nulls rank apart, so that they don't lift the values' ranks.
        rank = group.ranked(F.rank(), column, within=(column.isNull(),)) + (group.counted(column) - 1) / 2
        return F.when(column.isNotNull(), rank / group.over(F.count(column)))


class _SoFar(OrderedTransformPrimitive):
    """An aggregate of the rows so far; null where the row's own value is null."""

    def build(self, column: Column, *, group: Group) -> Column:
        return F.when(column.isNotNull(), group.so_far(self.reduce(column)))

    def reduce(self, column: Column) -> Column:
        raise NotImplementedError


@register
@dataclass(frozen=True)
class CumSum(_SoFar):
    """Running sum."""

    name, input_dtypes, widen = "cum_sum", (D.NUMERIC,), True

    def reduce(self, column: Column) -> Column:
        return F.sum(column)


@register
@dataclass(frozen=True)
class CumMin(_SoFar):
    """Running minimum."""

    name, input_dtypes = "cum_min", (D.NUMERIC,)

    def reduce(self, column: Column) -> Column:
        return F.min(column)


@register
@dataclass(frozen=True)
class CumMax(_SoFar):
    """Running maximum."""

    name, input_dtypes = "cum_max", (D.NUMERIC,)

    def reduce(self, column: Column) -> Column:
        return F.max(column)


@register
@dataclass(frozen=True)
class CumMean(_SoFar):
    """Running mean."""

    name, input_dtypes, output_dtype = "cum_mean", (D.NUMERIC,), DOUBLE

    def reduce(self, column: Column) -> Column:
        return F.avg(column)


@register
@dataclass(frozen=True)
class CumCount(OrderedTransformPrimitive):
    """Values so far; a row without one repeats the count."""

    name, input_dtypes, output_dtype = "cum_count", (D.ANY,), LONG

    def build(self, column: Column, *, group: Group) -> Column:
        return group.so_far(F.count(column))


@register
@dataclass(frozen=True)
class Diff(OrderedTransformPrimitive):
    """The value less the previous row's."""

    name, input_dtypes, widen = "diff", (D.NUMERIC,), True

    def build(self, column: Column, *, group: Group) -> Column:
        return column - group.lag(column)


@register
@dataclass(frozen=True)
class TimeSincePrevious(OrderedTransformPrimitive):
    """The moment less the previous row's."""

    name, input_dtypes, output_dtype, as_timestamps = "time_since_previous", (D.HAS_DATE,), T.DayTimeIntervalType, True

    def return_dtype(self, input_dtypes: Sequence[object]) -> T.DataType:
        return T.DayTimeIntervalType()

    def build(self, moment: Column, *, group: Group) -> Column:
        return moment - group.lag(moment)


@register
@dataclass(frozen=True)
class SameAsPrevious(OrderedTransformPrimitive):
    """Whether the value equals the previous row's."""

    name, input_dtypes, output_dtype = "same_as_previous", (D.NUMERIC,), BOOLEAN

    def build(self, column: Column, *, group: Group) -> Column:
        return column == group.lag(column)


@register
@dataclass(frozen=True)
class AbsoluteDiff(OrderedTransformPrimitive):
    """Distance from the previous row's value."""

    name, input_dtypes, output_dtype = "absolute_diff", (D.NUMERIC,), DOUBLE

    def build(self, column: Column, *, group: Group) -> Column:
        value = column.cast("double")
        return F.abs(value - group.lag(value))


@register
@dataclass(frozen=True)
class PercentChange(OrderedTransformPrimitive):
    """Change from the previous row's value as a share of it, by IEEE rules."""

    name, input_dtypes, output_dtype = "percent_change", (D.NUMERIC,), DOUBLE

    def build(self, column: Column, *, group: Group) -> Column:
        return divide(column, group.lag(column)) - 1


class _SinceMatch(OrderedTransformPrimitive):
    """The moment less that of the latest row, this one included, whose flag matches."""

    output_dtype, as_timestamps = T.DayTimeIntervalType, True

    def return_dtype(self, input_dtypes: Sequence[object]) -> T.DataType:
        return T.DayTimeIntervalType()

    def build(self, moment: Column, flag: Column, *, group: Group) -> Column:
        return moment - group.so_far(F.last(F.when(self.matching(flag), moment), ignorenulls=True))

    def matching(self, flag: Column) -> Column:
        raise NotImplementedError


@register
@dataclass(frozen=True)
class CumulativeTimeSinceLastTrue(_SinceMatch):
    """Time since the latest true flag."""

    name, input_dtypes = "cumulative_time_since_last_true", (D.HAS_DATE, D.BOOLEAN)

    def matching(self, flag: Column) -> Column:
        return flag


@register
@dataclass(frozen=True)
class CumulativeTimeSinceLastFalse(_SinceMatch):
    """Time since the latest false flag."""

    name, input_dtypes = "cumulative_time_since_last_false", (D.HAS_DATE, D.BOOLEAN)

    def matching(self, flag: Column) -> Column:
        return ~flag
