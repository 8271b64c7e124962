"""Column builders with fixed semantics for NULL logic, type promotion, division, casts and membership.

They are plain compositions of built-in functions, so they stay inside whole-stage code generation and comparisons of a column
with a literal still reach the scan as pushed filters.  ``Exprs`` knows the frame's column types (by analysis only, no job).
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern import types as Q

COMPARISONS = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
FLIPPED = {"=": "=", "!=": "!=", "<": ">", "<=": ">=", ">": "<", ">=": "<="}
INVERSE = {"=": "!=", "!=": "=", "<": ">=", "<=": ">", ">": "<=", ">=": "<", "in": "not in", "not in": "in", "like": "not like", "not like": "like", "is null": "is not null", "is not null": "is null"}
BETWEEN = {"inclusive": (">=", "<="), "lower_exclusive": (">", "<="), "upper_exclusive": (">=", "<"), "exclusive": (">", "<")}


def lit(value: Any, to: str | None = None) -> Column:
    """A literal: ints are int when they fit, else long; a NULL adopts ``to``."""
    if to is None and isinstance(value, int) and not isinstance(value, bool):
        to = "int" if -(2**31) <= value < 2**31 else "long"
    return F.lit(value).cast(to) if to else F.lit(value)


def as_int(condition: Column) -> Column:
    """A predicate as a value: 1, 0 or NULL."""
    return condition.cast("int")


def between(x: Column, low: Column, high: Column, mode: str = "inclusive") -> Column:
    """AND of two comparisons, so a false half decides even if the other bound is NULL.  Modes: see BETWEEN."""
    a, b = BETWEEN[mode]
    return COMPARISONS[a](x, low) & COMPARISONS[b](x, high)


def case(*branches: tuple[Column, Column], otherwise: Column | None = None) -> Column:
    """CASE WHEN; a NULL condition counts as false."""
    (c, v), *rest = branches
    out = F.when(c, v)
    for c, v in rest:
        out = out.when(c, v)
    return out if otherwise is None else out.otherwise(otherwise)


def extract(part: str, date_text: Column) -> Column:
    """YEAR, MONTH or DAY of a YYYY-MM-DD text as zero-padded text; HOUR, MINUTE or SECOND of a timestamp likewise."""
    at = {"year": (1, 4), "month": (6, 2), "day": (9, 2)}
    if part in at:
        return F.substring(date_text, *at[part])
    return F.date_format(date_text, {"hour": "HH", "minute": "mm", "second": "ss"}[part])


def substr(s: Column, start: Column | int, length: Column | int) -> Column:
    """1-based substring; a negative start counts from the end, start 0 takes one character less, a length below 1 gives ''."""
    start, length = (v if isinstance(v, Column) else F.lit(v) for v in (start, length))
    start, length = start.cast("int"), length.cast("int")
    begin = F.when(start < 0, F.greatest(F.length(s) + start + 1, F.lit(1))).when(start == 0, F.lit(1)).otherwise(start)
    take = F.when(start == 0, length - 1).otherwise(length)
    return F.when(s.isNull() | start.isNull() | length.isNull(), F.lit(None).cast("string")).when(take < 1, F.lit("")).otherwise(F.substr(s, begin, F.greatest(take, F.lit(0))))


def concat(*cols: Column) -> Column:
    """NULL if any part is NULL."""
    return F.concat(*cols)


def like(s: Column, pattern: str, negated: bool = False) -> Column:
    return ~s.like(pattern) if negated else s.like(pattern)


class Exprs:
    """Typed builders for one frame.  Arguments are Columns, column names (str) or Python literals other than str; text literals need ``lit``."""

    def __init__(self, df: DataFrame):
        self.df = df

    def col(self, x: Any) -> Column:
        return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else lit(x) if x is not None else F.lit(None)

    def type_of(self, x: Any) -> T.DataType:
        return self.df.select(self.col(x).alias("x")).schema["x"].dataType

    def _both(self, a: Any, b: Any) -> tuple[Column, Column, T.DataType]:
        a, b = self.col(a), self.col(b)
        t = Q.common_type(self.type_of(a), self.type_of(b))
        return a.cast(t), b.cast(t), t

    def add(self, a: Any, b: Any) -> Column:
        x, y, t = self._both(a, b)
        return (x + y).cast(t)

    def sub(self, a: Any, b: Any) -> Column:
        x, y, t = self._both(a, b)
        return (x - y).cast(t)

    def mul(self, a: Any, b: Any) -> Column:
        x, y, t = self._both(a, b)
        return (x * y).cast(t)

    def div(self, a: Any, b: Any) -> Column:
        """NULL on a NULL or zero divisor; two integers divide to an integer, rounded towards zero."""
        x, y, t = self._both(a, b)
        if Q.is_integral(t):
            return F.call_function("div", x, F.when(y != 0, y)).cast(t)
        return F.try_divide(x.cast("double"), F.when(y != 0, y.cast("double"))).cast(t)

    def mod(self, a: Any, b: Any) -> Column:
        """Sign of the dividend, also for floats; NULL on a NULL or zero divisor."""
        x, y, t = self._both(a, b)
        return F.try_mod(x, F.when(y != 0, y)).cast(t)

    def neg(self, a: Any) -> Column:
        c = self.col(a)
        if not Q.is_numeric(self.type_of(c)):
            raise TypeError("unary minus needs a number")
        return (-c).cast(self.type_of(c))

    def compare(self, a: Any, op: str, b: Any) -> Column:
        """NULL-propagating; both sides in their common type.  Equal types keep bare columns, so the filter can be pushed down."""
        a, b = self.col(a), self.col(b)
        ta, tb = self.type_of(a), self.type_of(b)
        if ta != tb:
            t = Q.common_type(ta, tb)
            a, b = (a if ta == t else a.cast(t)), (b if tb == t else b.cast(t))
        return COMPARISONS[op](a, b)

    def isin(self, x: Any, values: list[Any], negated: bool = False, strict: bool = False) -> Column:
        """Membership.  Elements of another type class are dropped; an empty list is false (NOT IN: true), even for NULL.

        A NULL element makes a miss NULL.  ``strict=True`` drops NULL elements beside a text column (a miss is then false).
        """
        c = self.col(x)
        text = Q.is_string(self.type_of(c))
        whole = Q.is_integral(self.type_of(c))
        if not values:
            return F.lit(negated)
        keep = [v for v in values if v is None and not (strict and text) or v is not None and isinstance(v, str) == text]
        # A numeric list that mixes in text is compared element by element after the text is dropped; fractions never equal integers.
        some = [v for v in keep if v is not None and not (whole and isinstance(v, float) and v != int(v))]
        if not some and None not in keep:
            hit = F.lit(False)
        else:
            hit = c.isin(*some) if some else F.lit(False)
            if None in keep:
                hit = hit | F.lit(None).cast("boolean")
        return ~hit if negated else hit

    def in_expression(self, x: Any, y: Any) -> Column:
        """``x IN expr`` is ``x = expr``."""
        return self.compare(x, "=", y)

    def cast(self, x: Any, to: str | T.DataType) -> Column:
        """Numbers truncate towards zero; text that is wholly a number converts, any other text (also with blanks) gives 0; NULL stays NULL."""
        c = self.col(x)
        t = Q.BY_NAME.get(to, to) if isinstance(to, str) else to
        of = self.type_of(c)
        if Q.is_string(of) and Q.is_numeric(t):
            form = r"^[+-]?\d+$" if Q.is_integral(t) else r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?)$"
            return F.when(c.isNull(), F.lit(None).cast(t)).when(c.rlike(form), F.coalesce(c.try_cast(t), F.lit(0).cast(t))).otherwise(F.lit(0).cast(t))
        return c.try_cast(t)
