"""Aggregates: NULL inputs are skipped, COUNT is never NULL, SUM of integers is long and of floats double."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern import types as Q

FUNCTIONS = ("sum", "avg", "min", "max", "count", "count_distinct", "stddev_samp", "any", "string_agg")


@dataclass(frozen=True)
class Agg:
    """One aggregate.  ``arg`` is a column name, a Column, or None for COUNT(*); ``order`` holds (column, ascending) for string_agg."""

    function: str
    arg: str | Column | None = None
    alias: str | None = None
    order: tuple[tuple[str, bool], ...] = field(default=())

    @property
    def name(self) -> str:
        if self.alias:
            return self.alias
        if self.arg is None:
            return "COUNT(*)"
        inner = self.arg if isinstance(self.arg, str) else "expr"
        return f"COUNT(DISTINCT {inner})" if self.function == "count_distinct" else f"{self.function.upper()}({inner})"

    def column(self, df: DataFrame) -> Column:
        if self.function not in FUNCTIONS:
            raise ValueError(f"unknown aggregate {self.function}")
        if self.arg is None:
            if self.function != "count":
                raise ValueError("only COUNT takes *")
            return F.count(F.lit(1)).alias(self.name)
        c = F.col(f"`{self.arg}`") if isinstance(self.arg, str) else self.arg
        kind = df.select(c.alias("x")).schema["x"].dataType
        if self.function in ("sum", "avg", "stddev_samp") and not Q.is_numeric(kind):
            raise TypeError(f"{self.function} needs numbers, got {kind.simpleString()}")
        if self.function == "string_agg":
            if not Q.is_string(kind):
                raise TypeError("string_agg needs text")
            return self._string_agg().alias(self.name)
        out = {
            "sum": lambda: F.sum(c), "avg": lambda: F.avg(c), "min": lambda: F.min(c), "max": lambda: F.max(c), "count": lambda: F.count(c),
            "count_distinct": lambda: F.countDistinct(c), "stddev_samp": lambda: F.stddev_samp(c), "any": lambda: F.any_value(c, F.lit(True)),
        }[self.function]()
        return out.alias(self.name)

    def _string_agg(self) -> Column:
        if not isinstance(self.arg, str):
            raise TypeError("string_agg takes a column name: project first")
        if not self.order:
            return F.listagg(F.col(f"`{self.arg}`"), F.lit(","))
        keys = ", ".join(f"`{c}` {'ASC' if up else 'DESC'} NULLS FIRST" for c, up in self.order)
        return F.expr(f"listagg(`{self.arg}`, ',') WITHIN GROUP (ORDER BY {keys})")
