"""Relational operators: thin, declarative, lazily planned by Catalyst."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.aggs import Agg

JOIN_MODES = {"inner": "inner", "left": "left", "right": "right", "full": "full", "semi": "left_semi", "anti_null_as_false": "left_anti", "cross": "cross"}


def table_wrapper(spark: SparkSession, rows: list, schema: T.StructType | str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def filter_(df: DataFrame, predicate: Column | bool) -> DataFrame:
    """Rows for which the predicate is TRUE; NULL drops."""
    return df.filter(F.lit(predicate) if isinstance(predicate, bool) else predicate)


def project(df: DataFrame, **columns: Column | str) -> DataFrame:
    return df.select(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()])


def alias(df: DataFrame, columns: Sequence[str], aliases: Sequence[str]) -> DataFrame:
    """Reorder and rename all columns; both lists must have one entry per column."""
    if len(columns) != len(aliases) or len(columns) != len(df.columns):
        raise ValueError("alias needs every column once")
    return df.select(*[F.col(f"`{c}`").alias(a) for c, a in zip(columns, aliases)])


def aggregate(df: DataFrame, keys: Sequence[str] = (), aggs: Sequence[Agg] = ()) -> DataFrame:
    """GROUP BY: NULL is a group of its own; without aggregates DISTINCT over the keys; without keys one row, also for empty input."""
    if not keys and not aggs:
        raise ValueError("aggregate needs keys or aggregates")
    if not aggs:
        return df.select(*keys).distinct()
    cols = [a.column(df) for a in aggs]
    return df.groupBy(*keys).agg(*cols) if keys else df.agg(*cols)


def join(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str] | tuple[str, str, str]] = (), how: str = "inner", condition: Column | None = None) -> DataFrame:
    """Join on (left column, right column[, operator]) triples plus an optional condition; both sides' key columns are kept.

    Key types of an equality must agree.  ``anti_null_as_true`` is NOT IN on the first pair: NULL-aware, so that one NULL on the
    right empties the result and NULL keys on the left never come out (unless the right is empty).
    """
    if how == "anti_null_as_true":
        (a, b, *_), *rest = on
        if rest or condition is not None:
            raise ValueError("NOT IN takes one pair")
        return _not_in(left, right, a, b)
    cond = condition
    for a, b, *op in on:
        op = op[0] if op else "="
        if op == "=" and left.schema[a].dataType != right.schema[b].dataType:
            raise TypeError(f"key types differ: {a} and {b}")
        x, y = left[a], right[b]
        one = {"=": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
        cond = one if cond is None else cond & one
    if how == "cross":
        return left.crossJoin(right)
    if cond is None:
        raise ValueError("a join needs a condition")
    return left.join(right, cond, JOIN_MODES[how])


def _not_in(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Equi anti join plus a one-row summary of the right side: unlike a NULL-aware anti join it needs no broadcast of the right."""
    facts = right.agg(F.count(F.lit(1)).alias("__n"), F.count(F.when(right[b].isNull(), 1)).alias("__nulls"))
    keys = right.select(right[b].alias("__key")).filter("__key is not null")
    kept = left.join(keys, left[a] == keys["__key"], "left_anti")
    return kept.join(F.broadcast(facts)).filter((F.col("__n") == 0) | ((F.col("__nulls") == 0) & F.col(f"`{a}`").isNotNull())).drop("__n", "__nulls")


def sort(df: DataFrame, *keys: tuple[str, bool], tie_breakers: Sequence[str] = ()) -> DataFrame:
    """Global order by (column, ascending); NULLs first in both directions; ``tie_breakers`` make it total."""
    order = [F.col(f"`{c}`").asc_nulls_first() if up else F.col(f"`{c}`").desc_nulls_first() for c, up in keys]
    return df.orderBy(*order, *[F.col(f"`{c}`").asc_nulls_first() for c in tie_breakers])


def limit(df: DataFrame, n: int | Column, *keys: tuple[str, bool], offset: int = 0) -> DataFrame:
    """First rows after ``offset`` ones; with keys a top-k (TakeOrderedAndProject)."""
    if isinstance(n, Column):
        n = int(df.sparkSession.range(1).select(n).first()[0])
    rows = sort(df, *keys) if keys else df
    return (rows.offset(offset) if offset else rows).limit(n)


def union(a: DataFrame, b: DataFrame, distinct: bool = False) -> DataFrame:
    """By position; column counts must agree."""
    if len(a.columns) != len(b.columns):
        raise ValueError("union needs as many columns on both sides")
    out = a.union(b)
    return out.distinct() if distinct else out


def partition(df: DataFrame, columns: Sequence[str], n: int, kind: str = "hash") -> DataFrame:
    """Equal keys share a partition.  ``hash`` or ``range``."""
    return df.repartition(n, *columns) if kind == "hash" else df.repartitionByRange(n, *columns)


def exchange(df: DataFrame, to: int = 1, keys: Sequence[str] = ()) -> DataFrame:
    """Merge to one partition (full), to a few (partial), or mesh fully by keys."""
    return df.repartition(to, *keys) if keys else df.coalesce(to)


def unique_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that occur more than once (a UNIQUE constraint is metadata; this checks the data)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
