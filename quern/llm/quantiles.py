"""Percentiles of very large numeric columns per group, from mergeable sketches with a known error.

The sketch is a randomized compactor hierarchy (KLL): levels of sorted buffers, a full buffer keeps every other value, starting at a random
one of the first two, and hands these to the next level with double weight; two sketches merge level by level.  Spark's built-in KLL
aggregates run this in the JVM as partial aggregates, so rows never move, only sketches do (a few thousand values a group at most), and
a group that holds a third of all rows costs one sketch a task.  Sketches are ordinary binary columns: those of days or files can be
stored and merged later.

Whole-number columns go to sketches of longs (``sketch_<column>``), others to sketches of doubles (``dsketch_<column>``), so no fraction is lost.

Error: with probability 0.99 the rank of an answer is off by at most ``rank_error(k)`` of the values counted; up to ``k`` values it is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Size of the top compactor: a rank error below 0.07 %, so that the 99.9th percentile is told apart; answers are exact up to as many values.
K = 8192
QUANTILES = (0.5, 0.9, 0.99, 0.999)


def rank_error(k: int) -> float:
    """Rank error of one answer at 99 % confidence; the fit published with the sketch's implementation."""
    return 2.296 / k**0.9021


def _whole(df: DataFrame, value: str) -> bool:
    return isinstance(df.schema[value].dataType, T.IntegralType)


def sketches(df: DataFrame, keys: Sequence[Column], values: Sequence[str], k: int = K) -> DataFrame:
    """One sketch a group and column; NULL and NaN are left out, negative values count; a group with none has a NULL sketch.

    Keys may be NULL (a group of its own).  An empty table gives no rows; other columns are ignored.
    """
    aggs = []
    for v in values:
        c = F.col(f"`{v}`")
        if _whole(df, v):
            aggs.append(F.kll_sketch_agg_bigint(c.cast("long"), F.lit(k)).alias(f"sketch_{v}"))
        else:
            d = c.cast("double")
            aggs.append(F.kll_sketch_agg_double(F.when(~F.isnan(d), d), F.lit(k)).alias(f"dsketch_{v}"))
    return df.groupBy(*keys).agg(*aggs)


def merge(df: DataFrame, keys: Sequence[str], values: Sequence[str], k: int = K) -> DataFrame:
    """Sketches of finer groups into those of coarser ones."""
    whole = [f"sketch_{v}" in df.columns for v in values]
    return df.groupBy(*keys).agg(*[F.kll_merge_agg_bigint(F.col(f"sketch_{v}"), F.lit(k)).alias(f"sketch_{v}") if w else F.kll_merge_agg_double(F.col(f"dsketch_{v}"), F.lit(k)).alias(f"dsketch_{v}") for v, w in zip(values, whole)])


def read(df: DataFrame, keys: Sequence[str], values: Sequence[str], quantiles: Sequence[float] = QUANTILES, k: int = K) -> DataFrame:
    """Rows of (keys, measure, n, p50 ..., rank_error); groups without values have no row for that measure.

    Percentiles are longs if all columns are whole numbers, else doubles.  The answer for ``q`` of ``n`` values is the smallest with at least ``q * n`` values up to it.
    """
    names = [f"p{q * 100:g}".replace(".", "_") for q in quantiles]
    whole = [f"sketch_{v}" in df.columns for v in values]
    kind = "array<bigint>" if all(whole) else "array<double>"
    each, at_ = [], F.array(*[F.lit(float(q)) for q in quantiles])
    for v, w in zip(values, whole):
        s = F.col(f"sketch_{v}" if w else f"dsketch_{v}")
        n = F.kll_sketch_get_n_bigint(s) if w else F.kll_sketch_get_n_double(s)
        at = F.kll_sketch_get_quantile_bigint(s, at_) if w else F.kll_sketch_get_quantile_double(s, at_)
        each.append(F.struct(F.lit(v).alias("measure"), n.alias("n"), F.when(n > 0, at).cast(kind).alias("at")))
    out = df.select(*keys, F.explode(F.array(*each)).alias("x")).filter("x.n > 0")
    exact = F.col("x.n") <= k
    return out.select(*keys, "x.measure", "x.n", *[F.element_at("x.at", i + 1).alias(c) for i, c in enumerate(names)], F.when(exact, F.lit(0.0)).otherwise(F.lit(rank_error(k))).alias("rank_error"))
