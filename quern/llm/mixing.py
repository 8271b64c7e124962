"""Mixing sources to target shares of the total size.

Each document of a source should be copied the same, usually fractional, number of times.  The whole part is given to all; the fractional part is
rounded by the pivotal method: two documents with fractional copy probabilities meet, mass (probability times size) moves from one to the other,
in a random direction whose expectation is zero, until one of the two is 0 or 1.  The total mass of a source stays as it is, so its share is met up to less
than one document.  Each task rounds its own documents and leaves at most one open document a source; these residuals meet in a tree of tasks.

The document left over at the end is rounded by chance, so it should be small: documents over a ``1/tiers`` part of their source, of which there are
fewer than ``tiers``, are rounded first, the largest first.  Each of these meets all smaller documents of its source as if they were one: mass moves between it
and them until it is integral, in a random direction with zero expectation unless they could not give or take so much at their copies from 0 to the cap.  The
rest then has the mass that is left.  So a source misses its share by less than one document of the rest, wherever the caps and sizes allow that.

Random choices are drawn from document ids, so a task that runs again decides the same.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import settle

FAN_IN = 64
SEED = 20240611
_ROUNDED = "doc_id long, source string, n_tokens long, node long, copies int, open double"
_TINY = 1e-12


def uniform(ids: np.ndarray, seed: int) -> np.ndarray:
    """Numbers in [0, 1) from ids by a splitmix step."""
    with np.errstate(over="ignore"):
        z = ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(seed % (1 << 32) + 1)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return (z >> np.uint64(11)).astype(np.float64) / float(1 << 53)


class Pivot:
    """One source's open document while others pass by.  ``open`` is (position, p, size)."""

    def __init__(self) -> None:
        self.open: tuple | None = None

    def meet(self, key: object, p: float, size: float, u: float) -> list[tuple[object, int]]:
        """Pair a document with the open one; returns (key, 0 or 1) of those that became integral."""
        if p <= _TINY or p >= 1 - _TINY:
            return [(key, int(p > 0.5))]
        if size <= 0:
            return [(key, int(u < p))]  # weighs nothing: no mass to keep
        if self.open is None:
            self.open = (key, p, size)
            return []
        k, q, s = self.open
        up = min((1 - q) * s, p * size)  # the open one gains
        down = min(q * s, (1 - p) * size)  # the open one loses
        move = up if u * (up + down) < down else -down
        q, p = q + move / s, p - move / size
        done, left = [], []
        for key_, x, w in ((k, q, s), (key, p, size)):
            if x <= _TINY or x >= 1 - _TINY:
                done.append((key_, int(x > 0.5)))
            else:
                left.append((key_, x, w))
        self.open = left[0] if left else None
        return done


def plan(totals: dict[str, int], targets: Sequence[tuple[str, float, int]]) -> dict[str, float]:
    """Mean copies of a document of each source: as much in total as the caps allow with all shares met.

    Sources without tokens or with no share get none and don't limit the others; shares of the rest are taken in proportion.
    """
    live = [(s, w, m) for s, w, m in targets if w > 0 and m > 0 and totals.get(s, 0) > 0]
    whole = sum(w for _, w, _ in live)
    total = min((m * totals[s] * whole / w for s, w, m in live), default=0.0)
    return {s: min(w / whole * total / totals[s], float(m)) for s, w, m in live}


def round_large(sizes: np.ndarray, u: np.ndarray, mass: float, rest: float, cap: float) -> np.ndarray:
    """Copies of the large documents of one source, the largest first; ``mass`` is due to them and to the ``rest`` tokens of smaller ones."""
    below = rest + sizes.sum() - np.cumsum(sizes)
    out = np.zeros(len(sizes), np.int64)
    for i, size in enumerate(sizes):
        p = min(max(mass / (size + below[i]), 0.0), cap)
        down = int(p)
        choices = {down: 1 - (p - down), min(down + 1, int(cap)): p - down}
        fit = {c: w for c, w in choices.items() if w > _TINY and -_TINY * mass <= mass - c * size <= cap * below[i] * (1 + _TINY)}
        if not fit:  # neither can be made up for: the number of copies that misses least
            miss = {c: max(c * size - mass, mass - c * size - cap * below[i], 0.0) for c in range(int(cap) + 1)}
            fit = {min(miss, key=lambda c: (miss[c], c)): 1.0}
        first = min(fit)
        out[i] = first if u[i] < fit[first] / sum(fit.values()) else max(fit)
        mass -= out[i] * size
    return out


_LARGE = "doc_id long, source string, n_tokens long, copies int"


def _round_large(pdf: pd.DataFrame) -> pd.DataFrame:
    """One source: fewer than ``tiers`` documents, so that one task holds them."""
    pdf = pdf.sort_values(["n_tokens", "doc_id"], ascending=[False, True])
    copies = round_large(pdf["n_tokens"].to_numpy(np.float64), uniform(pdf["doc_id"].to_numpy(np.int64), int(pdf["seed"].iloc[0])), float(pdf["mass"].iloc[0]), float(pdf["rest"].iloc[0]), float(pdf["cap"].iloc[0]))
    return pdf[["doc_id", "source", "n_tokens"]].assign(copies=copies.astype(np.int32))


def _round(seed: int, first: bool):
    """Rounds streams sorted by (node, source); in the first pass rows come with their rate, later with their open probability."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pivots: dict[str, Pivot] = {}
        held: dict[str, tuple] = {}
        at_node = None

        def close() -> list[tuple]:
            rows = [(*held[s][:4], held[s][4], v.open[1]) for s, v in pivots.items() if v.open is not None]
            pivots.clear()
            held.clear()
            return rows

        for pdf in batches:
            out: list[tuple] = []
            u = uniform(pdf["doc_id"].to_numpy(np.int64), seed)
            if first:
                base = np.floor(pdf["rate"].to_numpy(np.float64))
                pdf = pdf.assign(copies=base.astype(np.int32), open=pdf["rate"] - base)
            columns = [pdf[c].tolist() for c in ("doc_id", "source", "n_tokens", "node", "copies", "open")]
            for doc_id, source, size, node, whole, p, chance in zip(*columns, u.tolist()):
                if node != at_node:
                    out += close()
                    at_node = node
                pivot = pivots.get(source)
                if pivot is None:
                    pivot = pivots[source] = Pivot()
                done = pivot.meet((doc_id, source, size, node, whole), p, float(size), chance)
                if pivot.open is not None:
                    held[source] = pivot.open[0]
                out += [(*d[:4], d[4] + one, None) for d, one in done]
            yield _frame(out)
        yield _frame(close())

    return run


def _frame(rows: list[tuple]) -> pd.DataFrame:
    f = pd.DataFrame(rows, columns=["doc_id", "source", "n_tokens", "node", "copies", "open"])
    return f.astype({"doc_id": "int64", "n_tokens": "int64", "node": "int64", "copies": "int32", "open": "float64"})


def mix(sized: DataFrame, targets: DataFrame, max_sources: int = 10_000, tiers: int = 1000, nodes: int = 1024, seed: int = SEED) -> DataFrame:
    """doc_id, source, n_tokens, copies of every document.

    ``sized``: doc_id, source, n_tokens (NULL counts as 0).  ``targets``: source, target_share, max_repeats, at most ``max_sources`` rows (checked).  Documents of sources
    that are NULL or not listed have 0 copies.  A document of no tokens is rounded by itself.  Empty tables give no rows.  ``nodes``: leaves of the reduction tree; documents go
    to them by their id, so the result doesn't depend on how rows are partitioned.
    """
    spark = sized.sparkSession
    rows = targets.select(F.col("source").cast("string"), F.col("target_share").cast("double"), F.col("max_repeats").cast("int")).dropna().limit(max_sources + 1).collect()
    if len(rows) > max_sources or len({r[0] for r in rows}) != len(rows):
        raise ValueError("targets need one row a source, and not too many")
    docs = settle(sized.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)).alias("n_tokens")))
    listed = spark.createDataFrame([(r[0],) for r in rows], "source string")
    totals = {r[0]: r[1] for r in docs.join(F.broadcast(listed), "source", "left_semi").groupBy("source").agg(F.sum("n_tokens")).collect()}  # at most max_sources rows
    rates, caps = plan(totals, [tuple(r) for r in rows]), {r[0]: float(r[2]) for r in rows}
    # Small tables of at most max_sources rows: sent to all tasks.
    dues = spark.createDataFrame([(s, r, r * totals[s], caps[s], totals[s] / tiers) for s, r in rates.items()], "source string, rate double, mass double, cap double, bound double")
    known = docs.join(F.broadcast(dues), "source")
    other = docs.join(F.broadcast(dues.select("source")), "source", "left_anti").withColumn("copies", F.lit(0))

    # Fewer than ``tiers`` documents of a source are over its bound.
    is_large = F.col("n_tokens") > F.col("bound")
    rest = known.filter(~is_large).groupBy("source").agg(F.sum("n_tokens").alias("rest"))
    large = known.filter(is_large).join(F.broadcast(rest), "source", "left").select("doc_id", "source", "n_tokens", "mass", F.coalesce("rest", F.lit(0)).alias("rest"), "cap", F.lit(seed).alias("seed"))
    large = settle(large.groupBy("source").applyInPandas(_round_large, _LARGE))
    got = {r[0]: (r[1], r[2]) for r in large.groupBy("source").agg(F.sum("n_tokens"), F.sum(F.col("n_tokens") * F.col("copies"))).collect()}
    left_over = []
    for s, r in rates.items():
        tokens, reached = got.get(s, (0, 0))
        left_over.append((s, min(max((r * totals[s] - reached) / (totals[s] - tokens), 0.0), caps[s]) if totals[s] > tokens else r))
    small = known.filter(~is_large).drop("rate").join(F.broadcast(spark.createDataFrame(left_over, "source string, rate double")), "source")
    leaf = F.pmod(F.xxhash64("doc_id"), F.lit(nodes))
    small = small.select("doc_id", "source", "n_tokens", leaf.alias("node"), "rate").repartition("node").sortWithinPartitions("node", "source", F.col("n_tokens").desc(), "doc_id")
    level = settle(small.mapInPandas(_round(seed + 1, True), _ROUNDED))
    done = [other, large, level.filter("open is null")]
    left = level.filter("open is not null")
    step = 2
    while nodes > 1:
        nodes = -(-nodes // FAN_IN)
        met = left.withColumn("node", F.floor(F.col("node") / FAN_IN)).repartition(min(nodes, 200), "node").sortWithinPartitions("node", "source", F.col("n_tokens").desc(), "doc_id")
        level = settle(met.mapInPandas(_round(seed + step, False), _ROUNDED))
        done.append(level.filter("open is null"))
        left = level.filter("open is not null")
        step += 1
    done.append(_by_chance(left, seed))
    columns = ["doc_id", "source", "n_tokens", "copies"]
    out = done[0].select(columns)
    for x in done[1:]:
        out = out.unionByName(x.select(columns))
    return out


def _by_chance(rounded: DataFrame, seed: int) -> DataFrame:
    """Rounds what is still open."""
    u = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rounded.withColumn("copies", F.col("copies") + F.coalesce((u < F.col("open")).cast("int"), F.lit(0)))


def copies(mixed: DataFrame) -> DataFrame:
    """The mixture itself: one row for each copy, copy_no from 1."""
    return mixed.filter("copies > 0").select("doc_id", "source", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_no"))


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Target and reached share, tokens and copies of each listed source."""
    got = mixed.groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"), F.sum(F.col("n_tokens") * F.col("copies")).alias("reached_tokens"), F.max("copies").alias("most_copies"))
    out = targets.select("source", "target_share", "max_repeats").join(got, "source", "left").na.fill(0, ["available_tokens", "reached_tokens", "most_copies"])
    total = out.agg(F.sum("reached_tokens").alias("all_tokens"))  # one row
    return out.join(F.broadcast(total)).select("source", "target_share", "max_repeats", "available_tokens", "reached_tokens", "most_copies", F.try_divide(F.col("reached_tokens"), F.col("all_tokens")).alias("reached_share"))
