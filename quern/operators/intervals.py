"""Continuous periods and gaps of possibly overlapping, nested or repeated time intervals per entity.

The state is a mergeable aggregate: a sorted list of disjoint closed intervals.  Lists are combined by linear merge in a tree: each map task merges the rows of
a batch, partial lists meet by (entity, time block) and merge as a sorted stream, and the blocks of an entity meet in what they owe each other: the largest end before
a block comes in as an interval of its own, the period that is open at its end goes out as one row, and these rows are joined into periods.  From the
merged lists the periods and their complements, the gaps, are emitted.  A long entity is therefore never gathered in one task: its blocks are merged
apart, and what its blocks exchange is one row a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Length of a time block in microseconds.  Larger blocks mean fewer carried rows, smaller ones split long entities finer.
BLOCK_US = 60_000_000
#: Stands before all times: the place of a block's carried end, and that end where there is none.
_FIRST = -(2**63)


def merge_sorted(group: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Disjoint intervals of each group, from rows sorted by (group, start); touching intervals join.  ``group`` holds ascending numbers from 0."""
    n = len(start)
    if not n:
        return group, start, end
    # Running maximum of ends within groups: ranks of ends, lifted by group so that the maximum never crosses a border.
    order = np.argsort(end, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    reach = end[order][np.maximum.accumulate(group * n + rank) - group * n]
    new = np.ones(n, bool)
    new[1:] = (group[1:] != group[:-1]) | (start[1:] > reach[:-1])
    last = np.concatenate([new[1:], [True]])
    return group[new], start[new], reach[last]


def _partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partial lists of one batch; in any order of rows."""
    for pdf in batches:
        if not len(pdf):
            continue
        code, names = pd.factorize(pdf["entity"])
        start, end, block = (pdf[c].to_numpy(np.int64) for c in ("s", "e", "block"))
        order = np.lexsort((start, block, code))
        code, start, end, block = code[order], start[order], end[order], block[order]
        group = np.cumsum(np.concatenate([[False], (code[1:] != code[:-1]) | (block[1:] != block[:-1])]))
        first = np.searchsorted(group, np.arange(group[-1] + 1))
        g, s, e = merge_sorted(group, start, end)
        yield pd.DataFrame({"entity": np.asarray(names, object)[code[first][g]], "block": block[first][g], "s": s, "e": e})


_OUT = "entity string, kind string, s long, e long, block long, total long"


def _emit(loose_only: bool):
    """Linear merge of a stream sorted by (entity, block, start), and what it gives.

    A block's first row, from _FIRST on, ends at the largest end of earlier blocks, or at _FIRST in the first block; ``total`` is the largest end of the entity.
    Out come ``gap`` rows, ``period`` rows of all periods that begin and end in the block, and one ``loose`` row a block that begins any: ``s`` is the
    start of its last period, ``e`` the end of the one that was open before (meaningless in the first block).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, reach, total, start, before = None, None, 0, None, None
        names = [c.split()[0] for c in _OUT.split(", ")]

        def loose() -> list[tuple]:
            return [(*at, "loose", start, _FIRST if before is None else before, total)] if at is not None and start is not None else []

        for pdf in batches:
            if not len(pdf):
                continue
            rows: list[tuple] = []
            entity, block = pdf["entity"].to_numpy(object), pdf["block"].to_numpy(np.int64)
            s, e, t = (pdf[c].to_numpy(np.int64) for c in ("s", "e", "total"))
            new = np.concatenate([[True], (entity[1:] != entity[:-1]) | (block[1:] != block[:-1])])
            cuts = np.flatnonzero(new)
            # Lists of all blocks of the batch at once; the carried ends are intervals, so what they cover vanishes.
            group = np.cumsum(new) - 1
            g, ms, me = merge_sorted(group, s, e)
            lists = np.searchsorted(g, np.arange(len(cuts) + 1))
            for k, c in enumerate(cuts):
                here = (entity[c], int(block[c]))
                lo, hi = lists[k], lists[k + 1]
                if here != at:
                    rows += loose()
                    at, reach, total, start, before = here, None, int(t[c]), None, None
                    if s[c] == _FIRST:  # the carried end
                        reach = int(me[lo])
                        if e[c] == _FIRST:  # of the first block: none
                            reach = None
                        lo += 1
                a, b = ms[lo:hi], me[lo:hi]
                if reach is not None and len(a):  # the list goes on from the batch before, or from an earlier block
                    skip = int(np.searchsorted(a, reach, "right"))
                    if skip:
                        reach = max(reach, int(b[:skip].max()))
                        a, b = a[skip:], b[skip:]
                        more = int(np.searchsorted(a, reach, "right"))
                        if more:
                            reach, a, b = max(reach, int(b[more - 1])), a[more:], b[more:]
                if not len(a):
                    continue
                ends = np.concatenate([[reach if reach is not None else 0], b[:-1]])
                if not loose_only:
                    first = 0 if reach is not None else 1
                    rows += [(*here, "gap", x, y, 0) for x, y in zip(ends[first:].tolist(), a[first:].tolist())]
                    starts = a[:-1].tolist()
                    if start is not None:
                        rows.append((*here, "period", start, reach, 0))
                    rows += [(*here, "period", x, y, 0) for x, y in zip(starts, b[:-1].tolist())]
                if start is None:
                    before = reach
                start, reach = int(a[-1]), int(b[-1])
            yield _rows(rows)
        yield _rows(loose())

    def _rows(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["entity", "block", "kind", "s", "e", "total"])
        if loose_only:
            out = out[out["kind"] == "loose"]
        else:
            out = out[out["kind"] != "loose"]
        return out.astype({"block": "int64", "s": "int64", "e": "int64", "total": "int64"})[["entity", "kind", "s", "e", "block", "total"]]

    return run


def periods_and_gaps(df: DataFrame, entity: str, start_us: str, end_us: str, block_us: int = BLOCK_US) -> DataFrame:
    """Columns ``entity``, kind (``period`` or ``gap``), start_us, end_us.

    ``start_us`` and ``end_us`` are long columns of microseconds.  Rows with a NULL in any of the three columns, or that end before they start,
    are left out; rows of no length count; touching rows join; repeated rows change nothing.  An entity with one period has no gap.  Empty
    tables give no rows; other columns are ignored.
    """
    rows = df.select(F.col(f"`{entity}`").cast("string").alias("entity"), F.col(f"`{start_us}`").cast("long").alias("s"), F.col(f"`{end_us}`").cast("long").alias("e"))
    rows = rows.filter("entity is not null and s is not null and e is not null and e >= s").withColumn("block", F.floor(F.col("s") / F.lit(block_us)))

    # What each block gets from those before it: one row a block, made by partial aggregates.
    tops = rows.groupBy("entity", "block").agg(F.max("e").alias("top"))
    by_block = W.partitionBy("entity").orderBy("block")
    carried = F.coalesce(F.max("top").over(by_block.rowsBetween(W.unboundedPreceding, -1)), F.lit(_FIRST))
    carry = tops.select("entity", "block", F.lit(_FIRST).alias("s"), carried.alias("e"), F.max("top").over(W.partitionBy("entity")).alias("total"))

    partial = rows.mapInPandas(_partial, "entity string, block long, s long, e long").withColumn("total", F.lit(0).cast("long"))
    met = carry.unionByName(partial).repartition("entity", "block").sortWithinPartitions("entity", "block", "s")
    # Both read the one shuffle.
    inner, loose = met.mapInPandas(_emit(False), _OUT), met.mapInPandas(_emit(True), _OUT)

    # A period that is open at the end of its block ends where the next block that begins any says, or with the entity.
    end = F.coalesce(F.lead("e").over(by_block), F.col("total"))
    last = loose.select("entity", F.lit("period").alias("kind"), "s", end.alias("e"))
    out = inner.select("entity", "kind", "s", "e").unionByName(last)
    return out.select(F.col("entity").alias(entity), "kind", F.col("s").alias("start_us"), F.col("e").alias("end_us"))
