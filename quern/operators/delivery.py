"""Exactly-once delivery: keep one copy of each message that was delivered at least once.

Producers number their messages, so a message is (producer, number).  For each producer the operator keeps the numbers seen so far as
disjoint ranges: deliveries are visited in order of preference, a number outside all ranges is accepted and extends or joins ranges, a
covered number is a surplus copy.  Identifiers that don't end in a plain number are resolved by exact lookup of the whole identifier.

Plan at scale.  Each map task first runs the ledger over its own split, so of any message at most one copy a task goes on; surplus copies
travel keyless and spread evenly, with their id only.  One shuffle brings the rest together by (producer, block of numbers); the ledger runs
again over each sorted partition as a stream.  Memory is one Arrow batch plus the ranges of the producer block in hand (at most half a
block), so a message or producer that holds a third of all rows neither gathers in one task nor needs a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Blanks, tabs and line ends around identifiers don't count.
BLANKS = " \t\r\n"
#: Numbers of one producer that one task sees together; a long run of numbers spreads over many tasks.
BLOCK = 1 << 16


def trimmed(c: Column) -> Column:
    """Identifier without blanks around it; NULL if nothing is left."""
    t = F.trim(c, F.lit(BLANKS))
    return F.when(t != "", t)


class RangeLedger:
    """Numbers seen of one producer, as disjoint, sorted, closed ranges."""

    def __init__(self) -> None:
        self.lo = np.empty(0, np.int64)
        self.hi = np.empty(0, np.int64)

    def covers(self, numbers: np.ndarray) -> np.ndarray:
        if not len(self.lo):
            return np.zeros(len(numbers), bool)
        at = np.searchsorted(self.lo, numbers, "right") - 1
        return (at >= 0) & (numbers <= self.hi[np.maximum(at, 0)])

    def add(self, numbers: np.ndarray, upto: np.ndarray | None = None) -> None:
        """Add numbers, or the ranges from them up to ``upto``, merging ranges that touch or overlap."""
        if not len(numbers):
            return
        lo = np.concatenate([self.lo, numbers])
        hi = np.concatenate([self.hi, numbers if upto is None else upto])
        order = np.argsort(lo, kind="stable")
        lo, hi = lo[order], np.maximum.accumulate(hi[order])
        new = np.concatenate([[True], lo[1:] > hi[:-1] + 1])
        self.lo, self.hi = lo[new], hi[np.concatenate([new[1:], [True]])]

    def accept(self, numbers: np.ndarray) -> np.ndarray:
        """True for each number that is not yet covered, once; all are covered afterwards."""
        first = np.zeros(len(numbers), bool)
        first[np.unique(numbers, return_index=True)[1]] = True
        new = first & ~self.covers(numbers)
        self.add(numbers[new])
        return new


def _ledger_pass(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Mark surplus copies in rows sorted by (producer, block), preference.  Rows already marked pass through.

    Small producers are handled together: the numbers of each get an own offset in one ledger, wide enough that ranges never touch.
    """
    carry: tuple | None = None
    ledger, keys = RangeLedger(), set()
    for pdf in batches:
        if not len(pdf):
            continue
        surplus = pdf["surplus"].to_numpy(bool, copy=True)
        live = np.flatnonzero(~surplus)
        if not len(live):
            yield pdf
            continue
        part = pdf.iloc[live]
        h1, h2, block = (part[c].to_numpy(np.int64) for c in ("h1", "h2", "block"))
        exact = part["exact"].to_numpy(object)
        number, upto = part["number"].to_numpy(np.int64), part["upto"].to_numpy(np.int64)
        seen = part["at"].to_numpy(np.int64) == SEEN
        new = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (block[1:] != block[:-1])])
        group = np.cumsum(new) - 1
        last = len(part) - 1
        keep = np.zeros(len(part), bool)
        named = block >= 0
        # Rows of the group that went on from the batch before.
        head = np.zeros(len(part), bool)
        if carry == (h1[0], h2[0], block[0]):
            head = group == 0
        else:
            ledger, keys = RangeLedger(), set()
        if head.any() and named[0]:
            ledger.add(number[head & seen], upto[head & seen])
            mine = head & ~seen
            keep[mine] = ledger.accept(number[mine])
        # Complete groups and the last one: one ledger, numbers shifted apart by twice the block.
        rest = ~head & named
        if rest.any():
            shifted = group[rest] * (2 * BLOCK) + number[rest] % BLOCK
            all_seen, known = RangeLedger(), seen[rest]
            all_seen.add(shifted[known], shifted[known] + (upto - number)[rest][known])
            keep[np.flatnonzero(rest)[~known]] = all_seen.accept(shifted[~known])
        # Malformed identifiers: exact lookup.
        for i in np.flatnonzero(~named):
            if new[i] and not (i == 0 and head[0]):
                keys = set()
            if exact[i] not in keys:
                keys.add(exact[i])
                keep[i] = not seen[i]
        # What the next batch may go on with.
        if named[last]:
            tail = group == group[last]
            if not (head.any() and group[last] == 0):
                ledger = RangeLedger()
                ledger.add(number[tail & seen], upto[tail & seen])
                ledger.add(number[tail & keep])
        carry = (h1[last], h2[last], block[last])
        surplus[live] = ~keep
        out = pdf.copy()
        out["surplus"] = surplus
        yield out


_COLS = "h1 long, h2 long, block long, number long, upto long, exact string, at long, id long, surplus boolean"
#: The time of what earlier batches delivered: before all others.
SEEN = -(2**63)
_ORDER = ["h1", "h2", "block", "exact", "at", "id"]


def _parts(df: DataFrame, message_keys: list[str], sequence_key: str) -> tuple[list[Column], Column, Column, Column]:
    """Trimmed message keys, producer, number, and whether the identifier ends in a plain number."""
    seq = trimmed(F.col(f"`{sequence_key}`"))
    # A canonical number: no leading zeros, at most 18 digits, so that text and number say the same.
    digits = F.regexp_extract(seq, r"-(0|[1-9][0-9]{0,17})$", 1)
    plain = digits != ""
    number = F.when(plain, digits).otherwise(F.lit("0")).cast("long")
    producer = F.when(plain, F.substring(seq, F.lit(1), F.length(seq) - F.length(digits))).otherwise(seq)
    return [trimmed(F.col(f"`{k}`")) for k in message_keys], producer, number, plain


def _named(parts: list[Column], producer: Column) -> Column:
    wanted = producer.isNotNull()
    for p in parts:
        wanted &= p.isNotNull()
    return wanted


def _rows(parts: list[Column], producer: Column, number: Column, upto: Column, plain: Column, block: Column, at: Column, id_: Column) -> list[Column]:
    return [
        F.xxhash64(*parts, producer).alias("h1"), F.xxhash64(F.lit(7), producer, *parts).alias("h2"), F.when(plain, block).otherwise(F.lit(-1)).cast("long").alias("block"), number.alias("number"), upto.alias("upto"),
        F.when(~plain, F.to_json(F.array(*parts, producer))).alias("exact"), at.alias("at"), id_.alias("id"), F.lit(False).alias("surplus"),
    ]


def _marked(df: DataFrame, message_keys: list[str], sequence_key: str, order: str, row_id: str, seen: DataFrame | None) -> DataFrame:
    """(id, surplus, message) of surplus deliveries and of those that went through the shuffle; ``message`` is a hash of the identifier."""
    parts, producer, number, plain = _parts(df, message_keys, sequence_key)
    stamp = F.coalesce(F.unix_micros(F.col(f"`{order}`").cast("timestamp")), F.lit(2**63 - 1))
    block = (number / F.lit(BLOCK)).cast("long")
    rows = df.filter(_named(parts, producer) & F.col(f"`{row_id}`").isNotNull()).select(*_rows(parts, producer, number, number, plain, block, stamp, F.col(f"`{row_id}`").cast("long")))
    local = rows.sortWithinPartitions(*_ORDER).mapInPandas(_ledger_pass, _COLS)
    if seen is not None:
        # Ranges of earlier batches, cut at the borders of blocks; malformed identifiers have no range.
        first, last = (F.col("lo") / F.lit(BLOCK)).cast("long"), (F.col("hi") / F.lit(BLOCK)).cast("long")
        known = seen.withColumn("__block", F.explode(F.when(F.col("lo").isNotNull(), F.sequence(first, last)).otherwise(F.array(F.lit(-1).cast("long")))))
        ranged = F.col("lo").isNotNull()
        lo, hi = F.greatest("lo", F.col("__block") * BLOCK), F.least("hi", F.col("__block") * BLOCK + (BLOCK - 1))
        whose = F.when(ranged, F.concat("producer", F.lit("-"))).otherwise(F.col("producer"))
        zero = F.lit(0).cast("long")
        known = known.select(*_rows([F.col(f"`{k}`") for k in message_keys], whose, F.when(ranged, lo).otherwise(zero), F.when(ranged, hi).otherwise(zero), ranged, F.col("__block"), F.lit(SEEN), zero))
        local = local.unionByName(known)
    light = local.select(
        # Zeros, not NULLs: a NULL would turn whole columns to floats on the way to Python.
        *[F.when(~F.col("surplus"), F.col(c)).otherwise(F.lit(0)).alias(c) for c in ("h1", "h2", "block", "number", "upto")],
        F.when(~F.col("surplus"), F.col("exact")).alias("exact"), F.when(~F.col("surplus"), F.col("at")).otherwise(F.lit(0)).alias("at"), "id", "surplus",
        F.when(F.col("surplus"), F.xxhash64("id")).otherwise(F.xxhash64("h1", "h2", "block")).alias("to"),
    )
    return light.repartition("to").sortWithinPartitions(*_ORDER).mapInPandas(_ledger_pass, _COLS).filter(F.col("surplus") & (F.col("at") != SEEN))


def surplus_copies(df: DataFrame, message_keys: list[str], sequence_key: str, order: str, row_id: str, seen: DataFrame | None = None) -> DataFrame:
    """``row_id`` of every delivery that is a surplus copy, as one column of that name.

    A message is identified by ``message_keys`` and ``sequence_key`` together, blanks around them removed; ``sequence_key`` ends in ``-number``
    where it is well formed.  The copy with the smallest ``order`` (a timestamp; NULL counts as latest), then the smallest ``row_id``, is kept.
    Rows with a NULL or blank identifier identify nothing and never come out; rows without ``row_id`` can't be named and are passed over.  ``row_id`` must be unique (repeated rows that repeat it come out
    as often as they are surplus).  Empty tables give no rows; other columns are ignored.

    ``seen``: the ledger of earlier batches (see ``seen_messages``); what it holds was delivered, so every copy of it is surplus whatever its time.
    """
    kind = df.schema[row_id].dataType
    return _marked(df, message_keys, sequence_key, order, row_id, seen).select(F.col("id").cast(kind).alias(row_id))


def keep_once(df: DataFrame, message_keys: list[str], sequence_key: str, order: str, row_id: str, seen: DataFrame | None = None) -> DataFrame:
    """The rows of ``df`` without surplus copies; rows that identify nothing, or have no ``row_id``, are kept.

    Where rows repeat a ``row_id``, as many of them go as are surplus, the latest first; rows that share it should be copies of one message.
    """
    gone = surplus_copies(df, message_keys, sequence_key, order, row_id, seen).groupBy(F.col(row_id).alias("__id")).agg(F.count(F.lit(1)).alias("__surplus"))
    parts, producer, _, _ = _parts(df, message_keys, sequence_key)
    named = _named(parts, producer) & F.col(f"`{row_id}`").isNotNull()
    met = df.filter(named).join(gone, F.col(f"`{row_id}`") == F.col("__id"), "left")
    # Of rows with one id the first stay; the join has brought them together already.
    mine = W.partitionBy(f"`{row_id}`")
    met = met.withColumn("__nr", F.row_number().over(mine.orderBy(F.col(f"`{order}`").asc_nulls_last()))).withColumn("__all", F.count(F.lit(1)).over(mine))
    kept = met.filter(F.col("__nr") <= F.col("__all") - F.coalesce("__surplus", F.lit(0)))
    return kept.select(*[f"`{c}`" for c in df.columns]).unionByName(df.filter(~F.coalesce(named, F.lit(False))))


def seen_ranges(df: DataFrame, message_keys: list[str], sequence_key: str, seen: DataFrame | None = None) -> DataFrame:
    """The ledger as a table: for each message key and producer the disjoint ranges of numbers seen, those of ``seen`` included.

    Numbers are made distinct first (partial aggregation), then joined into islands within blocks and across block borders, so that a long
    producer is never sorted in one task.
    """
    seq = trimmed(F.col(f"`{sequence_key}`"))
    digits = F.regexp_extract(seq, r"-(0|[1-9][0-9]{0,17})$", 1)
    keys = [trimmed(F.col(f"`{k}`")).alias(k) for k in message_keys]
    base = df.select(*keys, F.substring(seq, F.lit(1), F.length(seq) - F.length(digits) - 1).alias("producer"), F.when(digits != "", digits).cast("long").alias("lo")).dropna()
    ids = [*message_keys, "producer"]
    block = (F.col("lo") / F.lit(BLOCK)).cast("long")
    numbers = base.distinct().withColumn("hi", F.col("lo"))
    if seen is not None:
        first, last = block, (F.col("hi") / F.lit(BLOCK)).cast("long")
        cut = seen.filter("lo is not null").select(*ids, "lo", "hi", F.explode(F.sequence(first, last)).alias("b"))
        numbers = numbers.unionByName(cut.select(*ids, F.greatest("lo", F.col("b") * BLOCK).alias("lo"), F.least("hi", F.col("b") * BLOCK + (BLOCK - 1)).alias("hi")))
    numbers = numbers.withColumn("block", block)
    inner = W.partitionBy(*ids, "block").orderBy("lo", "hi")
    upto = F.max("hi").over(inner.rowsBetween(W.unboundedPreceding, -1))
    flagged = numbers.withColumn("new", (F.coalesce(upto, F.lit(-2)) < F.col("lo") - 1).cast("int"))
    islands = flagged.withColumn("island", F.sum("new").over(inner)).groupBy(*ids, "block", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    # Islands that touch a block border join their neighbours; there are at most two of these a block.
    outer = W.partitionBy(*ids).orderBy("lo")
    edge = islands.withColumn("at_border", (F.col("lo") % BLOCK == 0) | (F.col("hi") % BLOCK == BLOCK - 1))
    inside = edge.filter("not at_border").select(*ids, "lo", "hi")
    chain = edge.filter("at_border").withColumn("new", (F.coalesce(F.lag("hi").over(outer), F.lit(-2)) != F.col("lo") - 1).cast("int"))
    joined = chain.withColumn("run", F.sum("new").over(outer)).groupBy(*ids, "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select(*ids, "lo", "hi")
    return inside.unionByName(joined)


def seen_messages(df: DataFrame, message_keys: list[str], sequence_key: str, seen: DataFrame | None = None) -> DataFrame:
    """The whole ledger after ``df``, to be written and handed to the next batch as ``seen``: ranges by producer, and malformed identifiers as they are, without a range (lo, hi NULL)."""
    parts, producer, _, plain = _parts(df, message_keys, sequence_key)
    none = F.lit(None).cast("long")
    odd = df.filter(_named(parts, producer) & ~plain).select(*[p.alias(k) for p, k in zip(parts, message_keys)], producer.alias("producer"), none.alias("lo"), none.alias("hi"))
    if seen is not None:
        odd = odd.unionByName(seen.filter("lo is null"))
    return seen_ranges(df, message_keys, sequence_key, seen).unionByName(odd.distinct())
