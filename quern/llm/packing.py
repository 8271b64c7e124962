"""Filling containers of fixed capacity with items of varying length, splitting only what exceeds the capacity.

Best fit in bulk-synchronous steps.  Items and gaps are sorted by size; in each step all items of one size, the largest first, are matched at
once: a sweep takes the smallest gap that holds them (the successor), ties between items are decided by their rank within the size, the gaps shrink and
move to their new place, and what finds no gap opens containers.

Sizes are whole numbers up to the capacity, so items of one size, and containers of one gap, stand for each other.  The steps therefore work on
counts by size, at most ``capacity`` rows a plan whatever the number of items, as one task a plan; their result is a table of runs (items of this size
with ranks from a to b go to containers from c on, so many each).  Items themselves are touched twice, in parallel: to count sizes, and to look up their container.
Items are kept by class (size, bucket of the id): the rank of an item is the number of items in earlier classes of its size and its place in its own, so a size
that a third of all items have is never sorted in one task.  Runs are cut at the borders of classes and joined to items by class; nothing goes to the driver.
"""

from __future__ import annotations

import bisect
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.session import settle

#: Buckets by item id; ranks are counted within them.
BUCKETS = 1024
#: Largest capacity accepted: it bounds the histogram and the list of runs.
MAX_CAPACITY = 1 << 20

_PIECES = "array<struct<container_no: bigint, piece_no: int, start_token: bigint, n_tokens: bigint>>"
_RUNS = "plan_id int, size int, rank_lo long, n long, container_lo long, each long"


class Gaps:
    """Open containers by gap: for each gap the runs [first, count) of container numbers that have it, gaps in order."""

    def __init__(self) -> None:
        self.keys: list[int] = []
        self.runs: dict[int, list[tuple[int, int]]] = {}

    def put(self, gap: int, first: int, count: int) -> None:
        if count <= 0 or gap <= 0:
            return
        if gap not in self.runs:
            bisect.insort(self.keys, gap)
            self.runs[gap] = []
        self.runs[gap].append((first, count))

    def successor(self, size: int) -> int | None:
        at = bisect.bisect_left(self.keys, size)
        return self.keys[at] if at < len(self.keys) else None

    def take(self, gap: int, most: int) -> tuple[int, int]:
        first, count = self.runs[gap].pop()
        if count > most:
            self.runs[gap].append((first + most, count - most))
            count = most
        elif not self.runs[gap]:
            del self.runs[gap]
            self.keys.pop(bisect.bisect_left(self.keys, gap))
        return first, count


def best_fit(sizes: Sequence[int], counts: Sequence[int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (size, rank_lo, n, container_lo, each) and the number of containers.  Item ``r`` of a run goes to container ``container_lo + (r - rank_lo) // each``.

    Items of size 0 share one container.
    """
    gaps, runs, opened = Gaps(), [], 0
    for size, left in sorted(zip(map(int, sizes), map(int, counts)), reverse=True):
        if not left:
            continue
        if size == 0:
            opened = max(opened, 1)
            runs.append((0, 0, left, 0, left))
            continue
        rank = 0
        while left:
            gap = gaps.successor(size)
            each = (capacity if gap is None else gap) // size
            want = -(-left // each)
            if gap is None:
                gap, first, count = capacity, opened, want
                opened += want
            else:
                first, count = gaps.take(gap, want)
            n = min(left, count * each)
            runs.append((size, rank, n, first, each))
            full = n // each
            gaps.put(gap - each * size, first, full)
            gaps.put(gap - (n - full * each) * size, first + full, count - full)
            rank, left = rank + n, left - n
    return runs, opened


def _runs_of_plan(pdf: pd.DataFrame) -> pd.DataFrame:
    runs, _ = best_fit(pdf["size"], pdf["n"], int(pdf["capacity"].iloc[0]))
    out = pd.DataFrame(runs, columns=["size", "rank_lo", "n", "container_lo", "each"])
    out.insert(0, "plan_id", int(pdf["plan_id"].iloc[0]))
    return out


def pack(sized: DataFrame, plans: Sequence[tuple[int, int]], item: str = "doc_id", size: str = "n_tokens", buckets: int = BUCKETS) -> DataFrame:
    """Every item in containers of every plan: plan_id, container_no, item, piece_no, start_token, n_tokens.

    ``sized`` has a unique item id (long) and a size (NULL counts as 0).  ``plans``: (plan_id, capacity), capacities up to MAX_CAPACITY.  A larger item than the capacity is cut
    into full pieces, each a container of its own, and a rest that is packed like the others; nothing else is cut.  Items of size 0 come out in the container
    numbered 0 and take no room.  Empty input gives no rows.  The result depends on ids and sizes only, not on how rows are partitioned.
    """
    if not plans or any(not 0 < c <= MAX_CAPACITY for _, c in plans) or len({p for p, _ in plans}) != len(plans):
        raise ValueError(f"plans need different ids and capacities from 1 to {MAX_CAPACITY}")
    n = F.coalesce(F.col(size).cast("long"), F.lit(0))
    items = sized.select(F.col(item).cast("long").alias("item"), n.alias("tokens"), F.pmod(F.xxhash64(F.col(item).cast("long")), F.lit(buckets)).cast("int").alias("bucket"))

    # Step 1: how many items of each class, and of each size in each plan.
    classes = settle(items.groupBy("tokens", "bucket").agg(F.count(F.lit(1)).alias("n")))
    each = F.explode(F.array(*[F.struct(F.lit(p).cast("int").alias("plan_id"), F.lit(c).cast("long").alias("capacity")) for p, c in plans]))
    whole = F.col("tokens") <= F.col("capacity")
    by_plan = classes.select("*", each.alias("p")).select("tokens", "bucket", "n", "p.*")
    by_plan = by_plan.withColumn("full", F.when(whole, F.lit(0)).otherwise(F.expr("tokens div capacity")).cast("long")).withColumn("size", F.when(whole, F.col("tokens")).otherwise(F.col("tokens") % F.col("capacity")).cast("int"))
    rests = by_plan.filter(whole | (F.col("size") > 0))
    histogram = rests.groupBy("plan_id", "capacity", "size").agg(F.sum("n").alias("n"))

    # Step 2: the sweeps, one task a plan; the runs are bounded by the capacities, not by the items.
    runs = settle(histogram.groupBy("plan_id").applyInPandas(_runs_of_plan, _RUNS))
    free = runs.groupBy("plan_id").agg(F.max(F.col("container_lo") + F.expr("(n - 1) div each") + 1).alias("free"))

    # Step 3: runs cut at the borders of classes. Both are laid along the ranks of a size; a stretch belongs to the last run and the last class that began.
    below = W.partitionBy("plan_id", "size").orderBy("tokens", "bucket").rowsBetween(W.unboundedPreceding, -1)
    placed = rests.select("plan_id", "size", F.coalesce(F.sum("n").over(below), F.lit(0)).alias("at"), F.struct("tokens", "bucket").alias("class"))
    begun = runs.select("plan_id", "size", F.col("rank_lo").alias("at"), F.struct("rank_lo", "container_lo", "each").alias("run"))
    along = W.partitionBy("plan_id", "size").orderBy("at", F.col("class").isNull())
    since = along.rowsBetween(W.unboundedPreceding, 0)
    laid = placed.unionByName(begun, allowMissingColumns=True).withColumn("next", F.lead("at").over(along))
    laid = laid.withColumn("start", F.max(F.when(F.col("class").isNotNull(), F.col("at"))).over(since)).withColumn("run", F.last("run", True).over(since)).withColumn("class", F.last("class", True).over(since))
    stretch = F.struct((F.col("at") - F.col("start")).alias("nr"), F.col("run.container_lo").alias("first"), (F.col("start") - F.col("run.rank_lo")).alias("skip"), F.col("run.each").alias("each"))
    stretches = laid.filter("next is null or next > at").groupBy("plan_id", "class").agg(F.array_sort(F.collect_list(stretch)).alias("stretches")).select("plan_id", "class.tokens", "class.bucket", "stretches")

    # Full pieces are numbered behind the containers of the runs: by bucket, then by size.
    long_ = by_plan.filter("full > 0").withColumn("pieces", F.col("n") * F.col("full"))
    buckets_below = W.partitionBy("plan_id").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    of_bucket = long_.groupBy("plan_id", "bucket").agg(F.sum("pieces").alias("pieces")).select("plan_id", "bucket", F.coalesce(F.sum("pieces").over(buckets_below), F.lit(0)).alias("before"))
    earlier = W.partitionBy("plan_id", "bucket").orderBy("tokens").rowsBetween(W.unboundedPreceding, -1)
    base = long_.withColumn("own", F.coalesce(F.sum("pieces").over(earlier), F.lit(0))).join(of_bucket, ["plan_id", "bucket"]).join(free, "plan_id", "left")
    base = base.select("plan_id", "tokens", "bucket", (F.coalesce("free", F.lit(0)) + F.col("before") + F.col("own")).alias("base"))

    # Step 4: items by class, once for all plans; plans are spread out only after that.
    keys = ["plan_id", "tokens", "bucket"]
    known = by_plan.select("plan_id", "tokens", "bucket", "capacity", "full", "size").join(stretches, keys, "left").join(base, keys, "left")
    known = known.groupBy("tokens", "bucket").agg(F.collect_list(F.struct("plan_id", "capacity", "full", "size", "stretches", "base")).alias("plans"))
    nr = F.row_number().over(W.partitionBy("tokens", "bucket").orderBy("item")).cast("long") - 1
    ranked = items.withColumn("nr", nr).join(known, ["tokens", "bucket"]).select("item", "nr", F.explode("plans").alias("p")).select("item", "nr", "p.*")
    mine = F.element_at(F.filter("stretches", lambda x: x["nr"] <= F.col("nr")), -1)
    ranked = ranked.withColumn("s", F.when(F.col("stretches").isNotNull(), mine)).drop("stretches")

    def piece(container, no, start, tokens):
        return F.struct(container.cast("long").alias("container_no"), no.cast("int").alias("piece_no"), start.cast("long").alias("start_token"), tokens.cast("long").alias("n_tokens"))

    rest = piece(F.col("s.first") + F.expr("(s.skip + nr) div s.each"), F.col("full"), F.col("full") * F.col("capacity"), F.col("size"))
    cut = F.transform(F.sequence(F.lit(0).cast("long"), F.col("full") - 1), lambda i: piece(F.col("base") + F.col("nr") * F.col("full") + i, i, i * F.col("capacity"), F.col("capacity")))
    pieces = F.concat(F.when(F.col("full") > 0, cut).otherwise(F.array().cast(_PIECES)), F.when(F.col("s").isNotNull(), F.array(rest)).otherwise(F.array().cast(_PIECES)))
    return ranked.select("plan_id", F.col("item").alias(item), F.explode(pieces).alias("x")).select("plan_id", "x.container_no", item, "x.piece_no", "x.start_token", "x.n_tokens")


def utilisation(packed: DataFrame, plans: Sequence[tuple[int, int]]) -> DataFrame:
    """Per plan: containers, tokens, the least number of containers that could do, and the share of room used."""
    capacity = F.element_at(F.create_map(*[F.lit(x) for p, c in plans for x in (p, c)]), F.col("plan_id")).cast("long")
    out = packed.groupBy("plan_id").agg((F.max("container_no") + 1).alias("containers"), F.sum("n_tokens").alias("tokens"))
    return out.select("plan_id", capacity.alias("capacity"), "containers", "tokens", F.ceil(F.col("tokens") / capacity).alias("least"), (F.col("tokens") / (F.col("containers") * capacity)).alias("used"))


def validity(packed: DataFrame, sized: DataFrame, plans: Sequence[tuple[int, int]], item: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """Per plan: containers over capacity, items whose pieces don't make up their size (or that are missing), pieces cut needlessly, and items packed."""
    capacity = F.element_at(F.create_map(*[F.lit(x) for p, c in plans for x in (p, c)]), F.col("plan_id"))
    over = packed.groupBy("plan_id", "container_no").agg(F.sum("n_tokens").alias("used")).groupBy("plan_id").agg(F.count(F.when(F.col("used") > capacity, 1)).alias("overfull"))
    each = F.explode(F.array(*[F.lit(p) for p, _ in plans])).alias("plan_id")
    due = sized.select(each, F.col(item).alias("item"), F.coalesce(F.col(size), F.lit(0)).alias("due"))
    got = packed.groupBy("plan_id", F.col(item).alias("item")).agg(F.sum("n_tokens").alias("got"), F.count(F.lit(1)).alias("pieces"))
    needed = F.greatest(F.ceil(F.col("due") / capacity), F.lit(1))
    both = due.join(got, ["plan_id", "item"], "left").groupBy("plan_id").agg(F.count(F.when(~F.col("got").eqNullSafe(F.col("due")), 1)).alias("misplaced"), F.count(F.when(F.col("pieces") > needed, 1)).alias("needless_cuts"), F.count(F.lit(1)).alias("items"))
    return both.join(over, "plan_id", "left")
