import random
from collections import Counter
from datetime import datetime, timedelta

import numpy as np

from quern.operators import delivery as D

SCHEMA = "delivery_id long, received_at timestamp_ntz, pipeline_id string, worker_id string, h1 long, surplus string"


def brute(rows):
    best = {}
    out = Counter()
    named = [(i, t, p.strip(" \t\r\n"), w.strip(" \t\r\n")) for i, t, p, w, *_ in rows if i is not None and p and w and p.strip(" \t\r\n") and w.strip(" \t\r\n")]
    for i, t, p, w in sorted(named, key=lambda r: (r[1] is None, r[1] or datetime.min, r[0])):
        if (p, w) in best:
            out[i] += 1
        best[p, w] = i
    return out


def found(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return Counter(r[0] for r in D.surplus_copies(df.repartition(3), ["pipeline_id"], "worker_id", "received_at", "delivery_id").collect())


def test_ledger():
    led = D.RangeLedger()
    assert led.accept(np.array([3, 4, 3, 9])).tolist() == [True, True, False, True]
    assert led.accept(np.array([5, 4, 8])).tolist() == [True, False, True]
    assert list(zip(led.lo, led.hi)) == [(3, 5), (8, 9)]
    led.accept(np.array([6, 7]))
    assert list(zip(led.lo, led.hi)) == [(3, 9)]
    rng, seen = np.random.default_rng(1), set()
    led = D.RangeLedger()
    for _ in range(50):
        x = rng.integers(0, 200, 20)
        for v, ok in zip(x, led.accept(x)):
            assert ok == (v not in seen)
            seen.add(v)
    assert (led.lo[1:] > led.hi[:-1] + 1).all() and sum(led.hi - led.lo + 1) == len(seen)


def test_against_brute_force(spark):
    rng = random.Random(3)
    t0 = datetime(2025, 1, 1)
    pids = ["p1", "P1", " p1\t", "p2\r\n", "", "  ", None, "p3"]
    rows = []
    for i in range(4000):
        worker = rng.choice([f"w{rng.randrange(40)}-{rng.randrange(30)}", f"w{rng.randrange(9)}-{rng.randrange(60000, 70000)}", "plain", "w-007", "w-", " w1-3 ", None, "\t", "w-99999999999999999999"])
        rows.append((i, t0 + timedelta(seconds=rng.randrange(50)) if rng.random() < 0.95 else None, rng.choice(pids), worker, rng.randrange(5), "x"))
    # one message and one producer that hold a third of the rows each
    rows += [(10_000 + i, t0 + timedelta(seconds=i % 7), "hot", "w-1", 0, None) for i in range(2500)]
    rows += [(20_000 + i, t0, "hot", f"long-{i % 2300}", 0, None) for i in range(2500)]
    rng.shuffle(rows)
    assert found(spark, rows) == brute(rows)


def test_edge_cases(spark):
    t = datetime(2025, 1, 1)
    assert found(spark, []) == Counter()
    assert found(spark, [(1, t, "p", "w-1", None, None), (2, t, "p", "w-1", None, None), (None, t, "p", "w-1", 1, "y")]) == Counter([2])
    assert found(spark, [(1, t, "p", "w-1", None, None)] * 3) == Counter([1, 1])  # repeated rows
    long_ = "w" * 100_000
    assert found(spark, [(1, t, "p", long_, 1, ""), (2, None, "p", long_, 1, "")]) == Counter([2])


def test_keep_once_and_ranges(spark):
    t = datetime(2025, 1, 1)
    rows = [(1, t, "p", "w-1", 0, ""), (2, t, "p", "w-2", 0, ""), (3, t, "p", "w-1", 0, ""), (4, t, None, "w-1", 0, ""), (5, t, "p", "w-65535", 0, ""), (6, t, "p", "w-65536", 0, ""), (7, t, "p", "odd", 0, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    kept = D.keep_once(df, ["pipeline_id"], "worker_id", "received_at", "delivery_id")
    assert sorted(r.delivery_id for r in kept.collect()) == [1, 2, 4, 5, 6, 7] and kept.columns == df.columns
    assert sorted(map(tuple, D.seen_ranges(df, ["pipeline_id"], "worker_id").collect())) == [("p", "w", 1, 2), ("p", "w", 65535, 65536)]


def test_repeated_rows_are_kept_once(spark):
    t = datetime(2025, 1, 1)
    rows = [(1, t, "p", "w-1", 0, ""), (1, t, "p", "w-1", 0, ""), (2, t, "p", "w-2", 0, ""), (3, None, "p", "w-2", 0, ""), (None, t, "p", "w-9", 0, ""), (4, t, None, None, 0, ""), (4, t, None, None, 0, "")]
    kept = D.keep_once(spark.createDataFrame(rows, SCHEMA), ["pipeline_id"], "worker_id", "received_at", "delivery_id")
    assert sorted((r.delivery_id or 0) for r in kept.collect()) == [0, 1, 2, 4, 4]


def test_batches_give_what_one_run_gives(spark):
    rng = random.Random(9)
    t0 = datetime(2025, 1, 1)
    rows = [(i, t0 + timedelta(seconds=i), rng.choice(["p", " q"]), rng.choice([f"w-{rng.randrange(300)}", f"v-{rng.randrange(65400, 65700)}", f"odd{rng.randrange(40)}", "x-01", None]), 0, "") for i in range(3000)]
    seen, kept = None, []
    for part in (rows[:1000], rows[1000:1100], rows[1100:]):
        df = spark.createDataFrame(part, SCHEMA).repartition(3)
        kept += [r.delivery_id for r in D.keep_once(df, ["pipeline_id"], "worker_id", "received_at", "delivery_id", seen).collect()]
        ledger = D.seen_messages(df, ["pipeline_id"], "worker_id", seen)
        seen = spark.createDataFrame(ledger.collect(), ledger.schema)
    gone = brute(rows)
    assert sorted(kept) == [r[0] for r in rows if r[0] not in gone]
    whole = D.seen_messages(spark.createDataFrame(rows, SCHEMA), ["pipeline_id"], "worker_id")
    assert sorted(map(str, seen.collect())) == sorted(map(str, whole.collect()))
