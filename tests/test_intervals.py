import random
from collections import defaultdict

import numpy as np

from quern.operators import intervals as I

SCHEMA = "entity string, s long, e long, block string, kind int"


def brute(rows):
    by, out = defaultdict(list), set()
    for k, s, e, *_ in rows:
        if k is not None and s is not None and e is not None and e >= s:
            by[k].append((s, e))
    for k, xs in by.items():
        xs.sort()
        a, b = xs[0]
        for s, e in xs[1:]:
            if s > b:
                out |= {(k, "period", a, b), (k, "gap", b, s)}
                a, b = s, e
            b = max(b, e)
        out.add((k, "period", a, b))
    return out


def got(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    out = [tuple(r) for r in I.periods_and_gaps(df.repartition(3), "entity", "s", "e", **kw).collect()]
    assert len(out) == len(set(out))
    return set(out)


def test_merge_sorted():
    g, s, e = I.merge_sorted(np.array([0, 0, 0, 1, 1]), np.array([1, 2, 9, 0, 4]), np.array([5, 3, 9, 4, 6]))
    assert list(zip(g, s, e)) == [(0, 1, 5), (0, 9, 9), (1, 0, 6)]


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for i in range(3000):
        k = rng.choice(["a", "b", None, "c", "hot", "hot", "hot"])
        s = rng.randrange(-500, 60_000)
        e = s + rng.choice([0, 1, 5, 30, rng.randrange(0, 200), -3, 20_000 if rng.random() < 0.02 else 2])
        rows.append((k, s if rng.random() < 0.97 else None, e if rng.random() < 0.97 else None, "x", i))
    rows += rows[:300]
    for block in (7, 500, 10_000, 10**9):
        assert got(spark, rows, block_us=block) == brute(rows), block


def test_edge_cases(spark):
    assert got(spark, []) == set()
    assert got(spark, [("a", None, 3, "", 0), (None, 1, 2, "", 0), ("a", 5, 4, "", 0)]) == set()
    rows = [("a", 1, 1, "", 0), ("a", 1, 1, "", 0), ("a", 2, 3, "", 0), ("a", 3, 4, "", 0)]  # no length, repeated, touching
    assert got(spark, rows) == {("a", "period", 1, 1), ("a", "gap", 1, 2), ("a", "period", 2, 4)}
    assert got(spark, [("x" * 50_000, 1, 2, "", 0)]) == {("x" * 50_000, "period", 1, 2)}


def test_times_beyond_2_to_53_and_plan(spark):
    far = 2**61
    rows = [("a", far + 1, far + 3, "", 0), ("a", far + 5, far + 7, "", 0), ("a", -far, -far + 1, "", 0)]
    assert got(spark, rows, block_us=2) == brute(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    plan = I.periods_and_gaps(df, "entity", "s", "e")._jdf.queryExecution().executedPlan().toString()
    import re

    assert len(set(re.findall(r"Exchange hashpartitioning[^\n]*plan_id=(\d+)", plan))) <= 7 and "Join" not in plan  # three of them twice: these are run once


def test_odd_times(spark, tmp_path):
    from quern.plans import pipeline_queries as P

    t = "1-" + "0" * 8 + "-" + "a" * 24
    rows = [(t, 1.0, 2.0), (f"Root={t.upper()};x", 3e11, 4e11), (t, float("nan"), 2.0), (t, 5.0, float("inf")), (t, 1e17, 2e17), (t, None, 1.0), (None, 1.0, 2.0)]
    spark.createDataFrame(rows, "trace_id string, start_time double, end_time double").write.parquet(str(tmp_path / "subsegment.parquet"))
    assert {tuple(r) for r in P.p3_found(spark, str(tmp_path)).collect()} == {(t, "period", 10**6, 2 * 10**6), (t, "gap", 2 * 10**6, 3 * 10**14), (t, "period", 3 * 10**14, 4 * 10**14)}
