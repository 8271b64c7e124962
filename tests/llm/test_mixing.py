import random

import numpy as np
import pytest

from quern.llm import mixing as M

TARGETS = "source string, target_share double, max_repeats int"


def test_pivot_keeps_mass_and_mean():
    rng = random.Random(1)
    sizes, probs = [rng.randrange(1, 50) for _ in range(40)], [rng.random() for _ in range(40)]
    mean, tries = np.zeros(40), 3000
    for _ in range(tries):
        p, got = M.Pivot(), {}
        for i, (a, q) in enumerate(zip(sizes, probs)):
            got.update(dict(p.meet(i, q, a, rng.random())))
        open_ = p.open
        mass = sum(sizes[i] * v for i, v in got.items()) + (open_[1] * open_[2] if open_ else 0)
        assert abs(mass - sum(a * q for a, q in zip(sizes, probs))) < 1e-6 and len(got) == 40 - bool(open_)
        for i, v in got.items():
            mean[i] += v
        if open_:
            mean[open_[0]] += open_[1]
    assert np.abs(mean / tries - probs).max() < 0.05


def test_plan():
    assert M.plan({"a": 100, "b": 100}, [("a", 0.5, 1), ("b", 0.5, 3)]) == {"a": 1.0, "b": 1.0}
    r = M.plan({"a": 1000, "b": 100}, [("a", 0.5, 1), ("b", 0.5, 3), ("none", 0.2, 2)])
    assert r == pytest.approx({"a": 0.3, "b": 3.0})
    assert M.plan({}, [("a", 1.0, 1)]) == {} and M.plan({"a": 5}, [("a", 0.0, 1)]) == {}


def test_mix(spark):
    rng = random.Random(3)
    docs = [(i, rng.choice(["big"] * 6 + ["mid", "small", None, "other"]), rng.choice([None, 0, rng.randrange(1, 900), rng.randrange(1, 300)])) for i in range(4000)]
    targets = spark.createDataFrame([("big", 0.4, 1), ("mid", 0.4, 3), ("small", 0.2, 2), ("absent", 0.1, 2), ("nothing", 0.0, 5)], TARGETS)
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, source string, n_tokens long, copies string").repartition(5)
    mixed = M.mix(df, targets)
    out = mixed.collect()
    assert sorted(r.doc_id for r in out) == list(range(4000))
    caps = {"big": 1, "mid": 3, "small": 2}
    assert all(0 <= r.copies <= caps.get(r.source, 0) for r in out)
    got = {r.source: r for r in M.shares(mixed, targets).collect()}
    for s, w in (("big", 0.4), ("mid", 0.4), ("small", 0.2)):
        assert abs(got[s].reached_share - w) < 0.002, got[s]
    assert got["absent"].reached_tokens == 0 and got["absent"].max_repeats == 2
    copies = M.copies(mixed).collect()
    assert len(copies) == sum(r.copies for r in out)
    assert sorted(map(tuple, M.mix(df, targets).collect())) == sorted(map(tuple, out))


def test_edges(spark):
    targets = spark.createDataFrame([("a", 1.0, 2)], TARGETS)
    none = spark.createDataFrame([], "doc_id long, source string, n_tokens long")
    assert M.mix(none, targets).count() == 0
    assert M.mix(none, targets.limit(0)).count() == 0
    one = spark.createDataFrame([(1, "a", 10), (2, "b", 10), (3, "a", 0)], "doc_id long, source string, n_tokens long")
    assert {r.doc_id: r.copies for r in M.mix(one, targets).collect()} == {1: 2, 2: 0, 3: 2}
    with pytest.raises(ValueError):
        M.mix(one, targets.union(targets))


def test_one_text_that_outweighs_the_rest(spark):
    """A text that is most of its source is decided first, so that the others can make up for it."""
    docs = [(0, "a", 68_000)] + [(i, "a", 40 + i % 90) for i in range(1, 800)] + [(i, "b", 100) for i in range(1000, 1300)]
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], TARGETS)
    df = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long")
    for seed in range(2):
        got = {r.source: r for r in M.shares(M.mix(df, targets, seed=seed), targets).collect()}
        assert abs(got["a"].reached_share - 0.5) < 0.002, got


def test_round_large():
    rng = np.random.default_rng(2)
    for _ in range(300):
        n, cap = int(rng.integers(1, 12)), int(rng.integers(1, 4))
        sizes = np.sort(rng.integers(100, 5000, n))[::-1].astype(float)
        rest = float(rng.integers(0, 6000))
        mass = rng.random() * cap * (sizes.sum() + rest)
        copies = M.round_large(sizes, rng.random(n), mass, rest, cap)
        assert ((0 <= copies) & (copies <= cap)).all()
        if rest * cap > sizes[0]:  # the rest can make up for any one document
            assert -1e-6 <= mass - (copies * sizes).sum() <= cap * rest + 1e-6
    mean = np.mean([M.round_large(np.array([100.0]), rng.random(1), 300.0, 900.0, 1)[0] for _ in range(4000)])
    assert abs(mean - 0.3) < 0.03


def test_partitions_change_nothing(spark):
    docs = [(i, "ab"[i % 3 == 0], 1 + i * 7 % 500) for i in range(3000)]
    targets = spark.createDataFrame([("a", 0.7, 2), ("b", 0.3, 1)], TARGETS)
    df = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long")
    assert sorted(M.mix(df.repartition(7), targets).collect()) == sorted(M.mix(df.coalesce(1), targets).collect())
