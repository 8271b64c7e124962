import random

import pytest

from quern.llm import packing as P


def check(out, sizes, plans):
    """Whole, within capacity, and split only if larger than the capacity."""
    for plan, cap in plans:
        rows = [r for r in out if r.plan_id == plan]
        room, got, pieces = {}, {}, {}
        for r in rows:
            room[r.container_no] = room.get(r.container_no, 0) + r.n_tokens
            got[r.doc_id] = got.get(r.doc_id, 0) + r.n_tokens
            pieces.setdefault(r.doc_id, []).append((r.piece_no, r.start_token, r.n_tokens))
        assert not room or max(room.values()) <= cap
        assert got == {k: v or 0 for k, v in sizes.items()}
        for k, p in pieces.items():
            p.sort()
            assert (len(p) > 1) == ((sizes[k] or 0) > cap) and [x[0] for x in p] == list(range(len(p)))
            assert [x[1] for x in p] == [sum(y[2] for y in p[:i]) for i in range(len(p))]
        assert not room or set(room) == set(range(max(room) + 1))
        yield len(room)


def test_best_fit_driver_free():
    runs, n = P.best_fit([6, 5, 4, 3], [1, 1, 1, 1], 10)
    assert n == 2
    runs, n = P.best_fit([0, 10, 1], [4, 2, 25], 10)
    assert n == 5 and sum(r[2] for r in runs) == 31
    assert P.best_fit([], [], 10) == ([], 0)
    rng = random.Random(2)
    for _ in range(200):
        cap = rng.randrange(1, 60)
        counts = {rng.randrange(0, cap + 1): rng.randrange(1, 30) for _ in range(rng.randrange(1, 15))}
        runs, n = P.best_fit(list(counts), list(counts.values()), cap)
        load = {}
        for size, lo, k, first, each in runs:
            for i in range(k):
                load[first + i // each] = load.get(first + i // each, 0) + size
        assert max(load.values()) <= cap and set(load) == set(range(n))
        total = sum(s * c for s, c in counts.items())
        assert n <= max(1, 1.7 * total / cap + 1)


def test_pack(spark):
    rng = random.Random(4)
    sizes = {i: rng.choice([7, 7, 7, rng.randrange(0, 40), rng.randrange(0, 400), None, 64, 128]) for i in range(3000)}
    plans = [(1, 64), (2, 100), (3, 1)]
    df = spark.createDataFrame([(i, n, "x", 1) for i, n in sizes.items()], "doc_id long, n_tokens long, bucket string, plan_id int")
    out = P.pack(df.repartition(3), plans).collect()
    used = list(check(out, sizes, plans))
    total = sum(v or 0 for v in sizes.values())
    assert used[0] <= 1.02 * -(-total // 64) and used[2] == total + 0 or used[2] == max(total, 1)
    again = P.pack(df.repartition(7), plans).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))
    shares = {r.plan_id: r for r in P.utilisation(P.pack(df, plans), plans).collect()}
    assert shares[1].containers == used[0] and 0.97 < shares[1].used <= 1


def test_edges(spark):
    df = spark.createDataFrame([], "doc_id long, n_tokens long")
    assert P.pack(df, [(1, 8)]).count() == 0
    for plans in ([], [(1, 0)], [(1, 5), (1, 6)], [(1, P.MAX_CAPACITY + 1)]):
        with pytest.raises(ValueError):
            P.pack(df, plans)
    twice = spark.createDataFrame([(1, 20), (1, 20), (2, 0)], "doc_id long, n_tokens long")
    assert sum(r.n_tokens for r in P.pack(twice, [(1, 8)]).collect()) == 40
