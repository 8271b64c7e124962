import pytest
from pyspark.sql import functions as F

from quern.plans import spec as S

PLAN = {
    "op": "alias", "columns": ["SUM(x)"], "aliases": ["revenue"],
    "left": {"op": "aggregate", "aggs": [{"function": "sum", "arg": "x"}], "left": {"op": "project", "columns": {"x": ["*", ["col", "price"], ["col", "discount"]]}, "left": {"op": "filter", "predicate": ["and", ["between", ["col", "day"], ["lit", "1994-01-01"], ["lit", "1995-01-01"], "upper_exclusive"], ["<", ["col", "quantity"], ["lit", 24]]], "left": {"op": "table", "name": "t"}}}},
}


@pytest.fixture(scope="module")
def t(spark):
    return spark.createDataFrame([(10.0, 0.5, "1994-03-01", 5), (10.0, 0.5, "1995-01-01", 5), (7.0, 1.0, "1994-12-31", 24), (4.0, 0.25, "1994-01-01", 23)], "price double, discount double, day string, quantity int")


def test_round_trip_and_run(spark, t):
    again = S.loads(S.dumps(PLAN))
    assert again == PLAN and S.fingerprint(again) == S.fingerprint(PLAN)
    assert [tuple(r) for r in S.run(again, spark, {"t": t}).collect()] == [(6.0,)]
    assert [n["op"] for n in S.nodes(PLAN)] == ["table", "filter", "project", "aggregate", "alias"]
    assert S.tree(PLAN).splitlines()[-1].strip() == "table t" and S.is_breaker(PLAN["left"])
    assert S.fingerprint(S.replace(PLAN, PLAN["left"], {"op": "table", "name": "t"})) != S.fingerprint(PLAN)


def test_expressions(t):
    cases = {
        "a": (["case", [">", ["col", "quantity"], 10], ["lit", "big"], ["lit", "small"]], "small"), "b": (["in", ["col", "quantity"], [5, "x", None]], True), "c": (["extract", "month", ["col", "day"]], "03"),
        "d": (["cast", ["col", "day"], "int"], 0), "e": (["/", ["col", "quantity"], 0], None), "f": (["like", ["col", "day"], "1994%"], True), "g": (["not", ["is null", ["col", "day"]]], True), "h": (["-", ["col", "quantity"]], -5),
        "i": (["concat", ["substr", ["col", "day"], 1, 4], ["lit", "!"]], "1994!"), "j": (["int", ["or", ["lit", True], ["lit", None, "boolean"]]], 1), "k": (["not in", ["col", "quantity"], [7]], True),
    }
    r = t.select(*[S.expression(e, t).alias(k) for k, (e, _) in cases.items()]).first()
    assert {k: r[k] for k in cases} == {k: v for k, (_, v) in cases.items()}
    assert S.describe(["*", ["+", ["col", "a"], 1], ["col", "b"]]) == "(a + 1) * b"
    with pytest.raises(ValueError):
        S.expression(["nope", 1], t)


def test_other_operators(spark, t, tmp_path):
    two = {"op": "union", "left": {"op": "table", "name": "t"}, "right": {"op": "table", "name": "t"}}
    top = {"op": "limit", "n": 2, "keys": [["price", False]], "left": {"op": "sort", "keys": [["day", True]], "left": two}}
    assert [r.price for r in S.run(top, spark, {"t": t}).collect()] == [10.0, 10.0]
    path = str(tmp_path / "o.parquet")
    S.run({"op": "export", "path": path, "left": {"op": "partition", "columns": ["day"], "n": 3, "left": two}}, spark, {"t": t})
    back = {"op": "import", "paths": [path], "columns": ["day"]}
    assert S.run(back, spark).count() == 8
    j = {"op": "join", "on": [["day", "d2"]], "left": back, "right": {"op": "exchange", "left": {"op": "project", "columns": {"d2": ["col", "day"]}, "left": {"op": "table", "name": "t"}}}}
    assert S.run(j, spark, {"t": t}).count() == 8
    with pytest.raises(ValueError):
        S.build({"op": "nope"}, spark)


def test_edit_helpers(spark, t):
    plan = {"op": "sort", "keys": [["price", True]], "left": {"op": "table", "name": "t"}}
    more = S.insert_above(plan, plan["left"], {"op": "filter", "predicate": ["<", ["col", "price"], ["lit", 5.0]]})
    assert [n["op"] for n in S.nodes(more)] == ["table", "filter", "sort"] and S.run(more, spark, {"t": t}).count() == 1
    assert S.leaves({"op": "union", "left": plan, "right": plan["left"]}) == [plan["left"]] * 2


def test_predicate_helpers(spark):
    a, one, two = ["col", "a"], ["lit", 1], ["lit", 2]
    assert S.flipped(["<", a, one]) == [">", one, a] and S.inverse(["<", a, one]) == [">=", a, one] and S.inverse(["in", a, [1]]) == ["not in", a, [1]]
    df = spark.createDataFrame([(x,) for x in (0, 1, 2, 3, None)], "a int")
    for mode in ("inclusive", "lower_exclusive", "upper_exclusive", "exclusive"):
        e = ["between", a, one, two, mode]
        assert S.merge_between(S.split_between(e)) == e
        rows = df.select(*[S.expression(x, df) for x in (e, S.split_between(e), S.inverse(e), S.inverse(S.inverse(e)))]).collect()
        assert all(r[0] == r[1] == r[3] and (r[2] is None if r[0] is None else r[2] is not r[0]) for r in rows)


def test_statistics(spark):
    from quern.plans.statistics import measured

    n, cost = measured(spark, lambda: spark.range(1000, numPartitions=3).groupBy((F.col("id") % 7).alias("k")).count().count())
    assert n == 7 and cost.jobs >= 1 and cost.tasks >= 3 and cost.shuffle_bytes > 0 and cost.runtime_ms > 0 and cost.cost(1.0) >= 0
