import pytest
from pyspark.sql import functions as F

from quern.functions.aggs import Agg
from quern.operators import relational as R


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def sides(spark):
    left = spark.createDataFrame([(i, c) for i, c in enumerate("abcdef")], "a int, b string")
    right = spark.createDataFrame(list(zip("ghijklmno", (9, 0, 8, 1, 7, 3, 6, 4, 5))), "c string, d int")
    return left, right


@pytest.mark.parametrize("how,n", [("inner", 5), ("left", 6), ("right", 9), ("full", 10), ("semi", 5), ("anti_null_as_false", 1), ("anti_null_as_true", 1)])
def test_join_modes(sides, how, n):
    out = R.join(*sides, [("a", "d")], how)
    assert out.count() == n and len(out.columns) == (2 if how[:4] in ("semi", "anti") else 4)


def test_not_in_with_nulls(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "a int")
    right = spark.createDataFrame([(1,), (None,)], "d int")
    assert rows(R.join(left, right, [("a", "d")], "anti_null_as_true")) == []
    assert rows(R.join(left, right.filter("d = 1"), [("a", "d")], "anti_null_as_true")) == [(2,)]
    assert R.join(left, right.filter("d = 7"), [("a", "d")], "anti_null_as_true").count() == 3


def test_join_checks(sides, spark):
    with pytest.raises(TypeError):
        R.join(sides[0], sides[1].withColumn("d", F.col("d").cast("long")), [("a", "d")])
    with pytest.raises(ValueError):
        R.join(*sides)
    assert R.join(*sides, how="cross").count() == 54
    assert R.join(*sides, [("a", "d", "<")]).count() == sum(a < d for a in range(6) for d in (9, 0, 8, 1, 7, 3, 6, 4, 5))
    assert R.join(*sides, [("a", "d"), ("b", "c", "<")]).count() == 5


@pytest.fixture(scope="module")
def numbers(spark):
    return spark.createDataFrame([(12345, 456.7), (12345, 457.7), (123, 458.7), (12, 350.7)], "a int, b float")


def test_aggregates(numbers, spark):
    total = R.aggregate(numbers, (), [Agg("avg", "b"), Agg("count", "b"), Agg("max", "b"), Agg("min", "b"), Agg("stddev_samp", "b"), Agg("sum", "b"), Agg("count")])
    assert total.columns == ["AVG(b)", "COUNT(b)", "MAX(b)", "MIN(b)", "STDDEV_SAMP(b)", "SUM(b)", "COUNT(*)"]
    r = total.first()
    assert [round(float(v), 2) for v in r] == [430.95, 4, 458.7, 350.7, 53.51, 1723.8, 4]
    assert rows(R.aggregate(numbers, ["a"])) == [(12,), (123,), (12345,)]
    empty = numbers.filter(F.lit(False))
    assert tuple(R.aggregate(empty, (), [Agg("count"), Agg("sum", "b"), Agg("any", "a")]).first()) == (0, None, None)
    assert R.aggregate(empty, ["a"], [Agg("count")]).count() == 0
    nulls = spark.createDataFrame([(None, 1), (None, None), (1, 2)], "a int, b int")
    assert rows(R.aggregate(nulls, ["a"], [Agg("count"), Agg("count", "b"), Agg("count_distinct", "b")])) == [(1, 1, 1, 1), (None, 2, 1, 1)]
    with pytest.raises(ValueError):
        R.aggregate(numbers)
    with pytest.raises(TypeError):
        R.aggregate(spark.createDataFrame([("x",)], "s string"), (), [Agg("sum", "s")])
    one = spark.createDataFrame([(1, 2.0)], "a int, b double")
    assert R.aggregate(one, (), [Agg("stddev_samp", "b")]).first()[0] is None


def test_string_agg(spark):
    df = spark.createDataFrame([("b", 1, 3), ("e", 1, 1), ("a", 1, 1), ("g", 1, 7), ("c", 2, 5), ("u", 2, 2), ("a", 2, 6), ("x", 3, 4), (None, 3, 1)], "a string, b int, c int")
    out = R.aggregate(df, ["b"], [Agg("string_agg", "a", "s", (("c", True), ("a", True)))])
    assert rows(out) == [(1, "a,e,b,g"), (2, "u,c,a"), (3, "x")]
    out = R.aggregate(df, ["b"], [Agg("string_agg", "a", "s", (("c", False), ("a", False)))])
    assert rows(out)[0] == (1, "g,b,e,a")


def test_sort_limit(spark):
    df = spark.createDataFrame([(3, "a"), (None, "b"), (1, "c"), (3, "d")], "a int, c string")
    assert [r.c for r in R.sort(df, ("a", False), tie_breakers=["c"]).collect()] == ["b", "a", "d", "c"]
    assert [r.c for r in R.sort(df, ("a", True), ("c", False)).collect()] == ["b", "c", "d", "a"]
    assert [r.c for r in R.limit(df, F.lit(1) + F.lit(1), ("a", True)).collect()] == ["b", "c"]
    assert "TakeOrderedAndProject" in R.limit(df, 2, ("a", True))._jdf.queryExecution().executedPlan().toString()


def test_union_alias_project_partition(spark, sides):
    left, right = sides
    assert R.union(left, left).count() == 12 and R.union(left, left, distinct=True).count() == 6
    with pytest.raises(ValueError):
        R.union(left, left.select("a"))
    assert R.alias(left, ["b", "a"], ["x", "y"]).columns == ["x", "y"]
    with pytest.raises(ValueError):
        R.alias(left, ["b"], ["x"])
    assert R.project(left, z=F.col("a") + 1).columns == ["z"]
    for kind in ("hash", "range"):
        p = R.partition(spark.range(100).withColumn("k", F.col("id") % 7), ["k"], 4, kind)
        assert p.count() == 100 and p.withColumn("p", F.spark_partition_id()).groupBy("k").agg(F.count_distinct("p").alias("n")).filter("n > 1").count() == 0
    assert R.exchange(spark.range(10), 1).rdd.getNumPartitions() == 1
    assert R.filter_(left, False).count() == 0 and R.filter_(left, True).count() == 6 and R.filter_(left, F.lit(None).cast("boolean")).count() == 0
    assert R.unique_violations(R.union(left, left.limit(1)), ["a"]).count() == 1


def test_pushdown_and_pruning(spark, data):
    from quern.plans import tpch

    plan = tpch.q6(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull" in plan and "LessThan(l_quantity,24.0)" in plan
    schema = plan.split("ReadSchema:")[1]
    assert "l_orderkey" not in schema and "l_shipdate" in schema
