import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import quantiles as Q


@pytest.mark.parametrize("k", [256, Q.K])
def test_error_bound_and_merging(spark, k):
    """Groups of 27,000 to 67,000 values, so both sizes of compactor compact; the bound holds at 99 % an answer."""
    df = spark.range(200_000, numPartitions=4).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 5)).alias("g"), (F.col("id") % 10).alias("day"), F.pmod(F.xxhash64("id"), F.lit(1_000_000)).alias("v"))
    days = Q.sketches(df, [F.col("g"), F.col("day")], ["v"], k)
    whole = Q.read(Q.merge(days, ["g"], ["v"], k), ["g"], ["v"], k=k).collect()
    values = df.toPandas().groupby("g")["v"].apply(lambda s: np.sort(s.to_numpy()))
    assert {r.g for r in whole} == set(values.index)
    for r in whole:
        x = values[r.g]
        assert r.n == len(x) > Q.K and r.rank_error == Q.rank_error(k)
        for q, got in zip(Q.QUANTILES, (r.p50, r.p90, r.p99, r.p99_9)):
            assert abs(np.searchsorted(x, got, "right") / len(x) - q) < 1.5 * Q.rank_error(k)


def test_exact_when_small_and_edges(spark):
    rows = [("a", v, "n") for v in (5, 1, None, -1, 3, 0)] + [("b", None, "n"), (None, 4, "n")]
    df = spark.createDataFrame(rows, "g string, v long, n string")
    got = {r.g: r for r in Q.read(Q.sketches(df, [F.col("g")], ["v"]), ["g"], ["v"]).collect()}
    assert set(got) == {"a", None}
    assert (got["a"].n, got["a"].p50, got["a"].p99_9, got["a"].rank_error) == (5, 1, 5, 0.0)
    assert Q.read(Q.sketches(df.limit(0), [F.col("g")], ["v"]), ["g"], ["v"]).count() == 0


def test_fractions_and_negative_values(spark):
    df = spark.createDataFrame([("a", v, 1) for v in (0.5, 0.7, 1.9, -2.5, float("nan"), None)], "g string, v double, w int")
    days = Q.sketches(df, [F.col("g")], ["v", "w"])
    got = {r.measure: r for r in Q.read(Q.merge(days, ["g"], ["v", "w"]), ["g"], ["v", "w"]).collect()}
    assert (got["v"].n, got["v"].p50, got["v"].p99) == (4, 0.5, 1.9) and (got["w"].n, got["w"].p50) == (6, 1.0)


def test_rows_without_a_day_count_in_the_whole(spark, tmp_path):
    from quern.llm import queries as P

    spark.createDataFrame([("p", None, 10, None), (" p", "2025-01-01 10:00:00", 20, -1), ("p", "2025-01-01 11:00:00", -1, 5)], "pipeline_id string, t string, runtime_ms long, function_instance_size_mb long").selectExpr(
        "pipeline_id", "cast(t as timestamp_ntz) as received_at", "runtime_ms", "function_instance_size_mb"
    ).write.parquet(str(tmp_path / "fragment_result.parquet"))
    got = {(str(r.day), r.measure): (r.n, r.p50, r.p99) for r in P.p5_percentiles(spark, str(tmp_path)).collect()}
    assert got == {("None", "runtime_ms"): (2, 10, 20), ("2025-01-01", "runtime_ms"): (1, 20, 20), ("None", "function_instance_size_mb"): (1, 5, 5), ("2025-01-01", "function_instance_size_mb"): (1, 5, 5)}
