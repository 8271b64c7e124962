"""Ready-made analytical flows: revenue forecast, priority counts, pricing summary, copy of orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.aggs import Agg
from quern.functions.exprs import Exprs, between, case
from quern.operators import relational as R
from quern.session import table


def ts(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def q1(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").filter(F.col("l_shipdate") <= ts("2001-09-02"))
    disc = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    out = R.aggregate(li, ["l_returnflag", "l_linestatus"], [
        Agg("sum", "l_quantity", "sum_qty"), Agg("sum", "l_extendedprice", "sum_base_price"), Agg("sum", disc, "sum_disc_price"), Agg("sum", disc * (1 + F.col("l_tax")), "sum_charge"),
        Agg("avg", "l_quantity", "avg_qty"), Agg("avg", "l_extendedprice", "avg_price"), Agg("avg", "l_discount", "avg_disc"), Agg("count", None, "count_order"),
    ])
    out = out.select("l_returnflag", "l_linestatus", *[F.round(c, 2).alias(c) for c in ("sum_qty", "sum_base_price", "sum_disc_price", "sum_charge")], *[F.round(c, 4).alias(c) for c in ("avg_qty", "avg_price", "avg_disc")], "count_order")
    return R.sort(out, ("l_returnflag", True), ("l_linestatus", True))


Q1_SQL = """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
 round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
 round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 4) AS avg_disc, count(*) AS count_order
 FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-09-02' GROUP BY 1, 2 ORDER BY 1, 2"""


def q6(spark: SparkSession, d: str) -> DataFrame:
    """Revenue of small discounted orders of one year; the three filters reach the scan."""
    li = table(spark, d, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_shipdate")
    kept = R.filter_(li, between(F.col("l_shipdate"), ts("1996-01-01"), ts("1997-01-01"), "upper_exclusive") & between(F.col("l_discount"), F.lit(0.05), F.lit(0.07001)) & (F.col("l_quantity") < 24))
    part = R.project(kept, amount=F.col("l_extendedprice") * F.col("l_discount"))
    return R.alias(R.aggregate(part, (), [Agg("sum", "amount")]).select(F.round("SUM(amount)", 4).alias("s")), ["s"], ["revenue"])


Q6_SQL = """SELECT round(sum(l_extendedprice * l_discount), 4) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01'
 AND l_shipdate < TIMESTAMP '1997-01-01' AND l_discount BETWEEN 0.05 AND 0.07001 AND l_quantity < 24"""


def _priority_counts(joined: DataFrame, key: str, priority: str) -> DataFrame:
    urgent = F.col(priority).isin("1-URGENT", "2-HIGH")
    cols = R.project(joined, mode=F.col(key), high=case((urgent, F.lit(1)), otherwise=F.lit(0)), low=case((urgent, F.lit(0)), otherwise=F.lit(1)))
    return R.aggregate(cols, ["mode"], [Agg("sum", "high", "high_line_count"), Agg("sum", "low", "low_line_count")])


def q12(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").filter(between(F.col("l_shipdate"), ts("1996-01-01"), ts("1997-01-01"), "upper_exclusive") & F.col("l_returnflag").isin("A", "R")).select("l_orderkey", "l_returnflag")
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    out = _priority_counts(R.join(li, o, [("l_orderkey", "o_orderkey")]), "l_returnflag", "o_orderpriority")
    return R.sort(out.withColumnRenamed("mode", "l_returnflag"), ("l_returnflag", True))


Q12_SQL = """SELECT l_returnflag, CAST(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS high_line_count,
 CAST(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 0 ELSE 1 END) AS BIGINT) AS low_line_count FROM lineitem JOIN orders ON l_orderkey = o_orderkey
 WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' AND l_returnflag IN ('A', 'R') GROUP BY 1 ORDER BY 1"""


def q6_ship(spark: SparkSession, d: str) -> DataFrame:
    """The same forecast on text dates and 32-bit floats: arithmetic stays float, the sum is double."""
    li = table(spark, d, "lineitem_ship")
    e = Exprs(li)
    kept = li.filter(between(F.col("shipdate"), F.lit("1994-01-01"), F.lit("1995-01-01"), "upper_exclusive") & between(F.col("discount"), F.lit(0.05).cast("float"), F.lit(0.07).cast("float")) & (F.col("quantity") < F.lit(24.0).cast("float")))
    return kept.select(e.mul("extendedprice", "discount").alias("amount")).agg(F.round(F.sum("amount"), 2).alias("revenue"), F.count("amount").alias("n"))


Q6_SHIP_SQL = """SELECT round(sum(CAST(extendedprice * discount AS DOUBLE)), 2) AS revenue, count(extendedprice * discount) AS n FROM lineitem_ship
 WHERE shipdate >= '1994-01-01' AND shipdate < '1995-01-01' AND discount >= CAST(0.05 AS FLOAT) AND discount <= CAST(0.07 AS FLOAT) AND quantity < CAST(24 AS FLOAT)"""


def q12_ship(spark: SparkSession, d: str) -> DataFrame:
    """Priority counts by ship mode: MAIL and SHIP, received in 1994, shipped before the committed day, received after it."""
    li = table(spark, d, "lineitem_ship").filter(
        between(F.col("receiptdate"), F.lit("1994-01-01"), F.lit("1995-01-01"), "upper_exclusive") & F.col("shipmode").isin("MAIL", "SHIP")
        & (F.col("shipdate") < F.col("commitdate")) & (F.col("commitdate") < F.col("receiptdate"))
    ).select("orderkey", "shipmode")
    o = table(spark, d, "order_priority").withColumnRenamed("orderkey", "o_orderkey")
    out = _priority_counts(R.join(li, o, [("orderkey", "o_orderkey")]), "shipmode", "orderpriority")
    return R.sort(out.withColumnRenamed("mode", "shipmode"), ("shipmode", True))


Q12_SHIP_SQL = """SELECT shipmode, CAST(sum(CASE WHEN orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS high_line_count,
 CAST(sum(CASE WHEN orderpriority IN ('1-URGENT', '2-HIGH') THEN 0 ELSE 1 END) AS BIGINT) AS low_line_count
 FROM lineitem_ship JOIN order_priority USING (orderkey) WHERE receiptdate >= '1994-01-01' AND receiptdate < '1995-01-01'
 AND shipmode IN ('MAIL', 'SHIP') AND shipdate < commitdate AND commitdate < receiptdate GROUP BY 1 ORDER BY 1"""


def etl_copy_orders(spark: SparkSession, d: str) -> DataFrame:
    """Column subset of orders written as CSV and read back: one task per split, no shuffle."""
    import uuid

    from quern.session import shared_dir
    from quern.sources import files

    src = files.import_(spark, f"{d}/orders.parquet", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"], fmt="parquet")
    path = f"{shared_dir(spark)}/etl-orders-{uuid.uuid4().hex}.csv"
    files.export(src, path, "csv")
    return files.read_csv(spark, path, schema=src.schema, sep=";", header=True)


ETL_SQL = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders"
