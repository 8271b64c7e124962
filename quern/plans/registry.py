"""Named queries over the test tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import exprs as X
from quern.functions.aggs import Agg
from quern.functions.exprs import Exprs
from quern.operators import relational as R
from quern.plans import tpch
from quern.session import shared_dir, table
from quern.sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def simple(name: str, source: str, sql: str, build: Callable[[DataFrame], DataFrame]) -> None:
    query(name, sql)(lambda spark, d: build(table(spark, d, source)))


for _n, _f, _s in (
    ("tpch_q1", tpch.q1, tpch.Q1_SQL), ("tpch_q6", tpch.q6, tpch.Q6_SQL), ("tpch_q12_adapted", tpch.q12, tpch.Q12_SQL), ("tpch_q6_ship", tpch.q6_ship, tpch.Q6_SHIP_SQL),
    ("tpch_q12_ship", tpch.q12_ship, tpch.Q12_SHIP_SQL), ("etl_copy_orders", tpch.etl_copy_orders, tpch.ETL_SQL),
):
    query(_n, _s)(_f)

# --- scan, filter, project -------------------------------------------------------------------------------------------
LI = "l_orderkey, l_linenumber, l_quantity"
_li = LI.split(", ")


def _filter(name: str, where: str, predicate: Callable) -> None:
    simple(name, "lineitem", f"SELECT {LI} FROM lineitem WHERE {where}", lambda df: R.filter_(df, predicate(df)).select(*_li))


simple("scan_projection", "lineitem", "SELECT l_orderkey, l_partkey FROM lineitem", lambda df: df.select("l_orderkey", "l_partkey"))
simple("alias_reorder", "region", "SELECT r_name AS name, r_regionkey AS id FROM region", lambda df: R.alias(df, ["r_name", "r_regionkey"], ["name", "id"]))
_filter("filter_eq", "l_returnflag = 'R'", lambda df: F.col("l_returnflag") == "R")
_filter("filter_ne", "l_returnflag <> 'R'", lambda df: F.col("l_returnflag") != "R")
_filter("filter_range_lt_ge", "l_quantity < 24 AND l_linenumber >= 3", lambda df: Exprs(df).compare("l_quantity", "<", 24) & (F.col("l_linenumber") >= 3))
_filter("between_inclusive", "l_quantity BETWEEN 10 AND 20", lambda df: X.between(F.col("l_quantity"), F.lit(10.0), F.lit(20.0)))
_filter("between_lower_excl", "l_quantity > 10 AND l_quantity <= 20", lambda df: X.between(F.col("l_quantity"), F.lit(10.0), F.lit(20.0), "lower_exclusive"))
_filter("between_upper_excl", "l_quantity >= 10 AND l_quantity < 20", lambda df: X.between(F.col("l_quantity"), F.lit(10.0), F.lit(20.0), "upper_exclusive"))
_filter("between_excl", "l_quantity > 10 AND l_quantity < 20", lambda df: X.between(F.col("l_quantity"), F.lit(10.0), F.lit(20.0), "exclusive"))
_filter("in_list_string", "l_returnflag IN ('A', 'N')", lambda df: Exprs(df).isin("l_returnflag", ["A", "N", 5]))
_filter("not_in_list", "l_linenumber NOT IN (1, 2, 7)", lambda df: Exprs(df).isin("l_linenumber", [1, 2, 7, "x"], negated=True))
_filter("in_list_empty", "false", lambda df: Exprs(df).isin("l_linenumber", []))
_filter("not_in_list_null", "l_linenumber NOT IN (1, NULL)", lambda df: Exprs(df).isin("l_linenumber", [1, None], negated=True))
_filter("filter_true", "true", lambda df: True)
_filter("filter_false", "false", lambda df: False)
simple("like", "part", "SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%A%'", lambda df: df.filter(X.like(F.col("p_type"), "%A%")).select("p_partkey", "p_type"))
simple("not_like", "part", "SELECT p_partkey, p_type FROM part WHERE p_type NOT LIKE '%A%'", lambda df: df.filter(X.like(F.col("p_type"), "%A%", True)).select("p_partkey", "p_type"))
simple("is_null", "typed_value", "SELECT row_no FROM typed_value WHERE a_long IS NULL", lambda df: df.filter(F.col("a_long").isNull()).select("row_no"))
simple("is_not_null", "typed_value", "SELECT row_no FROM typed_value WHERE a_long IS NOT NULL AND a_string IS NOT NULL", lambda df: df.filter(F.col("a_long").isNotNull() & F.col("a_string").isNotNull()).select("row_no"))
simple("and_or_3vl", "typed_value", "SELECT row_no, CAST((a_int > 5 AND a_long > 0) AS INTEGER) AS both_true, CAST((a_int > 5 OR a_long > 0) AS INTEGER) AS either_true FROM typed_value", lambda df: df.select("row_no", X.as_int((F.col("a_int") > 5) & (F.col("a_long") > 0)).alias("both_true"), X.as_int((F.col("a_int") > 5) | (F.col("a_long") > 0)).alias("either_true")))

# --- expressions -----------------------------------------------------------------------------------------------------
def _expr(name: str, sql: str, build: Callable[[Exprs], dict]) -> None:
    simple(name, "typed_value", f"SELECT row_no, {sql} FROM typed_value", lambda df: df.select("row_no", *[c.alias(n) for n, c in build(Exprs(df)).items()]))


_expr("arith_add_sub_mul", "CAST(a_int AS BIGINT) + a_long % 1000 AS added, a_int - 7 AS subtracted, a_int * 3 AS multiplied", lambda e: {"added": e.add("a_int", e.mod("a_long", 1000)), "subtracted": e.sub("a_int", 7), "multiplied": e.mul("a_int", 3)})
_expr("int_division", "CAST(trunc(a_int / 7.0) AS INTEGER) AS q, a_long // nullif(a_long, 0) AS one", lambda e: {"q": e.div("a_int", 7), "one": e.div("a_long", "a_long")})
_expr("div_by_zero_null", "CAST(a_int // nullif(0, 0) AS INTEGER) AS by_zero, a_double / nullif(a_int - a_int, 0) AS float_by_zero", lambda e: {"by_zero": e.div("a_int", 0), "float_by_zero": e.div("a_double", e.sub("a_int", "a_int"))})
_expr("modulo", "a_long % 7 AS m, CAST(a_int % nullif(a_int, 0) AS INTEGER) AS self_m", lambda e: {"m": e.mod("a_long", 7), "self_m": e.mod("a_int", "a_int")})
_expr("unary_minus", "-a_int AS neg_int, -a_long AS neg_long", lambda e: {"neg_int": e.neg("a_int"), "neg_long": e.neg("a_long")})
_expr("case_when", "CASE WHEN a_int > 10 THEN 'big' ELSE 'small' END AS size", lambda e: {"size": X.case((e.compare("a_int", ">", 10), F.lit("big")), otherwise=F.lit("small"))})
_expr("case_nested", "CASE WHEN a_int > 10 THEN CASE WHEN a_long > 0 THEN 2 ELSE 1 END ELSE 0 END AS k", lambda e: {"k": X.case((e.compare("a_int", ">", 10), X.case((F.col("a_long") > 0, F.lit(2)), otherwise=F.lit(1))), otherwise=F.lit(0))})
_expr("cast_num_trunc", "CAST(trunc(a_double) AS BIGINT) AS d, CAST(trunc(CAST(a_float AS DOUBLE)) AS BIGINT) AS f", lambda e: {"d": e.cast("a_double", "long"), "f": e.cast("a_float", "long")})
_expr("cast_string_fail_zero", "CASE WHEN a_string IS NULL THEN NULL WHEN regexp_full_match(a_string, '[+-]?[0-9]+') THEN coalesce(try_cast(a_string AS INTEGER), 0) ELSE 0 END AS i", lambda e: {"i": e.cast("a_string", "int")})
_expr("cast_to_string", "CAST(a_int AS VARCHAR) AS i, CAST(a_long AS VARCHAR) AS l", lambda e: {"i": e.cast("a_int", "string"), "l": e.cast("a_long", "string")})
_expr("cast_double_to_string", "CAST(a_int / 2.0::DOUBLE AS VARCHAR) AS halves", lambda e: {"halves": e.cast(F.col("a_int") / F.lit(2.0), "string")})
_expr("not_3vl", "CAST(NOT (a_int > 5) AS INTEGER) AS negated", lambda e: {"negated": X.as_int(~e.compare("a_int", ">", 5))})
_expr("predicate_as_int", "CAST(a_int = 1 AS INTEGER) AS is_one, CAST(a_string = '' AS INTEGER) AS is_empty", lambda e: {"is_one": X.as_int(e.compare("a_int", "=", 1)), "is_empty": X.as_int(F.col("a_string") == "")})
_expr("in_expression", "CAST(a_int = a_long AS INTEGER) AS hit", lambda e: {"hit": X.as_int(e.in_expression("a_int", "a_long"))})
_expr("substr", "CASE WHEN a_string IS NULL THEN NULL ELSE substr(a_string, 2, 3) END AS mid, substr(a_string, 1, 1) AS zero_start", lambda e: {"mid": X.substr(F.col("a_string"), 2, 3), "zero_start": X.substr(F.col("a_string"), 0, 2)})
_expr("concat", "a_string || '-' || CAST(a_int AS VARCHAR) AS joined", lambda e: {"joined": X.concat(F.col("a_string"), F.lit("-"), e.cast("a_int", "string"))})
simple("extract_ymd_string", "lineitem_ship", "SELECT orderkey, linenumber, substr(shipdate, 1, 4) AS y, substr(shipdate, 6, 2) AS m, substr(shipdate, 9, 2) AS d FROM lineitem_ship", lambda df: df.select("orderkey", "linenumber", X.extract("year", F.col("shipdate")).alias("y"), X.extract("month", F.col("shipdate")).alias("m"), X.extract("day", F.col("shipdate")).alias("d")))
simple("extract_hms", "events", "SELECT event_id, lpad(CAST(hour(ts) AS VARCHAR), 2, '0') AS h, lpad(CAST(minute(ts) AS VARCHAR), 2, '0') AS mi, lpad(CAST(second(ts) AS VARCHAR), 2, '0') AS s FROM events", lambda df: df.select("event_id", X.extract("hour", F.col("ts")).alias("h"), X.extract("minute", F.col("ts")).alias("mi"), X.extract("second", F.col("ts")).alias("s")))

# --- aggregates ------------------------------------------------------------------------------------------------------
def _agg(name: str, keys: list[str], aggs: list[Agg], sql: str, rounded: tuple[str, ...] = (), source: str = "typed_value") -> None:
    group = f" GROUP BY {', '.join(keys)}" if keys else ""
    cols = ", ".join([*keys, sql])

    def build(df: DataFrame) -> DataFrame:
        out = R.aggregate(df, keys, aggs)
        return out.withColumns({c: F.round(c, 4) for c in rounded}) if rounded else out

    simple(name, source, f"SELECT {cols} FROM {source}{group}", build)


_agg("agg_sum_int", ["a_int"], [Agg("sum", "a_long", "s")], "CAST(sum(a_long) AS BIGINT) AS s")
_agg("agg_sum_float", ["l_returnflag"], [Agg("sum", "l_extendedprice", "s")], "round(sum(l_extendedprice), 4) AS s", ("s",), "lineitem")
_agg("agg_avg", ["a_int"], [Agg("avg", "a_double", "m")], "round(avg(a_double), 4) AS m", ("m",))
_agg("agg_min_max", ["a_int"], [Agg("min", "a_long", "lo"), Agg("max", "a_long", "hi")], "min(a_long) AS lo, max(a_long) AS hi")
_agg("agg_min_max_string", ["a_int"], [Agg("min", "a_string", "lo"), Agg("max", "a_string", "hi")], "min(a_string) AS lo, max(a_string) AS hi")
_agg("agg_count", ["a_int"], [Agg("count", "a_string", "n")], "count(a_string) AS n")
_agg("agg_count_star", [], [Agg("count", None, "n")], "count(*) AS n")
_agg("agg_count_distinct", ["a_int"], [Agg("count_distinct", "a_string", "n")], "count(DISTINCT a_string) AS n")
_agg("agg_stddev_samp", ["a_int"], [Agg("stddev_samp", "a_double", "sd")], "round(stddev_samp(a_double), 4) AS sd", ("sd",))
_agg("agg_any", ["n_regionkey"], [Agg("any", "n_regionkey", "v"), Agg("count", None, "n")], "any_value(n_regionkey) AS v, count(*) AS n", (), "nation")
_agg("agg_any_other", ["o_orderkey"], [Agg("any", "o_orderstatus", "v")], "any_value(o_orderstatus) AS v", (), "orders")
simple("agg_string_agg_unordered", "nation", "SELECT n_regionkey, list_sort(string_split(string_agg(n_name, ','), ',')) AS names FROM nation GROUP BY 1", lambda df: R.aggregate(df, ["n_regionkey"], [Agg("string_agg", "n_name", "names")]).withColumn("names", F.array_sort(F.split("names", ","))))
_agg("agg_string_agg_ordered", ["n_regionkey"], [Agg("string_agg", "n_name", "names", (("n_name", True),))], "string_agg(n_name, ',' ORDER BY n_name) AS names", (), "nation")
_agg("agg_string_agg_multi_key", ["r"], [Agg("string_agg", "n_name", "names", (("k", False), ("n_name", True)))], "string_agg(n_name, ',' ORDER BY k DESC, n_name) AS names", (), "nation")
QUERIES["agg_string_agg_multi_key"] = lambda spark, d: R.aggregate(table(spark, d, "nation").select(F.lit(1).alias("r"), "n_name", (F.col("n_regionkey") % 2).alias("k")), ["r"], [Agg("string_agg", "n_name", "names", (("k", False), ("n_name", True)))])
SQL["agg_string_agg_multi_key"] = "SELECT 1 AS r, string_agg(n_name, ',' ORDER BY n_regionkey % 2 DESC, n_name) AS names FROM nation"
_agg("group_by_1", ["o_orderstatus"], [Agg("count", None, "n")], "count(*) AS n", (), "orders")
_agg("group_by_2", ["o_orderstatus", "o_orderpriority"], [Agg("count", None, "n"), Agg("sum", "o_totalprice", "s")], "count(*) AS n, round(sum(o_totalprice), 4) AS s", ("s",), "orders")
_agg("group_by_3", ["l_returnflag", "l_linestatus", "l_linenumber"], [Agg("count", None, "n")], "count(*) AS n", (), "lineitem")
_agg("group_by_null_key", ["a_int"], [Agg("count", None, "n")], "count(*) AS n")
simple("distinct_no_agg", "orders", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", lambda df: R.aggregate(df, ["o_orderstatus", "o_orderpriority"]))
simple("agg_empty_input", "orders", "SELECT count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS s, min(o_orderstatus) AS lo FROM orders WHERE false", lambda df: R.aggregate(df.filter(F.lit(False)), (), [Agg("count", None, "n"), Agg("sum", "o_custkey", "s"), Agg("min", "o_orderstatus", "lo")]))
simple("having", "orders", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12", lambda df: R.aggregate(df, ["o_custkey"], [Agg("count", None, "n")]).filter("n > 12"))
simple("two_stage_sum", "lineitem", "SELECT l_returnflag, CAST(sum(l_orderkey) AS BIGINT) AS s FROM lineitem GROUP BY 1", lambda df: R.aggregate(R.aggregate(df, ["l_returnflag", "l_linenumber"], [Agg("sum", "l_orderkey", "p")]), ["l_returnflag"], [Agg("sum", "p", "s")]))

# --- joins -----------------------------------------------------------------------------------------------------------
def _pair(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "customer").select("c_custkey", "c_mktsegment"), table(spark, d, "orders").select("o_orderkey", "o_custkey")


_C, _O = "(SELECT c_custkey, c_mktsegment FROM customer) c", "(SELECT o_orderkey, o_custkey FROM orders) o"
for _n, _how, _kw in (("inner", "inner", "JOIN"), ("left", "left", "LEFT JOIN"), ("right", "right", "RIGHT JOIN"), ("full", "full", "FULL JOIN")):
    query(f"join_{_n}", f"SELECT * FROM {_C} {_kw} {_O} ON c_custkey = o_custkey")(lambda spark, d, how=_how: R.join(*_pair(spark, d), [("c_custkey", "o_custkey")], how))
query("join_semi", f"SELECT * FROM {_C} WHERE EXISTS (SELECT 1 FROM {_O} WHERE o_custkey = c_custkey)")(lambda spark, d: R.join(*_pair(spark, d), [("c_custkey", "o_custkey")], "semi"))
query("join_anti_not_exists", f"SELECT * FROM {_C} WHERE NOT EXISTS (SELECT 1 FROM {_O} WHERE o_custkey = c_custkey)")(lambda spark, d: R.join(*_pair(spark, d), [("c_custkey", "o_custkey")], "anti_null_as_false"))
query("join_anti_not_in", f"SELECT * FROM {_C} WHERE c_custkey NOT IN (SELECT o_custkey FROM {_O})")(lambda spark, d: R.join(*_pair(spark, d), [("c_custkey", "o_custkey")], "anti_null_as_true"))
query("join_anti_not_in_null", f"SELECT * FROM {_C} WHERE c_custkey NOT IN (SELECT nullif(o_custkey, 1) FROM orders)")(lambda spark, d: R.join(_pair(spark, d)[0], table(spark, d, "orders").select(F.nullif("o_custkey", F.lit(1).cast("long")).alias("k")), [("c_custkey", "k")], "anti_null_as_true"))
query("join_cross", "SELECT r_name, n_name FROM region, nation")(lambda spark, d: R.join(table(spark, d, "region").select("r_name"), table(spark, d, "nation").select("n_name"), how="cross"))
query("join_theta", "SELECT r_name, n_name FROM region JOIN nation ON r_regionkey < n_regionkey")(lambda spark, d: R.join(table(spark, d, "region"), table(spark, d, "nation"), [("r_regionkey", "n_regionkey", "<")]).select("r_name", "n_name"))
query("join_multi_predicate", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey AND s_suppkey > n_regionkey")(lambda spark, d: R.join(table(spark, d, "supplier"), table(spark, d, "nation").withColumn("n_regionkey", F.col("n_regionkey").cast("long")), [("s_nationkey", "n_nationkey"), ("s_suppkey", "n_regionkey", ">")]).select("s_suppkey", "n_name"))
query("join_partitioned_hash", "SELECT o_orderkey, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")(lambda spark, d: R.join(table(spark, d, "orders").select("o_orderkey").hint("shuffle_hash"), table(spark, d, "lineitem").select("l_orderkey"), [("o_orderkey", "l_orderkey")]).groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n")))

# --- order, sets, partitioning ---------------------------------------------------------------------------------------
simple("sort_asc", "typed_value", "SELECT row_no, a_int FROM typed_value ORDER BY a_int ASC NULLS FIRST, row_no", lambda df: R.sort(df.select("row_no", "a_int"), ("a_int", True), tie_breakers=["row_no"]))
simple("sort_desc_nulls_first", "typed_value", "SELECT row_no, a_long FROM typed_value ORDER BY a_long DESC NULLS FIRST, row_no", lambda df: R.sort(df.select("row_no", "a_long"), ("a_long", False), tie_breakers=["row_no"]))
simple("sort_multi", "typed_value", "SELECT row_no, a_int, a_string FROM typed_value ORDER BY a_string DESC NULLS FIRST, a_int NULLS FIRST, row_no", lambda df: R.sort(df.select("row_no", "a_int", "a_string"), ("a_string", False), ("a_int", True), tie_breakers=["row_no"]))
simple("topk", "orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey NULLS FIRST LIMIT 10", lambda df: R.limit(df.select("o_orderkey", "o_totalprice"), 10, ("o_totalprice", False), ("o_orderkey", True)))
simple("limit", "nation", "SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT 7", lambda df: R.limit(df.select("n_nationkey"), F.lit(3) + F.lit(4), ("n_nationkey", True)))
query("union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")(lambda spark, d: R.union(table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select("s_nationkey")))
query("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")(lambda spark, d: R.union(table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select("s_nationkey"), distinct=True))
def _split(df: DataFrame, key: str) -> DataFrame:
    """What a partitioning by key gives: how many partitions, and whether every key is in one."""
    placed = df.select(key, F.spark_partition_id().alias("p")).groupBy(key, "p").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("lo"))
    per_key = placed.groupBy(key).agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("n"), F.min("p").alias("p"))
    return per_key.agg((F.max("p") < 4).alias("within"), (F.max("parts") == 1).alias("together"), F.sum("n").alias("n"))


def _in_order(df: DataFrame, key: str) -> DataFrame:
    """Whether partitions follow each other in the order of the key."""
    ranges = df.groupBy(F.spark_partition_id().alias("p")).agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
    later = ranges.select(F.col("p").alias("q"), F.col("lo").alias("next"))
    return ranges.join(later, F.col("q") == F.col("p") + 1).agg((F.count(F.when(F.col("hi") >= F.col("next"), 1)) == 0).alias("in_order"))


simple("hash_partition_keys", "orders", "SELECT true AS within, true AS together, count(*) AS n FROM orders", lambda df: _split(R.partition(df.select("o_custkey"), ["o_custkey"], 4), "o_custkey"))
simple("range_partition_keys", "orders", "SELECT true AS within, true AS together, count(*) AS n FROM orders", lambda df: _split(R.partition(df.select("o_custkey"), ["o_custkey"], 4, "range"), "o_custkey"))
simple("range_partition_order", "orders", "SELECT true AS in_order", lambda df: _in_order(R.partition(df.select("o_custkey"), ["o_custkey"], 4, "range"), "o_custkey"))
simple("exchange_merge_parts", "orders", "SELECT 1 AS partitions, count(*) AS n FROM orders", lambda df: R.exchange(df.select("o_orderkey"), 1).groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("partitions"), F.sum("n").alias("n")))
simple("topk_offset", "orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey NULLS FIRST LIMIT 10 OFFSET 5", lambda df: R.limit(df.select("o_orderkey", "o_totalprice"), 10, ("o_totalprice", False), ("o_orderkey", True), offset=5))
simple("hash_partition", "orders", "SELECT o_orderkey, o_custkey FROM orders", lambda df: R.partition(df.select("o_orderkey", "o_custkey"), ["o_custkey"], 4))
simple("range_partition", "orders", "SELECT o_orderkey, o_custkey FROM orders", lambda df: R.partition(df.select("o_orderkey", "o_custkey"), ["o_custkey"], 4, "range"))
simple("exchange_merge", "orders", "SELECT o_orderkey FROM orders", lambda df: R.exchange(df.select("o_orderkey"), 2))

# --- formats ---------------------------------------------------------------------------------------------------------
def _roundtrip(fmt: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        src = table(spark, d, "typed_value").select("row_no", "a_int", "a_long", "a_float", "a_double", "a_string")
        path = f"{shared_dir(spark)}/roundtrip-{uuid.uuid4().hex}.{fmt}"
        files.export(src, path, escaped=True)
        return files.import_(spark, path, expected=src.schema, **({"sep": ";", "header": True, "escaped": True} if fmt == "csv" else {}))

    query(f"{fmt}_roundtrip", "SELECT row_no, a_int, a_long, a_float, a_double, a_string FROM typed_value")(run)


for _fmt in ("csv", "orc", "parquet"):
    _roundtrip(_fmt)
