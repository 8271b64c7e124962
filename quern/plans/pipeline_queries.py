"""Queries of the general data-pipeline problems, each over its whole tables, beside their oracle SQL where SQL can say the same."""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import delivery, drift, intervals, nested
from quern.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}

_TRIM = "trim({}, ' ' || chr(9) || chr(10) || chr(13))"
_PID, _WID = _TRIM.format("pipeline_id"), _TRIM.format("worker_id")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return delivery.surplus_copies(table(spark, d, "fragment_result"), ["pipeline_id"], "worker_id", "received_at", "delivery_id")


def p1_kept(spark: SparkSession, d: str) -> DataFrame:
    kept = delivery.keep_once(table(spark, d, "fragment_result"), ["pipeline_id"], "worker_id", "received_at", "delivery_id")
    return kept.select("delivery_id", "batch_no", "runtime_ms")


def p1_ranges(spark: SparkSession, d: str) -> DataFrame:
    return delivery.seen_ranges(table(spark, d, "fragment_result"), ["pipeline_id"], "worker_id")


QUERIES |= {"p1_found": p1_found, "p1_kept": p1_kept, "p1_ranges": p1_ranges}
_RANKED = f"""SELECT delivery_id, batch_no, runtime_ms, p, w, row_number() OVER (PARTITION BY p, w ORDER BY received_at, delivery_id) AS rn
 FROM (SELECT *, {_PID} AS p, {_WID} AS w FROM fragment_result)"""
SQL["p1_found"] = f"SELECT delivery_id FROM ({_RANKED}) WHERE p <> '' AND w <> '' AND rn > 1"
SQL["p1_kept"] = f"SELECT delivery_id, batch_no, runtime_ms FROM ({_RANKED}) WHERE rn = 1 OR p IS NULL OR w IS NULL OR p = '' OR w = ''"
SQL["p1_ranges"] = f"""SELECT pipeline_id, producer, min(n) AS lo, max(n) AS hi FROM (
 SELECT *, n - row_number() OVER (PARTITION BY pipeline_id, producer ORDER BY n) AS island FROM (
 SELECT DISTINCT p AS pipeline_id, regexp_replace(w, '-[0-9]+$', '') AS producer, CAST(regexp_extract(w, '-(0|[1-9][0-9]*)$', 1) AS BIGINT) AS n FROM (
 SELECT {_PID} AS p, {_WID} AS w FROM fragment_result) WHERE p <> '' AND regexp_matches(w, '-(0|[1-9][0-9]*)$'))) GROUP BY pipeline_id, producer, island"""


# --- p3: periods and gaps --------------------------------------------------------------------------------------------
def _micros(name: str):
    """Microseconds since 1970: values over 1e11 are milliseconds, others seconds; NULL for what is no number or lies beyond the range of longs."""
    v = F.col(name)
    return F.round(F.when(v > 1e11, v * 1e3).otherwise(v * 1e6)).try_cast("long")


def _traces(spark: SparkSession, d: str) -> DataFrame:
    bare = F.regexp_extract(F.lower("trace_id"), r"(1-[0-9a-f]{8}-[0-9a-f]{24})", 1)
    rows = table(spark, d, "subsegment").select(F.when(bare != "", bare).alias("trace_id"), _micros("start_time").alias("s"), _micros("end_time").alias("e"))
    return intervals.periods_and_gaps(rows, "trace_id", "s", "e")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _traces(spark, d)


def p3_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Covered and uncovered time of each trace."""
    length = F.col("end_us") - F.col("start_us")
    return _traces(spark, d).groupBy("trace_id").agg(F.count(F.when(F.col("kind") == "period", 1)).alias("periods"), F.sum(F.when(F.col("kind") == "period", length).otherwise(0)).alias("covered_us"), F.sum(F.when(F.col("kind") == "gap", length).otherwise(0)).alias("gap_us"))


QUERIES |= {"p3_found": p3_found, "p3_coverage": p3_coverage}
_US = "TRY_CAST(round(CASE WHEN {0} > 1e11 THEN {0} * 1e3 ELSE {0} * 1e6 END) AS BIGINT)"
SQL["p3_found"] = f"""WITH r AS (SELECT regexp_extract(lower(trace_id), '(1-[0-9a-f]{{8}}-[0-9a-f]{{24}})', 1) AS trace_id, {_US.format("start_time")} AS s, {_US.format("end_time")} AS e
 FROM subsegment WHERE start_time IS NOT NULL AND end_time IS NOT NULL AND trace_id IS NOT NULL),
 o AS (SELECT *, max(e) OVER (PARTITION BY trace_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r WHERE trace_id <> '' AND s IS NOT NULL AND e >= s),
 i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY trace_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM o)
 SELECT trace_id, 'period' AS kind, min(s) AS start_us, max(e) AS end_us FROM i GROUP BY trace_id, k
 UNION ALL SELECT trace_id, 'gap', reach, s FROM i WHERE s > reach"""
SQL["p3_coverage"] = f"""SELECT trace_id, count(*) FILTER (kind = 'period') AS periods, CAST(sum(CASE WHEN kind = 'period' THEN end_us - start_us ELSE 0 END) AS BIGINT) AS covered_us,
 CAST(sum(CASE WHEN kind = 'gap' THEN end_us - start_us ELSE 0 END) AS BIGINT) AS gap_us FROM ({SQL["p3_found"]}) GROUP BY trace_id"""


# --- p2: drifting schemas --------------------------------------------------------------------------------------------
def _unions(spark: SparkSession, d: str) -> DataFrame:
    return drift.unions(table(spark, d, "benchmark_output"), "file_no", "campaign_id", "written_at", "document")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.changes(_unions(spark, d)).withColumnRenamed("file", "file_no")


def p2_schema(spark: SparkSession, d: str) -> DataFrame:
    return drift.fused(_unions(spark, d))


def p2_values(spark: SparkSession, d: str) -> DataFrame:
    return drift.values(table(spark, d, "benchmark_output"), "file_no", "document").withColumnRenamed("file", "file_no")


def p2_table(spark: SparkSession, d: str) -> DataFrame:
    """All parameters of each run: field to canonical text (that of the first spelling)."""
    table_ = drift.consistent(table(spark, d, "benchmark_output"), "file_no", "document")
    return table_.select(F.col("file").alias("file_no"), "run_no", F.to_json(F.transform_values("parameters", lambda _, v: F.get(v, F.lit(0))["canonical"])).alias("parameters"))


def p2_wide(spark: SparkSession, d: str) -> DataFrame:
    """Typed columns of two fields that drift."""
    table_ = drift.consistent(table(spark, d, "benchmark_output"), "file_no", "document")
    return drift.wide(table_, [drift.field_of("message_size_kb"), drift.field_of("enable_vpc")]).withColumnRenamed("file", "file_no")


QUERIES |= {"p2_found": p2_found, "p2_schema": p2_schema, "p2_values": p2_values, "p2_table": p2_table, "p2_wide": p2_wide}


# Words of a name: breaks between small and capital letters, before the last capital of a row, and between letters and digits.
_FIELD = "n"
for _pattern in (r"(\p{Ll})(\p{Lu})", r"(\p{Lu})(\p{Lu}\p{Ll})", r"(\p{L})(\p{N})", r"(\p{N})(\p{L})"):
    _FIELD = f"regexp_replace({_FIELD}, '{_pattern}', '\\1 \\2', 'g')"
_FIELD = f"array_to_string(list_sort(list_filter(string_split_regex(lower({_FIELD}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')), ' ')"
_KIND = "CASE type WHEN 'BOOLEAN' THEN 'boolean' WHEN 'VARCHAR' THEN 'string' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' WHEN 'DOUBLE' THEN 'decimal' WHEN 'NULL' THEN NULL ELSE 'integer' END"
SQL["p2_found"] = f"""WITH docs AS (SELECT file_no, campaign_id, written_at, CAST(document AS JSON) AS d FROM benchmark_output WHERE json_valid(document) AND campaign_id IS NOT NULL),
 pairs AS (SELECT file_no, lag(file_no) OVER (PARTITION BY campaign_id ORDER BY written_at, file_no) AS before FROM docs),
 lists AS (SELECT file_no, CASE json_type(d -> 'runs') WHEN 'ARRAY' THEN json_extract(d, '$.runs[*]') WHEN 'OBJECT' THEN [d -> 'runs'] ELSE [] END AS l FROM docs),
 runs AS (SELECT file_no, unnest(l) AS x, generate_subscripts(l, 1) AS r FROM lists),
 members AS (SELECT file_no, r, e.id AS pos, e.key AS n, {_KIND.replace("type", "e.type")} AS kind FROM runs, json_each(x -> 'parameters') e WHERE json_type(x -> 'parameters') = 'OBJECT'),
 fields AS (SELECT file_no, {_FIELD} AS f, arg_min(n, r * 1000000 + pos) AS n, coalesce(list_sort(list(DISTINCT kind) FILTER (kind IS NOT NULL)), []) AS kinds FROM members GROUP BY 1, 2),
 new AS (SELECT p.file_no AS k, f.* FROM pairs p JOIN fields f ON f.file_no = p.file_no WHERE before IS NOT NULL), old AS (SELECT p.file_no AS k, f.* FROM pairs p JOIN fields f ON f.file_no = p.before),
 fused AS (SELECT coalesce(new.k, old.k) AS file_no, new.n AS new_n, old.n AS old_n, new.kinds AS new_kinds, old.kinds AS old_kinds FROM new FULL JOIN old ON new.k = old.k AND new.f = old.f)
 SELECT file_no, new_n AS field_name, 'added' AS drift_kind FROM fused WHERE old_n IS NULL UNION ALL SELECT file_no, old_n, 'removed' FROM fused WHERE new_n IS NULL
 UNION ALL SELECT file_no, new_n, 'renamed' FROM fused WHERE new_n <> old_n UNION ALL SELECT file_no, new_n, 'retyped' FROM fused WHERE len(new_kinds) > 0 AND len(old_kinds) > 0 AND new_kinds <> old_kinds"""


# --- p4: nested records ----------------------------------------------------------------------------------------------
_KEYS = ("node_kind", "owner_id", "run_no", "repetition_no", "invocation_no", "item_name")


def _results(spark: SparkSession, d: str, visitor=nested.visit_result) -> DataFrame:
    return nested.flatten(table(spark, d, "benchmark_output"), "file_no", "document", visitor)


def _messages(spark: SparkSession, d: str) -> DataFrame:
    return nested.flatten(table(spark, d, "fragment_result"), "delivery_id", "metering", nested.visit_metering)


def _tables(spark: SparkSession, d: str) -> DataFrame:
    """All tables, written partitioned by tag in one pass, and read back."""
    from quern.session import shared_dir

    path = f"{shared_dir(spark)}/p4-tables-{uuid.uuid4().hex}"
    nested.write_tables(_results(spark, d).unionByName(_messages(spark, d)), path)
    return nested.read_tables(spark, path)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _tables(spark, d).filter(F.col("node_kind").isin("run", "metric", "repetition", "invocation", "invocation_request", "fragment_request")).select(*_KEYS)


def p4_tables(spark: SparkSession, d: str) -> DataFrame:
    """All tables with keys and parent keys."""
    return _tables(spark, d).select("node_kind", "key", "parent_key", "payload")


def p4_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Per table: whether its keys are unique, and rows whose parent key is no key."""
    rows = _tables(spark, d).select("node_kind", "key", "parent_key")
    keys = rows.filter(F.col("node_kind").isin("file", "delivery", "run", "repetition", "invocation")).select(F.col("key").alias("parent_key"), F.lit(1).alias("is_key"))
    linked = rows.join(keys, "parent_key", "left")
    return linked.groupBy("node_kind").agg((F.count(F.lit(1)) == F.count_distinct("key")).alias("unique_keys"), F.count(F.when(F.col("parent_key").isNotNull() & F.col("is_key").isNull(), 1)).alias("orphans"))


def p4_runs(spark: SparkSession, d: str) -> DataFrame:
    """One row a run; ``parameters`` is the JSON of its parameters, whose schema drifts (see p2)."""
    return nested.flat(_results(spark, d), "run", "dummy string", members="parameters").select("key", "parent_key", "owner_id", "run_no", "parameters")


def p4_metrics(spark: SparkSession, d: str) -> DataFrame:
    """One row a metric: its JSON, and the number in it, also where that is written as text."""
    rows = nested.flat(_results(spark, d), "metric", "dummy string", members="value")
    return rows.select("key", "parent_key", "owner_id", "run_no", F.col("item_name").alias("metric"), "value", F.btrim("value", F.lit('"')).try_cast("double").alias("number"))


def p4_repetitions(spark: SparkSession, d: str) -> DataFrame:
    rows = nested.flat(_results(spark, d), "repetition", "repetition_duration_ms double, repetition_lambda_runtime_duration_ms double")
    return rows.select("key", "parent_key", "owner_id", "run_no", "repetition_no", "repetition_duration_ms", "repetition_lambda_runtime_duration_ms")


def p4_invocations(spark: SparkSession, d: str) -> DataFrame:
    """One row an invocation; ``members`` is the JSON of all its members but metering, nested ones too."""
    return nested.flat(_results(spark, d, partial(nested.visit_result, whole=True)), "invocation", "invocation_id string, succeeded boolean, invocation_total_duration_ms double", members="members")


_COUNTS = "finished long, succeeded long, retried long, failed long"


def p4_invocation_requests(spark: SparkSession, d: str) -> DataFrame:
    return nested.flat(_results(spark, d), "invocation_request", _COUNTS).select("key", "parent_key", "owner_id", "run_no", "repetition_no", "invocation_no", "item_name", "finished", "succeeded", "retried", "failed")


def p4_fragment_requests(spark: SparkSession, d: str) -> DataFrame:
    return nested.flat(_messages(spark, d), "fragment_request", _COUNTS).select("key", "parent_key", "owner_id", "item_name", "finished", "succeeded", "retried", "failed")


QUERIES |= {
    "p4_found": p4_found, "p4_tables": p4_tables, "p4_orphans": p4_orphans, "p4_runs": p4_runs, "p4_metrics": p4_metrics, "p4_repetitions": p4_repetitions, "p4_invocations": p4_invocations,
    "p4_invocation_requests": p4_invocation_requests, "p4_fragment_requests": p4_fragment_requests,
}


def _elements(value: str, rest: str, position: str, source: str) -> str:
    """SQL: elements of an array, or a lone object, with their positions."""
    lists = f"SELECT {rest}, CASE json_type({value}) WHEN 'ARRAY' THEN json_extract({value}, '$[*]') WHEN 'OBJECT' THEN [{value}] ELSE [] END AS l FROM {source}"
    return f"SELECT * FROM (SELECT {rest}, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS {position} FROM ({lists})) WHERE json_type(x) = 'OBJECT'"


def _requests(source: str, rest: str) -> str:
    """SQL: requests of ``m``, metering in any of its shapes."""
    for _ in range(5):
        source = f"(SELECT {rest}, CASE WHEN json_type(m) = 'VARCHAR' THEN CASE WHEN json_valid(m ->> '$') THEN CAST(m ->> '$' AS JSON) END WHEN json_type(m) = 'OBJECT' AND json_exists(m, '$.metering') THEN m -> 'metering' ELSE m END AS m FROM {source})"
    by_name = f"SELECT {rest}, e.key AS item_name FROM (SELECT * FROM {source} WHERE json_type(m) = 'OBJECT' AND json_type(m -> 'request') IS DISTINCT FROM 'VARCHAR') s, json_each(s.m) e WHERE e.type = 'OBJECT'"
    listed = f"(SELECT {rest}, m FROM {source} WHERE json_type(m) = 'ARRAY' OR json_type(m -> 'request') = 'VARCHAR')"
    return f"{by_name} UNION ALL SELECT {rest}, x ->> 'request' FROM ({_elements('m', rest, 'at', listed)}) WHERE json_type(x -> 'request') = 'VARCHAR'"


SQL["p4_found"] = f"""WITH docs AS (SELECT file_no AS o, CAST(document AS JSON) -> 'runs' AS v FROM benchmark_output WHERE json_valid(document)),
 runs AS ({_elements("v", "o", "r", "docs")}), reps AS ({_elements("x -> 'repetitions'", "o, r", "p", "runs")}), invs AS ({_elements("x -> 'invocations'", "o, r, p", "i", "reps")}),
 metered AS (SELECT o, r, p, i, x -> 'metering' AS m FROM invs), sent AS (SELECT delivery_id AS o, CAST(metering AS JSON) AS m FROM fragment_result WHERE json_valid(metering))
 SELECT 'run' AS node_kind, o AS owner_id, CAST(r AS INTEGER) AS run_no, -1 AS repetition_no, -1 AS invocation_no, '' AS item_name FROM runs
 UNION ALL SELECT 'metric', o, r, -1, -1, e.key FROM runs, json_each(x -> 'metrics') e WHERE json_type(x -> 'metrics') = 'OBJECT' AND e.type <> 'NULL'
 UNION ALL SELECT 'repetition', o, r, p, -1, '' FROM reps UNION ALL SELECT 'invocation', o, r, p, i, '' FROM invs
 UNION ALL SELECT 'invocation_request', o, r, p, i, item_name FROM ({_requests("metered", "o, r, p, i")})
 UNION ALL SELECT 'fragment_request', o, -1, -1, -1, item_name FROM ({_requests("sent", "o")})"""
SQL["p4_orphans"] = "SELECT unnest([" + ", ".join(f"'{k}'" for k in ("file", "delivery", *nested.PARENTS)) + "]) AS node_kind, true AS unique_keys, 0 AS orphans"
