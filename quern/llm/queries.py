"""Queries of the text problems, over whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import content, mixing, packing, quantiles, tokens
from quern.operators.delivery import trimmed
from quern.session import settle, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _sizes(spark: SparkSession, d: str, keep: list[str]) -> DataFrame:
    """Tokenized once; later steps read ids and sizes."""
    return settle(tokens.with_sizes(table(spark, d, "documents"), "text", keep))


# --- p5 --------------------------------------------------------------------------------------------------------------
_MEASURES = ("runtime_ms", "function_instance_size_mb")


def _day_sketches(spark: SparkSession, d: str) -> DataFrame:
    """Of each pipeline and day; negative values are no measurements.  Rows without a time are a day of their own (NULL)."""
    measured = [F.when(F.col(c) >= 0, F.col(c)).alias(c) for c in _MEASURES]
    rows = table(spark, d, "fragment_result").select(trimmed(F.col("pipeline_id")).alias("pipeline_id"), F.to_date("received_at").alias("day"), *measured)
    return quantiles.sketches(rows.filter("pipeline_id is not null"), [F.col("pipeline_id"), F.col("day")], _MEASURES)


def p5_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each pipeline and day, and of each pipeline as a whole (day is NULL) merged from its days: the table is read once."""
    # The day sketches are what a later run would keep; written once, read by both levels.
    kept = settle(_day_sketches(spark, d))
    whole = quantiles.merge(kept, ["pipeline_id"], _MEASURES).withColumn("day", F.lit(None).cast("date"))
    return quantiles.read(kept.filter("day is not null").unionByName(whole), ["pipeline_id", "day"], _MEASURES)


def p5_days(spark: SparkSession, d: str) -> DataFrame:
    return quantiles.read(_day_sketches(spark, d).filter("day is not null"), ["pipeline_id", "day"], _MEASURES)


QUERIES |= {"p5_percentiles": p5_percentiles, "p5_days": p5_days}
# Exact percentiles: what the sketches give up to K values a group, as all groups of the small tables have.
_LONG = "SELECT trim(pipeline_id, ' ' || chr(9) || chr(10) || chr(13)) AS pipeline_id, CAST(received_at AS DATE) AS day, measure, v FROM (" + " UNION ALL ".join(f"SELECT pipeline_id, received_at, '{m}' AS measure, {m} AS v FROM fragment_result" for m in _MEASURES) + ") WHERE v >= 0"
_EXACT = "count(*) AS n, " + ", ".join(f"quantile_disc(v, {q}) AS p{q * 100:g}".replace("p99.9", "p99_9") for q in quantiles.QUANTILES) + f", CASE WHEN count(*) <= {quantiles.K} THEN 0.0::DOUBLE ELSE {quantiles.rank_error(quantiles.K)!r}::DOUBLE END AS rank_error"
SQL["p5_days"] = f"SELECT pipeline_id, day, measure, {_EXACT} FROM ({_LONG}) WHERE pipeline_id <> '' AND day IS NOT NULL GROUP BY ALL"
SQL["p5_percentiles"] = f"{SQL['p5_days']} UNION ALL SELECT pipeline_id, NULL, measure, {_EXACT} FROM ({_LONG}) WHERE pipeline_id <> '' GROUP BY pipeline_id, measure"


# --- p6 --------------------------------------------------------------------------------------------------------------
def _plans(spark: SparkSession, d: str, most: int = 1000) -> list[tuple[int, int]]:
    rows = table(spark, d, "container_plan").select("plan_id", "capacity_tokens").dropna().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("too many plans")
    return sorted((r[0], r[1]) for r in rows)


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_sizes(spark, d, ["doc_id"]), _plans(spark, d))


def p6_utilisation(spark: SparkSession, d: str) -> DataFrame:
    return packing.utilisation(p6_containers(spark, d), _plans(spark, d))


def p6_validity(spark: SparkSession, d: str) -> DataFrame:
    sizes, plans = _sizes(spark, d, ["doc_id"]), _plans(spark, d)
    return packing.validity(packing.pack(sizes, plans), sizes, plans)


SQL["p6_validity"] = "SELECT plan_id, 0 AS overfull, 0 AS misplaced, 0 AS needless_cuts, (SELECT count(*) FROM documents) AS items FROM container_plan"


# --- p7 --------------------------------------------------------------------------------------------------------------
def _mixed(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(tokens.with_sizes(table(spark, d, "documents"), "text", ["doc_id", "source"]), table(spark, d, "source_target"))


def p7_copies(spark: SparkSession, d: str) -> DataFrame:
    return mixing.copies(_mixed(spark, d))


def p7_tolerance(spark: SparkSession, d: str) -> DataFrame:
    """Of each listed source: whether its share is met within half a point, and whether its documents stay within the cap."""
    got = mixing.shares(_mixed(spark, d), table(spark, d, "source_target"))
    return got.select("source", (F.abs(F.coalesce("reached_share", F.lit(0.0)) - F.col("target_share")) <= 0.005).alias("met"), (F.col("most_copies") <= F.col("max_repeats")).alias("capped"))


SQL["p7_tolerance"] = "SELECT source, true AS met, true AS capped FROM source_target"


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(_mixed(spark, d), table(spark, d, "source_target"))


QUERIES |= {"p6_containers": p6_containers, "p6_utilisation": p6_utilisation, "p6_validity": p6_validity, "p7_copies": p7_copies, "p7_shares": p7_shares, "p7_tolerance": p7_tolerance}


# --- p8 --------------------------------------------------------------------------------------------------------------
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return content.found(content.score_documents(table(spark, d, "documents"), "text", ["doc_id"]), "doc_id")


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    return content.score_documents(table(spark, d, "documents"), "text", ["doc_id", "source"])


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    return content.rates(p8_scores(spark, d), "source")


QUERIES |= {"p8_found": p8_found, "p8_scores": p8_scores, "p8_rates": p8_rates}
