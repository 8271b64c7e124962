"""Structured Streaming forms: late-tolerant windows and once-only delivery over unbounded input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators.delivery import keep_once, seen_messages, trimmed


def read_folder(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_counts(events: DataFrame, time: str, keys: list[str], length: str = "1 hour", slide: str | None = None, late: str = "10 minutes", value: str | None = None) -> DataFrame:
    """Counts (and sums of ``value``) a window and key; rows later than ``late`` behind the newest are left out."""
    t = F.col(time).cast("timestamp")
    aggs = [F.count(F.lit(1)).alias("n")] + ([F.sum(value).alias("total")] if value else [])
    w = F.window("__t", length, slide) if slide else F.window("__t", length)
    return events.withColumn("__t", t).withWatermark("__t", late).groupBy(w, *keys).agg(*aggs).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, *[a for a in ("n", "total") if a == "n" or value])


def once(messages: DataFrame, keys: list[str], time: str, late: str = "1 day") -> DataFrame:
    """Messages without copies that arrive within ``late`` of the first; rows with a blank identifier pass.

    State is bounded by the watermark.  ``deliver_once`` has no such limit.
    """
    ids = [trimmed(F.col(f"`{k}`")) for k in keys]
    blank = F.lit(False)
    for i in ids:
        blank |= i.isNull()
    # Each row without an identifier gets one of its own, so that it is never taken for a copy.
    key = F.when(blank, F.concat(F.lit("\u0000"), F.uuid())).otherwise(F.to_json(F.array(*ids)))
    return messages.withColumn("__t", F.col(time).cast("timestamp")).withColumn("__key", key).withWatermark("__t", late).dropDuplicatesWithinWatermark(["__key"]).drop("__t", "__key")


def deliver_once(path: str, ledger: str, message_keys: list[str], sequence_key: str, order: str, row_id: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each message once however late its copies come.  Kept rows go to ``path``, the ranges seen so far to ``ledger``, a folder a batch.

    A batch that is run again reads the ledger of the batch before and overwrites its own folders, so it comes out the same.
    """

    def write(batch: DataFrame, number: int) -> None:
        seen = batch.sparkSession.read.parquet(f"{ledger}/batch={number - 1}") if number > 0 else None
        keep_once(batch, message_keys, sequence_key, order, row_id, seen).write.mode("overwrite").parquet(f"{path}/batch={number}")
        seen_messages(batch, message_keys, sequence_key, seen).write.mode("overwrite").parquet(f"{ledger}/batch={number}")

    return write
