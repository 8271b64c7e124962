from datetime import datetime, timedelta

from quern.streaming import events as S


def run(spark, df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def test_once(spark, tmp_path):
    t = datetime(2025, 1, 1)
    rows = [("p", "w-1", t, 1), (" p", "w-1\n", t, 2), ("p", "w-2", t, 3), (None, "w-1", t, 4), (None, "w-1", t, 5)]
    df = spark.createDataFrame(rows, "p string, w string, at timestamp_ntz, id long")
    df.coalesce(1).write.parquet(str(tmp_path / "m"))
    out = run(spark, S.once(S.read_folder(spark, str(tmp_path / "m"), df.schema), ["p", "w"], "at"), "once_out")
    ids = sorted(r.id for r in out)
    assert len(ids) == 4 and {3, 4, 5} <= set(ids)


def test_windows(spark, tmp_path):
    t = datetime(2025, 1, 1)
    df = spark.createDataFrame([(t + timedelta(minutes=m), "a" if m % 2 else "b", 1.0) for m in range(0, 240, 10)], "ts timestamp_ntz, k string, v double")
    df.coalesce(1).write.parquet(str(tmp_path / "e"))
    out = run(spark, S.windowed_counts(S.read_folder(spark, str(tmp_path / "e"), df.schema), "ts", ["k"], value="v"), "win_out", "complete")
    assert sum(r.n for r in out) == 24 and sum(r.total for r in out) == 24.0


def test_deliver_once(spark, tmp_path):
    t = datetime(2025, 1, 1)
    schema = "p string, w string, at timestamp_ntz, id long"
    for k, rows in enumerate([[("p", "w-1", t, 1), ("p", "w-2", t, 2)], [("p", "w-1", t + timedelta(days=9), 3), ("p", "w-3", t, 4), (None, "w-1", t, 5)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = S.read_folder(spark, str(tmp_path / "in"), spark.createDataFrame(rows, schema).schema).writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True)
        q.foreachBatch(S.deliver_once(str(tmp_path / "out"), str(tmp_path / "seen"), ["p"], "w", "at", "id")).start().awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 4, 5]
