import pytest
from pyspark.sql import types as T

from quern.sources import files, storage
from quern.sources.catalog import Catalog


def test_sniff():
    assert files.sniff(["id;text", "1;a"]) == {"sep": ";", "header": ["id", "text"], "types": None}
    assert files.sniff(["a_int|a_str", "int|string", "1|x"]) == {"sep": "|", "header": ["a_int", "a_str"], "types": ["int", "string"]}
    assert files.sniff(["1|2|", "3|4|"])["header"] is None
    assert files.sniff([])["header"] is None


def test_csv_reading(spark, tmp_path):
    p = tmp_path / "typed.csv"
    p.write_text("a_int|a_long|a_float|a_double|a_string\nint|long|float|double|string\n1|2|1.2|1.23|Hel;o\n")
    df = files.read_csv(spark, str(p))
    assert df.dtypes == [("a_int", "int"), ("a_long", "bigint"), ("a_float", "float"), ("a_double", "double"), ("a_string", "string")]
    assert df.collect()[0]["a_string"] == "Hel;o" and df.count() == 1
    bare = tmp_path / "bare.tbl"
    bare.write_text("1|x|\n2|y|\n")
    assert files.read_csv(spark, str(bare)).columns == ["Column1", "Column2", "Column3"]
    only = tmp_path / "only.csv"
    only.write_text("id,text\n")
    assert files.read_csv(spark, str(only)).count() == 0
    bad = tmp_path / "bad.csv"
    bad.write_text("a,b\n1,x\n")
    with pytest.raises(Exception):
        files.read_csv(spark, str(bad), schema=T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())])).collect()


@pytest.mark.parametrize("fmt", ["csv", "orc", "parquet"])
def test_round_trip(spark, tmp_path, fmt):
    df = spark.createDataFrame([(1, 2, 0.1, 0.2, "x"), (None, None, None, None, None), (3, -4, -0.5, 1e300, ""), (5, 6, 1.5, 2.5, " blank ")], "a int, b long, c float, d double, e string")
    path = str(tmp_path / f"t.{fmt}")
    files.export(df, path, single=True)
    options = {"sep": ";", "header": True} if fmt == "csv" else {}
    back = files.import_(spark, path, expected=df.schema, **options)
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr)
    assert files.import_(spark, path, ["e", "a"], expected=df.schema, **options).columns == ["e", "a"]
    files.export(df.repartition(1), path, split_rows=1)
    assert len(list((tmp_path / f"t.{fmt}").glob("part-*"))) == 4


def test_expected_schema(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    files.export(spark.range(3).toDF("a"), path)
    with pytest.raises(ValueError):
        files.import_(spark, path, expected=T.StructType([T.StructField("b", T.LongType())]))
    with pytest.raises(ValueError):
        files.format_of("x.xml")


def test_catalog(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    files.export(spark.createDataFrame([(1, 2), (1, 3)], "a int, b int"), path)
    c = Catalog(spark)
    c.add("Things", path, primary_key=("a",), unique=[("a", "b")])
    assert c.exists("things") and c.names() == ["things"] and c.schema("THINGS").names == ["a", "b"]
    assert spark.sql("select count(*) from things").first()[0] == 2
    v = c.violations("things")
    assert v[("a",)].count() == 1 and v[("a", "b")].count() == 0
    assert c.partitions("things").count() >= 1
    with pytest.raises(ValueError):
        c.add("x", path, primary_key=("z",))
    c.drop("things")
    assert not c.exists("things")


def test_escaped_round_trip(spark, tmp_path):
    texts = ["a;b", "NULL", None, "", "%3B", "%4E%25", "two\nlines\r\n", "100 %", ";", "N", 'q"uote', "back\\slash"]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
    path = str(tmp_path / "e.csv")
    files.export(df, path, escaped=True)
    back = files.import_(spark, path, expected=df.schema, sep=";", header=True, escaped=True)
    assert sorted(map(tuple, back.collect())) == list(enumerate(texts))


def test_export_refuses_what_it_cannot_hold(spark, tmp_path):
    for text in ("a;b", "NULL", "two\nlines"):
        with pytest.raises(Exception, match="can't hold"):
            files.export(spark.createDataFrame([(text,)], "t string"), str(tmp_path / "x.csv"))
    wrote = files.export(spark.range(10).repartition(2), str(tmp_path / "y.csv"))
    assert wrote["objects"] == 2 and wrote["bytes"] > 20


def test_storage(spark, tmp_path):
    path = str(tmp_path / "s.parquet")
    files.export(spark.range(5).coalesce(1), path)
    seen = storage.ls(spark, path, ".parquet")
    assert len(seen) == 1 and storage.status(spark, seen[0].path).size == seen[0].size and storage.unchanged(spark, seen)
    files.export(spark.range(500).coalesce(1), path)
    assert not storage.unchanged(spark, seen)
    assert storage.delete(spark, path) and not storage.delete(spark, path) and storage.status(spark, path) is None and storage.ls(spark, path) == []


def test_options_and_row_groups(spark, tmp_path):
    text = files.options_to_json("csv", sep="|", header=True)
    assert files.options_from_json(text) == {"fmt": "csv", "sep": "|", "header": True}
    for bad in ({"sep": 1}, {"nope": "x"}):
        with pytest.raises(ValueError):
            files.options_to_json("csv", **bad)
    import pyarrow as pa
    import pyarrow.parquet as pq

    path = str(tmp_path / "g.parquet")
    pq.write_table(pa.table({"a": list(range(30)), "b": ["x"] * 30}), path, row_group_size=10)
    assert sorted(r.a for r in files.read_row_groups(spark, path, [0, 2], ["a"]).collect()) == [*range(10), *range(20, 30)]
    assert files.read_row_groups(spark, path, []).count() == 0


def test_catalog_databases_versions_and_manifest(spark, tmp_path):
    path = str(tmp_path / "v.parquet")
    files.export(spark.range(3), path)
    c = Catalog(spark)
    c.create_database("Sales")
    assert c.add("sales.T", path).version == 1 and c.add("SALES.t", path).version == 2 and c.databases() == ["default", "sales"]
    assert c.table("sales.t").count() == 3 and c.partitions("sales.t").count() == len(c.entry("sales.t").manifest) and not c.changed("sales.t")
    files.export(spark.range(4), path)
    assert c.changed("sales.t")
    with pytest.raises(ValueError):
        c.add("none.t", path)
    with pytest.raises(ValueError):
        c.create_database("sales")
    c.drop_database("sales")
    assert c.names() == [] and c.databases() == ["default"]
