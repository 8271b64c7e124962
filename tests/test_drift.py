import json
from datetime import datetime, timedelta

from quern.operators import drift as D

SCHEMA = "file_no long, campaign_id long, written_at timestamp_ntz, document string, file string, fields string"


def test_words():
    same = ["message_size_kb", "messageSizeKB", "kb-message-size", "MESSAGE_SIZE_KB", "Size Message Kb"]
    assert len({D.field_of(n) for n in same}) == 1
    assert D.field_of("enableS3Eoz") == D.field_of("enable_s3_eoz") == "3 enable eoz s"
    assert D.field_of("HTTPServer") == D.field_of("http_server") and D.field_of("a") != D.field_of("aa")
    assert D.field_of("--") == "--" and D.field_of("") == ""


def doc(**p):
    return json.dumps({"runs": [{"parameters": p}]})


def run(spark, rows):
    return sorted(tuple(r) for r in D.changes(D.unions(spark.createDataFrame(rows, SCHEMA).repartition(3), "file_no", "campaign_id", "written_at", "document")).collect())


def test_changes(spark):
    t = datetime(2024, 1, 1)
    h = timedelta(hours=3)
    rows = [
        (1, 1, t, doc(size_kb=1, vpc=True, gone=1), "", ""), (2, 1, t, doc(sizeKb="1", vpc=None, gone=1), "", ""),  # same time: by file
        (3, 1, t + h, '{"runs": [', "", ""), (4, 1, t + h, doc(sizeKb=1.5, VPC=False), "", ""), (5, 1, t + 2 * h, json.dumps({"runs": {"parameters": {"sizeKb": 2, "new": None}}}), "", ""),
        (6, 2, t, doc(a=1), "", ""), (7, None, t, doc(b=1), "", ""), (8, 2, None, doc(c=1), "", ""), (9, 2, t, None, "", ""), (10, 2, t + h, "[1]", "", ""),
    ]
    want = [
        (2, "sizeKb", "renamed"), (2, "sizeKb", "retyped"), (4, "VPC", "renamed"), (4, "gone", "removed"), (4, "sizeKb", "retyped"),
        (5, "VPC", "removed"), (5, "new", "added"), (5, "sizeKb", "retyped"), (6, "a", "added"), (6, "c", "removed"), (10, "a", "removed"),
    ]
    assert run(spark, rows) == sorted(want)
    assert run(spark, rows + rows[:1]) == sorted(want)  # a repeated row changes nothing
    assert run(spark, []) == []


def test_types_union_over_runs_and_numbers(spark):
    t = datetime(2024, 1, 1)
    two = json.dumps({"runs": [{"parameters": {"x": 1}}, {"parameters": {"x": "1"}}, None, {"parameters": None}, {}]})
    rows = [(1, 1, t, doc(x=1), "", ""), (2, 1, t, two, "", ""), (3, 1, t, '{"runs":[{"parameters":{"x":1e0}}]}', "", ""), (4, 1, t, '{"runs":[{"parameters":{"x":' + "9" * 5000 + "}}]}", "", ""), (5, 1, t, '{"runs":[{"parameters":{"x":NaN}}]}', "", ""), (6, 1, t, "[" * 100_000, "", "")]
    assert run(spark, rows) == [(2, "x", "retyped"), (3, "x", "retyped"), (4, "x", "retyped")]


def test_fused_and_values(spark):
    t = datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, 1, t, doc(x=1, y=[1]), "", ""), (2, 1, t, doc(X="1.0", y={"a": None}), "", ""), (3, 1, t, doc(x=True, z=None), "", "")], SCHEMA)
    got = sorted((r.field, r.name, r.kind, r.files) for r in D.fused(D.unions(df, "file_no", "campaign_id", "written_at", "document")).filter("path = name").collect())
    assert got == [("x", "X", "string", 1), ("x", "x", "boolean", 1), ("x", "x", "integer", 1), ("y", "y", "array", 1), ("y", "y", "object", 1), ("z", "z", "null", 1)]
    v = {(r.file, r.name): r for r in D.values(df, "file_no", "document").collect()}
    assert v[1, "x"].as_integer == 1 and v[2, "X"].as_string == "1.0" and v[1, "x"].canonical == v[2, "X"].canonical == "1"
    assert v[3, "x"].as_boolean is True and v[3, "x"].canonical == "true" and v[3, "z"].canonical is None and v[2, "y"].as_json == '{"a": null}'
    table = {r.file: r.parameters for r in D.consistent(df, "file_no", "document").collect()}
    assert {k: [x.canonical for x in v] for k, v in table[2].items()} == {"x": ["1"], "y": ['{"a":null}']}
    assert D.values(df.limit(0), "file_no", "document").count() == 0


def test_two_spellings_and_files_that_come_twice(spark):
    t = datetime(2024, 1, 1)
    both = json.dumps({"runs": [{"parameters": {"size_kb": 1, "sizeKB": "2", "y": {"a": [1, {"b": None}]}}}]})
    df = spark.createDataFrame([(1, 1, t, both, "", ""), (1, 1, t, both, "", "")], SCHEMA)
    table = D.consistent(df, "file_no", "document")
    (row,) = table.collect()
    assert {k: [(x.name, x.kind, x.canonical) for x in v] for k, v in row.parameters.items()} == {"kb size": [("sizeKB", "string", "2"), ("size_kb", "integer", "1")], "y": [("y", "object", '{"a":[1,{"b":null}]}')]}
    w = D.wide(table, ["kb size", "y", "none"]).first()
    assert (w.kb_size, w.kb_size__string, w.kb_size__integer, w.y__json, w.none) == ("2", "2", None, '{"a": [1, {"b": null}]}', None)
    got = {(r.name, r.path, r.kind) for r in D.fused(D.unions(df, "file_no", "campaign_id", "written_at", "document")).collect()}
    assert got == {("size_kb", "size_kb", "integer"), ("sizeKB", "sizeKB", "string"), ("y", "y", "object"), ("y", "y/a", "array"), ("y", "y/a/*", "integer"), ("y", "y/a/*", "object"), ("y", "y/a/*/b", "null")}


def test_canonical():
    assert D.canonical("9" * 4000) != D.canonical("9" * 4001) == "9" * 4001 and D.canonical(10**5000) == "1" + "0" * 5000
    assert D.canonical(16) == D.canonical(16.0) == D.canonical(" 16 ") == D.canonical("16.0") == D.canonical("1.6e1") == "16" and D.canonical(1e16) == D.canonical(10**16)
    assert D.canonical("1_0") == "1_0" and D.canonical("nan") == "nan" and D.canonical("True") == "true" and D.canonical("1e999") == "inf"
