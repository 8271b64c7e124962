import json

from quern.operators import nested as N


def flat(spark, docs, visitor=N.visit_result, **kw):
    df = spark.createDataFrame([(i, d, "x", -1) for i, d in docs], "own long, doc string, payload string, run_no int")
    return sorted((r.node_kind, r.owner_id, r.run_no, r.repetition_no, r.invocation_no, r.item_name) for r in N.flatten(df, "own", "doc", visitor, **kw).collect())


def test_result(spark):
    d = {"runs": [None, {"parameters": {"a": 1}, "metrics": {"m": 1.5, "n": None}, "repetitions": [None, {"invocations": {"metering": {"S3:Get": {"finished": 1}, "SQS:Send": None}}}, {"invocations": [None, {"metering": '{"metering": [{"request": "L:I"}, null]}'}, 7]}]}]}
    want = [("invocation", 1, 1, 1, 0, ""), ("invocation", 1, 1, 2, 1, ""), ("invocation_request", 1, 1, 1, 0, "S3:Get"), ("invocation_request", 1, 1, 2, 1, "L:I"), ("metric", 1, 1, -1, -1, "m"), ("repetition", 1, 1, 1, -1, ""), ("repetition", 1, 1, 2, -1, ""), ("run", 1, 1, -1, -1, "")]
    assert flat(spark, [(1, json.dumps(d))]) == [("file", 1, -1, -1, -1, ""), *want] and flat(spark, [(1, json.dumps(d))], payload=False) == want


def test_edge_cases(spark):
    assert flat(spark, []) == []
    assert flat(spark, [(1, None), (2, ""), (3, "{"), (None, "{}"), (4, '{"runs": null}'), (5, "3"), (6, '{"runs": NaN}'), (7, "[" * 90_000)], payload=False) == []
    assert flat(spark, [(1, '{"runs": {}}'), (1, '{"runs": {}}')], payload=False) == [("run", 1, 0, -1, -1, "")] * 2
    assert len(flat(spark, [(1, json.dumps({"runs": [{}] * 60_000}))], payload=False)) == 60_000


def test_metering_shapes(spark):
    one = {"A:B": {"finished": 1}}
    shapes = [one, [{"request": "A:B", "finished": 1}], {"request": "A:B"}, json.dumps(one), {"metering": one}, {"metering": json.dumps([{"request": "A:B"}])}]
    for s in shapes:
        assert flat(spark, [(9, json.dumps(s))], N.visit_metering) == [("delivery", 9, -1, -1, -1, ""), ("fragment_request", 9, -1, -1, -1, "A:B")], s
    for s in ("{}", "[]", "[null]", '{"A:B": null}', '""', '"x"', "null", "5"):
        assert flat(spark, [(9, s)], N.visit_metering) == [("delivery", 9, -1, -1, -1, "")]


def test_links_and_tables(spark, tmp_path):
    d = json.dumps({"runs": [{"metrics": {"m": 2}, "repetitions": [{"invocations": [{"invocation_id": "q", "metering": {"A:B": {"finished": 4, "failed": "x"}}}]}]}]})
    nodes = N.flatten(spark.createDataFrame([(1, d)], "own long, doc string"), "own", "doc")
    keyed = {r.node_kind: (r.key, r.parent_key) for r in N.keyed(nodes).collect()}
    assert keyed == {
        "file": ("file:1", None), "run": ("file:1/0", "file:1"), "metric": ("file:1/0/metric:m", "file:1/0"), "repetition": ("file:1/0/0", "file:1/0"), "invocation": ("file:1/0/0/0", "file:1/0/0"),
        "invocation_request": ("file:1/0/0/0/invocation_request:A:B", "file:1/0/0/0"),
    }
    assert N.flat(nodes, "invocation", "invocation_id string").first().invocation_id == "q"
    N.write_tables(nodes, str(tmp_path / "t"))
    assert sorted(p.name for p in (tmp_path / "t").glob("node_kind=*"))[0] == "node_kind=file" and N.read_tables(spark, str(tmp_path / "t")).count() == 6


def test_nested_members_are_kept(spark):
    inv = {"invocation_id": "q", "introspection": {"env": "e", "cpu": {"a/b": [1, 2]}}, "intervals": [{"a": 1}, None, 3], "metering": {"A:B": {"finished": 4, "by": [1]}}}
    d = {"context": {"date": "x", "host": {"n": 2}}, "version": 3, "runs": [{"id": 7, "metrics": [5], "parameters": {"p": [1]}, "repetitions": {"throughput": [5, 6], "empty": [], "invocations": inv}}]}
    df = spark.createDataFrame([(1, json.dumps(d))], "own long, doc string")
    nodes = N.flatten(df, "own", "doc")
    got = {(r.parent_key, r.item_name): json.loads(r.payload) for r in N.keyed(nodes).filter("node_kind = 'member'").collect()}
    assert got == {
        ("file:1", "/context"): {"date": "x"}, ("file:1", "/context/host"): {"n": 2}, ("file:1/0", "/id"): 7, ("file:1/0", "/metrics"): [5], ("file:1/0/0", "/throughput"): [5, 6], ("file:1/0/0", "/empty"): [],
        ("file:1/0/0/0", "/introspection"): {"env": "e"}, ("file:1/0/0/0", "/introspection/cpu"): {}, ("file:1/0/0/0", "/introspection/cpu/a~1b"): [1, 2], ("file:1/0/0/0", "/intervals/0"): {"a": 1}, ("file:1/0/0/0", "/intervals/1"): None, ("file:1/0/0/0", "/intervals/2"): 3,
    }
    assert json.loads(nodes.filter("node_kind = 'file'").first().payload) == {"version": 3}
    assert json.loads(nodes.filter("node_kind = 'invocation_request'").first().payload)["by"] == [1]
    assert N.flatten(df, "own", "doc", payload=False).filter("node_kind = 'member'").count() == 0


def test_invocations_hold_nested_members(spark, data):
    from quern.plans import pipeline_queries as P

    rows = P.p4_invocations(spark, data).collect()
    assert any("introspection" in r.members for r in rows) and any("intervals_download" in r.members for r in rows) and not any('"metering"' in r.members for r in rows)


def test_keys_are_unique(spark):
    """Entries of one request in one array, names with a slash, and numbers of any length."""
    metering = json.dumps([{"request": "A:B", "finished": 1}, {"request": "A:B", "finished": 2}, {"request": "A:B/1"}, {"request": "A:B~11"}])
    nodes = N.flatten(spark.createDataFrame([(9, metering)], "own long, doc string"), "own", "doc", N.visit_metering)
    keys = [r.key for r in N.keyed(nodes).collect()]
    assert sorted(keys) == ["delivery:9", "delivery:9/fragment_request:A:B", "delivery:9/fragment_request:A:B/1", "delivery:9/fragment_request:A:B~011", "delivery:9/fragment_request:A:B~11"]
    big = '{"runs": [{"parameters": {"x": ' + "7" * 5000 + "}}]}"
    run = N.flatten(spark.createDataFrame([(1, big)], "own long, doc string"), "own", "doc").filter("node_kind = 'run'").first()
    assert "7" * 5000 in run.payload
