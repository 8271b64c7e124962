"""Deeply nested records into related flat tables, in one pass.

A depth-first visitor walks each document once and emits tagged rows: the table, the key of the row, the key of its parent and the scalar
members as payload.  Nested members without a table of their own, and members of the document and of a run beside their tables, are ``member`` rows of the
node that holds them; ``item_name`` is then a JSON pointer from that node, so nothing of a document is lost.  Keys are the position path (owner, run, repetition, invocation, item, number of the item among those of one name), so parent links
need no generated numbers and come out the same when a task is run again; they are unique where owners are.  Documents and messages have rows of their own, so every parent key is a key.  The pass is map-only; ``write_tables`` writes it partitioned by tag, and ``flat`` applies a table's schema.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Collection, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.jsontext import INVALID, elements, parse

#: What holds the rows of a table; the roots have no parent.
PARENTS = {"member": "file, run, repetition or invocation", "run": "file", "metric": "run", "repetition": "run", "invocation": "repetition", "invocation_request": "invocation", "fragment_request": "delivery"}
SCHEMA = "node_kind string, owner_id long, run_no int, repetition_no int, invocation_no int, item_name string, item_no int, payload string"
_ARROW = pa.schema([("node_kind", pa.string()), ("owner_id", pa.int64()), ("run_no", pa.int32()), ("repetition_no", pa.int32()), ("invocation_no", pa.int32()), ("item_name", pa.string()), ("item_no", pa.int32()), ("payload", pa.string())])


def requests(metering: Any) -> Iterator[tuple[str, Any]]:
    """(request, counts) of metering in any of its shapes: object by request, array of objects, lone object, as text, inside another ``metering``.

    A NULL element or NULL counts give nothing.  Text that isn't valid JSON gives nothing.
    """
    while True:
        if isinstance(metering, str):
            metering = parse(metering)
        elif isinstance(metering, dict) and "metering" in metering:
            metering = metering["metering"]
        else:
            break
    if isinstance(metering, dict) and not isinstance(metering.get("request"), str):
        for name, counts in metering.items():
            if isinstance(counts, dict):
                yield name, counts
    elif isinstance(metering, (list, dict)):
        for x in elements(metering):
            if isinstance(x, dict) and isinstance(x.get("request"), str):
                yield x["request"], x
            elif isinstance(x, dict) and "request" not in x:
                yield from requests(x)


def _scalars(node: dict) -> str:
    return json.dumps({k: v for k, v in node.items() if not isinstance(v, (dict, list))})


def _step(name: str | int) -> str:
    """A step of a JSON pointer."""
    return "/" + str(name).replace("~", "~0").replace("/", "~1")


def members(value: Any, pointer: str) -> Iterator[tuple[str, str]]:
    """(JSON pointer, JSON) of a value in flat rows: an object is a row of its scalars, an array without objects or arrays is one row, another a row an element."""
    todo = [(pointer, value)]
    while todo:  # no recursion: the parser goes deeper than that
        at, x = todo.pop()
        if isinstance(x, dict):
            yield at, _scalars(x)
            todo += [(at + _step(k), v) for k, v in x.items() if isinstance(v, (dict, list))]
        elif isinstance(x, list) and any(isinstance(v, (dict, list)) for v in x):
            todo += [(at + _step(k), v) for k, v in enumerate(x)]
        else:
            yield at, json.dumps(x)


def _numbered(found: Iterator[tuple[str, Any]]) -> Iterator[tuple[str, int, Any]]:
    """Requests with their number among those of the same name."""
    seen: Counter[str] = Counter()
    for name, counts in found:
        yield name, seen[name], counts
        seen[name] += 1


def visit_result(owner: int, document: Any, emit: Callable, payload: bool, whole: bool = False) -> None:
    """A benchmark result: runs with their parameters, metrics, repetitions, invocations and requests.

    With ``payload``, what has no table of its own follows as ``member`` rows; ``whole`` leaves it in the payload of repetitions and invocations instead.
    """

    def rest(node: dict, r: int, p: int, i: int, tables: Collection[str], scalars: bool) -> None:
        """``member`` rows of a node; ``scalars``: no other row holds its scalars."""
        for k, v in node.items():
            if payload and k not in tables and (scalars or isinstance(v, (dict, list)) and not whole):
                for pointer, text in members(v, _step(k)):
                    emit("member", owner, r, p, i, pointer, 0, text)

    def own(node: dict, table: str) -> str | None:
        return (json.dumps({k: v for k, v in node.items() if k != table}) if whole else _scalars(node)) if payload else None

    if not isinstance(document, dict):
        return
    if payload:
        emit("file", owner, -1, -1, -1, "", 0, _scalars(document))
    rest(document, -1, -1, -1, ("runs",), False)
    for r, run in enumerate(elements(document.get("runs"))):
        if not isinstance(run, dict):
            continue
        emit("run", owner, r, -1, -1, "", 0, json.dumps(run.get("parameters")) if payload else None)
        metrics = run.get("metrics")
        rest(run, r, -1, -1, ("parameters", "repetitions", *(["metrics"] if metrics is None or isinstance(metrics, dict) else [])), True)
        if isinstance(metrics, dict):
            for name, v in metrics.items():
                if v is not None:
                    emit("metric", owner, r, -1, -1, name, 0, json.dumps(v) if payload else None)
        for p, rep in enumerate(elements(run.get("repetitions"))):
            if not isinstance(rep, dict):
                continue
            emit("repetition", owner, r, p, -1, "", 0, own(rep, "invocations"))
            rest(rep, r, p, -1, ("invocations",), False)
            for i, inv in enumerate(elements(rep.get("invocations"))):
                if not isinstance(inv, dict):
                    continue
                emit("invocation", owner, r, p, i, "", 0, own(inv, "metering"))
                rest(inv, r, p, i, ("metering",), False)
                for name, no, counts in _numbered(requests(inv.get("metering"))):
                    emit("invocation_request", owner, r, p, i, name, no, json.dumps(counts) if payload else None)


def visit_metering(owner: int, metering: Any, emit: Callable, payload: bool) -> None:
    """The metering of one delivered message."""
    if payload:
        emit("delivery", owner, -1, -1, -1, "", 0, None)
    for name, no, counts in _numbered(requests(metering)):
        emit("fragment_request", owner, -1, -1, -1, name, no, json.dumps(counts) if payload else None)


def flatten(df: DataFrame, owner: str, document: str, visitor: Callable = visit_result, payload: bool = True) -> DataFrame:
    """Tagged rows of all documents (see SCHEMA).  Positions count from 0; what doesn't apply is -1 or empty text.

    NULL or invalid documents give no rows; a NULL element keeps its position and is no row; a lone object stands for an array of one.
    Repeated rows count each.  Rows with a NULL owner are left out.  ``payload=False`` gives positions only: no members, and no rows of the documents themselves.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: tuple[list, ...] = tuple([] for _ in _ARROW)
            adders = [c.append for c in cols]

            def emit(*row: Any) -> None:
                for add, v in zip(adders, row):
                    add(v)

            for own, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                value = parse(text)
                if value is not INVALID:
                    visitor(own, value, emit, payload)
                if len(cols[0]) > 50_000:  # one batch of documents may hold many nodes
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW)], schema=_ARROW)
                    for c in cols:
                        c.clear()
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW)], schema=_ARROW)

    rows = df.select(F.col(owner).cast("long").alias("owner"), F.col(document).cast("string").alias("doc")).filter("owner is not null and doc is not null")
    return rows.mapInArrow(walk, SCHEMA)


def keyed(nodes: DataFrame) -> DataFrame:
    """Adds ``key`` and ``parent_key``: the position path of a row and of its parent (NULL for roots).  Names are escaped as in JSON pointers."""
    kind = F.col("node_kind")
    root = F.concat(F.when(kind.isin("delivery", "fragment_request"), F.lit("delivery:")).otherwise(F.lit("file:")), F.col("owner_id").cast("string"))
    path = F.concat_ws("/", root, *[F.when(F.col(c) >= 0, F.col(c)) for c in ("run_no", "repetition_no", "invocation_no")])
    up = F.when(kind.isin("run", "repetition", "invocation"), F.regexp_replace(path, "/[0-9]+$", "")).when(~kind.isin("file", "delivery"), path)
    name = F.when(kind == "member", F.col("item_name")).otherwise(F.replace(F.replace("item_name", F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")))
    item = F.concat_ws("/", path, F.concat(kind, F.lit(":"), name), F.when(F.col("item_no") > 0, F.col("item_no")))
    own = kind.isin("file", "delivery", "run", "repetition", "invocation")
    return nodes.withColumn("key", F.when(own, path).otherwise(item)).withColumn("parent_key", up)


def flat(nodes: DataFrame, kind: str, schema: str, members: str = "") -> DataFrame:
    """One flat table: keys and the payload's members by ``schema`` (DDL); members of another type are NULL.  ``members`` names a column for the whole payload."""
    keys = ("key", "parent_key", "owner_id", "run_no", "repetition_no", "invocation_no", "item_name")
    rows = keyed(nodes.filter(F.col("node_kind") == kind)).select(*keys, F.from_json("payload", schema).alias("x"), "payload")
    return rows.select(*keys, "x.*", *([F.col("payload").alias(members)] if members else []))


def write_tables(nodes: DataFrame, path: str) -> None:
    """All tables by one pass, a folder for each tag."""
    keyed(nodes).write.mode("overwrite").partitionBy("node_kind").parquet(path)


def read_tables(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_tables`` wrote; a filter on ``node_kind`` reads the folders of these tables only."""
    return spark.read.schema(f"{SCHEMA}, key string, parent_key string").parquet(path)
