"""Schemas that drift between files: fuse them, keep alternative types apart, and report each change.

Each document is read to a tagged union: per field (names are one field if they have the same words) the spelling and the set of JSON types, and every
alternative (spelling, path, type) below it.  Unions fuse: those of all documents by a plain partial aggregate into one schema, those of a file and the one before it in
its series field by field, with the alternatives of either side apart, from which changes are read.  Values whose types conflict go to typed branches (one
column a type) beside one canonical text.

A series is compared within hours first; only the last file of each hour is carried to the next, so that a series that holds a third of all
files is not sorted in one task.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Any

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions.jsontext import INVALID, elements, parse

BUCKET_US = 3_600_000_000
KINDS = ("boolean", "integer", "decimal", "string", "array", "object")
_BREAKS = regex.compile(r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})")
_NUMBER = re.compile(r"[+-]?[0-9]+(\.[0-9]*|(?:\.[0-9]*)?[eE][+-]?[0-9]+)?")
_SEPARATORS = regex.compile(r"[^\p{L}\p{N}\p{M}]+")


@lru_cache(maxsize=100_000)
def field_of(name: str) -> str:
    """The words of a name, in lower case and order of the alphabet.  A name without letters and digits is its own field."""
    words = _SEPARATORS.sub(" ", _BREAKS.sub(" ", name)).lower().split()
    return " ".join(sorted(words)) or name


def kind_of(v: Any) -> str | None:
    """JSON type of a value; None for null.  A number written with a point or exponent is a decimal."""
    if v is None:
        return None
    return {bool: "boolean", int: "integer", float: "decimal", str: "string", list: "array", dict: "object"}[type(v)]


def run_parameters(document: Any) -> list[tuple[int, dict]]:
    """(run_no, parameters) of each run of a result document."""
    runs = elements(document.get("runs")) if isinstance(document, dict) else []
    return [(i, r["parameters"]) for i, r in enumerate(runs) if isinstance(r, dict) and isinstance(r.get("parameters"), dict)]


def _alternatives(name: str, value: Any) -> Iterator[tuple[str, str]]:
    """(path, type) of a value and all below it: members by name, elements of arrays as ``*``; a null has the type ``null``."""
    todo = [(name, value)]
    while todo:
        path, v = todo.pop()
        yield path, kind_of(v) or "null"
        if isinstance(v, dict):
            todo += [(f"{path}/{k}", x) for k, x in v.items()]
        elif isinstance(v, list):
            todo += [(f"{path}/*", x) for x in v]


def _unions(extract: Callable[[Any], list[tuple[int, dict]]]) -> Callable:
    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep, unions, below = [], [], []
            for at, text in enumerate(pdf["doc"]):
                value = parse(text)
                if value is INVALID:
                    continue
                union: dict[str, tuple[str, set]] = {}
                paths: set[tuple[str, str, str, str]] = set()
                for _, members in extract(value):
                    for name, v in members.items():
                        field = field_of(name)
                        _, kinds = union.setdefault(field, (name, set()))
                        if (k := kind_of(v)) is not None:
                            kinds.add(k)
                        paths |= {(field, name, path, kind) for path, kind in _alternatives(name, v)}
                keep.append(at)
                unions.append({f: {"name": n, "kinds": sorted(k)} for f, (n, k) in union.items()})
                below.append([dict(zip(("field", "name", "path", "kind"), x)) for x in sorted(paths)])
            out = pdf.iloc[keep][["file", "series", "at"]].copy()
            out["fields"], out["alternatives"] = unions, below
            yield out

    return visit


_UNION = "file long, series string, at long, fields map<string, struct<name: string, kinds: array<string>>>, alternatives array<struct<field: string, name: string, path: string, kind: string>>"


def unions(df: DataFrame, file: str, series: str, written_at: str, document: str, extract: Callable = run_parameters) -> DataFrame:
    """(file, series, at, fields, alternatives) of each file with a valid document.  ``fields`` has the spelling met first; ``alternatives`` has them all."""
    rows = df.select(F.col(file).cast("long").alias("file"), F.col(series).cast("string").alias("series"), F.coalesce(F.unix_micros(F.col(written_at).cast("timestamp")), F.lit(-(2**62))).alias("at"), F.col(document).alias("doc"))
    return rows.filter("doc is not null and file is not null").mapInPandas(_unions(extract), _UNION)


def changes(tagged: DataFrame) -> DataFrame:
    """(file, field_name, drift_kind) of each change against the file before in the series, by time, then file.

    ``added``, ``removed`` (named as in the file before), ``renamed`` (other spelling), ``retyped`` (both sets of types are not empty and differ).
    The first file of a series has no changes; files without a series are left out; a NULL time comes before all others.
    """
    from quern.session import settle

    rows = settle(tagged.filter("series is not null").select("file", "series", "at", "fields")).withColumn("bucket", F.floor(F.col("at") / F.lit(BUCKET_US)))
    inside = W.partitionBy("series", "bucket").orderBy("at", "file")
    last = rows.groupBy("series", "bucket").agg(F.max_by("fields", F.struct("at", "file")).alias("last"))
    carried = last.select("series", "bucket", F.lag("last").over(W.partitionBy("series").orderBy("bucket")).alias("carried"))
    own = rows.withColumn("before", F.lag("fields").over(inside)).withColumn("nr", F.row_number().over(inside))
    pairs = own.join(carried, ["series", "bucket"]).withColumn("before", F.when(F.col("nr") == 1, F.col("carried")).otherwise(F.col("before"))).filter("before is not null")
    both = F.map_zip_with("before", "fields", lambda field, old, new: F.struct(old.alias("old"), new.alias("new")))
    kinds = F.transform(F.map_values(both), _told)
    return pairs.select("file", F.explode(F.flatten(kinds)).alias("c")).select("file", "c.field_name", "c.drift_kind")


def _told(x: Column) -> Column:
    """What changed in one field of two fused unions."""
    old, new = x["old"], x["new"]

    def said(condition: Column, name: Column, kind: str) -> Column:
        return F.when(condition, F.struct(name.alias("field_name"), F.lit(kind).alias("drift_kind")))

    differ = (F.size(new["kinds"]) > 0) & (F.size(old["kinds"]) > 0) & (new["kinds"] != old["kinds"])
    told = F.array(said(old.isNull(), new["name"], "added"), said(new.isNull(), old["name"], "removed"), said(new["name"] != old["name"], new["name"], "renamed"), said(differ, new["name"], "retyped"))
    return F.filter(told, lambda c: c.isNotNull())


def fused(tagged: DataFrame) -> DataFrame:
    """The fused schema: one row a field and alternative (spelling, path and type), with the number of files and the first one that has it."""
    each = tagged.select("file", "at", F.explode("alternatives").alias("f")).select("file", "at", "f.*")
    return each.groupBy("field", "name", "path", "kind").agg(F.count(F.lit(1)).alias("files"), F.min(F.struct("at", "file"))["file"].alias("first_file"))


_VALUES = "file long, run_no int, field string, name string, kind string, as_boolean boolean, as_integer long, as_decimal double, as_string string, as_json string, canonical string"


def _branches(extract: Callable) -> Callable:
    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _VALUES.split(", ")]
        for pdf in batches:
            out = []
            for file, text in zip(pdf["file"], pdf["doc"]):
                value = parse(text)
                if value is INVALID:
                    continue
                for run_no, members in extract(value):
                    for name, v in members.items():
                        k = kind_of(v)
                        out.append((
                            file, run_no, field_of(name), name, k or "null", v if k == "boolean" else None, v if k == "integer" and abs(v) < 2**63 else None,
                            float(v) if k == "decimal" else None, v if k == "string" else None, json.dumps(v) if k in ("array", "object") else None, canonical(v),
                        ))
            frame = pd.DataFrame(out, columns=names)
            frame["as_integer"] = frame["as_integer"].astype("Int64")
            frame["as_boolean"] = frame["as_boolean"].astype("boolean")
            yield frame

    return visit


def canonical(v: Any) -> str | None:
    """One text for values that mean the same in other types: 16, 16.0 and "16" are 16; true and "True" are true; arrays and objects are compact JSON.

    Decimals are doubles; integers are kept whole, however long.
    """
    if v is None:
        return None
    if isinstance(v, str):
        t = v.strip()
        if t.lower() in ("true", "false"):
            return t.lower()
        if not (number := _NUMBER.fullmatch(t)):
            return v
        v = float(t) if number[1] else int(t)
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        return str(int(v)) if math.isfinite(v) and v == int(v) else repr(v)
    return str(v) if isinstance(v, int) else json.dumps(v, sort_keys=True, separators=(",", ":"))


def values(df: DataFrame, file: str, document: str, extract: Callable = run_parameters) -> DataFrame:
    """One consistent table: a row for each file, run and field, the value in the branch of its type and as canonical text."""
    rows = df.select(F.col(file).cast("long").alias("file"), F.col(document).alias("doc")).filter("doc is not null and file is not null")
    return rows.mapInPandas(_branches(extract), _VALUES)


def consistent(df: DataFrame, file: str, document: str, extract: Callable = run_parameters) -> DataFrame:
    """The same, one row for each file and run: ``parameters`` maps a field to its values, each with its spelling, typed branches and canonical text.

    A field has one value but where a run spells it in several ways.  Files that come twice are one: what they repeat counts once.
    """
    v = values(df, file, document, extract)
    branches = F.struct("name", "kind", "as_boolean", "as_integer", "as_decimal", "as_string", "as_json", "canonical")
    by_field = v.groupBy("file", "run_no", "field").agg(F.array_sort(F.collect_set(branches)).alias("values"))
    return by_field.groupBy("file", "run_no").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "values")))).alias("parameters"))


def wide(table: DataFrame, fields: list[str], most: int = 2000) -> DataFrame:
    """``consistent`` as typed columns for the given fields: of each the canonical text under its name, and a column for each typed branch.

    The fields may come from ``fused``; more than ``most`` raise.  Of several spellings in one run the first in order of spelling counts.
    """
    if len(fields) > most:
        raise ValueError(f"more than {most} fields")
    columns = []
    for f in fields:
        x, name = F.get(F.col("parameters")[F.lit(f)], F.lit(0)), f.replace(" ", "_")
        columns += [x["canonical"].alias(name), *[x[c].alias(f"{name}__{c.removeprefix('as_')}") for c in ("as_boolean", "as_integer", "as_decimal", "as_string", "as_json")]]
    return table.select("file", "run_no", *columns)
