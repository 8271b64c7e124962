"""Import and export of CSV, ORC and Parquet with the engine's defaults."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.parquet as pq

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern import types as Q
from quern.sources import storage

#: Delimiters tried by the CSV reader, in this order.
DELIMITERS = ("|", ";", ",", "\t", " ")
SNIFF_LINES = 5


def format_of(path: str) -> str:
    m = re.search(r"\.(csv|tbl|orc|parquet)/?$", path)
    if not m:
        raise ValueError(f"cannot tell the format of {path}")
    return {"tbl": "csv"}.get(m[1], m[1])


def sniff(lines: Sequence[str]) -> dict:
    """Delimiter, header and type line from the first lines: the delimiter is the first that occurs equally often (at least once) in each line."""
    lines = [x.rstrip("\r\n") for x in lines[:SNIFF_LINES] if x.strip()]
    if not lines:
        return {"sep": ",", "header": None, "types": None}
    sep = next((d for d in DELIMITERS if lines[0].count(d) and len({x.count(d) for x in lines}) == 1), None)
    sep = sep or next((d for d in DELIMITERS if d in lines[0]), ",")
    first = lines[0].split(sep)
    named = all(re.fullmatch(r"\s*[A-Za-z_]\w*\s*", x) for x in first)
    types = lines[1].split(sep) if named and len(lines) > 1 and all(x.strip() in Q.BY_NAME for x in lines[1].split(sep)) else None
    return {"sep": sep, "header": [x.strip() for x in first] if named else None, "types": types and [x.strip() for x in types]}


def read_csv(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType | None = None, sep: str | None = None, header: bool | None = None, escaped: bool = False) -> DataFrame:
    """CSV or TBL; ``escaped`` as in ``export``.  Without a schema, names and types come from the first lines (else text columns Column1, Column2, ...); a bad value raises."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    head = [r[0] for r in spark.read.text(paths[0]).limit(SNIFF_LINES).collect()]
    found = sniff(head)
    sep, has_header = sep or found["sep"], found["header"] is not None if header is None else header
    if schema is None:
        names = found["header"] if has_header else [f"Column{i + 1}" for i in range(len(head[0].split(sep)) if head else 0)]
        kinds = [Q.BY_NAME[t] for t in found["types"]] if found["types"] else [Q.STRING] * len(names)
        schema = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)])
    # Read as text, then cast: so NULL, empty text and a second header line are told apart, and a bad value raises.
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    reader = spark.read.option("sep", sep).option("quote", "").option("mode", "FAILFAST").option("header", has_header)
    raw = reader.option("nullValue", "\x00").schema(text).csv(paths)
    if found["types"] and has_header:
        marker = F.lit(True)
        for f, kind in zip(schema.fields, found["types"]):
            marker &= F.col(f"`{f.name}`").eqNullSafe(kind)
        raw = raw.filter(~marker)
    return raw.select(*[_value(f, escaped).alias(f.name) for f in schema.fields])


#: What unquoted text can't hold, and how escaped text says it; ``%`` first.
ESCAPES = (("%", "%25"), (";", "%3B"), ("\n", "%0A"), ("\r", "%0D"), ("\x00", "%00"))


def _escape(c: Column) -> Column:
    for raw, said in ESCAPES:
        c = F.replace(c, F.lit(raw), F.lit(said))
    return F.when(c == "NULL", F.lit("%4EULL")).otherwise(c)


def _unescape(c: Column) -> Column:
    for raw, said in (("N", "%4E"), *reversed(ESCAPES)):
        c = F.replace(c, F.lit(said), F.lit(raw))
    return c


def _value(f: T.StructField, escaped: bool = False) -> Column:
    c = F.col(f"`{f.name}`")
    if isinstance(f.dataType, T.StringType):
        return F.when(c.isNull(), F.lit("")).when(c != "NULL", _unescape(c) if escaped else c)
    return F.when(c != "NULL", c).cast(f.dataType)


def import_(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str] | None = None, fmt: str | None = None, expected: T.StructType | None = None, **options: str) -> DataFrame:
    """Scan one or many objects of one schema, pruned to ``columns``; the scan reads only these."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    fmt = fmt or format_of(paths[0])
    if fmt == "csv":
        df = read_csv(spark, paths, schema=expected, **options)
    else:
        df = spark.read.options(**options).format(fmt).load(paths)
        if expected is not None:
            Q.check_schema(df, expected)
    return df.select(*columns) if columns else df


def _refuse(c: Column) -> Column:
    """Text that unquoted CSV can hold; anything else raises."""
    return F.when(c.rlike("[;\\n\\r\\x00]") | (c == "NULL"), F.raise_error(F.lit("CSV can't hold this text: use escaped=True"))).otherwise(c)


def export(df: DataFrame, path: str, fmt: str | None = None, single: bool = False, split_rows: int | None = None, mode: str = "overwrite", escaped: bool = False) -> dict[str, int]:
    """Write csv (``;``, header, NULL for nulls), orc or parquet (zstd).  ``single`` writes one object; ``split_rows`` caps rows per object.

    CSV is unquoted: text that holds ``;`` or a line end, or is ``NULL``, raises unless ``escaped`` writes these as percent signs and hex digits.
    Gives the number of objects below the path and their bytes.
    """
    fmt = fmt or format_of(path)
    if fmt == "csv":
        say = _escape if escaped else _refuse
        df = df.select(*[say(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in df.schema.fields])
    w = (df.coalesce(1) if single else df).write.mode(mode)
    if split_rows:
        w = w.option("maxRecordsPerFile", split_rows)
    if fmt == "csv":
        w = w.option("sep", ";").option("header", True).option("nullValue", "NULL").option("emptyValue", "").option("quote", "")
        w.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    else:
        w.option("compression", "zstd").format(fmt).save(path)
    written = storage.ls(df.sparkSession, path)
    return {"objects": len(written), "bytes": sum(x.size for x in written)}


#: Options of ``import_`` by format.
OPTIONS = {"csv": {"sep": str, "header": bool, "escaped": bool}, "parquet": {"mergeSchema": bool}, "orc": {"mergeSchema": bool}}


def options_to_json(fmt: str, **options: str | bool) -> str:
    """Import options as text; unknown ones, and values of another type, raise."""
    for k, v in options.items():
        if k not in OPTIONS[fmt] or not isinstance(v, OPTIONS[fmt][k]):
            raise ValueError(f"no option of {fmt}: {k}={v!r}")
    return json.dumps({"format": fmt, "options": options}, sort_keys=True)


def options_from_json(text: str) -> dict:
    """Keywords of ``import_`` from such a text."""
    said = json.loads(text)
    options_to_json(said["format"], **said["options"])
    return {"fmt": said["format"], **said["options"]}


def read_row_groups(spark: SparkSession, path: str, ids: Sequence[int], columns: Sequence[str] | None = None) -> DataFrame:
    """Chosen row groups of one Parquet object, a task for each.  The object must lie where all executors read it as a file; an id it hasn't got raises."""
    kept = spark.read.parquet(path).select(*(columns or ["*"]))
    schema, names = kept.schema, kept.columns
    plain = path.removeprefix("file://")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in b.column(0).to_pylist():
                yield from pq.ParquetFile(plain).read_row_group(i, columns=names).select(names).to_batches()

    wanted = spark.createDataFrame([(int(i),) for i in ids], "id int")
    return wanted.repartition(max(len(ids), 1), "id").mapInArrow(read, schema)
