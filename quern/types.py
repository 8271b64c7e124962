"""The five column types, the arithmetic result type and schema checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

INT, LONG, FLOAT, DOUBLE, STRING, NULL = T.IntegerType(), T.LongType(), T.FloatType(), T.DoubleType(), T.StringType(), T.NullType()
SUPPORTED = (T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.StringType)
BY_NAME = {"int": INT, "long": LONG, "float": FLOAT, "double": DOUBLE, "string": STRING}


def is_integral(t: T.DataType) -> bool:
    return isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def is_string(t: T.DataType) -> bool:
    return isinstance(t, T.StringType)


def is_numeric(t: T.DataType) -> bool:
    return is_integral(t) or isinstance(t, (T.FloatType, T.DoubleType))


def common_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """Result type of arithmetic on ``a`` and ``b``.

    NULL adopts the other type; strings combine only with strings; double wins; a long beside a float gives double (a float
    cannot hold it); otherwise float, then long, then int.
    """
    if isinstance(a, T.NullType):
        return b
    if isinstance(b, T.NullType):
        return a
    if is_string(a) or is_string(b):
        if is_string(a) and is_string(b):
            return STRING
        raise TypeError("strings combine only with strings")
    if not (is_numeric(a) and is_numeric(b)):
        raise TypeError(f"no common type of {a.simpleString()} and {b.simpleString()}")
    kinds = {type(a), type(b)}
    if T.DoubleType in kinds or kinds == {T.LongType, T.FloatType}:
        return DOUBLE
    if T.FloatType in kinds:
        return FLOAT
    return LONG if T.LongType in kinds else INT


def validate_types(df: DataFrame) -> DataFrame:
    """Raise if a column is outside the five types; returns ``df``."""
    bad = [f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields if not isinstance(f.dataType, SUPPORTED)]
    if bad:
        raise TypeError("unsupported column types: " + ", ".join(bad))
    return df


def narrow_types(df: DataFrame, dates_as_string: bool = False) -> DataFrame:
    """Bring file types to the five: booleans, bytes and shorts to int, binary to string, dates to days (or text), timestamps to microseconds."""
    from pyspark.sql import functions as F

    cols = []
    for f in df.schema.fields:
        c, t = F.col(f"`{f.name}`"), f.dataType
        if isinstance(t, (T.BooleanType, T.ByteType, T.ShortType)):
            c = c.cast("int")
        elif isinstance(t, T.BinaryType):
            c = c.cast("string")
        elif isinstance(t, T.DateType):
            c = c.cast("string") if dates_as_string else F.unix_date(c).cast("long")
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            c = F.unix_micros(c.cast("timestamp"))
        cols.append(c.alias(f.name))
    return df.select(*cols)


def check_schema(df: DataFrame, expected: T.StructType) -> DataFrame:
    """Names and types must equal ``expected`` (nullability is not compared)."""
    got = [(f.name, f.dataType) for f in df.schema.fields]
    if got != [(f.name, f.dataType) for f in expected.fields]:
        raise ValueError(f"unexpected schema: {df.schema.simpleString()}, expected {expected.simpleString()}")
    return df
