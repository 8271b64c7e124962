"""Truth tables of the expression builders on literals and on columns."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern import types as Q
from quern.functions import exprs as X
from quern.functions.exprs import Exprs


@pytest.fixture(scope="module")
def one(spark):
    return spark.createDataFrame([(1,)], "x int")


@pytest.fixture(scope="module")
def wide(spark):
    rows = [(1, 2, 2, "a", "b", "2017-12-06", 20.5, 99.5), (2, 3, 5, "Hello", "World", "2014-08-05", 100.0, 2.2), (3, 4, 6, "what", "up", "2011-09-03", 42.8, 13.8), (4, 5, 7, "Same", "Same", "2010-01-02", -14.0, 15.9)]
    return spark.createDataFrame(rows, "a int, b int, d int, s1 string, s2 string, dates string, e float, f double").coalesce(1)


def value(df, c):
    return df.select(c.alias("v")).first()[0]


def column(df, c):
    return [r[0] for r in df.select(c.alias("v")).collect()]


@pytest.mark.parametrize("a,op,b,want", [(False, "or", None, None), (True, "or", None, 1), (False, "and", None, 0), (True, "and", None, None), (None, "or", None, None), (False, "or", True, 1), (True, "and", True, 1)])
def test_three_valued_logic(one, a, op, b, want):
    x, y = (F.lit(v).cast("boolean") for v in (a, b))
    assert value(one, X.as_int(x | y if op == "or" else x & y)) == want


def test_arithmetic(one, wide):
    e = Exprs(one)
    assert value(one, e.div(10, 0)) is None and value(one, e.div(10.0, 0)) is None and value(one, e.mod(5, 0)) is None
    assert value(one, e.mod(23.25, 3)) == 2.25
    assert [value(one, e.div(a, 2)) for a in (7, -7)] == [3, -3]
    assert value(one, e.mod(-7, 3)) == -1
    assert value(one, e.div(None, 2)) is None
    assert column(wide, Exprs(wide).mod("b", "a")) == [0, 1, 1, 1]
    assert value(one, e.neg(F.lit(5))) == -5


def test_result_types(wide):
    e = Exprs(wide)
    assert wide.select(e.add("a", "e").alias("v")).dtypes == [("v", "float")]
    assert wide.select(e.mul("a", "f").alias("v")).dtypes == [("v", "double")]
    assert wide.select(e.add(F.col("a").cast("long"), "e").alias("v")).dtypes == [("v", "double")]
    assert wide.select(e.div("a", "b").alias("v")).dtypes == [("v", "int")]
    assert Q.common_type(Q.NULL, Q.STRING) == Q.STRING
    with pytest.raises(TypeError):
        Q.common_type(Q.INT, Q.STRING)
    with pytest.raises(TypeError):
        e.neg("s1")


@pytest.mark.parametrize("x,lo,hi,mode,want", [(5.1, None, 5.0, "inclusive", 0), (5.1, 3.1, None, "inclusive", None), (5.0, 3.1, 5.0, "inclusive", 1), (5.0, 3.1, 5.0, "upper_exclusive", 0), (3.1, 3.1, 5.0, "lower_exclusive", 0), (4.0, 3.1, 5.0, "exclusive", 1)])
def test_between(one, x, lo, hi, mode, want):
    c = X.between(F.lit(x), F.lit(lo).cast("double"), F.lit(hi).cast("double"), mode)
    assert value(one, X.as_int(c)) == want


def test_in_list(one):
    e = Exprs(one)
    five = F.lit(5)
    cases = [([None, 6, None], None), ([None, 5, None], 1), ([], 0), (["Hello", 1.0, "You", 3.0], 0), ([5.0], 1), ([5.5], 0), (["5"], 0)]
    for values, want in cases:
        assert value(one, X.as_int(e.isin(five, values))) == want, values
    null = F.lit(None).cast("int")
    assert value(one, X.as_int(e.isin(null, []))) == 0 and value(one, X.as_int(e.isin(null, [], negated=True))) == 1
    assert value(one, X.as_int(e.isin(five, [None, 6], negated=True))) is None
    a = F.lit("a")
    assert value(one, X.as_int(e.isin(a, ["b", None]))) is None and value(one, X.as_int(e.isin(a, ["b", None], strict=True))) == 0
    assert value(one, X.as_int(e.in_expression(five, 5))) == 1


def test_case_and_extract(one, wide):
    assert value(one, X.case((F.lit(None).cast("boolean"), F.lit(42)), otherwise=F.lit(5) + 3)) == 8
    assert value(one, X.extract("month", F.lit("1992-09-30"))) == "09"
    assert column(wide, X.extract("year", F.col("dates"))) == ["2017", "2014", "2011", "2010"]
    assert value(one, X.extract("hour", F.lit("2020-01-01 07:08:09").cast("timestamp"))) == "07"


def test_cast(one):
    e = Exprs(one)
    assert value(one, e.cast(F.lit(5.5), "int")) == 5 and value(one, e.cast(F.lit(-5.9), "int")) == -5
    for text, want in (("Hello", 0), (" 5hallo", 0), (" 5", 0), ("12", 12), ("-3", -3), ("", 0), ("99999999999", 0), (None, None)):
        assert value(one, e.cast(F.lit(text).cast("string"), "int")) == want, text
    assert value(one, e.cast(F.lit("1.5e1"), "double")) == 15.0
    assert value(one, e.cast(F.lit(5.5), "string")) == "5.5"


def test_substr_and_concat(one):
    for start, length, want in ((1, 2, "HE"), (0, 2, "H"), (-2, 2, "LO"), (2, 0, ""), (2, -1, ""), (4, 9, "LO"), (9, 1, ""), (0, 1, "")):
        assert value(one, X.substr(F.lit("HELLO"), start, length)) == want, (start, length)
    assert value(one, X.substr(F.lit(None).cast("string"), 1, 2)) is None
    assert value(one, X.concat(F.lit("a"), F.lit(None).cast("string"))) is None


def test_compare_common_type(one, wide):
    e = Exprs(wide)
    assert column(wide, X.as_int(e.compare("d", "<", "f"))) == [1, 0, 1, 1]
    assert column(wide, X.as_int(e.compare("s1", "=", "s2"))) == [0, 0, 0, 1]
    with pytest.raises(TypeError):
        e.compare("s1", "=", 1)
    assert wide.filter(X.like(F.col("s1"), "%a%")).count() == 3 and wide.filter(X.like(F.col("s1"), "%a%", True)).count() == 1


def test_types(spark):
    df = spark.createDataFrame([(True, b"x")], "p boolean, q binary")
    with pytest.raises(TypeError):
        Q.validate_types(df)
    assert Q.narrow_types(df).dtypes == [("p", "int"), ("q", "string")]
    with pytest.raises(ValueError):
        Q.check_schema(df, T.StructType([T.StructField("p", Q.INT)]))
