"""Plans as JSON: a tree of operators and expressions that is stored, sent, printed and turned into a DataFrame.

Expressions are lists ``[operator, argument, ...]`` or plain values: ``["col", "a"]``, ``["lit", 5]``, ``["+", x, y]``, ``["between", x, lo, hi, mode]``,
``["in", x, [values]]``, ``["case", cond, then, else]``, ``["cast", x, type]``, ``["extract", part, x]``, ``["is null", x]``, ``["and", x, y]``.
Plans are dictionaries with ``op`` and inputs ``left`` and ``right``.  The result is an ordinary logical plan: Catalyst optimizes it.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import exprs as X
from quern.functions.aggs import Agg
from quern.functions.exprs import BETWEEN, FLIPPED, INVERSE, Exprs
from quern.operators import relational as R
from quern.sources import files

ARITHMETIC = {"+": "add", "-": "sub", "*": "mul", "/": "div", "%": "mod"}
BREAKERS = {"aggregate", "join", "sort", "limit", "union", "partition"}


def expression(e: Any, df: DataFrame) -> Column:
    """The column of an expression over a frame."""
    if not isinstance(e, list):
        return X.lit(e) if e is not None else F.lit(None)
    op, *args = e
    x = Exprs(df)
    if op == "col":
        return F.col(f"`{args[0]}`")
    if op == "lit":
        return X.lit(args[0], args[1] if len(args) > 1 else None)
    if op in ("in", "not in"):
        return x.isin(expression(args[0], df), args[1], negated=op == "not in")
    if op == "cast":
        return x.cast(expression(args[0], df), args[1])
    if op == "extract":
        return X.extract(args[0], expression(args[1], df))
    if op in ("like", "not like"):
        return X.like(expression(args[0], df), args[1], op == "not like")
    if op == "between":
        return X.between(*[expression(a, df) for a in args[:3]], *args[3:])
    c = [expression(a, df) for a in args]
    if op in ARITHMETIC:
        return x.neg(c[0]) if op == "-" and len(c) == 1 else getattr(x, ARITHMETIC[op])(*c)
    if op in X.COMPARISONS:
        return x.compare(c[0], op, c[1])
    simple = {"and": lambda: c[0] & c[1], "or": lambda: c[0] | c[1], "not": lambda: ~c[0], "is null": lambda: c[0].isNull(), "is not null": lambda: c[0].isNotNull(), "case": lambda: X.case((c[0], c[1]), otherwise=c[2]), "concat": lambda: X.concat(*c), "substr": lambda: X.substr(*c), "int": lambda: X.as_int(c[0])}
    if op not in simple:
        raise ValueError(f"unknown expression {op}")
    return simple[op]()


def describe(e: Any) -> str:
    """An expression as text, with as few brackets as its operators need."""
    order = {"or": 1, "and": 2, "=": 3, "!=": 3, "<": 3, "<=": 3, ">": 3, ">=": 3, "+": 4, "-": 4, "*": 5, "/": 5, "%": 5}

    def show(e: Any, above: int) -> str:
        if not isinstance(e, list):
            return json.dumps(e)
        op, *a = e
        if op == "col":
            return a[0]
        if op == "lit":
            return json.dumps(a[0])
        if op in order and len(a) == 2:
            s = f"{show(a[0], order[op])} {op.upper()} {show(a[1], order[op] + 1)}"
            return f"({s})" if order[op] < above else s
        return f"{op.upper()}({', '.join(show(x, 0) for x in a)})"

    return show(e, 0)


def _agg(a: dict) -> Agg:
    return Agg(a["function"], a.get("arg"), a.get("alias"), tuple((c, up) for c, up in a.get("order", ())))


def build(plan: dict, spark: SparkSession, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """The DataFrame of a plan; ``tables`` are frames that ``{"op": "table", "name": ...}`` stands for."""
    left = build(plan["left"], spark, tables) if "left" in plan else None
    right = build(plan["right"], spark, tables) if "right" in plan else None
    op = plan["op"]
    if op == "table":
        return (tables or {})[plan["name"]]
    if op == "import":
        return files.import_(spark, plan["paths"], plan.get("columns"), plan.get("format"), **plan.get("options", {}))
    if op == "filter":
        return R.filter_(left, expression(plan["predicate"], left))
    if op == "project":
        return R.project(left, **{n: expression(e, left) for n, e in plan["columns"].items()})
    if op == "alias":
        return R.alias(left, plan["columns"], plan["aliases"])
    if op == "aggregate":
        return R.aggregate(left, plan.get("keys", ()), [_agg(a) for a in plan.get("aggs", ())])
    if op == "join":
        return R.join(left, right, [tuple(p) for p in plan.get("on", ())], plan.get("how", "inner"))
    if op == "sort":
        return R.sort(left, *[tuple(k) for k in plan["keys"]], tie_breakers=plan.get("tie_breakers", ()))
    if op == "limit":
        return R.limit(left, plan["n"], *[tuple(k) for k in plan.get("keys", ())], offset=plan.get("offset", 0))
    if op == "union":
        return R.union(left, right, plan.get("distinct", False))
    if op == "partition":
        return R.partition(left, plan["columns"], plan["n"], plan.get("kind", "hash"))
    if op == "exchange":
        return R.exchange(left, plan.get("to", 1), plan.get("keys", ()))
    raise ValueError(f"unknown operator {op}")


def run(plan: dict, spark: SparkSession, tables: dict[str, DataFrame] | None = None) -> DataFrame | None:
    """Like ``build``; an ``export`` at the root writes its input and returns nothing."""
    if plan["op"] == "export":
        files.export(build(plan["left"], spark, tables), plan["path"], plan.get("format"), plan.get("single", False))
        return None
    return build(plan, spark, tables)


def nodes(plan: dict) -> Iterator[dict]:
    """Depth first, inputs before their operator."""
    for side in ("left", "right"):
        if side in plan:
            yield from nodes(plan[side])
    yield plan


def replace(plan: dict, old: dict, new: dict) -> dict:
    """A copy of the plan with one node, and what is below it, replaced."""
    if plan is old:
        return new
    return {k: replace(v, old, new) if k in ("left", "right") else v for k, v in plan.items()}


def insert_above(plan: dict, below: dict, node: dict, side: str = "left") -> dict:
    """A copy of the plan with ``node`` between ``below`` and what took it as input."""
    return replace(plan, below, {**node, side: below})


def leaves(plan: dict) -> list[dict]:
    """The nodes without input, from left to right."""
    return [n for n in nodes(plan) if "left" not in n and "right" not in n]


def flipped(e: list) -> list:
    """The same comparison with its sides exchanged."""
    return [FLIPPED[e[0]], e[2], e[1]]


def inverse(e: list) -> list:
    """The predicate that is true where this one is false; NULL stays NULL."""
    if e[0] in ("and", "or"):
        return [{"and": "or", "or": "and"}[e[0]], *map(inverse, e[1:])]
    if e[0] == "not":
        return e[1]
    if e[0] == "between":
        return inverse(split_between(e))
    return [INVERSE[e[0]], *e[1:]] if e[0] in INVERSE else ["not", e]


def split_between(e: list) -> list:
    """BETWEEN as two comparisons."""
    low, high = BETWEEN[e[4] if len(e) > 4 else "inclusive"]
    return ["and", [low, e[1], e[2]], [high, e[1], e[3]]]


def merge_between(e: list) -> list:
    """Two comparisons of one value with a lower and an upper bound as BETWEEN; anything else stays."""
    if e[0] == "and" and len(e) == 3 and all(isinstance(x, list) and len(x) == 3 for x in e[1:]):
        for a, b in ((e[1], e[2]), (e[2], e[1])):
            mode = next((m for m, ops in BETWEEN.items() if ops == (a[0], b[0])), None)
            if mode and a[1] == b[1]:
                return ["between", a[1], a[2], b[2], mode]
    return e


def is_breaker(plan: dict) -> bool:
    return plan["op"] in BREAKERS


def dumps(plan: dict) -> str:
    return json.dumps(plan, sort_keys=True)


def loads(text: str) -> dict:
    return json.loads(text)


def fingerprint(plan: dict) -> str:
    """Equal plans, equal text: for caching results by plan."""
    return hashlib.sha256(dumps(plan).encode()).hexdigest()


def tree(plan: dict, depth: int = 0) -> str:
    """The plan as an indented tree."""
    what = {"filter": lambda: " " + describe(plan["predicate"]), "import": lambda: " " + str(plan["paths"]), "table": lambda: " " + plan["name"]}.get(plan["op"], lambda: "")()
    lines = ["  " * depth + plan["op"] + what] + [tree(plan[s], depth + 1) for s in ("left", "right") if s in plan]
    return "\n".join(lines)
