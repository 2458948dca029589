"""Expressions of the language as Spark columns, with their kinds."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tuplewise.errors import QueryError, semantic
from tuplewise.functions import dates, search
from tuplewise.language import ast as A

NUMERIC = r"^-?[0-9]+(\.[0-9]+)?$"
INTEGER = r"^-?[0-9]+$"
REAL = r"^-?[0-9]+\.[0-9]+$"
_CAST = {"int": "bigint", "float": "double", "string": "string", "decimal": "decimal(38,10)", "bool": "boolean", "datetime": "timestamp_ntz"}
_KIND = {"int": "int", "float": "float", "string": "string", "decimal": "float", "bool": "bool", "datetime": "datetime"}


def like_pattern(text: str) -> str | None:
    """A LIKE pattern if ``text`` has wildcards, ``*`` for any run and ``?`` for one character."""
    if not set("*?") & set(text):
        return None
    return "".join({"*": "%", "?": "_", "%": r"\%", "_": r"\_", "\\": "\\\\"}.get(c, c) for c in text)


class Scalar:
    """Lowers bound expressions. ``column`` gives a field's column, ``kind`` its kind.

    ``known`` maps nodes that are computed already (aggregates, group keys, match
    flags) to their column and kind.
    """

    def __init__(self, column: Callable[[A.Field], Column], kind: Callable[[A.Field], str], params: dict, searching: Callable[[A.Search], str], matched: Callable[[str], Column], known: dict | None = None, now: Column | None = None):
        self.column, self.field_kind, self.params = column, kind, params
        self.searching, self.matched, self.known = searching, matched, known or {}
        self.now = now if now is not None else F.current_timestamp().cast("timestamp_ntz")

    def value(self, name: str) -> object:
        if name not in self.params:
            raise QueryError("resolution_error", f"the parameter :{name} is not given")
        return self.params[name]

    # kinds

    def kind(self, n: A.Node) -> str:
        if n in self.known:
            return self.known[n][1]
        if isinstance(n, A.Field):
            return self.field_kind(n)
        if isinstance(n, (A.Literal, A.Param)):
            v = self.value(n.name) if isinstance(n, A.Param) else n.value
            return next((k for t, k in ((bool, "bool"), (int, "int"), (float, "float"), (str, "string")) if isinstance(v, t)), "null" if v is None else "datetime")
        if isinstance(n, A.Unary):
            return self.kind(n.operand)
        if isinstance(n, A.Arith):
            a, b = self.kind(n.left), self.kind(n.right)
            if "datetime" in (a, b) or "interval" in (a, b):
                return dates.ALGEBRA.get((a, n.op, b), "null")
            if "float" in (a, b) or n.op == "/":
                return "float"
            return "int" if a == b == "int" else "float" if "string" in (a, b) else a
        if isinstance(n, A.Cast):
            return _KIND[n.kind]
        if isinstance(n, A.Call):
            return self._call_kind(n)
        if isinstance(n, A.Search):
            return "float" if n.score else "bool"
        if isinstance(n, A.Aggregate):
            return "int" if n.fn in ("count", "countu", "any") else "float" if n.fn in ("avg", "avgu") else self.kind(n.operand)
        return "bool"

    def _call_kind(self, n: A.Call) -> str:
        if n.name == "concat":
            return "string"
        if n.name == "ifnull":
            a = self.kind(n.args[0])
            return self.kind(n.args[1]) if a == "null" else a
        if n.name == "date":
            return "interval" if self.interval(n) is not None else "datetime"
        return "bool"

    def interval(self, n: A.Node) -> int | None:
        """Seconds, if ``n`` is date() of an interval in text."""
        arg = n.args[0] if isinstance(n, A.Call) and n.name == "date" else None
        if isinstance(arg, A.Literal) and isinstance(arg.value, str) and not dates.is_date(arg.value):
            return dates.interval(arg.value)
        return None

    # columns

    def lower(self, n: A.Node) -> Column:
        if n in self.known:
            return self.known[n][0]
        return getattr(self, f"_{type(n).__name__.lower()}")(n)

    def condition(self, n: A.Node) -> Column:
        """As a truth value: numbers are true unless 0, texts unless empty."""
        c, kind = self.lower(n), self.kind(n)
        return c if kind == "bool" else c != 0 if kind in ("int", "float", "interval") else c != "" if kind == "string" else c.cast("boolean")

    def _field(self, n: A.Field) -> Column:
        return self.column(n)

    def _literal(self, n: A.Literal) -> Column:
        return F.lit(n.value)

    def _param(self, n: A.Param) -> Column:
        return F.lit(self.value(n.name))

    def _unary(self, n: A.Unary) -> Column:
        c = self._number(n.operand)
        return -c if n.op == "-" else c

    def _number(self, n: A.Node) -> Column:
        c = self.lower(n)
        return c.try_cast("double") if self.kind(n) in ("string", "json", "other") else c.cast("int") if self.kind(n) == "bool" else c

    def _arith(self, n: A.Arith) -> Column:
        a, b = self.kind(n.left), self.kind(n.right)
        if {"datetime", "interval"} & {a, b}:
            return self._temporal(n, a, b)
        x, y = self._number(n.left), self._number(n.right)
        if n.op == "/":
            return F.try_divide(x, y)
        return x + y if n.op == "+" else x - y if n.op == "-" else x * y

    def _temporal(self, n: A.Arith, a: str, b: str) -> Column:
        kind = dates.ALGEBRA.get((a, n.op, b))
        if kind is None:
            return F.lit(None).cast("bigint")
        x, y = (dates.seconds(self.lower(s)) if k == "datetime" else self.lower(s) for s, k in ((n.left, a), (n.right, b)))
        out = x + y if n.op == "+" else x - y
        return dates.timestamp(out) if kind == "datetime" else out

    def _compare(self, n: A.Compare) -> Column:
        if isinstance(n.right, A.Regex):
            flags = "".join({"i": "i", "m": "m", "n": "s", "u": "u"}.get(f, "") for f in n.right.flags)
            hit = self.lower(n.left).cast("string").rlike(f"(?{flags}){n.right.pattern}" if flags else n.right.pattern)
            return hit if n.op == "=" else ~hit
        if isinstance(n.right, A.Literal) and isinstance(n.right.value, str) and n.op in ("=", "<>"):
            pattern = like_pattern(n.right.value)
            if pattern is not None:
                hit = self.lower(n.left).cast("string").like(pattern)
                return hit if n.op == "=" else ~hit
        x, y = self._comparable(n.left, n.right)
        return {"=": x == y, "<>": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[n.op]

    def _comparable(self, left: A.Node, right: A.Node) -> tuple[Column, Column]:
        a, b = self.kind(left), self.kind(right)
        if "datetime" in (a, b) or "date" in (a, b):
            return self._as_moment(left), self._as_moment(right)
        x, y = self.lower(left), self.lower(right)
        text, number = ("string", "json"), ("int", "float", "interval")
        if a in text and b in number:
            x = x.try_cast("double")
        elif b in text and a in number:
            y = y.try_cast("double")
        elif "bool" in (a, b) and {a, b} & {"int", "float"}:
            x, y = (c.cast("int") if k == "bool" else c for c, k in ((x, a), (y, b)))
        elif "bool" in (a, b) and {a, b} & set(text):
            x, y = x.try_cast("boolean"), y.try_cast("boolean")
        return x, y

    def _as_moment(self, n: A.Node) -> Column:
        if isinstance(n, A.Param) or isinstance(n, A.Literal) and n.value is not None:
            return F.lit(dates.moment(self.value(n.name) if isinstance(n, A.Param) else n.value)).cast("timestamp_ntz")
        kind, c = self.kind(n), self.lower(n)
        return dates.timestamp(c) if kind in ("int", "interval") else c.try_cast("timestamp_ntz") if kind == "string" else c.cast("timestamp_ntz")

    def _logic(self, n: A.Logic) -> Column:
        x, y = self.condition(n.left), self.condition(n.right)
        return x & y if n.op == "and" else x | y

    def _not(self, n: A.Not) -> Column:
        return ~self.condition(n.operand)

    def _in(self, n: A.In) -> Column:
        kind, c = self.kind(n.operand), self.lower(n.operand)
        texts = any(isinstance(v, str) for v in n.values)
        if kind in ("int", "float") and texts:
            c = c.cast("string")
        values = [str(v) for v in n.values] if texts or kind in ("string", "json") else list(n.values)
        hit = c.isin(values)
        return ~hit if n.negated else hit

    def _cast(self, n: A.Cast) -> Column:
        kind, c = self.kind(n.operand), self.lower(n.operand)
        if n.kind == "string" and kind == "datetime":
            return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        if n.kind == "string" and kind == "interval":
            return dates.interval_text(c)
        if n.kind in ("int", "float") and kind == "datetime":
            c = dates.seconds(c)
        if n.kind == "int" and kind in ("string", "json"):
            c = c.try_cast("double")
        if n.kind == "datetime" and kind in ("int", "float", "interval"):
            return dates.timestamp(c)
        return c.try_cast(_CAST[n.kind])

    def _call(self, n: A.Call) -> Column:
        arg = n.args[0]
        c, kind = (None, None) if n.name == "date" else (self.lower(arg), self.kind(arg))
        if n.name == "concat":
            return F.concat(*[self.lower(A.Cast("string", a)) for a in n.args])
        if n.name == "ifnull":
            x, y = self._comparable(*n.args) if self.kind(n.args[1]) != "null" else (c, self.lower(n.args[1]))
            return F.coalesce(x, y) if kind == self.kind(n.args[1]) or kind not in ("string", "json") else F.coalesce(c, self.lower(n.args[1]).cast("string"))
        if n.name == "is_null":
            return c.isNull()
        if n.name == "is_empty":
            if kind in ("int", "float", "interval"):
                return c.isNull() | (c == 0)
            if kind == "bool":
                return c.isNull() | ~c
            return c.isNull() | (c == "") if kind in ("string", "json", "null") else c.isNull()
        if n.name == "date":
            return self._date(n)
        text = c.cast("string")
        if kind in ("int", "float"):
            return F.lit(n.name == "is_numeric" or (n.name == "is_integer") == (kind == "int"))
        return F.coalesce(text.rlike({"is_numeric": NUMERIC, "is_integer": INTEGER, "is_float": REAL}[n.name]), F.lit(False))

    def _date(self, n: A.Call) -> Column:
        secs = self.interval(n)
        if secs is not None:
            return F.lit(secs).cast("bigint")
        arg = n.args[0]
        if isinstance(arg, A.Literal) and isinstance(arg.value, str) and not dates.is_date(arg.value):
            return self.now
        return self._as_moment(arg)

    def _search(self, n: A.Search) -> Column:
        text = self.value(n.text.name) if isinstance(n.text, A.Param) else n.text.value
        if not isinstance(text, str):
            raise QueryError("type_error", "search takes a text")
        terms, fields, how = search.parse(text), [self.lower(f).cast("string") for f in n.fields], self.searching(n)
        if n.score:
            return search.score(fields, terms) if how == "indexed" else F.lit(0.0)
        if not (terms.some or terms.every or terms.none):
            return F.lit(True)
        return {"indexed": search.indexed, "pooled": search.pooled, "fields": search.by_field}[how](fields, terms)

    def _exists(self, n: A.Exists) -> Column:
        return self.matched(n.range)

    def _whole(self, n: A.Whole) -> Column:
        raise semantic(f"the range {n.range} can't be part of an expression")

    def _regex(self, n: A.Regex) -> Column:
        raise semantic("a regular expression can only be compared with")

    def _aggregate(self, n: A.Aggregate) -> Column:
        """As an aggregate function over the current rows; a condition makes its argument null elsewhere."""
        c = self._number(n.operand) if n.fn in ("sum", "sumu", "avg", "avgu") else self.lower(n.operand)
        if n.where is not None:
            c = F.when(self.condition(n.where), c)
        out = {"count": F.count, "countu": F.count_distinct, "sum": F.sum, "sumu": F.sum_distinct, "avg": F.avg, "avgu": lambda x: F.sum_distinct(x) / F.nullif(F.count_distinct(x), F.lit(0)), "min": F.min, "max": F.max}[n.fn](c)
        return F.coalesce(out, F.lit(0)) if n.fn in ("sum", "sumu") else out


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
