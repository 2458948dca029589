"""A bound query to one DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tuplewise.catalog import BOOL, DATETIME, EntityCatalog, kind_of
from tuplewise.errors import semantic
from tuplewise.functions.scalar import Scalar
from tuplewise.language import ast as A
from tuplewise.operators import aggregates, joins
from tuplewise.plans.binder import Bound, BoundRange
from tuplewise.sources import json_file

TEMPORAL = {"datetime", "interval"}


def name_of(r: str, prop: str) -> str:
    return f"{r}__{prop}"


def at(name: str) -> Column:
    return F.col(f"`{name}`")


class Lowering:
    """Lowers one query. Columns of ranges are named ``range__property`` until the final projection."""

    def __init__(self, spark: SparkSession, catalog: EntityCatalog, bound: Bound, params: dict, entities: str = "flat", now: Column | None = None):
        self.spark, self.catalog, self.b, self.params = spark, catalog, bound, params
        self.entities, self.now = entities, now
        self.notes: list[str] = []
        self.frames: dict[str, DataFrame] = {}

    # ranges

    def frame(self, r: BoundRange) -> DataFrame:
        if r.name not in self.frames:
            if r.entity:
                rows = self.catalog.frame(r.entity)
                rows = rows.select(*[at(c.physical).alias(name_of(r.name, p)) for p, c in r.entity.columns.items()])
            elif r.json:
                rows = json_file.read(self.spark, r.json.file, r.json.path)
                rows = rows.select(*[at(c).alias(name_of(r.name, c)) for c in rows.columns])
            else:
                inner = Lowering(self.spark, self.catalog, r.query, self.params, now=self.now)
                rows = inner.run()
                self.notes += [f"SUBQUERY_MATERIALIZED {r.name}", *inner.notes]
                rows = rows.toDF(*[name_of(r.name, x) for x in r.query.exports])
            self.frames[r.name] = rows
        return self.frames[r.name]

    def _raw_kind(self, f: A.Field) -> str | None:
        r = self.b.ranges[f.range]
        if r.entity:
            return r.entity.columns[f.name].kind
        schema = self.frame(r).schema
        return kind_of(schema[name_of(f.range, f.name)].dataType) if name_of(f.range, f.name) in schema.names else None

    def kind(self, f: A.Field) -> str:
        raw = self._raw_kind(f)
        if raw is None:
            return "null"
        if not f.path:
            return raw
        if raw in ("json", "string"):
            return "string"
        t = self.frame(self.b.ranges[f.range]).schema[name_of(f.range, f.name)].dataType
        for p in f.path:
            if not hasattr(t, "names") or p not in t.names:
                return "null"
            t = t[p].dataType
        return kind_of(t)

    def column(self, f: A.Field) -> Column:
        raw = self._raw_kind(f)
        if raw is None:
            return F.lit(None).cast("string")
        c = at(name_of(f.range, f.name))
        if not f.path:
            return c
        if raw in ("json", "string"):
            return F.get_json_object(c, "$" + "".join(f".{p}" for p in f.path))
        if self.kind(f) == "null":
            return F.lit(None).cast("string")
        for p in f.path:
            c = c.getField(p)
        return c

    def searching(self, n: A.Search) -> str:
        r = self.b.ranges[next(iter(A.ranges_in(*n.fields)))]
        if not r.entity:
            return "pooled"
        wanted = {f.name for f in n.fields}
        return "indexed" if any(wanted <= set(index) for index in r.entity.fulltext) else "fields"

    def matched(self, name: str) -> Column:
        return F.coalesce(at(name_of(name, "__here")), F.lit(False))

    def scalar(self, known: dict | None = None) -> Scalar:
        return Scalar(self.column, self.kind, self.params, self.searching, self.matched, known, self.now)

    # checks that need kinds

    def check_temporal(self, nodes) -> None:
        own = self.scalar()
        for top in nodes:
            for n in A.walk(top):
                if isinstance(n, A.Arith) and not any(isinstance(x, (A.Whole, A.Exists)) for x in A.walk(n)):
                    kinds = {own.kind(n.left), own.kind(n.right)}
                    if kinds & TEMPORAL and (n.op in "*/" or kinds - TEMPORAL - {"null"}):
                        raise semantic("a date or interval can't be reckoned with a plain value")

    # the query

    def run(self) -> DataFrame:
        b = self.b
        how = aggregates.strategy(b)
        exprs = [*(i.expr for i in b.items), b.where, *(s.expr for s in b.sort)]
        self.check_temporal(exprs)
        plan = joins.plan_joins(b, how == "one")
        self.notes += plan.notes
        if how == "apart":
            return self._apart(plan)
        rows = self._joined(plan)
        rows, known = self._existence(rows, plan)
        rows = self._filtered(rows, plan.where, plan.kept, known)
        if how == "rows":
            return self._plain(rows, known)
        self.notes.append({"one": "DIRECT", "total": "WINDOW", "groups": "DIRECT"}[how])
        return self._grouped(rows, known, how)

    def _joined(self, plan: joins.JoinPlan) -> DataFrame:
        rows: DataFrame | None = None
        for name in plan.kept:
            r = self.b.ranges[name]
            own, how = self.frame(r), plan.how[name]
            if name in plan.flagged:
                own = own.withColumn(name_of(name, "__here"), F.lit(True))
            if rows is None:
                rows = own
            elif name in plan.on:
                tell = self.scalar()
                rows = rows.join(own, tell.condition(A.both(plan.on[name])), how)
            elif how == "cross":
                rows = rows.crossJoin(own)
            else:
                same = at(name_of(r.link.parent, r.link.there)) == at(name_of(name, r.link.here))
                rows = rows.join(own, same, "left_semi" if how == "semi" else how)
        return self.spark.range(1).select() if rows is None else rows

    def _filtered(self, rows: DataFrame, where: list[A.Node], kept: list[str], known: dict) -> DataFrame:
        tell = self.scalar(known)
        for t in where:
            if joins.is_any(t) or isinstance(t, A.Not) and joins.is_any(t.operand):
                continue
            rows = rows.where(tell.condition(t))
        for name in kept:
            e = self.b.ranges[name].entity
            if e is None or name_of(name, next(iter(e.columns))) not in rows.columns:
                continue
            if e.soft_delete and not self.b.directives.get("ignoreSoftDelete"):
                gone = at(name_of(name, e.soft_delete))
                kind = e.columns[e.soft_delete].kind
                if kind in (BOOL, DATETIME):
                    rows = rows.where(gone == F.lit(False) if kind == BOOL else gone.isNull())
            if e.discriminator:
                rows = rows.where(at(name_of(name, e.discriminator[0])) == F.lit(e.discriminator[1]))
        return rows

    # ANY

    def _existence(self, rows: DataFrame, plan: joins.JoinPlan) -> tuple[DataFrame, dict]:
        """Semi and anti joins for ANY at the top of where; elsewhere a flag from the distinct keys."""
        known: dict = {}
        for t in plan.where:
            inner = t.operand if isinstance(t, A.Not) else t
            if joins.is_any(inner):
                rows = self._any(rows, inner, plan.kept, "left_anti" if isinstance(t, A.Not) else "left_semi", "")
        tops = {id(t) for t in plan.where} | {id(t.operand) for t in plan.where if isinstance(t, A.Not)}
        nodes = [*(i.expr for i in self.b.items), *plan.where, *(s.expr for s in self.b.sort)]
        for node in nodes:
            for n in A.walk(node):
                if joins.is_any(n) and n not in known and id(n) not in tops:
                    flag = f"__any{len(known)}"
                    rows = self._any(rows, n, plan.kept, "left", flag)
                    known[n] = (F.when(at(flag).isNotNull(), 1).otherwise(0), "int")
        return rows, known

    def _any(self, rows: DataFrame, n: A.Aggregate, outer: list[str], how: str, flag: str) -> DataFrame:
        b = self.b
        of_operand = A.ranges_in(n.operand) or A.ranges_in(n.where)
        conditions, pairs = [], []
        live = set(of_operand)
        for t in A.terms(n.where):
            used = A.ranges_in(t)
            if isinstance(t, A.Compare) and t.op == "=" and used & set(outer) - of_operand and used & of_operand:
                a, c = (t.left, t.right) if A.ranges_in(t.left) <= of_operand else (t.right, t.left)
                if A.ranges_in(a) <= of_operand and A.ranges_in(c) <= set(outer):
                    pairs.append((self.scalar().lower(c), self.scalar().lower(a)))
                    continue
            conditions.append(t)
            live |= used
        todo, seen = list(live), set(live)
        links: list[tuple[str, str]] = []
        while todo:
            name = todo.pop()
            link = b.ranges[name].link
            if link is None:
                continue
            there, here = at(name_of(link.parent, link.there)), at(name_of(name, link.here))
            if link.parent in outer and link.parent not in live:
                pairs.append((there, here))
            else:
                links.append((name, link.parent))
                if link.parent not in seen:
                    seen.add(link.parent)
                    todo.append(link.parent)
        inner, joined = None, set()
        for name in b.ranges:
            if name in seen:
                own = self.frame(b.ranges[name])
                own_links = [(c, p) for c, p in links if {c, p} <= joined | {name} and name in (c, p)]
                if inner is None:
                    inner = own
                elif own_links:
                    on = [at(name_of(p, b.ranges[c].link.there)) == at(name_of(c, b.ranges[c].link.here)) for c, p in own_links]
                    inner = inner.join(own, on, "inner")
                else:
                    inner = inner.crossJoin(own)
                joined.add(name)
        if inner is None:
            raise semantic("ANY needs a range")
        inner = self._filtered(inner, conditions, list(joined), {})
        if any(b.ranges[r].json for r in of_operand):
            inner = inner.where(self.scalar().lower(n.operand).isNotNull())
        keys = inner.select(*[c.alias(f"__key{i}") for i, (_, c) in enumerate(pairs)])
        self.notes.append(f"ANY {how}")
        if not pairs:
            one = F.broadcast(keys.limit(1).agg(F.count("*").alias("__n")).where("__n > 0").select(F.lit(True).alias(flag or "__found")))
            return rows.join(one, F.lit(True), how)
        if how == "left":
            keys = keys.distinct().withColumn(flag, F.lit(True))
        on = [c == at(f"__key{i}") for i, (c, _) in enumerate(pairs)]
        out = rows.join(keys, on, how)
        return out.drop(*[f"__key{i}" for i in range(len(pairs))]) if how == "left" else out

    # projection

    def _outputs(self, known: dict) -> list[Column]:
        tell, out = self.scalar(known), []
        for i, item in enumerate(self.b.items):
            if isinstance(item.expr, A.Whole):
                out += self._entity(item)
            else:
                c = tell.lower(item.expr)
                out.append((F.lit(None).cast("string") if tell.kind(item.expr) == "null" else c).alias(self._alias(i, item)))
        return out

    def _alias(self, i: int, item: A.Item) -> str:
        if not self.b.nested:
            return item.alias
        head, dot, rest = item.alias.partition(".")
        return rest if not item.explicit and dot and head in self.b.ranges else item.alias

    def _entity(self, item: A.Item) -> list[Column]:
        name = item.expr.range
        r = self.b.ranges[name]
        parts = {p: at(name_of(name, p)) for p in r.entity.columns}
        files = [x.name for x in self.b.ranges.values() if x.json]
        for p, (source, of) in r.entity.source_fields.items():
            if of or files:
                parts[p] = self.column(A.Field(of or files[0], source))
        if self.entities == "flat":
            return [c.alias(f"{item.alias}.{p}") for p, c in parts.items()]
        none = F.lit(True)
        for p in r.entity.columns:
            none = none & parts[p].isNull()
        return [F.when(~none, F.struct(*[c.alias(p) for p, c in parts.items()])).alias(item.alias)]

    def _order(self, known: dict, named: dict[A.Node, str] | None = None) -> list[Column]:
        """Null integers sort as 0 and texts as empty; other nulls come first, last when descending."""
        tell, out = self.scalar(known), []
        for s in self.b.sort:
            if isinstance(s.expr, A.Whole):
                raise semantic("rows can't be sorted by a whole range")
            c = at(named[s.expr]) if named and s.expr in named else tell.lower(s.expr)
            if isinstance(s.expr, A.Field):
                kind = tell.kind(s.expr)
                c = F.coalesce(c, F.lit(0)) if kind == "int" else F.coalesce(c, F.lit("")) if kind in ("string", "json") else c
            out.append(c.desc_nulls_last() if s.descending else c.asc_nulls_first())
        return out

    def _plain(self, rows: DataFrame, known: dict) -> DataFrame:
        b = self.b
        rows, order, paged = self._paged(rows, known)
        if b.unique:
            out = rows.select(*self._outputs(known)).distinct()
            named = {i.expr: self._alias(n, i) for n, i in enumerate(b.items)}
            for s in b.sort:
                if s.expr not in named and not order:
                    raise semantic("unique rows are sorted by what is retrieved")
            if b.sort and not all(s.expr in named for s in b.sort):
                raise semantic("unique rows are sorted by what is retrieved")
            out = out.orderBy(*self._order(known, named)) if b.sort else out
            return out if paged else self._window(out)
        sort = order or (self._order(known) if b.sort else [])
        if sort:
            rows = rows.orderBy(*sort)
        if not paged:
            rows = self._window(rows)
        return rows.select(*self._outputs(known))

    def _window(self, rows: DataFrame) -> DataFrame:
        if self.b.window is None:
            return rows
        page, size = self.b.window
        return rows.offset(int(page * size)).limit(int(size))

    def _paged(self, rows: DataFrame, known: dict) -> tuple[DataFrame, list[Column], bool]:
        """A page counts rows of the main entity: its keys are sorted and cut, and joined rows follow their key.

        With ``@InValuesAreFinal`` a list of the main key's values is itself what is
        cut, and rows come in its order.
        """
        b = self.b
        main = joins.main_range(b)
        e = b.ranges[main].entity if main else None
        listed = self._listed(main, e) if b.directives.get("InValuesAreFinal") and e and e.key else None
        if listed is not None:
            values = listed.values
            if b.window is not None:
                page, size = b.window
                values = values[int(page * size) : int(page * size) + int(size)]
            key = at(name_of(main, e.key))
            rows = rows.where(key.isin(list(values)))
            return rows, [F.array_position(F.array(*[F.lit(v) for v in listed.values]), key).asc()] if not b.sort else [], True
        if b.window is None or e is None or name_of(main, e.columns and next(iter(e.columns))) not in rows.columns:
            return rows, [], False
        if e.key is None:
            raise semantic(f"{e.name} has no key to page by")
        key, page, size = name_of(main, e.key), *b.window
        tell = self.scalar(known)
        orders = self._order(known)
        marks = []
        for i, s in enumerate(b.sort):
            c = tell.lower(s.expr)
            kind = tell.kind(s.expr)
            if isinstance(s.expr, A.Field):
                c = F.coalesce(c, F.lit(0)) if kind == "int" else F.coalesce(c, F.lit("")) if kind in ("string", "json") else c
            marks.append((F.max(c) if s.descending else F.min(c)).alias(f"__s{i}"))
        keys = rows.groupBy(at(key).alias("__page")).agg(*marks) if marks else rows.select(at(key).alias("__page")).distinct()
        by = [at(f"__s{i}").desc_nulls_last() if s.descending else at(f"__s{i}").asc_nulls_first() for i, s in enumerate(b.sort)]
        keys = keys.orderBy(*by, "__page").offset(int(page * size)).limit(int(size)).select("__page")
        rows = rows.join(keys, at(key) == at("__page"), "left_semi")
        return rows, [*orders, at(key).asc()], True

    def _listed(self, main: str, e) -> A.In | None:
        return next((t for t in A.terms(self.b.where) if isinstance(t, A.In) and not t.negated and t.operand == A.Field(main, e.key)), None)

    # aggregates

    def _grouped(self, rows: DataFrame, known: dict, how: str) -> DataFrame:
        b = self.b
        own = list(dict.fromkeys(a for e in [*(i.expr for i in b.items), *(s.expr for s in b.sort)] for a in aggregates.aggregates(e)))
        tell = self.scalar(known)
        made = [tell.lower(a).alias(f"__agg{i}") for i, a in enumerate(own)]
        after = {a: (at(f"__agg{i}"), tell.kind(a)) for i, a in enumerate(own)}
        if how == "one":
            out = rows.agg(*made)
            return self._finish(out, after)
        if how == "total":
            out = rows.crossJoin(F.broadcast(rows.agg(*made)))
            return self._finish(out, known | after)
        plain = [i.expr for i in b.items if not aggregates.aggregates(i.expr)]
        keys, groups = {}, []
        for e in plain:
            parts = [A.Field(e.range, p) for p in b.ranges[e.range].entity.columns] if isinstance(e, A.Whole) else [e]
            for part in parts:
                if part not in keys:
                    name = name_of(part.range, part.name) if isinstance(part, A.Field) and not part.path else f"__g{len(keys)}"
                    keys[part] = (at(name), tell.kind(part))
                    groups.append(tell.lower(part).alias(name))
        out = rows.groupBy(*groups).agg(*made)
        for e in [*(i.expr for i in b.items), *(s.expr for s in b.sort)]:
            free = A.rewrite(e, lambda n: A.Literal(None) if n in keys or n in after else None)
            if A.ranges_in(free) and not isinstance(e, A.Whole):
                raise semantic("beside aggregates only what rows are grouped by can be used")
        return self._finish(out, keys | after)

    def _finish(self, out: DataFrame, known: dict) -> DataFrame:
        b = self.b
        if b.sort:
            out = out.orderBy(*self._order(known))
        if not b.unique:
            return self._window(out).select(*self._outputs(known))
        named = {i.expr: self._alias(n, i) for n, i in enumerate(b.items)}
        if any(s.expr not in named for s in b.sort):
            raise semantic("unique rows are sorted by what is retrieved")
        out = out.select(*self._outputs(known)).distinct()
        return self._window(out.orderBy(*self._order(known, named)) if b.sort else out)

    def _apart(self, plan: joins.JoinPlan) -> DataFrame:
        """Aggregates over ranges of their own: one row, computed without the outer where, beside every plain row.

        Terms of where over those ranges ask whether such a row exists: if none does, there are no plain rows either.
        """
        b = self.b
        own = list(dict.fromkeys(a for i in b.items for a in aggregates.aggregates(i.expr)))
        names = aggregates.family(b, set().union(*(A.ranges_in(a) for a in own)))
        side, plan_rest = [n for n in plan.kept if n in names], [n for n in plan.kept if n not in names]
        inner = self._joined(joins.JoinPlan(side, {n: plan.how[n] for n in side}))
        inner = self._filtered(inner, [], side, {})
        tell = self.scalar()
        one = inner.agg(*[tell.lower(a).alias(f"__agg{i}") for i, a in enumerate(own)])
        asked = [t for t in plan.where if A.ranges_in(t) & names and not joins.is_any(t.operand if isinstance(t, A.Not) else t)]
        rest = joins.JoinPlan(plan_rest, {n: plan.how[n] for n in plan_rest}, plan.on, [t for t in plan.where if t not in asked], plan.flagged - names)
        rows = self._joined(rest)
        if asked:
            there = self._filtered(self._joined(joins.JoinPlan(side, {n: plan.how[n] for n in side}, flagged=plan.flagged & names)), asked, side, {})
            rows = rows.join(F.broadcast(there.limit(1).select(F.lit(True).alias("__there"))), F.lit(True), "left_semi")
        rows, known = self._existence(rows, rest)
        rows = self._filtered(rows, rest.where, plan_rest, known)
        self.notes.append("SUBQUERY")
        known |= {a: (at(f"__agg{i}"), tell.kind(a)) for i, a in enumerate(own)}
        return self._finish(rows.crossJoin(F.broadcast(one)), known)


