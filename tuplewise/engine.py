"""The engine: queries, lookups by entity, explanations and the slow-query log."""

from __future__ import annotations

import time
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tuplewise.catalog import EntityCatalog
from tuplewise.errors import QueryError
from tuplewise.language.parser import parse
from tuplewise.plans.binder import bind
from tuplewise.plans.lowering import Lowering
from tuplewise.sources import slow_log


@dataclass(frozen=True)
class QueryPlan:
    """What the front end decided and what Spark will run."""

    notes: tuple[str, ...]
    spark: str


class Engine:
    """Runs queries over a catalog. ``now`` fixes date("now"); ``entities`` is how whole entities come: flat columns or a struct."""

    def __init__(self, spark: SparkSession, catalog: EntityCatalog, entities: str = "flat", now: Column | None = None, log: str | Path | None = None, threshold: float = 0.0):
        self.spark, self.catalog, self.entities, self.now = spark, catalog, entities, now
        self.log, self.threshold = log, threshold

    def _lower(self, text: str, params: dict | None) -> tuple[DataFrame, Lowering]:
        bound = bind(parse(text), self.catalog)
        lowering = Lowering(self.spark, self.catalog, bound, {str(k): v for k, v in (params or {}).items()}, self.entities, self.now)
        return lowering.run(), lowering

    def query(self, text: str, params: dict | None = None) -> DataFrame:
        """The one DataFrame of a query; nothing runs yet."""
        return self._lower(text, params)[0]

    def explain(self, text: str, params: dict | None = None) -> QueryPlan:
        df, lowering = self._lower(text, params)
        return QueryPlan(tuple(lowering.notes), df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")))

    def get_all(self, text: str, params: dict | None = None) -> list[Row]:
        """All rows, timed: a query at or above the threshold goes to the slow-query log."""
        began = time.time()
        rows = self.query(text, params).collect()
        took = time.time() - began
        if self.log is not None and took >= self.threshold:
            slow_log.write(self.log, text, took, len(rows))
        return rows

    def get_col(self, text: str, params: dict | None = None) -> DataFrame:
        """The different values of the first column."""
        df = self.query(text, params)
        return df.select(F.col(f"`{df.columns[0]}`")).distinct()

    def find(self, entity: str, key: object) -> Row | None:
        """The row with this key, soft-deleted or not; of an entity with a discriminator only a row of its kind."""
        return self.found(entity, key).first()

    def found(self, entity: str, key: object) -> DataFrame:
        """What find() looks at."""
        e = self.catalog.entity(entity)
        if e.key is None:
            raise QueryError("semantic_error", f"{e.name} has no key")
        return self._rows(e, "@ignoreSoftDelete true ", f" where main.{e.key} = :key", {"key": key})

    def find_or_fail(self, entity: str, key: object) -> Row:
        row = self.find(entity, key)
        if row is None:
            raise QueryError("resolution_error", f"no {entity} has the key {key!r}")
        return row

    def find_by(self, entity: str, conditions: dict[str, object], sort: str = "") -> DataFrame:
        """Rows whose properties equal the given values (None: is null; a list: any of them), each entity once: by its
        key, or without one by all its columns. Each eager relation adds a column with what it leads to, as a struct."""
        e = self.catalog.entity(entity)
        parts, params = [], {}
        for i, (prop, value) in enumerate(conditions.items()):
            if prop not in e.columns:
                raise QueryError("semantic_error", f"{e.name} has no property {prop}")
            if value is None:
                parts.append(f"is_null(main.{prop})")
            elif isinstance(value, (list, tuple)):
                parts.append(f"main.{prop} in ({', '.join(repr(v) if not isinstance(v, str) else _quoted(v) for v in value)})")
            else:
                parts.append(f"main.{prop} = :p{i}")
                params[f"p{i}"] = value
        out = self._rows(e, "", f" where {' and '.join(parts)}" if parts else "", params)
        out = out.dropDuplicates([e.key] if e.key else None)
        for name, relation in e.relations.items():
            if relation.eager:
                out = self._attached(out, e, name, name)
        orders = [x.split() for x in sort.split(",") if x.strip()]
        return out.orderBy(*[F.col(p[0]).desc() if p[1:] and p[1].lower() == "desc" else F.col(p[0]).asc() for p in orders]) if orders else out

    def find_one_by(self, entity: str, conditions: dict[str, object], sort: str = "") -> Row | None:
        return self.find_by(entity, conditions, sort).limit(1).first()

    def related(self, entity: str, relation: str, into: str | None = None) -> DataFrame:
        """Rows of an entity with what a relation leads to: a struct, or for an inverse an array of structs.

        The array holds what one row is related to; it is built by a grouped join. On both sides soft-deleted rows
        and rows of other kinds are left out.
        """
        e = self.catalog.entity(entity)
        return self._attached(self._rows(e), e, relation, into or relation)

    def _attached(self, rows: DataFrame, e, relation: str, into: str) -> DataFrame:
        joined = e.join_of(relation, self.catalog)
        if joined is None:
            raise QueryError("semantic_error", f"{e.name} has no relation {relation}")
        target, here, there, required = joined
        other = self._rows(self.catalog.entity(target))
        packed = other.select(F.col(there).alias("__there"), F.struct(*other.columns).alias(into))
        if relation in e.inverses:
            packed = packed.groupBy("__there").agg(F.collect_list(into).alias(into))
        return rows.join(packed, F.col(here) == F.col("__there"), "inner" if required else "left").drop("__there")

    def _rows(self, e, directives: str = "", where: str = "", params: dict | None = None) -> DataFrame:
        """An entity's rows, columns by property, as a query sees them."""
        flat = Engine(self.spark, self.catalog, "flat", self.now)
        out = flat.query(f"{directives}range of main is {e.name} retrieve (main){where}", params)
        return out.toDF(*[c.partition(".")[2] or c for c in out.columns])


class Cursor:
    """Steps through a result row by row, one partition at a time on the driver; seek() starts it over at a row."""

    def __init__(self, df: DataFrame):
        self.df = df
        self.seek(0)

    def seek(self, row: int) -> None:
        self._rows = (self.df.offset(row) if row else self.df).toLocalIterator()

    def fetch_row(self) -> Row | None:
        """The next row, None after the last."""
        return next(self._rows, None)


def _quoted(text: str) -> str:
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"'


def merge(*results: DataFrame) -> DataFrame:
    """Rows of several results one after another, repeats kept, missing columns null."""
    out = results[0]
    for other in results[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out
