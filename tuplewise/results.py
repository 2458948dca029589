"""What results turn into: JSON, JSON:API documents, typed values, sorted collections, appended tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tuplewise.catalog import DATETIME, INT, STRING, Entity
from tuplewise.errors import QueryError, semantic
from tuplewise.functions import dates
from tuplewise.sources import files


def to_json(df: DataFrame, groups: dict[str, set[str]] | None = None, only: set[str] | None = None) -> DataFrame:
    """One JSON object for each row; with ``only`` the columns of these serialisation groups (columns without groups always)."""
    groups = groups or {}
    columns = [c for c in df.columns if only is None or not groups.get(c) or groups[c] & only]
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), {"ignoreNullFields": "false"}).alias("json"))


def to_json_api(df: DataFrame, kind: str, key: str, base_url: str = "", relationships: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """One JSON:API resource for each row. ``relationships``: name: (type, column that holds the other's id)."""
    relationships = relationships or {}
    owned = {key, *(c for _, c in relationships.values())}
    ident = F.col(f"`{key}`").cast("string")
    parts = [F.lit(kind).alias("type"), ident.alias("id"), F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in owned]).alias("attributes")]
    if relationships:
        made = []
        for name, (other, column) in relationships.items():
            there = F.col(f"`{column}`").cast("string")
            made.append(F.struct(F.when(there.isNotNull(), F.struct(F.lit(other).alias("type"), there.alias("id"))).alias("data")).alias(name))
        parts.append(F.struct(*made).alias("relationships"))
    parts.append(F.struct(F.concat(F.lit(f"{base_url}/{kind}/"), ident).alias("self")).alias("links"))
    return df.select(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}).alias("json"))


#: Conversions of stored values by name.
NORMALISE = {
    "date": lambda c: c.try_cast("date"),
    "datetime": lambda c: c.try_cast("timestamp_ntz"),
    "decimal": lambda c: c.try_cast("decimal(38,10)"),
    "interval": lambda c: dates.interval_text(c.try_cast("bigint")),
    "json": lambda c: F.try_parse_json(c),
}


def normalise(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Columns converted as named; ``enum:a|b`` keeps listed values and makes others null."""
    for name, kind in kinds.items():
        c = F.col(f"`{name}`")
        new = F.when(c.isin(kind[5:].split("|")), c) if kind.startswith("enum:") else NORMALISE[kind](c)
        df = df.withColumn(name, new)
    return df


def sort_collection(items: Column, order: str, kinds: dict[str, str]) -> Column:
    """An array of structs by "prop desc, prop2": texts without regard to case, nulls last when ascending."""
    keys = [(p.split()[0], p.split()[1:] == ["desc"]) for p in order.lower().split(",") for p in [p.strip()] if p]
    names = {n.lower(): n for n in kinds}

    def compare(a: Column, b: Column) -> Column:
        out = F.lit(0)
        for name, down in reversed(keys):
            prop = names[name]
            x, y = a[prop], b[prop]
            if kinds[prop] == STRING:
                x, y = F.lower(x), F.lower(y)
            way = F.when(x.isNull() & y.isNull(), 0).when(x.isNull(), 1).when(y.isNull(), -1).when(x < y, -1).when(x > y, 1).otherwise(0)
            way = -way if down else way
            out = F.when(way != 0, way).otherwise(out)
        return out

    return F.array_sort(items, compare)


def insert(rows: DataFrame, entity: Entity, path: str, keys: str = "identity", version: str | None = None) -> None:
    """Append ``rows`` (columns by property) to the entity's Parquet folder.

    ``keys``: identity and sequence count on from the largest key there; uuid makes
    text keys. The version column starts at 1, or now. To be counted, rows are first
    written to the shared folder with their partition and place in it, so that the
    numbers don't depend on how they are computed again; each partition then gets a
    block of the numbers, nothing meets in one task.
    """
    if entity.immutable:
        raise semantic(f"{entity.name} is immutable")
    staged = None
    if entity.key and entity.key not in rows.columns:
        if keys == "uuid":
            rows = rows.withColumn(entity.key, F.expr("uuid()"))
        else:
            rows, staged = _numbered(rows, entity, path)
    if version and version not in rows.columns:
        kind = entity.columns[version].kind
        first = {INT: F.lit(1), DATETIME: F.current_timestamp().cast("timestamp_ntz")}.get(kind, F.expr("uuid()"))
        rows = rows.withColumn(version, first)
    rows.select(*[F.col(p).alias(entity.columns[p].physical) for p in rows.columns if p in entity.columns]).write.mode("append").parquet(path)
    if staged:
        files.remove(rows.sparkSession, staged)


def _numbered(rows: DataFrame, entity: Entity, path: str) -> tuple[DataFrame, str]:
    """``rows`` with keys that count on from those at ``path``, and the folder where they are staged."""
    spark = rows.sparkSession
    try:
        last = spark.read.parquet(path).agg(F.max(entity.columns[entity.key].physical)).first()[0] or 0
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        last = 0
    staged = files.scratch(spark)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows.withColumn("__p", F.spark_partition_id()).withColumn("__i", place).write.parquet(staged)
    numbered = spark.read.parquet(staged)
    before, offsets = 0, []
    for r in sorted(numbered.groupBy("__p").agg(F.count("*").alias("n")).collect()):
        offsets.append((r["__p"], before))
        before += r["n"]
    if not offsets:
        return numbered.withColumn(entity.key, F.lit(None).cast("long")).drop("__p", "__i"), staged
    blocks = F.broadcast(spark.createDataFrame(offsets, "__p int, __o long"))
    made = numbered.join(blocks, "__p").withColumn(entity.key, F.col("__i") + F.col("__o") + last + 1)
    return made.drop("__p", "__i", "__o"), staged


def conflicts(table: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """The changes whose row is gone or has another version by now, with the version there is (``found``)."""
    now = table.select(F.col(key).alias("__key"), F.col(version).alias("found"))
    joined = changes.join(now, F.col(key) == F.col("__key"), "left").drop("__key")
    return joined.where(~F.coalesce(F.col("found") == F.col(version), F.lit(False)))


def updated(table: DataFrame, changes: DataFrame, key: str, version: str | None = None, strict: bool = False) -> DataFrame:
    """``table`` with the changed columns of ``changes`` (by key); with a version only where it still is what ``changes`` has.

    A key that ``changes`` repeats is refused, and, if ``strict``, so are changes that conflicts() finds; without it
    such changes are left out.
    """
    if changes.groupBy(key).count().where("count > 1").limit(1).count():
        raise QueryError("conflict_error", f"changes repeat a value of {key}")
    if strict and version and conflicts(table, changes, key, version).limit(1).count():
        raise QueryError("conflict_error", f"a row was changed since its {version} was read")
    set_ = [c for c in changes.columns if c not in (key, version)]
    new = changes.select(F.col(key), F.lit(True).alias("__hit"), *[F.col(c).alias(f"__{c}") for c in changes.columns if c != key])
    joined = table.join(new, key, "left")
    hit = F.coalesce(F.col("__hit"), F.lit(False))
    if version:
        hit = hit & (F.col(version) == F.col(f"__{version}"))
    out = []
    for c in table.columns:
        value = F.col(f"__{c}") if c in set_ else F.col(c) + 1 if c == version else None
        out.append(F.when(hit, value).otherwise(F.col(c)).alias(c) if value is not None else F.col(c))
    return joined.select(*out)


def deleted(table: DataFrame, keys: DataFrame, key: str, cascade: dict[str, tuple[DataFrame, str]] | None = None) -> dict[str, DataFrame]:
    """The table without these keys, as "", and each dependent table without the rows that refer to them."""
    gone = keys.select(F.col(key).alias("__gone")).distinct()
    out = {"": table.join(gone, F.col(key) == F.col("__gone"), "left_anti")}
    for name, (other, column) in (cascade or {}).items():
        out[name] = other.join(gone, F.col(column) == F.col("__gone"), "left_anti")
    return out
