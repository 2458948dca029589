"""Entities: what names the query language knows, and where their rows are."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tuplewise.errors import semantic

#: Column kinds that the language tells apart.
INT, FLOAT, STRING, BOOL, DATETIME, DATE, JSON, OTHER = "int", "float", "string", "bool", "datetime", "date", "json", "other"


def kind_of(spark_type: T.DataType) -> str:
    if isinstance(spark_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return INT
    if isinstance(spark_type, (T.FloatType, T.DoubleType, T.DecimalType)):
        return FLOAT
    for t, kind in ((T.StringType, STRING), (T.BooleanType, BOOL), (T.TimestampType, DATETIME), (T.TimestampNTZType, DATETIME), (T.DateType, DATE)):
        if isinstance(spark_type, t):
            return kind
    return OTHER


@dataclass(frozen=True)
class Column:
    """A property: its physical column, its kind, and whether it may be null."""

    physical: str
    kind: str
    nullable: bool = True


@dataclass(frozen=True)
class Relation:
    """A reference to one ``target``: local property = referenced property (its key by default).

    ``required`` makes joins over it inner ones; with ``eager`` find_by() brings what it leads to along.
    """

    target: str
    local: str | None = None
    referenced: str | None = None
    required: bool = False
    eager: bool = False


@dataclass(frozen=True)
class Inverse:
    """The many side of another entity's relation."""

    target: str
    relation: str


@dataclass
class Entity:
    """``key`` is the property that identifies rows; None refuses paging and find."""

    name: str
    table: str
    columns: dict[str, Column]
    key: str | None = None
    relations: dict[str, Relation] = field(default_factory=dict)
    inverses: dict[str, Inverse] = field(default_factory=dict)
    soft_delete: str | None = None
    discriminator: tuple[str, object] | None = None
    fulltext: tuple[tuple[str, ...], ...] = ()
    source_fields: dict[str, tuple[str, str | None]] = field(default_factory=dict)
    immutable: bool = False

    def join_of(self, name: str, catalog: "EntityCatalog") -> tuple[str, str, str, bool] | None:
        """For a relation or inverse: target entity, property here, property there, required."""
        if r := self.relations.get(name):
            there = r.referenced or catalog.entity(r.target).key
            return r.target, r.local or f"{name}Id", there, r.required
        if i := self.inverses.get(name):
            back = catalog.entity(i.target).relations[i.relation]
            return i.target, back.referenced or self.key, back.local or f"{i.relation}Id", False
        return None


class EntityCatalog:
    """Entities by name; ``reader`` gives a table's rows by its name."""

    def __init__(self, entities: list[Entity], reader: Callable[[str], DataFrame], namespace: str = ""):
        self.entities = {e.name: e for e in entities}
        self.reader, self.namespace = reader, namespace

    def find(self, name: str) -> Entity | None:
        """By full name, within the default namespace, or by its last part if that is unique."""
        for full in (name, f"{self.namespace}\\{name}"):
            if full in self.entities:
                return self.entities[full]
        last = [e for e in self.entities.values() if e.name.rpartition("\\")[2] == name.rpartition("\\")[2]]
        return last[0] if len(last) == 1 and ("\\" not in name or "\\" not in last[0].name) else None

    def entity(self, name: str) -> Entity:
        found = self.find(name)
        if found is None:
            raise semantic(f"there is no entity {name}")
        return found

    def frame(self, entity: Entity) -> DataFrame:
        return self.reader(entity.table)


def columns_of(schema: T.StructType, names: dict[str, str], json: tuple[str, ...] = (), not_null: tuple[str, ...] = ()) -> dict[str, Column]:
    """Properties from a schema: ``names`` maps property to physical column; kinds come from the types."""
    by = {f.name: f.dataType for f in schema.fields}
    return {p: Column(c, JSON if p in json else kind_of(by[c]), p not in not_null) for p, c in names.items()}


def schema_changes(declared: T.StructType, found: T.StructType) -> dict[str, list[str]]:
    """Column names that a table lacks, has in addition, or has with another type."""
    a, b = ({f.name: f.dataType for f in s.fields} for s in (declared, found))
    return {"missing": sorted(set(a) - set(b)), "added": sorted(set(b) - set(a)), "changed": sorted(n for n in set(a) & set(b) if a[n] != b[n])}
