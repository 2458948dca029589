"""JSON files: a list of objects, at the top or where a path leads."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tuplewise.errors import QueryError
from tuplewise.sources import files

_STEP = re.compile(r"""\.\.(?P<deep>\w+|\*)|\.(?P<name>\w+|\*)|\[(?P<index>-?\d+|\*)\]|\[(?P<quote>['"])(?P<key>.+?)(?P=quote)\]|\[\?\(\s*@\.(?P<left>[\w.]+)\s*(?:(?P<op>==|!=|<=|>=|<|>)\s*(?P<right>'[^']*'|"[^"]*"|-?\d+(?:\.\d+)?|true|false|null))?\s*\)\]""")


def read(spark: SparkSession, file: str, path: str | None = None, schema: T.StructType | str | None = None) -> DataFrame:
    """The objects of the list in ``file``, or of the first match of ``path``; no match gives no rows.

    A ``schema`` saves the pass that finds one. With a path each file is one row of
    text, so Spark's bound for a text holds; such a path is followed where the file
    is read, and nothing of it reaches the driver.
    """
    try:
        if path is not None:
            return _at(spark, spark.read.option("wholetext", True).text(file), file, path, schema)
        signs = files.first_signs(spark, file)
        if not signs:
            raise QueryError("json_error", f"{file} can't be read")
    except (PySparkException, Py4JJavaError) as e:
        raise QueryError("json_error", f"{file} can't be read") from e
    if any(sign != "[" for sign in signs):
        _broken(spark.read.option("wholetext", True).text(file), file)
        raise QueryError("json_error", f"{file} is not an array of rows")
    try:
        reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
        return (reader.schema(schema) if schema else reader).json(file)
    except PySparkException as e:
        raise QueryError("json_error", f"{file} is not valid JSON") from e


def _broken(whole: DataFrame, file: str) -> None:
    if whole.where(F.expr("try_parse_json(value)").isNull()).limit(1).count():
        raise QueryError("json_error", f"{file} is not valid JSON")


def _at(spark: SparkSession, whole: DataFrame, file: str, path: str, schema: T.StructType | str | None) -> DataFrame:
    steps = parse_path(path)
    _broken(whole, file)
    if all(kind in ("name", "index") and v != "*" for kind, v in steps):
        native = "$" + "".join(f"['{v}']" if kind == "name" else f"[{v}]" for kind, v in steps)
        found = whole.select(F.get_json_object("value", native).alias("v")).where("v is not null")
        lists = found.select(F.when(F.ltrim("v").startswith("["), F.from_json("v", "array<string>")).alias("items"))
    else:
        lists = _followed(spark, whole, steps)
    if lists.where("items is null").limit(1).count():
        raise QueryError("jsonpath_error", f"{path} in {file} leads to no array of rows")
    rows = lists.select(F.explode("items").alias("v"))
    if rows.where(~F.coalesce(F.ltrim("v").startswith("{"), F.lit(False))).limit(1).count():
        raise QueryError("jsonpath_error", f"{path} in {file} leads to no array of rows")
    texts = getattr(rows._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    reader = spark.read.schema(schema) if schema else spark.read
    return DataFrame(reader._jreader.json(texts), spark)


def _followed(spark: SparkSession, whole: DataFrame, steps: list[tuple[str, object]]) -> DataFrame:
    """(items): the first match of a path in each file as an array of JSON texts, null if it is no list."""
    files.in_workers(spark)

    def run(batches):
        for batch in batches:
            found = [m for x in batch.column(0) for m in follow(json.loads(x.as_py()), steps)[:1]]
            items = [[json.dumps(x) for x in m] if isinstance(m, list) else None for m in found]
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.list_(pa.string()))], ["items"])

    return whole.mapInArrow(run, "items array<string>")


def parse_path(path: str) -> list[tuple[str, object]]:
    """Steps of a JSONPath: names, indexes, ``*``, descents and filters on one property."""
    if not path.startswith("$"):
        raise QueryError("jsonpath_error", f"{path} does not begin with $")
    steps, at = [], 1
    while at < len(path):
        m = _STEP.match(path, at)
        if not m:
            raise QueryError("jsonpath_error", f"{path} can't be read from {path[at:]!r} on")
        if m["deep"]:
            steps.append(("deep", m["deep"]))
        elif m["name"] or m["key"]:
            steps.append(("name", m["name"] or m["key"]))
        elif m["index"]:
            steps.append(("index", m["index"] if m["index"] == "*" else int(m["index"])))
        else:
            right = m["right"]
            value = None if right is None else right[1:-1] if right[0] in "'\"" else json.loads(right)
            steps.append(("filter", (m["left"].split("."), m["op"], value)))
        at = m.end()
    return steps


def follow(value: object, steps: list[tuple[str, object]]) -> list[object]:
    """All matches of a path, in document order."""
    found = [value]
    for kind, what in steps:
        found = [m for v in found for m in _step(v, kind, what)]
    return found


def _step(v: object, kind: str, what) -> list[object]:
    inside = list(v.values()) if isinstance(v, dict) else v if isinstance(v, list) else []
    if kind == "deep":
        own = _step(v, "name", what)
        return own + [m for x in inside for m in _step(x, "deep", what)]
    if what == "*":
        return list(inside)
    if kind == "name":
        return [v[what]] if isinstance(v, dict) and what in v else []
    if kind == "index":
        return [v[what]] if isinstance(v, list) and -len(v) <= what < len(v) else []
    return [x for x in inside if _passes(x, *what)]


def _passes(x: object, left: list[str], op: str | None, right: object) -> bool:
    for name in left:
        if not isinstance(x, dict) or name not in x:
            return False
        x = x[name]
    if op is None:
        return x is not None and x is not False
    if op in ("==", "!="):
        return (x == right) == (op == "==")
    if type(x) in (int, float) and type(right) in (int, float) or isinstance(x, str) and isinstance(right, str):
        return {"<": x < right, "<=": x <= right, ">": x > right, ">=": x >= right}[op]
    return False
