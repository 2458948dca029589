import json

import pytest
from pyspark.sql import functions as F

from tuplewise import results
from tuplewise import validation as V
from tuplewise.catalog import INT, STRING, Column, Entity
from tuplewise.engine import Engine
from tuplewise.errors import QueryError
from tuplewise.sources import json_file, slow_log
from tuplewise.tables import catalog


@pytest.fixture
def engine(spark, sf):
    return Engine(spark, catalog(spark, sf))


def test_sorting_and_paging_keep_their_order(engine):
    rows = engine.query("range of o is Order retrieve (k=o.orderKey, p=o.totalPrice) sort by o.totalPrice desc window 1, 5").collect()
    prices = [r.p for r in engine.query("range of o is Order retrieve (p=o.totalPrice) sort by p desc").collect()]
    assert [r.p for r in rows] == prices[5:10]


def test_in_values_final_keeps_the_order_of_the_list(engine):
    rows = engine.query("@InValuesAreFinal true range of o is Order retrieve (k=o.orderKey) where o.orderKey in (9, 5, 7)").collect()
    assert [r.k for r in rows] == [9, 5, 7]


def test_an_empty_page_has_no_rows(engine):
    assert engine.query("range of o is Order retrieve (o.orderKey) window 9999, 10").count() == 0


def test_plans_push_filters_and_prune_columns(engine):
    plan = engine.explain("range of o is Order range of c is Customer via o.customer retrieve (k=o.orderKey) where o.totalPrice > 1000")
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,1000.0)]" in plan.spark
    assert "o_orderpriority" not in plan.spark


def test_notes_tell_what_was_decided(engine):
    assert "ANNOTATION_INNER r" in engine.explain("range of n is Nation range of r is Region via n.region retrieve (n.name)").notes
    assert "UNUSED_JOIN_REMOVED r" in engine.explain("range of n is Nation range of r is Region retrieve (n.name)").notes


def test_entities_as_structs(spark, sf):
    e = Engine(spark, catalog(spark, sf), entities="struct")
    rows = e.query("range of o is Order range of l is LineItem via o.lines retrieve (o, l) where o.orderKey < 40").collect()
    assert rows[0].o.orderKey < 40 and any(r.l is None for r in rows) == (not all(r.l for r in rows))


def test_find(engine):
    assert engine.find("Customer", 7).name == "Customer#000000007"
    assert engine.find("Customer", -1) is None
    assert engine.find_one_by("Nation", {"regionKey": 1}, "name desc").regionKey == 1
    assert engine.find_by("Customer", {"name": None}).count() == 0
    with pytest.raises(QueryError):
        engine.find_or_fail("Customer", -1)
    with pytest.raises(QueryError):
        engine.find("LineItem", 1)


def test_slow_queries_are_logged(spark, sf, tmp_path):
    log = tmp_path / "slow.log"
    e = Engine(spark, catalog(spark, sf), log=log)
    e.get_all("range of r is Region\nretrieve (r.name)")
    e.get_all("retrieve (1)")
    rows = slow_log.read(spark, str(log)).orderBy("rows_sent").collect()
    assert [r.rows_sent for r in rows] == [1, 5] and rows[1].query == "range of r is Region\nretrieve (r.name)"


@pytest.mark.parametrize("text, path, category", [("{", None, "json_error"), ('{"a": 1}', None, "json_error"), ('{"a": 1}', "$.a", "jsonpath_error"), ("[1, 2]", "$", "jsonpath_error"), ('{"a": []}', "a", "jsonpath_error")])
def test_bad_json(spark, tmp_path, text, path, category):
    file = tmp_path / "x.json"
    file.write_text(text)
    with pytest.raises(QueryError) as e:
        json_file.read(spark, str(file), path).collect()
    assert e.value.category == category


def test_json_paths(spark, tmp_path, sf):
    file = tmp_path / "x.json"
    file.write_text(json.dumps({"a": {"b": [{"id": 1, "n": {"x": 5}}, {"id": 2}]}, "c": []}))
    assert [r.id for r in json_file.read(spark, str(file), "$.a.b").orderBy("id").collect()] == [1, 2]
    assert json_file.read(spark, str(file), "$.no").count() == 0
    assert json_file.read(spark, str(file), "$.c").count() == 0
    rows = Engine(spark, catalog(spark, sf)).query(f"range of j is json_source('{file}', '$..b') retrieve (i=j.id, x=j.n.x, no=j.no)").collect()
    assert sorted(((r.i, r.x, r.no) for r in rows), key=lambda r: r[0]) == [(1, 5, None), (2, None, None)]
    steps = json_file.parse_path("$.a.b[?(@.id > 1)].id")
    assert json_file.follow(json.loads(file.read_text()), steps) == [2]


def test_an_empty_list_gives_no_rows(spark, tmp_path, sf):
    file = tmp_path / "x.json"
    file.write_text("[]")
    e = Engine(spark, catalog(spark, sf))
    assert e.query(f"range of j is json_source('{file}') retrieve (a=j.a)").count() == 0
    assert e.query(f"range of r is Region range of j is json_source('{file}') retrieve (n=r.name, a=j.a) where r.name = j.a").count() == 5


def test_rules(spark):
    df = spark.createDataFrame([("a@b.co", "2024-01-31", "12"), ("nope", "31-31-2024", "x"), ("", None, "")], "mail string, day string, n string")
    out = V.validate(df, {"mail": {"email": V.email(), "blank": V.not_blank()}, "day": {"date": V.date()}, "n": {"int": V.type_is("integer"), "any": V.at_least_one_of(V.type_is("int"), V.value_in(["x"]))}})
    assert [r.violations for r in out.collect()] == [[], ["mail.email", "day.date", "n.int"], ["mail.blank"]]
    assert df.select((~V.type_is("nothing")(F.col("n"))).alias("x")).collect()[0].x


def test_json_output(spark):
    df = spark.createDataFrame([(1, "a", None)], "id int, name string, owner int")
    assert json.loads(results.to_json(df, {"name": {"full"}}, {"brief"}).first().json) == {"id": 1, "owner": None}
    doc = json.loads(results.to_json_api(df, "item", "id", "/api", {"owner": ("user", "owner")}).first().json)
    assert doc == {"type": "item", "id": "1", "attributes": {"name": "a"}, "relationships": {"owner": {"data": None}}, "links": {"self": "/api/item/1"}}


def test_normalised_values(spark):
    df = spark.createDataFrame([("2024-02-30", "b", "93600")], "d string, e string, i string")
    row = results.normalise(df, {"d": "date", "e": "enum:a|c", "i": "interval"}).first()
    assert (row.d, row.e, row.i) == (None, None, "1 day 2 hours")


def test_sorted_collections(spark):
    df = spark.sql("SELECT array(named_struct('n', 'b', 'k', 1), named_struct('n', 'A', 'k', 2), named_struct('n', null, 'k', 3), named_struct('n', 'B', 'k', 4)) AS x")
    row = df.select(results.sort_collection(F.col("x"), "n, k desc", {"n": STRING, "k": INT}).alias("x")).first()
    assert [i.k for i in row.x] == [2, 4, 1, 3]


def test_inserted_updated_and_deleted_rows(spark, tmp_path):
    e = Entity("T", "t", {"id": Column("t_id", INT), "name": Column("t_name", STRING), "version": Column("t_version", INT)}, "id")
    path = str(tmp_path / "t")
    for names in (["a", "b", "c"], ["d"], []):
        results.insert(spark.createDataFrame([(n,) for n in names], "name string"), e, path, version="version")
    t = spark.read.parquet(path)
    assert sorted(r.t_id for r in t.collect()) == [1, 2, 3, 4]
    changes = spark.createDataFrame([(1, "z", 1), (2, "y", 9)], "t_id long, t_name string, t_version int")
    assert sorted((r.t_id, r.t_name, r.t_version) for r in results.updated(t, changes, "t_id", "t_version").collect())[:2] == [(1, "z", 2), (2, next(r.t_name for r in t.collect() if r.t_id == 2), 1)]
    assert results.deleted(t, changes, "t_id")[""].count() == 2
    with pytest.raises(QueryError):
        results.insert(t, Entity("V", "v", {}, immutable=True), path)


def test_changes_that_conflict(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, "b", 3)], "id int, name string, version int")
    twice = spark.createDataFrame([(1, "x", 1), (1, "y", 1)], t.schema)
    stale = spark.createDataFrame([(1, "x", 1), (2, "y", 1), (9, "z", 1)], t.schema)
    with pytest.raises(QueryError) as e:
        results.updated(t, twice, "id", "version")
    assert e.value.category == "conflict_error"
    assert sorted((r.id, r.found) for r in results.conflicts(t, stale, "id", "version").collect()) == [(2, 3), (9, None)]
    with pytest.raises(QueryError):
        results.updated(t, stale, "id", "version", strict=True)
    assert sorted(map(tuple, results.updated(t, stale, "id", "version").collect())) == [(1, "x", 2), (2, "b", 3)]


def test_keys_of_rows_that_come_in_another_order_each_time(spark, tmp_path):
    """Numbers are given to staged rows, so a plan that deals rows out at random makes no key twice."""
    e = Entity("T", "t", {"id": Column("t_id", INT), "name": Column("t_name", STRING)}, "id")
    rows = spark.range(2000).repartition(7).select(F.col("id").cast("string").alias("name")).orderBy(F.rand())
    results.insert(rows, e, str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    assert t.select("t_id").distinct().count() == t.select("t_name").distinct().count() == 2000
    assert t.agg(F.min("t_id"), F.max("t_id")).first()[:] == (1, 2000)


def test_a_cursor_steps_and_seeks(engine):
    from tuplewise.engine import Cursor

    cursor = Cursor(engine.query("range of n is Nation retrieve (k=n.nationKey) sort by n.nationKey"))
    assert [cursor.fetch_row().k for _ in range(3)] == [0, 1, 2]
    cursor.seek(23)
    assert [cursor.fetch_row().k, cursor.fetch_row().k, cursor.fetch_row()] == [23, 24, None]


def test_find_sees_only_rows_of_its_kind(engine, spark, sf):
    types = {r.p_partkey: r.p_type for r in spark.read.parquet(f"{sf}/part.parquet").limit(40).collect()}
    other, own = (next(k for k, t in types.items() if (t == "PROMO") == same) for same in (False, True))
    assert engine.find("PromoPart", other) is None and engine.find("PromoPart", own).type == "PROMO"


def test_tables_of_a_database(spark, sf):
    """Over the database that comes with Spark, in memory."""
    from tuplewise.catalog import EntityCatalog
    from tuplewise.sources import tables
    from tuplewise.tables import entities

    url = "jdbc:derby:memory:t;create=true"
    known = [t for t in ("region", "nation") if spark.read.parquet(f"{sf}/{t}.parquet").write.jdbc(url, t, mode="overwrite") is None]
    e = Engine(spark, EntityCatalog(entities(), tables.jdbc(spark, url, split={"nation": ("n_nationkey", 0, 25, 3)})))
    text = "range of n is Nation range of r is Region via n.region retrieve (n=n.name, r=r.name) where n.nationKey > 4"
    want = Engine(spark, catalog(spark, sf)).query(text)
    assert len(known) == 2 and sorted(map(tuple, e.query(text).collect())) == sorted(map(tuple, want.collect()))
    assert "PushedFilters" in e.explain(text).spark


def test_paths_are_followed_where_files_are_read(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.json").write_text(json.dumps({"a": [{"id": i, "t": "x" * 100}]} if i else {"b": 1}))
    rows = json_file.read(spark, f"{tmp_path}/*.json", "$..a").collect()
    assert sorted(r.id for r in rows) == [1, 2]
    (tmp_path / "3.json").write_text('{"a": 5}')
    with pytest.raises(QueryError):
        json_file.read(spark, f"{tmp_path}/*.json", "$..a").collect()


def test_a_list_after_any_number_of_blanks(spark, tmp_path):
    file = tmp_path / "x.json"
    file.write_bytes(b"\xef\xbb\xbf" + b" \n" * 100_000 + b'[{"id": 1}]')
    assert [r.id for r in json_file.read(spark, str(file)).collect()] == [1]
    assert json_file.read(spark, str(file), schema="id long, more string").first()[:] == (1, None)


@pytest.mark.parametrize("text, fits", [("2024-02-29", True), ("2023-02-29", False), ("31.12.2024", True), ("12/31/2024", True), ("2024-01-31T10:20:30Z", True), ("2024-01-31 10:20", True), ("23:59:59.123", True), ("24:00", False), ("on 2024-01-31", False), ("2024", False)])
def test_dates(spark, text, fits):
    df = spark.createDataFrame([(text,)], "x string")
    assert df.select(V.date()(F.col("x")).alias("y")).first().y == fits


def test_eager_relations_come_along(spark, sf):
    from tuplewise.catalog import EntityCatalog, Relation
    from tuplewise.sources import tables
    from tuplewise.tables import entities

    own = entities()
    nation = next(e for e in own if e.name == "Nation")
    nation.relations["region"] = Relation("Region", "regionKey", required=True, eager=True)
    rows = Engine(spark, EntityCatalog(own, tables.parquet(spark, sf))).find_by("Nation", {"regionKey": [1, 2]}, "name").collect()
    assert len(rows) == 10 and all(r.region.regionKey == r.regionKey and r.region.name for r in rows)
