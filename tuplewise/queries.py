"""Every operator of the language as a query over the sample tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuplewise import results
from tuplewise import validation as V
from tuplewise.catalog import INT, STRING, Column, Entity
from tuplewise.engine import Engine, merge
from tuplewise.tables import catalog

O, C, L = "range of o is Order ", "range of c is Customer ", "range of l is LineItem "  # noqa: E741
OC = O + "range of c is Customer via o.customer "
CO = C + "range of o is Order via c.orders "
DEC = "CAST(CAST(sum(CAST(CAST({} AS VARCHAR) AS DECIMAL(38,10))) AS VARCHAR) AS DOUBLE)"

#: name: (query, parameters, SQL)
TEXTS: dict[str, tuple[str, dict, str]] = {
    "scan_filter_sort": (O + "retrieve (order_key=o.orderKey, total=o.totalPrice) where o.totalPrice > 400000 and o.status = 'F' sort by o.totalPrice desc", {}, "SELECT o_orderkey AS order_key, o_totalprice AS total FROM orders WHERE o_totalprice > 400000 AND o_orderstatus = 'F'"),
    "via_left_join": (OC + "retrieve (order_key=o.orderKey, customer=c.name, total=o.totalPrice) where o.totalPrice > :min sort by o.totalPrice desc", {"min": 100000}, "SELECT o_orderkey AS order_key, c_name AS customer, o_totalprice AS total FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000"),
    "via_inverse_left_join": (O + "range of l is LineItem via o.lines retrieve (order_key=o.orderKey, line=l.lineNumber)", {}, "SELECT o_orderkey AS order_key, l_linenumber AS line FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey"),
    "via_required_inner_join": ("range of n is Nation range of r is Region via n.region retrieve (nation=n.name, region=r.name)", {}, "SELECT n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "chained_relations": (C + "range of n is Nation via c.nation range of r is Region via n.region retrieve (customer=c.name, region=r.name)", {}, "SELECT c_name AS customer, r_name AS region FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "comma_join": ("range of n is Nation " + C + "retrieve (nation=n.name, customer=c.name) where n.nationKey = c.nationKey and c.balance > 5000", {}, "SELECT n_name AS nation, c_name AS customer FROM nation, customer WHERE n_nationkey = c_nationkey AND c_acctbal > 5000"),
    "theta_join": ("range of a is Region range of n is Nation retrieve (region=a.regionKey, nation=n.nationKey) where a.regionKey < n.regionKey", {}, "SELECT r_regionkey AS region, n_nationkey AS nation FROM region, nation WHERE r_regionkey < n_regionkey"),
    "self_join": ("range of a is Nation range of b is Nation retrieve (one=a.name, two=b.name) where a.regionKey = b.regionKey and a.nationKey < b.nationKey", {}, "SELECT a.n_name AS one, b.n_name AS two FROM nation a, nation b WHERE a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey"),
    "many_to_many_bridge": ("range of p is Part range of l is LineItem via p.lines range of s is Supplier via l.supplier retrieve unique (part=p.name, supplier=s.name) where p.size > 45", {}, "SELECT DISTINCT p_name AS part, s_name AS supplier FROM part LEFT JOIN lineitem ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey WHERE p_size > 45"),
    "exists_range": (O + "range of l is LineItem via o.lines retrieve (order_key=o.orderKey, line=l.lineNumber) where exists(l)", {}, "SELECT o_orderkey AS order_key, l_linenumber AS line FROM orders JOIN lineitem ON l_orderkey = o_orderkey"),
    "exists_under_or": (C + "range of e is Event via c.events retrieve (cust=c.custKey, event=e.eventId) where exists(e) or c.balance > 9000", {}, "SELECT c_custkey AS cust, event_id AS event FROM customer LEFT JOIN events ON user_id = c_custkey WHERE event_id IS NOT NULL OR c_acctbal > 9000"),
    "any_where": (CO + "retrieve (name=c.name) where ANY(o.orderKey where o.totalPrice > 450000)", {}, "SELECT c_name AS name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)"),
    "any_under_or": (CO + "retrieve (name=c.name) where ANY(o.orderKey where o.totalPrice > 480000) or c.balance < 0", {}, "SELECT c_name AS name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 480000) OR c_acctbal < 0"),
    "any_projection": (CO + "retrieve (name=c.name, has=ANY(o.orderKey where o.status = 'P'))", {}, "SELECT c_name AS name, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') THEN 1 ELSE 0 END AS has FROM customer"),
    "not_any": (C + "range of e is Event via c.events retrieve (cust=c.custKey) where not ANY(e.eventId)", {}, "SELECT c_custkey AS cust FROM customer WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey)"),
    "any_through_bridge": (CO + "range of l is LineItem via o.lines retrieve (cust=c.custKey) where ANY(l.quantity where l.quantity > 49)", {}, "SELECT c_custkey AS cust FROM customer WHERE EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey AND l_quantity > 49)"),
    "wildcard_like": ("range of p is Part retrieve (name=p.name, brand=p.brand) where p.name = 'small*' and p.brand = 'Brand#?' or p.name <> '*ring*' and p.size = 7", {}, "SELECT p_name AS name, p_brand AS brand FROM part WHERE p_name LIKE 'small%' AND p_brand LIKE 'Brand#_' OR p_name NOT LIKE '%ring%' AND p_size = 7"),
    "regex_flags": ("range of p is Part retrieve (name=p.name, type=p.type) where p.name = /^SMALL r/i and p.type <> /O$/", {}, "SELECT p_name AS name, p_type AS type FROM part WHERE regexp_matches(p_name, '^SMALL r', 'i') AND NOT regexp_matches(p_type, 'O$')"),
    "in_list": (C + "retrieve (name=c.name) where c.segment in ('BUILDING', 'MACHINERY') and c.nationKey in (1, 2, 3)", {}, "SELECT c_name AS name FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey IN (1, 2, 3)"),
    "not_in_list": (C + "retrieve (name=c.name) where c.nationKey not in (1, 2, 3)", {}, "SELECT c_name AS name FROM customer WHERE c_nationkey NOT IN (1, 2, 3)"),
    "is_null": ("range of d is Document range of l is Label via d.label retrieve (doc=d.docId) where is_null(l.docId)", {}, "SELECT d.doc_id AS doc FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE l.doc_id IS NULL"),
    "is_not_null": ("range of d is Document range of l is Label via d.label retrieve (doc=d.docId, q=l.quality) where not is_null(l.quality)", {}, "SELECT d.doc_id AS doc, quality AS q FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE quality IS NOT NULL"),
    "is_empty": ("range of d is Document range of l is Label via d.label retrieve (doc=d.docId, e=is_empty(l.toxic), t=is_empty(d.lang))", {}, "SELECT d.doc_id AS doc, toxic IS NULL OR toxic = 0 AS e, lang IS NULL OR lang = '' AS t FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"),
    "is_numeric_integer_float": ("range of e is Event retrieve (id=e.eventId, n=is_numeric(e.props.k), i=is_integer(e.props.k), f=is_float(e.props.k), v=is_float(e.value), k=is_integer(e.userId), t=is_numeric(e.type))", {}, "SELECT event_id AS id, true AS n, true AS i, false AS f, true AS v, true AS k, false AS t FROM events"),
    "ifnull_concat": ("range of d is Document range of l is Label via d.label retrieve (doc=d.docId, tag=concat(d.lang, '-', d.source), q=ifnull(l.quality, -1))", {}, "SELECT d.doc_id AS doc, lang || '-' || source AS tag, coalesce(quality, -1) AS q FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"),
    "casts": (O + "retrieve (k=o.orderKey, i=(int)o.totalPrice, s=(string)o.orderKey, f=(float)o.orderKey, w=(string)o.orderDate, b=(bool)o.custKey)", {}, "SELECT o_orderkey AS k, CAST(trunc(o_totalprice) AS BIGINT) AS i, CAST(o_orderkey AS VARCHAR) AS s, CAST(o_orderkey AS DOUBLE) AS f, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS w, CAST(o_custkey AS BOOLEAN) AS b FROM orders"),
    "arithmetic_precedence": (L + "retrieve (k=l.orderKey, n=l.lineNumber, a=l.quantity + 2 * l.lineNumber - 1, b=(l.quantity + 2) * l.lineNumber, c=-l.quantity / 4, z=l.quantity / (l.lineNumber - l.lineNumber))", {}, "SELECT l_orderkey AS k, l_linenumber AS n, l_quantity + 2 * l_linenumber - 1 AS a, (l_quantity + 2) * l_linenumber AS b, -l_quantity / 4 AS c, CAST(NULL AS DOUBLE) AS z FROM lineitem"),
    "boolean_precedence": (O + "retrieve (k=o.orderKey) where (o.status = 'F' or o.status = 'P') and not (o.totalPrice < 200000 or o.custKey = 7)", {}, "SELECT o_orderkey AS k FROM orders WHERE (o_orderstatus = 'F' OR o_orderstatus = 'P') AND NOT (o_totalprice < 200000 OR o_custkey = 7)"),
    "comparison_operators": ("range of p is Part retrieve (k=p.partKey) where p.size <= 10 and p.size >= 3 and p.size <> 5 and p.size != 6 and p.price < 1500", {}, "SELECT p_partkey AS k FROM part WHERE p_size BETWEEN 3 AND 10 AND p_size NOT IN (5, 6) AND p_retailprice < 1500"),
    "constant_query": ("retrieve (x=1 + 2 * 3, y='a', z=concat('b', \"c\"), t=true, s=date('2 days'))", {}, "SELECT 7 AS x, 'a' AS y, 'bc' AS z, true AS t, CAST(172800 AS BIGINT) AS s"),
    "unique_rows": (C + "retrieve unique (segment=c.segment, nation=c.nationKey)", {}, "SELECT DISTINCT c_mktsegment AS segment, c_nationkey AS nation FROM customer"),
    "macro_alias": (L + "retrieve (k=l.orderKey, net=l.quantity * 2) where net > 90 sort by net desc", {}, "SELECT l_orderkey AS k, l_quantity * 2 AS net FROM lineitem WHERE l_quantity * 2 > 90"),
    "unqualified_property": ("range of p is Part retrieve (k=partKey, n=name) where size = 9", {}, "SELECT p_partkey AS k, p_name AS n FROM part WHERE p_size = 9"),
    "parameters": (O + "retrieve (k=o.orderKey) where o.status = :s and o.totalPrice > :low and o.totalPrice < :high", {"s": "O", "low": 100000.0, "high": 150000}, "SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 100000 AND o_totalprice < 150000"),
    "count_countu": (O + "retrieve (n=count(o.custKey), u=countu(o.custKey))", {}, "SELECT count(o_custkey) AS n, count(DISTINCT o_custkey) AS u FROM orders"),
    "sum_sumu": ("range of p is Part retrieve (s=sum(p.size), u=sumu(p.size), none=sum(p.size where p.size > 1000))", {}, "SELECT CAST(sum(p_size) AS BIGINT) AS s, CAST(sum(DISTINCT p_size) AS BIGINT) AS u, CAST(0 AS BIGINT) AS none FROM part"),
    "avg_avgu": ("range of p is Part retrieve (a=avg(p.size), u=avgu(p.size), none=avg(p.size where p.size > 1000))", {}, "SELECT avg(p_size) AS a, avg(DISTINCT p_size) AS u, CAST(NULL AS DOUBLE) AS none FROM part"),
    "min_max": (O + "retrieve (a=min(o.totalPrice), b=max(o.totalPrice), p=max(o.priority))", {}, "SELECT min(o_totalprice) AS a, max(o_totalprice) AS b, max(o_orderpriority) AS p FROM orders"),
    "filtered_aggregates": (OC + "retrieve (segment=c.segment, f=count(o.orderKey where o.status = 'F'), n=count(o.orderKey), t=(float)sum((decimal)o.totalPrice where o.totalPrice > 400000))", {}, f"SELECT c_mktsegment AS segment, count(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) AS f, count(o_orderkey) AS n, coalesce({DEC.format('CASE WHEN o_totalprice > 400000 THEN o_totalprice END')}, 0) AS t FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1"),
    "aggregate_only": (L + "retrieve (n=count(l.orderKey), q=(float)sum((decimal)l.quantity), m=max(l.price)) where l.returnFlag = 'R'", {}, f"SELECT count(l_orderkey) AS n, {DEC.format('l_quantity')} AS q, max(l_extendedprice) AS m FROM lineitem WHERE l_returnflag = 'R'"),
    "implicit_group_by": (OC + "retrieve (name=c.name, total=(float)sum((decimal)o.totalPrice), n=count(o.orderKey)) sort by total desc", {}, f"SELECT c_name AS name, {DEC.format('o_totalprice')} AS total, count(o_orderkey) AS n FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1"),
    "group_by_distinct_one_range": (L + "retrieve (flag=l.returnFlag, status=l.lineStatus, parts=countu(l.partKey))", {}, "SELECT l_returnflag AS flag, l_linestatus AS status, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1, 2"),
    "window_total": ("range of p is Part retrieve (k=p.partKey, total=sum(p.size), biggest=max(p.size)) where p.size < 20", {}, "SELECT p_partkey AS k, CAST(sum(p_size) OVER () AS BIGINT) AS total, max(p_size) OVER () AS biggest FROM part WHERE p_size < 20"),
    "disjoint_aggregate_filtered": ("range of r is Region range of o is Order retrieve (name=r.name, n=count(o.orderKey)) where o.totalPrice > 300000 and r.regionKey > 0", {}, "SELECT r_name AS name, (SELECT count(o_orderkey) FROM orders) AS n FROM region WHERE r_regionkey > 0 AND EXISTS (SELECT 1 FROM orders WHERE o_totalprice > 300000)"),
    "disjoint_aggregate_none": ("range of r is Region range of o is Order retrieve (name=r.name, n=count(o.orderKey)) where o.totalPrice > 99999999", {}, "SELECT r_name AS name, (SELECT count(o_orderkey) FROM orders) AS n FROM region WHERE EXISTS (SELECT 1 FROM orders WHERE o_totalprice > 99999999)"),
    "disjoint_aggregate": ("range of r is Region range of p is Part retrieve (region=r.name, parts=count(p.partKey), size=sum(p.size)) where r.regionKey > 1", {}, "SELECT r_name AS region, (SELECT count(p_partkey) FROM part) AS parts, (SELECT CAST(sum(p_size) AS BIGINT) FROM part) AS size FROM region WHERE r_regionkey > 1"),
    "aggregate_arithmetic": (OC + "retrieve (segment=c.segment, mean=(float)sum((decimal)o.totalPrice) / count(o.orderKey), twice=count(o.orderKey) * 2 + 1)", {}, f"SELECT c_mktsegment AS segment, {DEC.format('o_totalprice')} / count(o_orderkey) AS mean, count(o_orderkey) * 2 + 1 AS twice FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1"),
    "aggregate_only_semi_join": (O + "range of l is LineItem via o.lines retrieve (n=count(o.orderKey))", {}, "SELECT count(o_orderkey) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)"),
    "subquery_range": ("range of x is (" + O + "retrieve (o.custKey, n=countu(o.orderKey))) " + C + "retrieve (name=c.name, n=x.n) where x.custKey = c.custKey and x.n > 12", {}, "SELECT c_name AS name, n FROM (SELECT o_custkey, count(DISTINCT o_orderkey) AS n FROM orders GROUP BY 1) JOIN customer ON o_custkey = c_custkey WHERE n > 12"),
    "nested_subquery_range": ("range of y is (range of x is (" + O + "retrieve (o.custKey, n=countu(o.orderKey))) retrieve (most=max(x.n))) retrieve (most=y.most)", {}, "SELECT max(n) AS most FROM (SELECT count(DISTINCT o_orderkey) AS n FROM orders GROUP BY o_custkey)"),
    "page_window": (O + "retrieve (k=o.orderKey, p=o.totalPrice) sort by o.totalPrice desc window 2, 25", {}, "SELECT o_orderkey AS k, o_totalprice AS p FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50"),
    "page_using_size": (O + "retrieve (k=o.orderKey) window 3 using window_size 7", {}, "SELECT o_orderkey AS k FROM orders ORDER BY o_orderkey LIMIT 7 OFFSET 21"),
    "page_default_size": (O + "retrieve (k=o.orderKey) sort by o.orderKey desc window 4", {}, "SELECT o_orderkey AS k FROM orders ORDER BY o_orderkey DESC LIMIT 1 OFFSET 4"),
    "page_joined_entities": (CO + "retrieve (cust=c.custKey, order_key=o.orderKey) where c.balance > 0 sort by c.name window 1, 10", {}, "WITH k AS (SELECT c_custkey FROM customer WHERE c_acctbal > 0 ORDER BY c_name, c_custkey LIMIT 10 OFFSET 10) SELECT c.c_custkey AS cust, o_orderkey AS order_key FROM customer c JOIN k USING (c_custkey) LEFT JOIN orders ON o_custkey = c.c_custkey"),
    "in_values_final": ("@InValuesAreFinal true " + O + "retrieve (k=o.orderKey) where o.orderKey in (90, 5, 70, 33, 12) window 0, 3", {}, "SELECT o_orderkey AS k FROM orders WHERE o_orderkey IN (90, 5, 70)"),
    "sort_nulls_as_zero": ("range of d is Document range of l is Label via d.label retrieve (doc=d.docId, q=l.quality) sort by l.quality desc, d.docId window 0, 500", {}, "SELECT d.doc_id AS doc, quality AS q FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id ORDER BY coalesce(quality, 0) DESC, d.doc_id LIMIT 500"),
    "date_interval_filter": ("range of e is Event retrieve (id=e.eventId) where e.ts > date('2024-01-10') and e.ts < date('2024-01-10') + date('3 days 12 hours')", {}, "SELECT event_id AS id FROM events WHERE ts > TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-13 12:00:00'"),
    "date_difference": (O + "retrieve (k=o.orderKey, d=date('2002-01-01') - o.orderDate, later=(string)(o.orderDate + date('1 month')))", {}, "SELECT o_orderkey AS k, CAST(epoch(TIMESTAMP '2002-01-01') - epoch(o_orderdate) AS BIGINT) AS d, strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d %H:%M:%S') AS later FROM orders"),
    "interval_text": ("retrieve (a=(string)date('4 years 20 minutes'), b=(string)date('-30 days'), c=(string)date('0 seconds'), d=(string)(date('1 day 2 hours') + date('1 second')))", {}, "SELECT '4 years 20 minutes' AS a, '-1 month' AS b, '0 seconds' AS c, '1 day 2 hours 1 second' AS d"),
    "date_param_coercion": ("range of e is Event retrieve (id=e.eventId) where e.ts >= :a and e.ts < :b", {"a": "2024-01-05", "b": 1705017600}, "SELECT event_id AS id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12'"),
    "date_min_max": ("range of e is Event retrieve (a=(string)min(e.ts), b=(string)max(e.ts))", {}, "SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS a, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS b FROM events"),
    "json_column_path": ("range of e is Event retrieve (id=e.eventId, k=e.props.k, miss=e.props.no.such) where e.props.k = 69", {}, "SELECT event_id AS id, json_extract_string(props, '$.k') AS k, CAST(NULL AS VARCHAR) AS miss FROM events WHERE json_extract_string(props, '$.k') = '69'"),
    "search_like": ("range of p is Page retrieve (id=p.pageId) where search(p.url, p.html, 'casino spam')", {}, "SELECT page_id AS id FROM pages WHERE contains(lower(url), 'casino') OR contains(lower(url), 'spam') OR contains(lower(html), 'casino') OR contains(lower(html), 'spam')"),
    "search_and_not_phrase": ("range of p is Part retrieve (k=p.partKey, n=p.name) where search(p.name, '\"small ring\" bolt +a -old')", {}, "SELECT p_partkey AS k, p_name AS n FROM part WHERE (contains(lower(p_name), 'small ring') OR contains(lower(p_name), 'bolt')) AND contains(lower(p_name), 'a') AND NOT contains(lower(p_name), 'old')"),
    "search_indexed": ("range of d is Document retrieve (doc=d.docId) where search(d.text, :q)", {"q": "+the -und"}, "WITH w AS (SELECT doc_id, '  ' || regexp_replace(lower(text), '[^\\p{L}\\p{N}_]+', '  ', 'g') || '  ' AS t FROM documents) SELECT doc_id AS doc FROM w WHERE contains(t, ' the ') AND NOT contains(t, ' und ')"),
    "search_score": ("range of d is Document retrieve (doc=d.docId, s=search_score(d.text, 'the of')) where search(d.text, 'the of')", {}, "WITH w AS (SELECT doc_id, '  ' || regexp_replace(lower(text), '[^\\p{L}\\p{N}_]+', '  ', 'g') || '  ' AS t FROM documents) SELECT doc_id AS doc, (length(t) - length(replace(t, ' the ', ''))) / 5 + (length(t) - length(replace(t, ' of ', ''))) / 4 AS s FROM w WHERE contains(t, ' the ') OR contains(t, ' of ')"),
    "search_score_unindexed": ("range of p is Part retrieve (k=p.partKey, s=search_score(p.name, 'ring')) where search(p.name, 'ring')", {}, "SELECT p_partkey AS k, CAST(0 AS DOUBLE) AS s FROM part WHERE contains(lower(p_name), 'ring')"),
    "soft_delete": ("range of o is OpenOrder retrieve (k=o.orderKey)", {}, "SELECT o_orderkey AS k FROM orders WHERE o_orderstatus <> 'F'"),
    "soft_delete_ignored": ("@ignoreSoftDelete true range of o is OpenOrder retrieve (k=o.orderKey)", {}, "SELECT o_orderkey AS k FROM orders"),
    "discriminator": ("range of p is PromoPart retrieve (k=p.partKey, n=p.name)", {}, "SELECT p_partkey AS k, p_name AS n FROM part WHERE p_type = 'PROMO'"),
    "entity_projection": ("range of s is Supplier retrieve (s) where s.balance > 9000", {}, "SELECT s_suppkey AS \"s.suppKey\", s_name AS \"s.name\", s_nationkey AS \"s.nationKey\", s_acctbal AS \"s.balance\" FROM supplier WHERE s_acctbal > 9000"),
    "source_text_alias": ("range of s is Supplier retrieve (s.name, s.suppKey + 1)", {}, "SELECT s_name AS \"s.name\", s_suppkey + 1 AS \"s.suppKey + 1\" FROM supplier"),
    "unreferenced_range_dropped": ("range of n is Nation range of r is Region retrieve (name=n.name)", {}, "SELECT n_name AS name FROM nation"),
    "unreferenced_via_kept": ("range of n is Nation range of c is Customer via n.customers retrieve (name=n.name)", {}, "SELECT n_name AS name FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey"),
}


def _text(text: str, params: dict) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: Engine(spark, catalog(spark, sf_dir)).query(text, params)


def _notes(spark: SparkSession, sf_dir: str, nested: bool = False) -> str:
    """A JSON file of notes on parts, in a new folder beside others in the shared one; its rows are those of NOTES."""
    from tuplewise.sources.files import scratch

    rows = spark.range(1, 101).selectExpr("to_json(array_agg(named_struct('id', id * 3, 'note', concat('n', id), 'kind', if(id % 2 = 0, 'gift', 'plain'), 'size', struct(id AS w)))) AS value")
    if nested:
        rows = rows.selectExpr("concat('{\"meta\": {\"n\": 1}, \"rows\": ', value, '}') AS value")
    folder = scratch(spark)
    rows.coalesce(1).write.text(folder)
    return folder


NOTES = "(SELECT range * 3 AS id, 'n' || range AS note, CASE WHEN range % 2 = 0 THEN 'gift' ELSE 'plain' END AS kind, range AS w FROM range(1, 101)) j"


def _json(text: str, path: str = "") -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        file = _notes(spark, sf_dir, bool(path))
        return Engine(spark, catalog(spark, sf_dir)).query(text.replace("FILE", file), {})

    return run


_J = "range of j is json_source('FILE') "
JSON: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "json_source_left": (_json("range of p is Part " + _J + "retrieve (k=p.partKey, note=j.note) where p.partKey = j.id and p.size > 5"), f"SELECT p_partkey AS k, note FROM part LEFT JOIN {NOTES} ON p_partkey = id WHERE p_size > 5"),
    "json_source_inner": (_json("range of p is Part " + _J + "retrieve (k=p.partKey, note=j.note) where p.partKey = j.id and j.kind = 'gift'"), f"SELECT p_partkey AS k, note FROM part JOIN {NOTES} ON p_partkey = id WHERE kind = 'gift'"),
    "json_source_cross": (_json("range of r is Region " + _J + "retrieve (region=r.name, note=j.note)"), f"SELECT r_name AS region, note FROM region, {NOTES}"),
    "json_source_theta": (_json("range of r is Nation " + _J + "retrieve (k=r.nationKey, id=j.id) where r.nationKey > j.id and j.kind = 'plain'"), f"SELECT n_nationkey AS k, id FROM nation, {NOTES} WHERE n_nationkey > id AND kind = 'plain'"),
    "json_source_path": (_json("range of j is json_source(file='FILE', jsonPath='$.rows') retrieve (id=j.id, note=j.note, w=j.size.w, miss=j.nothing) where j.id > 30", "$"), f"SELECT id, note, w, CAST(NULL AS VARCHAR) AS miss FROM {NOTES} WHERE id > 30"),
    "json_source_filter_path": (_json("range of j is json_source('FILE', '$..rows') retrieve (id=j.id) where j.kind = 'gift' sort by j.id window 1, 5", "$"), f"SELECT id FROM {NOTES} WHERE kind = 'gift' ORDER BY id LIMIT 5 OFFSET 5"),
    "json_aggregate": (_json(_J + "retrieve (n=count(j.id), s=sum(j.id where j.kind = 'gift'))"), f"SELECT count(id) AS n, CAST(sum(CASE WHEN kind = 'gift' THEN id END) AS BIGINT) AS s FROM {NOTES}"),
    "json_search_pooled": (_json(_J + "retrieve (id=j.id) where search(j.note, j.kind, '+gift +1')"), f"SELECT id FROM {NOTES} WHERE kind = 'gift' AND contains(note, '1')"),
    "json_subquery_range": (_json("range of x is (" + _J + "retrieve (j.kind, n=countu(j.id))) retrieve (kind=x.kind, n=x.n)"), f"SELECT kind, count(DISTINCT id) AS n FROM {NOTES} GROUP BY 1"),
    "source_field": (_json("range of p is NotedPart " + _J + "retrieve (p) where p.partKey = j.id and j.kind = 'gift'"), f"SELECT p_partkey AS \"p.partKey\", p_name AS \"p.name\", p_brand AS \"p.brand\", note AS \"p.note\" FROM part JOIN {NOTES} ON p_partkey = id WHERE kind = 'gift'"),
}


def _engine(spark: SparkSession, sf_dir: str) -> Engine:
    return Engine(spark, catalog(spark, sf_dir))


def _related(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _engine(spark, sf_dir).related("Customer", "orders")
    return rows.select("custKey", F.coalesce(F.size("orders"), F.lit(0)).alias("n"), F.coalesce(F.array_max("orders.orderKey"), F.lit(-1)).alias("last"))


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _engine(spark, sf_dir)
    rules = {"name": {"blank": V.not_blank(), "length": V.length(1, 9)}, "brand": {"form": V.reg_exp(r"^Brand#\d$")}, "type": {"in": V.value_in(["PROMO", "SMALL"])}}
    return V.violations(e.query("range of p is Part retrieve (name=p.name, brand=p.brand, type=p.type)"), rules)


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _engine(spark, sf_dir)
    return merge(e.query("range of r is Region retrieve (name=r.name)"), e.query("range of n is Nation retrieve (name=n.name, region=n.regionKey)"))


def _sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _engine(spark, sf_dir).related("Customer", "orders").where("orders is not null")
    first = results.sort_collection(F.col("orders"), "priority desc, orderKey", {"priority": STRING, "orderKey": INT})[0]
    return rows.select("custKey", first["orderKey"].alias("first"))


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engine(spark, sf_dir).query("range of n is Nation retrieve (id=n.nationKey, name=n.name, region=n.regionKey)")


def _inserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tuplewise.sources.files import scratch

    entity = Entity("Numbered", "numbered", {"id": Column("n_id", INT), "name": Column("n_name", STRING), "version": Column("n_version", INT)}, "id")
    path = scratch(spark)
    for _ in range(2):
        results.insert(_nations(spark, sf_dir).select("name"), entity, path, version="version")
    rows = spark.read.parquet(path)
    return rows.groupBy(F.col("n_name").alias("name")).agg(F.count("*").alias("n"), F.max("n_version").alias("version")).crossJoin(F.broadcast(rows.agg(F.count_distinct("n_id").alias("ids"), F.max("n_id").alias("last"))))


def _updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _nations(spark, sf_dir).withColumn("version", F.col("region"))
    changes = rows.where("id % 2 = 0").select("id", F.lit("changed").alias("name"), F.lit(1).alias("version"))
    return results.updated(rows, changes, "id", "version")


def _deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _engine(spark, sf_dir)
    customers = e.query("range of c is Customer retrieve (cust=c.custKey, nation=c.nationKey)")
    gone = _nations(spark, sf_dir).where("region = 1")
    return results.deleted(_nations(spark, sf_dir), gone, "id", {"customers": (customers, "nation")})["customers"]


def _normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _engine(spark, sf_dir).query("range of o is Order retrieve (id=o.orderKey, status=o.status, secs=o.custKey * 3600)")
    return results.normalise(rows, {"status": "enum:F|O", "secs": "interval"})


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """find() of parts of a kind by keys of parts of any kind, and of orders that are soft-deleted or not."""
    e = _engine(spark, sf_dir)
    parts = [e.found("PromoPart", k).select(F.col("partKey").alias("k"), F.lit("part").alias("what")) for k in range(1, 25)]
    return merge(*parts, *[e.found("OpenOrder", k).select(F.col("orderKey").alias("k"), F.lit("order").alias("what")) for k in range(1, 9)])


def _related_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _engine(spark, sf_dir).related("Customer", "openOrders")
    return rows.select("custKey", F.coalesce(F.size("openOrders"), F.lit(0)).alias("n"), F.coalesce(F.array_max("openOrders.orderKey"), F.lit(-1)).alias("last"))


def _conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _nations(spark, sf_dir).withColumn("version", F.col("region")).drop("region")
    changes = rows.where("id % 2 = 0").select("id", F.lit("changed").alias("name"), F.lit(1).alias("version"))
    return results.conflicts(rows, changes.unionByName(changes.limit(1).withColumn("id", F.lit(-5))), "id", "version")


def _padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON list that begins after more blanks than any look ahead should be bounded by."""
    from tuplewise.sources.files import scratch

    folder = scratch(spark)
    spark.read.option("wholetext", True).text(_notes(spark, sf_dir)).select(F.concat(F.repeat(F.lit(" \n"), 70_000), "value").alias("value")).coalesce(1).write.text(folder)
    return _engine(spark, sf_dir).query(f"range of j is json_source('{folder}') retrieve (id=j.id, note=j.note)")


def _now(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark, catalog(spark, sf_dir), now=F.lit("2000-01-31 12:00:00").cast("timestamp_ntz"))
    return e.query("range of o is Order retrieve (k=o.orderKey) where o.orderDate > date('now') - date('30 days')")


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _engine(spark, sf_dir).query("range of o is Order retrieve (status=o.status, priority=o.priority, price=(string) o.totalPrice, key=(string) o.orderKey, day=(string) o.orderDate)")
    rules = {"status": {"alpha": V.type_is("alpha"), "email": V.email()}, "priority": {"alnum": V.type_is("alnum"), "date": V.date()}, "price": {"int": V.type_is("int"), "numeric": V.type_is("numeric")}, "key": {"digit": V.type_is("digit")}, "day": {"date": V.date()}}
    return V.violations(rows, rules)


def _converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _engine(spark, sf_dir).query("range of e is Event retrieve (id=e.eventId, props=e.props, value=(string) e.value, day=(string) e.ts, at=(string) e.ts)")
    made = results.normalise(rows, {"props": "json", "value": "decimal", "day": "date", "at": "datetime"})
    return made.select("id", F.try_variant_get("props", "$.k", "long").alias("k"), F.col("value").cast("double").alias("value"), "day", "at")


CALLS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "find_discriminator": (_found, "SELECT p_partkey AS k, 'part' AS what FROM part WHERE p_partkey BETWEEN 1 AND 24 AND p_type = 'PROMO' UNION ALL SELECT o_orderkey, 'order' FROM orders WHERE o_orderkey BETWEEN 1 AND 8"),
    "related_soft_delete": (_related_open, "SELECT c_custkey AS \"custKey\", CAST(count(o_orderkey) AS INT) AS n, coalesce(max(o_orderkey), -1) AS last FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus <> 'F' GROUP BY 1"),
    "update_conflict": (_conflicts, "SELECT n_nationkey AS id, 'changed' AS name, 1 AS version, n_regionkey AS found FROM nation WHERE n_nationkey % 2 = 0 AND n_regionkey <> 1 UNION ALL SELECT -5, 'changed', 1, NULL"),
    "json_source_padded": (_padded, f"SELECT id, note FROM {NOTES}"),
    "date_now": (_now, "SELECT o_orderkey AS k FROM orders WHERE o_orderdate > TIMESTAMP '2000-01-01 12:00:00'"),
    "validation_types": (
        _typed,
        "SELECT unnest(['status.alpha', 'status.email', 'priority.alnum', 'priority.date', 'price.int', 'price.numeric', 'key.digit', 'day.date']) AS rule,"
        " unnest([count(*) FILTER (NOT regexp_full_match(o_orderstatus, '[A-Za-z]+')), count(*), count(*) FILTER (NOT regexp_full_match(o_orderpriority, '[A-Za-z0-9]+')), count(*), count(*), 0, 0, 0]) AS rows FROM orders",
    ),
    "normalised_types": (_converted, "SELECT event_id AS id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, value, CAST(ts AS DATE) AS day, date_trunc('second', ts) AS at FROM events"),
    "find_by": (lambda s, d: _engine(s, d).find_by("Customer", {"segment": "BUILDING", "nationKey": [1, 2, 3]}, "name desc").select("custKey", "name"), "SELECT c_custkey AS \"custKey\", c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey IN (1, 2, 3)"),
    "json_rows": (lambda s, d: results.to_json(_nations(s, d)), "SELECT to_json({'id': n_nationkey, 'name': n_name, 'region': n_regionkey})::VARCHAR AS json FROM nation"),
    "json_api_rows": (lambda s, d: results.to_json_api(_nations(s, d), "nation", "id", "/api", {"region": ("region", "region")}), "SELECT to_json({'type': 'nation', 'id': n_nationkey::VARCHAR, 'attributes': {'name': n_name}, 'relationships': {'region': {'data': {'type': 'region', 'id': n_regionkey::VARCHAR}}}, 'links': {'self': '/api/nation/' || n_nationkey}})::VARCHAR AS json FROM nation"),
    "sorted_collections": (_sorted, "SELECT o_custkey AS \"custKey\", first(o_orderkey ORDER BY lower(o_orderpriority) DESC, o_orderkey) AS first FROM orders GROUP BY 1"),
    "inserted_rows": (_inserted, "SELECT n_name AS name, count(*) * 2 AS n, 1 AS version, CAST((SELECT count(*) * 2 FROM nation) AS BIGINT) AS ids, CAST((SELECT count(*) * 2 FROM nation) AS BIGINT) AS last FROM nation GROUP BY 1"),
    "updated_rows": (_updated, "SELECT n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 AND n_regionkey = 1 THEN 'changed' ELSE n_name END AS name, n_regionkey AS region, CASE WHEN n_nationkey % 2 = 0 AND n_regionkey = 1 THEN 2 ELSE n_regionkey END AS version FROM nation"),
    "deleted_cascade": (_deleted, "SELECT c_custkey AS cust, c_nationkey AS nation FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)"),
    "normalised_values": (_normalised, "WITH t AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderstatus END AS status, o_custkey * 3600 AS s FROM orders), p AS (SELECT id, status, s, [(s // 31536000, 'year'), (s % 31536000 // 2592000, 'month'), (s % 31536000 % 2592000 // 604800, 'week'), (s % 31536000 % 2592000 % 604800 // 86400, 'day'), (s % 31536000 % 2592000 % 604800 % 86400 // 3600, 'hour')] AS u FROM t) SELECT id, status, CASE WHEN s = 0 THEN '0 seconds' ELSE array_to_string(list_transform(list_filter(u, lambda x: x[1] > 0), lambda x: x[1] || ' ' || x[2] || CASE WHEN x[1] = 1 THEN '' ELSE 's' END), ' ') END AS secs FROM p"),
    "get_col": (lambda s, d: _engine(s, d).get_col(C + "retrieve (segment=c.segment, name=c.name)"), "SELECT DISTINCT c_mktsegment AS segment FROM customer"),
    "related_collections": (_related, "SELECT c_custkey AS \"custKey\", CAST(count(o_orderkey) AS INT) AS n, coalesce(max(o_orderkey), -1) AS last FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1"),
    "merged_results": (_merged, "SELECT r_name AS name, CAST(NULL AS INT) AS region FROM region UNION ALL SELECT n_name, n_regionkey FROM nation"),
    "validation_rules": (_rules, "SELECT 'name.blank' AS rule, count(*) FILTER (trim(p_name) = '') AS rows FROM part UNION ALL SELECT 'name.length', count(*) FILTER (strlen(p_name) NOT BETWEEN 1 AND 9) FROM part UNION ALL SELECT 'brand.form', count(*) FILTER (NOT regexp_matches(p_brand, '^Brand#[0-9]$')) FROM part UNION ALL SELECT 'type.in', count(*) FILTER (p_type NOT IN ('PROMO', 'SMALL')) FROM part"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: _text(t, p) for n, (t, p, _) in TEXTS.items()} | {n: f for n, (f, _) in (JSON | CALLS).items()}


def oracle_sql() -> dict[str, str]:
    return {n: sql for n, (_, _, sql) in TEXTS.items()} | {n: sql for n, (_, sql) in (JSON | CALLS).items()}
