"""The catalog of the sample tables."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tuplewise.catalog import DATETIME, FLOAT, INT, JSON, OTHER, STRING, Column, Entity, EntityCatalog, Inverse, Relation


def _columns(spec: str, not_null: str = "") -> dict[str, Column]:
    """Properties from "property=physical:kind" words."""
    required = set(not_null.split())
    kinds = {"i": INT, "f": FLOAT, "s": STRING, "t": DATETIME, "j": JSON, "o": OTHER}
    out = {}
    for word in spec.split():
        prop, _, rest = word.partition("=")
        physical, _, kind = rest.partition(":")
        out[prop] = Column(physical, kinds[kind], prop not in required)
    return out


def entities() -> list[Entity]:
    return [
        Entity("Region", "region", _columns("regionKey=r_regionkey:i name=r_name:s", "regionKey"), "regionKey", inverses={"nations": Inverse("Nation", "region")}),
        Entity("Nation", "nation", _columns("nationKey=n_nationkey:i name=n_name:s regionKey=n_regionkey:i", "nationKey"), "nationKey", {"region": Relation("Region", "regionKey", required=True)}, {"customers": Inverse("Customer", "nation"), "suppliers": Inverse("Supplier", "nation")}),
        Entity("Customer", "customer", _columns("custKey=c_custkey:i name=c_name:s nationKey=c_nationkey:i balance=c_acctbal:f segment=c_mktsegment:s", "custKey"), "custKey", {"nation": Relation("Nation", "nationKey")}, {"orders": Inverse("Order", "customer"), "openOrders": Inverse("OpenOrder", "customer"), "events": Inverse("Event", "user")}),
        Entity("Supplier", "supplier", _columns("suppKey=s_suppkey:i name=s_name:s nationKey=s_nationkey:i balance=s_acctbal:f", "suppKey"), "suppKey", {"nation": Relation("Nation", "nationKey")}, {"lines": Inverse("LineItem", "supplier")}),
        Entity("Part", "part", _columns("partKey=p_partkey:i name=p_name:s brand=p_brand:s type=p_type:s size=p_size:i price=p_retailprice:f", "partKey"), "partKey", inverses={"lines": Inverse("LineItem", "part")}),
        Entity("Order", "orders", _columns("orderKey=o_orderkey:i custKey=o_custkey:i status=o_orderstatus:s totalPrice=o_totalprice:f orderDate=o_orderdate:t priority=o_orderpriority:s", "orderKey"), "orderKey", {"customer": Relation("Customer", "custKey")}, {"lines": Inverse("LineItem", "order")}),
        Entity(
            "LineItem",
            "lineitem",
            _columns("orderKey=l_orderkey:i partKey=l_partkey:i suppKey=l_suppkey:i lineNumber=l_linenumber:i quantity=l_quantity:f price=l_extendedprice:f discount=l_discount:f tax=l_tax:f returnFlag=l_returnflag:s lineStatus=l_linestatus:s shipDate=l_shipdate:t"),
            None,
            {"order": Relation("Order", "orderKey"), "part": Relation("Part", "partKey"), "supplier": Relation("Supplier", "suppKey")},
        ),
        Entity("Event", "events", _columns("eventId=event_id:i ts=ts:t userId=user_id:i type=event_type:s value=value:f props=props:j", "eventId"), "eventId", {"user": Relation("Customer", "userId")}),
        Entity("Document", "documents", _columns("docId=doc_id:i text=text:s lang=lang:s source=source:s nChars=n_chars:i", "docId"), "docId", inverses={"label": Inverse("Label", "document")}, fulltext=(("text",),)),
        Entity("Label", "labels", _columns("docId=doc_id:i quality=quality:i toxic=toxic:i", "docId"), "docId", {"document": Relation("Document", "docId")}),
        Entity("Page", "pages", _columns("pageId=page_id:i url=url:s html=html:s", "pageId"), "pageId"),
        Entity("Benchmark", "benchmark", _columns("itemId=item_id:i text=text:s", "itemId"), "itemId"),
        Entity("Turn", "conversations", _columns("convId=conv_id:i turn=turn:i role=role:s text=text:s"), None),
        Entity("Embedding", "embeddings", _columns("vecId=vec_id:i embedding=embedding:o label=label:i", "vecId"), "vecId"),
        # the same tables seen otherwise: a row that an event closed, a kind of parts
        Entity("OpenOrder", "orders", _columns("orderKey=o_orderkey:i closed=o_closed:t totalPrice=o_totalprice:f custKey=o_custkey:i"), "orderKey", {"customer": Relation("Customer", "custKey")}, soft_delete="closed"),
        Entity("PromoPart", "part", _columns("partKey=p_partkey:i name=p_name:s type=p_type:s price=p_retailprice:f"), "partKey", discriminator=("type", "PROMO")),
        Entity("NotedPart", "part", _columns("partKey=p_partkey:i name=p_name:s brand=p_brand:s"), "partKey", source_fields={"note": ("note", None)}),
    ]


def catalog(spark: SparkSession, sf_dir: str) -> EntityCatalog:
    """Entities over ``{sf_dir}/{table}.parquet``; finished orders count as closed on their date."""

    def read(table: str):
        rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        return rows.selectExpr("*", "CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS o_closed") if table == "orders" else rows

    return EntityCatalog(entities(), read)
