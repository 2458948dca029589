import pytest

from tuplewise.engine import Engine
from tuplewise.errors import QueryError
from tuplewise.tables import catalog

O = "range of o is Order "  # noqa: E741
J = "range of j is json_source('/nowhere.json') "

BAD = [
    ("retrieve ()", "semantic_error"),
    (O + O + "retrieve (o.orderKey)", "semantic_error"),
    (O + "range of c is Customer via o.status retrieve (c.name)", "semantic_error"),
    ("range of o is Nothing retrieve (o.a)", "semantic_error"),
    ("range of a is Order via b.customer range of b is Customer via a.customer retrieve (a.orderKey)", "semantic_error"),
    (O + "retrieve (x.orderKey)", "semantic_error"),
    ("range of a is Nation range of b is Region retrieve (name)", "semantic_error"),
    (O + "retrieve (o.nothing)", "semantic_error"),
    (O + "retrieve (o.status.a)", "semantic_error"),
    (O + "range of c is Customer via o.nothing retrieve (c.name)", "semantic_error"),
    (O + "range of c is Customer via o.customer.nation retrieve (c.name)", "semantic_error"),
    (O + "range of c is Nation via o.customer retrieve (c.name)", "semantic_error"),
    ("range of x is (range of o is Order retrieve (o.orderKey)) retrieve (x)", "semantic_error"),
    ("range of x is (range of o is Order retrieve (o)) retrieve (x.orderKey)", "semantic_error"),
    ("range of x is (range of o is Order retrieve (o.orderKey)) retrieve (x.status)", "semantic_error"),
    (J + "retrieve (j)", "semantic_error"),
    (O + "retrieve (/x/)", "semantic_error"),
    (O + "retrieve (o.orderKey) where o = 1", "semantic_error"),
    (O + "retrieve (o.orderKey) where sum(o.totalPrice) > 1", "semantic_error"),
    (O + "range of c is Customer via o.customer retrieve (o.orderKey) where search(o.status, c.name, 'x')", "semantic_error"),
    (O + J + "retrieve (sum(o.totalPrice * j.a))", "semantic_error"),
    (O + "retrieve ((nothing) o.orderKey)", "semantic_error"),
    (O + "retrieve (o.orderDate + 5)", "semantic_error"),
    (O + "retrieve (o.orderDate * 2)", "semantic_error"),
    (O + "retrieve (date('2 days') / 2)", "semantic_error"),
    ("range of p is NotedPart " + J + "range of k is json_source('/x.json') retrieve (p)", "semantic_error"),
    ("range of l is LineItem retrieve (l.orderKey) window 0, 5", "semantic_error"),
    (O + "retrieve (o.orderKey) where o.orderDate > :p", "resolution_error"),
    (J + "retrieve (j.a)", "json_error"),
]


@pytest.mark.parametrize("text, category", BAD)
def test_refused(text, category, spark, sf):
    with pytest.raises(QueryError) as e:
        Engine(spark, catalog(spark, sf)).query(text)
    assert e.value.category == category


def test_a_parameter_that_is_no_date(spark, sf):
    with pytest.raises(QueryError) as e:
        Engine(spark, catalog(spark, sf)).query(O + "retrieve (o.orderKey) where o.orderDate > :p", {"p": "soon"})
    assert e.value.category == "type_error"
