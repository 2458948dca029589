import pytest
from hypothesis import given
from hypothesis import strategies as st

from tuplewise.errors import QueryError
from tuplewise.functions import dates, search
from tuplewise.functions.scalar import like_pattern
from tuplewise.language import ast as A
from tuplewise.language.lexer import tokens
from tuplewise.language.parser import parse


def test_operators_bind_as_written():
    q = parse("range of o is Order retrieve (x = o.a + 2 * -o.b - 1) where o.a = 1 or o.b = 2 and not o.c = 3")
    x = q.retrieve.items[0].expr
    assert isinstance(x, A.Arith) and x.op == "-" and x.left.op == "+" and x.left.right.op == "*"
    assert q.retrieve.where.op == "or" and q.retrieve.where.right.op == "and" and isinstance(q.retrieve.where.right.right, A.Not)


def test_minus_after_an_operand_subtracts():
    assert parse("retrieve (1 -1)").retrieve.items[0].expr == A.Arith("-", A.Literal(1), A.Literal(1))


def test_slash_is_a_division_or_a_regular_expression():
    assert parse("range of p is P retrieve (p.a) where p.a = /x\\/y/im").retrieve.where.right == A.Regex("x\\/y", "im")
    assert parse("retrieve (4 / 2 / 1)").retrieve.items[0].expr.op == "/"


def test_casts_and_brackets():
    assert parse("range of p is P retrieve ((int) p.a, (p.b), (string) (1 + 2))").retrieve.items[0].expr == A.Cast("int", A.Path(("p", "a")))
    assert parse("range of p is P retrieve ((p.b))").retrieve.items[0].expr == A.Path(("p", "b"))


def test_an_alias_is_the_source_text():
    assert [i.alias for i in parse("range of p is P retrieve (p.a,  p.b + 1, n=p.c)").retrieve.items] == ["p.a", "p.b + 1", "n"]


def test_strings_windows_directives_and_keywords_in_any_case():
    q = parse('@InValuesAreFinal true RANGE OF o IS App\\Order RETRIEVE UNIQUE (o.a) WHERE o.a IN ("x\\n", \'it\\\'s\') SORT BY o.a DESC WINDOW 2 USING window_size 5;')
    assert q.directives == {"InValuesAreFinal": True} and q.ranges[0].source.entity == "App\\Order"
    assert q.retrieve.where.values == ("x\n", "it's") and q.retrieve.unique and q.retrieve.window == (2, 5) and q.retrieve.sort[0].descending


@pytest.mark.parametrize("text", ["retrieve (", "retrieve (a=1, a=2)", "retrieve (1) retrieve (2)", "range of x retrieve (1)", "retrieve (nope(1))", "retrieve ('a)", "range of p is P retrieve (p.a) where p.a > /x/", "retrieve (concat())", "retrieve (1) where 1 in (a)", "retrieve (1 % 2)", "range of p is P retrieve (p.a) where p.a = /x/q"])
def test_bad_syntax(text):
    with pytest.raises(QueryError) as e:
        parse(text)
    assert e.value.category == "syntax_error"


def test_tokens_know_their_places():
    assert [(t.value, t.start) for t in tokens("a <> 1.5")][:3] == [("a", 0), ("<>", 2), (1.5, 5)]


@given(st.integers(0, 10**9))
def test_intervals_read_what_they_write(seconds):
    left, parts = seconds, []
    for name, unit in dates.UNITS:
        n, left = divmod(left, unit)
        if n:
            parts.append(f"{n} {name}{'s' * (n != 1)}")
    assert (dates.interval(" ".join(parts)) or 0) == seconds


@pytest.mark.parametrize("text", ["yesterday", "1 bananas", "6 days ago", "6days"])
def test_bad_intervals(text):
    with pytest.raises(QueryError):
        dates.interval(text)


def test_intervals():
    assert dates.interval("now") is None and dates.interval("-1.5 minutes") == -90 and dates.interval("1 day 2 hours") == 93600


@given(st.text(alphabet="ab%_\\*?", max_size=8))
def test_wildcards_become_like(text):
    pattern = like_pattern(text)
    assert (pattern is None) == (not set("*?") & set(text))


def test_search_strings():
    assert search.parse('a "b c" +d -e +"f g"') == search.Terms(("a", "b c"), ("d", "f g"), ("e",))
    assert search.parse("") == search.Terms((), (), ())
