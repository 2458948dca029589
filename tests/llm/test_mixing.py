import math
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tuplewise.llm import mixing, queries


def test_the_query_is_its_sql(spark, sf, same):
    same(queries.op10_mixing(spark, sf), queries.oracle_sql()["op10_mixing"])


def shares(sizes):
    """Targets by resharing round after round. sizes: by source."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        level = left / sum(weight[s] for s in free) if free else 0
        more = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not more:
            return {s: 3.0 * sizes[s] if s in capped else level * weight[s] for s in names}
        capped |= more


@settings(max_examples=12, deadline=None)
@given(st.lists(st.integers(0, 2000), min_size=1, max_size=12))
def test_targets(spark, sizes):
    named = {None if i == 2 else f"s{i}é": n for i, n in enumerate(sizes)}
    df = spark.createDataFrame([(s, n) for s, n in named.items()], "source string, source_size long")
    want = shares(named)
    for r in mixing.targets(df).collect():
        assert math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-6)


def test_sources_come_near_their_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    assert all(r.taken <= 3 * r.size and r.taken % max(r.size, 1) == 0 for r in rows)
    for s in {r.source for r in rows}:
        own = [r for r in rows if r.source == s]
        assert own[0].source_size == sum(r.size for r in own)
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own)
    assert all(r.size == len(re.findall(r"[^\x20\x09-\x0d]+", t)) for r, t in [(r, docs.where(F.col("doc_id") == r.doc_id).first().text) for r in rows[:5]])


def test_reruns_and_other_partitions_agree(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one, two = (sorted(map(tuple, mixing.mix(d).collect())) for d in (docs, docs.repartition(7)))
    assert one == two


def test_good_documents_are_likelier(spark):
    rows = [(i, ("word " if i % 2 else "*** ") * 20, "a" if i < 2000 else "b") for i in range(4000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).where("doc_id < 2000").collect()
    taken = [sum(r.taken for r in got if r.doc_id % 2 == k) for k in (0, 1)]
    assert taken[1] > 2 * taken[0]


def test_nulls_empty_long_ties_and_clashing(spark):
    rows = [(1, None, "a"), (2, "", None), (None, "x y", None), (None, "x y", None), (3, "w " * 200_000, "b"), (4, "one two three", "a"), (4, "one two three", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("key", F.lit("clash")).withColumn("epochs", F.lit(9)).withColumn("size", F.lit("c"))
    got = mixing.mix(df).collect()
    assert len(got) == 7 and {r.taken for r in got if r.size == 0} == {0} and all(r.taken <= 3 * r.size for r in got)
    assert sum(r.target for r in {r.source_size: r for r in got}.values()) <= 200_010
    often = mixing.apply(df)
    assert often.columns == df.columns and often.where("text is null or text = ''").count() == 0
    want = sorted((str(r.doc_id), r.size) for r in got for _ in range(r.taken // r.size if r.size else 0))
    assert sorted((str(r.doc_id), len(r.text.split())) for r in often.collect()) == want
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.apply(df.limit(0)).count() == 0


def test_only_null_texts(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in mixing.mix(df).collect()] == [(0, 0.0, 0)] * 2


@pytest.mark.parametrize("name", ["opN"])
def test_every_operator_has_its_query(name):
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))


@pytest.mark.parametrize("sorted_", [3, 50_000])
def test_rows_that_repeat_are_cut_among_themselves(spark, monkeypatch, sorted_):
    """A target that ends among equal rows is met, also when classes are split to the last digit."""
    monkeypatch.setattr(mixing, "SORTED", sorted_)
    rows = [(1, "a b c", "x")] * 1000 + [(i, f"w{i} " * 50, "y") for i in range(60)] + [(2, "d", "z")] * 500
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.mix(df).collect()
    names = {1: "x", 2: "z"}
    for s in "xyz":
        own = [r for r in got if names.get(r.doc_id if r["size"] in (1, 3) else None, "y") == s]
        assert own and abs(sum(r.taken for r in own) - own[0].target) <= max(r["size"] for r in own)
    again = mixing.mix(df.repartition(3)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    assert sum(r.taken for r in got) == sum(len(r.text.split()) for r in mixing.apply(df).collect())


def test_split_classes_give_the_same(spark, sf, same, monkeypatch):
    monkeypatch.setattr(mixing, "SORTED", 1)
    monkeypatch.setattr(mixing, "CLASSES", 8)
    same(mixing.mix(spark.read.parquet(f"{sf}/documents.parquet")), queries.oracle_sql()["op10_mixing"])


def test_a_column_of_weights(spark):
    rows = [(i, "one two three", "a" if i < 2000 else "b", (0.05, 1.0, None, -1.0)[i % 4]) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, w double")
    got = mixing.mix(df, weight="w").where("doc_id < 2000").collect()
    taken = [sum(r.taken for r in got if r.doc_id % 4 == k) for k in range(4)]
    assert taken[1] > taken[0] > taken[2] and abs(taken[2] - taken[3]) < 300


def test_many_sources(spark):
    """More sources than any one list of them should hold: targets come from sums by ranges."""
    sizes = {f"s{i * 7919 % 3001:05d}": i * 37 % 101 for i in range(3001)}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    want = shares(sizes)
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert all(math.isclose(got[s], want[s], rel_tol=1e-9, abs_tol=1e-6) for s in sizes) and len(got) == len(sizes)
