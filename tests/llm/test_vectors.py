import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tuplewise.llm import ann, blocks, queries, topk


def brute(rows, k, every, score):
    out = []
    for qid, q in rows:
        if qid is not None and qid % every == 0:
            own = [(-score(q, v), i) for i, v in rows if i is not None and i != qid and len(v) == len(q)]
            out += [(qid, r + 1, i, -s) for r, (s, i) in enumerate(sorted(own)[:k])]
    return sorted(out)


def integers(q, v):
    return sum(math.floor(256 * a) * math.floor(256 * b) for a, b in zip(q, v))


def test_top_k_is_exact(spark, sf, same):
    same(queries.op1_topk(spark, sf), queries.oracle_sql()["op1_topk"])


def test_top_k_with_ties_repeats_and_bad_rows(spark):
    rng = np.random.default_rng(1)
    vecs = [[float(x) for x in rng.integers(-2, 3, 4) / 4] for _ in range(300)]
    rows = [(i, v) for i, v in enumerate(vecs)] + [(400, vecs[0]), (401, [1.0, 2.0]), (450, [1.0, 1.0]), (500, [])]
    bad = [(501, None), (502, [None, 1.0, 1.0, 1.0]), (503, [float("nan")] * 4), (504, [float("inf")] * 4), (None, vecs[0])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash")).withColumn("id", F.lit(1)).withColumn("rank", F.lit(0))
    got = sorted(tuple(r) for r in topk.top_k(df).collect())
    assert got == brute(rows, 5, 50, integers)


def test_top_k_beyond_doubles(spark):
    rows = [(0, [3e9, 1.0]), (1, [3e9, 2.0]), (2, [3e9, 3.0]), (3, [-3e9, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in topk.top_k(df).orderBy("rank").collect()]
    assert got == [(1, 2**63 - 1), (2, 2**63 - 1), (3, -(2**63))]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(none).collect() == [] and ann.nearest(none).collect() == []
    one = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")
    assert topk.top_k(one).collect() == []


def test_nearest_has_full_recall_and_exact_scores(spark, sf):
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = queries.op4_ann(spark, sf).collect()
    want = brute(rows, 20, 20, lambda a, b: float(np.dot(a, b)))
    pairs = {(r.query_id, r.vec_id) for r in got}
    assert len(got) == len(want) and len(pairs & {(q, i) for q, _, i, _ in want}) / len(want) == 1
    by = dict(rows)
    assert all(abs(r.score - math.fsum(a * b for a, b in zip(by[r.query_id], by[r.vec_id]))) < 1e-12 for r in got)


def test_nearest_is_its_sql(spark, sf, same):
    same(queries.op4_ann(spark, sf), queries.oracle_sql()["op4_ann"])


def test_nearest_with_ties_zero_vectors_and_few_rows(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 0.0]), (3, [0.5, 1.0]), (2, [0.5, -1.0]), (1, [-1.0, 0.0])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(0, 1, 2, 0.5), (0, 2, 3, 0.5), (0, 3, 1, -1.0)]


@pytest.mark.parametrize("module", [topk, ann])
@pytest.mark.parametrize("known", [False, True])
def test_kernels_against_all_pairs(module, known):
    """With and without a kth score that is already known: then only what reaches it must be found."""
    rng = np.random.default_rng(2)
    x = np.floor(rng.normal(size=(1500, 8)) * 20)
    q, ids, q_ids = x[:40], np.arange(1500), np.arange(40)
    full = q @ x.T
    full[q_ids, q_ids] = -np.inf
    least = np.sort(full, axis=1)[:, -7] if known else np.full(40, -np.inf)
    a, b, s = (np.array(v) for v in module.search(q_ids, q, least, module.build(ids, x), 7))
    want, names = blocks.best(full, np.broadcast_to(ids, full.shape), 7)
    for i in range(40):
        own = sorted((-v, n) for v, n in zip(s[a == i].tolist(), b[a == i].tolist()))[:7]
        assert own == [(-v, n) for v, n in zip(want[i].tolist(), names[i].tolist())]


@pytest.mark.parametrize("scale", [1.0, 2.0**40, 2.0**600])
def test_whole_numbers_of_any_size_go_through_the_tree(scale):
    rng = np.random.default_rng(6)
    x = np.floor(rng.normal(size=(700, 5)) * 1000) * scale
    q, ids, q_ids = x[::70], np.arange(700), np.arange(0, 700, 70)
    found = module_rows(topk.search(q_ids, q, np.full(len(q), -np.inf), topk.build(ids, x), 6))
    most = lambda v: max(-(2**63), min(2**63 - 1, v))
    want = []
    for i, own in zip(q_ids.tolist(), q):
        scores = [(most(sum(int(a) * int(b) for a, b in zip(own, v))), -j) for j, v in enumerate(x) if j != i]
        want += [(i, -j, s) for s, j in sorted(scores, reverse=True)[:6]]
    assert sorted(found) == sorted(want)


def module_rows(found):
    return [(int(a), int(b), int(s)) for a, b, s in zip(*found)]


def test_small_grids_give_the_same(spark, sf, same, monkeypatch):
    """Many shards, blocks and packed rows, and ids that repeat."""
    for name, value in (("BLOCK", 4), ("SHARD", 60), ("PACK", 16)):
        monkeypatch.setattr(blocks, name, value)
    same(queries.op1_topk(spark, sf), queries.oracle_sql()["op1_topk"])
    same(queries.op4_ann(spark, sf), queries.oracle_sql()["op4_ann"])
    rng = np.random.default_rng(8)
    rows = [(50, [1.0, 1.0])] + [(7, [float(x) for x in rng.integers(-8, 8, 2)]) for _ in range(400)]
    got = sorted(tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == brute(rows, 5, 50, integers)


def test_vectors_are_sent_in_the_smallest_exact_type():
    assert [blocks.compact(np.array([x])).dtype.str for x in (3.0, 0.5, 0.1, 40000.0, 1e300, 32768.0 + 2**-30)] == ["<i2", "<f4", "<f8", "<f4", "<f8", "<f8"]


def test_a_ball_tree_holds_every_row_within_its_radius():
    x = np.random.default_rng(3).normal(size=(1000, 5))
    tree = topk.BallTree(x, 50)
    assert sorted(tree.order) == list(range(1000))
    for lo, hi, centre, radius, *_ in tree.nodes:
        assert np.linalg.norm(x[tree.order[lo:hi]] - centre, axis=1).max() <= radius + 1e-9


def test_quantisation_bound():
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(50, 16)), rng.normal(size=(60, 16)) * 100
    (xc, xs, x1), (yc, ys, y1) = ann.quantise(x), ann.quantise(y)
    near = (xc.astype(int) @ yc.astype(int).T) * xs[:, None] * ys[None, :]
    bound = xs[:, None] * ys[None, :] * ((x1[:, None] + y1[None, :]) / 2 + 16 / 4)
    assert (np.abs(x @ y.T - near) <= bound + 1e-9).all()
