"""Exact top-k search by inner product: ball trees with branch and bound."""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuplewise.llm import blocks

LEAF = 256
LONG = 2**63


class BallTree:
    """Nodes over ranges of a permuted matrix: centre, radius, and two children or none."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(x))
        self.nodes: list[tuple[int, int, np.ndarray, float, int]] = []
        todo = [(0, len(x), -1)]
        while todo:
            lo, hi, parent = todo.pop()
            own = x[self.order[lo:hi]]
            centre = own.mean(0)
            away = own - centre
            radius = float(np.sqrt((away * away).sum(1).max())) if own.size else 0.0
            at = len(self.nodes)
            self.nodes.append((lo, hi, centre, radius, -1))
            if parent >= 0 and self.nodes[parent][4] < 0:
                self.nodes[parent] = (*self.nodes[parent][:4], at)
            elif parent >= 0:
                self.nodes[parent] = (*self.nodes[parent], at)
            if hi - lo > leaf and radius > 0:
                half = (hi - lo) // 2
                part = np.argpartition(away[:, away.var(0).argmax()], half)
                self.order[lo:hi] = self.order[lo:hi][part]
                todo += [(lo, lo + half, at), (lo + half, hi, at)]


def _scaled(x: np.ndarray) -> tuple[np.ndarray, int]:
    """``x`` divided by a power of two so that no component is above 1, and the exponent. The quotient is exact."""
    e = int(np.frexp(np.abs(x).max(initial=0))[1])
    return np.ldexp(x, -e), e


def build(ids: np.ndarray, x: np.ndarray) -> dict:
    """A shard: its ids and vectors in the order of its tree, and the tree over the scaled vectors."""
    tree = BallTree(_scaled(x)[0])
    lo, hi, centre, radius, kids = [], [], [], [], []
    for a, b, c, r, *own in tree.nodes:
        lo.append(a)
        hi.append(b)
        centre.append(c)
        radius.append(r)
        kids.append(own if len(own) == 2 else (-1, -1))
    return {"ids": ids[tree.order], "x": blocks.compact(x[tree.order]), "lo": lo, "hi": hi, "centre": np.array(centre), "radius": radius, "kids": kids}


def _whole(score: int) -> int:
    return max(-LONG, min(LONG - 1, score))


def search(q_ids, q, least, shard, k):
    """Branch and bound over one shard's tree for a block of queries.

    The tree's nodes are taken best first, by the largest upper bound of the
    inner product (q . centre + |q| radius) among the queries that still need the
    node; a query leaves a node when its bound is below its current kth score,
    ``least`` at first and growing from leaf to leaf. Bounds get a margin for
    rounding; equal scores are always examined. All is reckoned with vectors scaled
    by powers of two. Sums beyond 2**53 are rounded: what reaches the kth score
    within the margin is then multiplied out in whole numbers.
    """
    x = shard["x"].astype(float)
    ids = shard["ids"]
    (p, qe), (y, xe) = _scaled(q), _scaled(x)
    d = max(q.shape[1], 1)
    # least may have been rounded from a whole number, and stands for all scores above a long
    floor = np.where(np.isfinite(least), np.ldexp(least, -qe - xe), -np.inf)
    floor = floor - np.where(np.isfinite(floor), np.abs(floor), 0) * 2.0**-50
    sure = d * 2.0 ** min(qe + xe, 1000) < 2.0**53
    norm = np.sqrt((p * p).sum(1))
    away = 0.0 if sure else d * 2.0**-51 * norm * np.sqrt((y * y).sum(1).max(initial=0)) + 1e-290
    kth = floor.copy()
    top, top_ids = np.full((len(q), k), -np.inf), np.full((len(q), k), np.iinfo("i8").max)
    heaps: list[list] = [[] for _ in range(0 if sure else len(q))]

    def bound(n):
        centre = shard["centre"][n]
        b = p @ centre + norm * shard["radius"][n]
        return b + 1e-9 * (np.abs(b) + norm * np.abs(centre).max(initial=0)) + 1e-290

    def merge(need, rows, scores, hit):
        """Put exact scores into the k best of each query."""
        for at in range(0, len(need), 1024):
            own = need[at : at + 1024]
            new = np.where(hit[at : at + 1024], scores[at : at + 1024], -np.inf)
            cols = np.concatenate([top[own], new], 1)
            names = np.concatenate([top_ids[own], np.broadcast_to(ids[rows], new.shape)], 1)
            top[own], top_ids[own] = blocks.best(cols, names, k)
        kth[need] = np.maximum(kth[need], top[need, -1])

    def multiply(need, rows, hit):
        """The same in whole numbers, in a heap of each query."""
        for i, own in enumerate(need):
            mine = [int(v) for v in q[own]]
            for j in np.flatnonzero(hit[i]):
                score = _whole(sum(a * int(b) for a, b in zip(mine, x[rows][j])))
                heap = heaps[own]
                (heapq.heappush if len(heap) < k else heapq.heappushpop)(heap, (score, -int(ids[rows][j])))
            if len(heaps[own]) == k:
                known = float(np.ldexp(float(heaps[own][0][0]), -qe - xe))
                kth[own] = max(kth[own], known - abs(known) * 2.0**-50)

    root = bound(0)
    queue = [(-float(root.max(initial=0)), 0, root)]
    while queue:
        _, n, upper = heapq.heappop(queue)
        need = np.flatnonzero(upper >= kth)
        if not len(need):
            continue
        if shard["kids"][n][0] >= 0:
            for c in shard["kids"][n]:
                b = bound(c)
                open_ = b[need] >= kth[need]
                if open_.any():
                    heapq.heappush(queue, (-float(b[need][open_].max()), c, b))
            continue
        rows = slice(shard["lo"][n], shard["hi"][n])
        scores = p[need] @ y[rows].T
        hit = scores >= np.maximum(kth, top[:, -1])[need, None] - (away if sure else away[need, None])
        hit &= q_ids[need][:, None] != ids[rows][None, :]
        some = hit.any(1)
        if sure:
            merge(need[some], rows, scores[some], hit[some])
        else:
            multiply(need[some], rows, hit[some])
    if not sure:
        own = [(int(i), -name, score) for i, heap in zip(q_ids, heaps) for score, name in heap]
        return tuple(zip(*own)) if own else ([], [], [])
    keep = np.isfinite(top)
    return np.repeat(q_ids, k).reshape(-1, k)[keep], top_ids[keep], np.ldexp(top[keep], qe + xe).astype("i8")


def top_k(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """Each query's ``k`` rows of highest inner product over integer vectors floor(scale * x).

    Queries are the rows whose id is divisible by ``every``; candidates are all
    rows but those with the query's own id. Returns query_id, rank (from 1),
    vec_id, score; fewer than k candidates give fewer rows. Ties go to the
    smaller id; rows that repeat an id are each a candidate. Rows with a null id,
    or a vector that is null or holds null, NaN or infinite components, take no
    part; vectors meet only vectors of their own length. A score beyond a long
    saturates, as does a component beyond a double. Other columns are ignored; an empty table gives no rows.
    """
    rows = blocks.usable(df, id_col, vec_col, nonzero=False)
    rows = rows.withColumn("vec", F.transform("vec", lambda x: _floor(x * float(scale))))
    return blocks.block_topk(rows.where(F.col("id") % every == 0), rows, k, build, search, "long")


def _floor(x):
    """floor as a double: Spark's own returns a long, which large components overflow."""
    most = F.lit(1.7e308)
    return F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(F.greatest(F.least(x, most), -most))
