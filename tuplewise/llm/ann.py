"""Nearest neighbours by a block matrix join over int8 codes with error bounds."""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuplewise.llm import blocks

TILE_Q, TILE_X = 1024, 8192
#: Surviving pairs that are rescored at once.
PAIRS = 32768


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes in -127..127, the scale of each row, and the sum of each row's absolute codes."""
    scale = np.abs(x).max(1) / 127
    scale[scale == 0] = 1
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    return codes, scale, np.abs(codes.astype(np.int16)).sum(1).astype(float)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed component after component, so that they are the same wherever they are computed."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def build(ids: np.ndarray, x: np.ndarray) -> dict:
    """A shard: ids, vectors, and their codes, scales and sums."""
    codes, scale, ones = quantise(x)
    return {"ids": ids, "x": blocks.compact(x), "codes": codes, "scale": scale, "ones": ones}


def search(q_ids, q, least, shard, k):
    """Every (query, row) pair of a cell, in tiles of int8 products.

    With x = s (c + e), every |e| <= 1/2: the product of two vectors differs from
    s s' (c . c') by at most s s' (|c|/2 + |c'|/2 + d/4), |c| being the sum of
    absolute codes. A pair survives if its upper bound reaches the kth best lower
    bound seen so far, ``least`` at first; survivors are recomputed in double
    precision from the original vectors, and the k best of a tile are merged into
    each query's heap. The products are exact integers: they run as float32 while
    their sum stays under 2**24, else as float64.
    """
    x, ids, xc, xs, x1 = shard["x"], shard["ids"], shard["codes"], shard["scale"], shard["ones"]
    d = x.shape[1]
    exact = np.float32 if d * 127 * 127 < 2**24 else np.float64
    qc, qs, q1 = quantise(q)
    found = []
    for a in range(0, len(q), TILE_Q):
        at = slice(a, a + TILE_Q)
        own, own_ids = q[at], q_ids[at]
        kth = least[at] - 1e-9 * np.where(np.isfinite(least[at]), np.abs(least[at]), 0)
        heaps: list[list] = [[] for _ in own]
        for b in range(0, len(x), TILE_X):
            to = slice(b, b + TILE_X)
            near = (qc[at].astype(exact) @ xc[to].astype(exact).T).astype(np.float64)
            unit = qs[at][:, None] * xs[to][None, :]
            near *= unit
            unit *= (q1[at][:, None] + x1[to][None, :]) / 2 + d / 4 * (1 + 1e-6) + 1e-6
            near[own_ids[:, None] == ids[to][None, :]] = -np.inf
            if near.shape[1] >= k:
                low = near - unit
                kth = np.maximum(kth, np.partition(low, near.shape[1] - k, axis=1)[:, near.shape[1] - k])
            near += unit
            r, c = np.nonzero((near >= kth[:, None]) & (near > -np.inf))
            if not len(r):
                continue
            score = np.concatenate([products(own[r[i : i + PAIRS]], x[b + c[i : i + PAIRS]].astype(np.float64)) for i in range(0, len(r), PAIRS)])
            order = np.lexsort((ids[b + c], -score, r))
            r, score, names = r[order], score[order], ids[b + c[order]]
            nth = np.arange(len(r)) - np.searchsorted(r, r)
            for i, s, name in zip(r[nth < k].tolist(), score[nth < k].tolist(), names[nth < k].tolist()):
                heap = heaps[i]
                if len(heap) < k:
                    heapq.heappush(heap, (s, -name))
                elif (s, -name) > heap[0]:
                    heapq.heapreplace(heap, (s, -name))
            for i in np.unique(r).tolist():
                if len(heaps[i]) == k:
                    kth[i] = max(kth[i], heaps[i][0][0] - 1e-9 * abs(heaps[i][0][0]))
        found += [(int(i), -name, s) for i, heap in zip(own_ids, heaps) for s, name in heap]
    return tuple(zip(*found)) if found else ([], [], [])


def nearest(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, every: int = 20) -> DataFrame:
    """Each query's ``k`` rows of largest inner product, found through int8 tiles and rescored in double precision.

    Queries are the rows whose id is divisible by ``every``; candidates are all
    rows but those with the query's own id. Returns query_id, rank (from 1),
    vec_id, score, nearest first, ties to the smaller id. The bounds are sound,
    so nothing is lost: recall is 1 but for sums that differ in their last bit.
    Rows with a null id, or a vector that is null, zero or holds null, NaN or
    infinite components, take no part; vectors meet only vectors of their own
    length. Repeated ids are each a candidate; fewer than k candidates give fewer
    rows, an empty table none; other columns are ignored.
    """
    rows = blocks.usable(df, id_col, vec_col, nonzero=True)
    return blocks.block_topk(rows.where(F.col("id") % every == 0), rows, k, build, search, "double")
