"""Block join of a stated query set with all rows: queries and candidates meet in cells of a grid.

Candidates are dealt to ``C`` shards and queries to ``R`` blocks; cell (r, c) gets
one block and one shard, so both sides stay bounded whatever the input's size. A
shard is built once (its tree or its codes) and written; a block is sent to every
shard, a shard to every block, in the smallest type that holds its numbers
exactly. Shards are searched in rounds: what a query's kth score is after one round
goes with it into the next, so that later shards are pruned by what earlier ones
have found. Each cell returns at most k rows per query and a rank-limited window
merges the cells.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tuplewise.llm.common import materialise, small, small_batches

#: Rows of a query block, of a shard, of a packed row; rows of a shard when there are few.
BLOCK, SHARD, PACK, LEAST = 32768, 32768, 1024, 2048
#: One shard in FIRST is searched in the first round.
FIRST = 8

PACKED = "dim int, cell int, ids binary, vecs binary, least binary"
#: Of ids and vectors what a cell needs of a shard; of a block's ids, vectors and kth scores with a shard the (query_id, vec_id, score) found.
Build = Callable[[np.ndarray, np.ndarray], dict]
Search = Callable[[np.ndarray, np.ndarray, np.ndarray, dict, int], tuple]


def usable(df: DataFrame, id_col: str, vec_col: str, nonzero: bool) -> DataFrame:
    """(id, vec) of the rows whose id and vector are non-null and whose components are all finite."""
    vec = F.col(vec_col).cast("array<double>")
    ok = F.col(id_col).isNotNull() & F.forall(vec, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x))
    if nonzero:
        ok = ok & F.exists(vec, lambda x: x != 0)
    return df.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"), ok.alias("ok")).where("ok").drop("ok")


def compact(x: np.ndarray) -> np.ndarray:
    """``x`` in the smallest of int16, float32 and float64 that holds it exactly."""
    for kind in ("<i2", "<f4"):
        with np.errstate(over="ignore", invalid="ignore"):
            own = x.astype(kind)
        if np.array_equal(own.astype("<f8"), x):
            return own
    return x.astype("<f8")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, vec, cell, least) rows to packed rows of PACK vectors of one length and cell."""
    names = [x.split()[0] for x in PACKED.split(", ")]
    types = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    held: dict[tuple[int, int], list] = {}

    def flush(key):
        ids, vecs, least = zip(*held.pop(key))
        packed = pickle.dumps(compact(np.concatenate(vecs)))
        row = [key[0], key[1], np.array(ids, "<i8").tobytes(), packed, np.array(least, "<f8").tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names)

    for batch in batches:
        col = batch.column(1)
        ids, cell, least = batch.column(0).to_numpy(), batch.column(2).to_numpy(), batch.column(3).to_numpy()
        flat, ends = col.flatten().to_numpy(), np.cumsum(col.value_lengths().to_numpy(zero_copy_only=False))
        for i, (key_id, end) in enumerate(zip(ids, ends)):
            begin = ends[i - 1] if i else 0
            key = (int(end - begin), int(cell[i]))
            held.setdefault(key, []).append((key_id, flat[begin:end].copy(), least[i]))
            if len(held[key]) == PACK:
                yield flush(key)
    for key in list(held):
        yield flush(key)


def _read(tab: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, least = (np.concatenate([np.frombuffer(x, t) for x in tab.column(c).to_pylist()]) for c, t in (("ids", "<i8"), ("least", "<f8")))
    vecs = np.concatenate([pickle.loads(x).astype("<f8") for x in tab.column("vecs").to_pylist()]).reshape(len(ids), dim)
    order = np.argsort(ids, kind="stable")
    return ids[order], vecs[order], least[order]


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row, by score downwards, then id upwards; missing ones have score -inf."""
    order = np.lexsort((ids, -scores), axis=-1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def shards(candidates: DataFrame, build: Build) -> tuple[DataFrame, int]:
    """A written table (dim, c, payload), one row for each shard and length of vectors, and the number of shards.

    Rows are dealt by a hash of their id and their place in the input, so that rows
    that repeat an id, however many, are dealt out too.
    """
    count, cores = candidates.count(), candidates.sparkSession.sparkContext.defaultParallelism
    n = max(1, -(-count // SHARD), min(2 * cores, count // LEAST))
    place = F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(n)).cast("int")
    packed = candidates.select("id", "vec", place.alias("cell"), F.lit(0.0).alias("least")).mapInArrow(_pack, PACKED)

    def made(key, tab):
        dim, cell = (x.as_py() for x in key)
        ids, x, _ = _read(tab, dim)
        return pa.table({"dim": pa.array([dim], pa.int32()), "c": pa.array([cell], pa.int32()), "payload": pa.array([pickle.dumps(build(ids, x))], pa.binary())})

    return materialise(packed.groupBy("dim", "cell").applyInArrow(made, "dim int, c int, payload binary")), n


def block_topk(queries: DataFrame, candidates: DataFrame, k: int, build: Build, search: Search, score_type: str) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best candidates of the same dimension other than its own id.

    Both frames have (id, vec). ``search(q_ids, q, least, shard, k)`` returns
    (query_id, vec_id, score) arrays of at least the cell's k best per query that
    can be in the result, ``least`` being the kth score that each query has already.
    Of queries that share an id the one with the smallest vector stands. Empty sides
    give an empty result.
    """
    spark = queries.sparkSession
    small_batches(spark, 4096)
    queries = materialise(queries.groupBy("id").agg(F.min("vec").alias("vec")))
    built, n = shards(candidates, build)
    blocks = max(1, -(-queries.count() // BLOCK))

    def cell(key, left, right):
        out = ([], [], [])
        if left.num_rows and right.num_rows:
            out = search(*_read(left, key[0].as_py()), pickle.loads(right.column("payload")[0].as_py()), k)
        kinds = (pa.int64(), pa.int64(), pa.int64() if score_type == "long" else pa.float64())
        return pa.table([pa.array(x, t) for x, t in zip(out, kinds)], names=["query_id", "vec_id", "score"])

    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    rounds, edge = [], -(-n // FIRST)
    for low, high in ((0, edge), (edge, n)):
        if low >= high:
            continue
        least = F.lit(float("-inf"))
        asked = queries.select("id", "vec", least.alias("least"))
        if rounds:
            known = rounds[0].groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("kth"))
            asked = queries.join(small(materialise(known.where(F.col("n") == k))), F.col("id") == F.col("query_id"), "left").select("id", "vec", F.coalesce("kth", least).alias("least"))
        dealt = asked.select("id", "vec", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("cell"), "least").mapInArrow(_pack, PACKED)
        left = dealt.withColumnRenamed("cell", "r").withColumn("c", F.explode(F.sequence(F.lit(low), F.lit(high - 1))))
        right = built.where((F.col("c") >= low) & (F.col("c") < high)).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        found = left.groupBy("dim", "r", "c").cogroup(right.groupBy("dim", "r", "c")).applyInArrow(cell, f"query_id long, vec_id long, score {score_type}")
        ranked = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
        rounds.append(materialise(ranked.select("query_id", "vec_id", "score")))
    every = reduce(DataFrame.unionByName, rounds)
    return every.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
