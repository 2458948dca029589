"""SimHash near-duplicates: candidates by pigeonring chains, components by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tuplewise.llm.common import forget, keep, materialise, small, small_batches

BITS, DIFFER, SEGMENTS, WORDS, SEED = 64, 2, 9, 3, 42
#: Fingerprints in a bucket that are compared with each other; a larger bucket's are linked through midpoints.
BUCKET = 48


def _fingerprint(text: str | None) -> int:
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    data = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    begins = (ends - sizes).tolist()
    ends = ends[min(WORDS, len(words)) - 1 :].tolist()
    digest, ones = xxhash.xxh64_digest, np.zeros(BITS, np.int64)
    for at in range(0, len(ends), 16384):
        hashes = b"".join([digest(data[a:b], SEED) for a, b in zip(begins[at : at + 16384], ends[at : at + 16384])])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(ends)).tobytes(), "big", signed=True)


def _fingerprints(texts: pa.Array) -> pa.Array:
    keep("simhash", None, lambda: None)
    return pa.array([_fingerprint(x.as_py()) for x in texts], pa.int64())


def fingerprint(text: Column) -> Column:
    """64 bits as a signed long: bit set if set in over half the XXH64 of the text's shingles of 3 words."""
    return F.arrow_udf(_fingerprints, LongType())(text)


def as_hex(bits: Column) -> Column:
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


def segments(count: int = SEGMENTS) -> list[int]:
    """Masks of consecutive segments of nearly equal width."""
    edges = [round(i * BITS / count) for i in range(count + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]


def budget(length: int) -> int:
    """Differences that ``length`` consecutive segments of some chain may have at most: their proportional share."""
    return length * DIFFER // SEGMENTS


def _mask(start: int, length: int) -> int:
    own = segments()
    return sum(own[(start + i) % SEGMENTS] for i in range(length))


#: Segments that every near pair has equal in a row, from some start on: their budget is 0.
EXACT = max(n for n in range(1, SEGMENTS + 1) if budget(n) == 0)
_CHAINS = np.array([[_mask(i, n) for n in range(EXACT + 1, SEGMENTS + 1)] for i in range(SEGMENTS)], np.uint64)
_BUDGETS = np.array([budget(n) for n in range(EXACT + 1, SEGMENTS + 1)])


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _buckets(prints: DataFrame) -> DataFrame:
    """(start, bits, print, node): each fingerprint under every start of a chain, by the bits that must be equal."""
    keys = F.array(*[F.struct(F.lit(i).alias("start"), F.col("print").bitwiseAND(F.lit(_signed(_mask(i, EXACT)))).alias("bits")) for i in range(SEGMENTS)])
    return prints.select("print", "node", F.explode(keys).alias("k")).select("k.start", "k.bits", "print", "node")


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within buckets of sorted rows; the last bucket of a batch waits for the next."""
    held: list[np.ndarray] = []

    def links(cols):
        start, bits, prints, node = cols
        out_a, out_b = [], []
        unsigned = prints.view(np.uint64)
        for step in range(1, min(BUCKET, len(start))):
            same = (start[step:] == start[:-step]) & (bits[step:] == bits[:-step])
            at = np.flatnonzero(same)
            if not len(at):
                break
            differ = unsigned[at] ^ unsigned[at + step]
            chain = np.ones(len(at), bool)
            for j, most in enumerate(_BUDGETS):
                chain[chain] = np.bitwise_count(differ[chain] & _CHAINS[start[at[chain]], j]) <= most
            at = at[chain]
            out_a.append(node[at])
            out_b.append(node[at + step])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_a, out_b))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        if held:
            cols = [np.concatenate(x) for x in zip(held, cols)]
        if not len(cols[0]):
            continue
        last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        held = [c[cut:] for c in cols]
        if cut:
            yield links([c[:cut] for c in cols])
    if held:
        yield links(held)


def links(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b) nodes of ``prints`` (print, node) that connect whatever differs in at most 2 bits.

    Pigeonring: over 9 segments in a ring, fingerprints that differ in at most 2
    bits have a start from which every chain of l segments differs in at most
    floor(2 l / 9) bits. So 4 segments in a row are equal, which is what candidates
    are looked up by; chains of 5 to 9 segments are then held against their
    budgets, the last being the whole Hamming distance.

    In a bucket of more than ``bucket`` fingerprints pairs are not formed. Its
    members are written under each fingerprint that differs from them in at most
    one bit: two that are 2 or fewer bits apart meet under such a midpoint, and all
    that meet there are 2 or fewer apart. At most 65 meet under one.
    """
    keys = materialise(_buckets(prints))
    hot = materialise(keys.groupBy("start", "bits").agg(F.count("*").alias("n")).where(F.col("n") > bucket).select("start", "bits"))
    hinted = small(hot)
    cold = keys.join(hinted, ["start", "bits"], "left_anti").select("start", "bits", "print", "node")
    near = cold.repartition("start", "bits").sortWithinPartitions("start", "bits", "print").mapInArrow(_pairs, "a long, b long")
    crowd = keys.join(hinted, ["start", "bits"], "left_semi").groupBy("print").agg(F.min("node").alias("node"))
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(BITS)])
    meet = crowd.select("node", F.explode(F.transform(flips, lambda m: F.col("print").bitwiseXOR(m))).alias("mid"))
    met = meet.groupBy("mid").agg(F.collect_list("node").alias("all"), F.min("node").alias("a")).where(F.size("all") > 1)
    stars = met.select("a", F.explode("all").alias("b")).where("a != b")
    return near.unionByName(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for each node of an edge (a, b) the smallest node of its component, itself left out if smallest.

    Large-star and small-star steps alternate until nothing changes; each result
    is a written table, so a lost executor costs one step, and nothing is gathered
    on the driver but a count and a checksum.
    """

    def stars(tagged: DataFrame, large: bool) -> DataFrame:
        least = materialise(tagged.groupBy("u").agg(F.min("v").alias("m")))
        joined = tagged.join(least, "u").withColumn("m", F.least("m", "u"))
        if large:
            moved = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            pairs = F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))
            moved = joined.select(F.explode(pairs).alias("e")).select("e.*")
        out = materialise(moved.where("a != b").distinct())
        forget(least)
        return out

    def state(df: DataFrame):
        return df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b") % 2**31), F.lit(0))).first()[:]

    now = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = state(now)
    while seen[0]:
        both = now.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*")
        large = stars(both, True)
        after = stars(large.select(F.col("a").alias("u"), F.col("b").alias("v")), False)
        forget(large, now)
        now, before, seen = after, seen, state(after)
        if before == seen:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest id reachable over links of 2 or fewer bits.

    Words are runs of other characters than space and tab to carriage return,
    after A-Z are lower-cased; shingles have 3 words, repeats included; fewer
    words give one shingle, none (null or empty text) the fingerprint 0, which
    links like any other. Every row gives one row, repeated rows too. Rows are
    linked by their fingerprints alone: rows that repeat an id with other texts are
    not thereby linked. Rows with a null id get their component's smallest id,
    null if it has none. Other columns are not read.
    """
    rows = _rows(docs, id_col, text)
    named = small(components_of(rows).select("print", F.col("least.doc_id").alias("component_id")))
    return rows.join(named, "print").select("doc_id", as_hex(F.col("print")).alias("fingerprint"), "component_id")


def _rows(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """A written table (doc_id, print)."""
    small_batches(docs.sparkSession)
    return materialise(docs.select(F.col(id_col).cast("long").alias("doc_id"), fingerprint(F.col(text)).alias("print")))


def components_of(rows: DataFrame) -> DataFrame:
    """A written table (print, least): for each fingerprint of ``rows`` its component's first row.

    ``least`` is a struct (no_id, doc_id, print): the smallest id, rows without one
    last, then the smallest fingerprint.
    """
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "print")
    prints = materialise(rows.groupBy("print").agg(F.min(first).alias("own")))
    near = links(prints.select("print", F.col("print").alias("node")))
    edges = materialise(near)
    forget(near)
    roots = components(edges)
    grouped = materialise(prints.join(roots.withColumnRenamed("node", "print"), "print", "left").select("print", "own", F.coalesce("root", "print").alias("root")))
    least = materialise(grouped.groupBy("root").agg(F.min("own").alias("least")))
    out = materialise(grouped.join(small(least), "root").select("print", "least"))
    forget(grouped, least, prints, edges, roots)
    return out


def one_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each component one with the smallest id, one without an id only if none has any.

    Rows are told apart by id and fingerprint, so a text is never lost because its
    id stands at another text too. Of rows that repeat both, the one with the
    smallest digest of all its columns stays. An empty table stays empty.
    """
    rows = _rows(docs, id_col, text)
    found = small(components_of(rows))
    marks = materialise(rows.join(found, "print").select("doc_id", "print", ((F.col("print") == F.col("least.print")) & F.col("doc_id").eqNullSafe(F.col("least.doc_id"))).alias("first")))
    # most ids are those of one row and need no fingerprint to find it
    told = marks.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.max("first").alias("first"))
    gone = small(materialise(told.where("n > 1 or not first").select(F.col("doc_id").alias("gone"))))
    own = docs[id_col].cast("long")
    kept = docs.join(gone, own == gone["gone"], "left_anti").where(own.isNotNull())
    again = materialise(told.where("n > 1").select(F.col("doc_id").alias("again")))
    lost = marks.where("doc_id is null").limit(1).count()
    if not lost and not again.limit(1).count():
        return kept
    # the others: rows without an id, or with an id that repeats
    hinted = small(again)
    odd = docs.where(own.isNull()).unionByName(docs.join(hinted, own == hinted["again"], "left_semi"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    packed = odd.select(row.alias("row"), F.col(id_col).cast("long").alias("id_"), fingerprint(F.col(text)).alias("print_"), F.md5(F.to_json(row).cast("binary")).alias("mark"))
    wanted = small(materialise(marks.where("first").select(F.col("doc_id").alias("of"), "print").distinct()))
    stay = packed.join(wanted, (F.col("print_") == F.col("print")) & F.col("id_").eqNullSafe(F.col("of")), "left_semi")
    return kept.unionByName(stay.groupBy("id_", "print_").agg(F.min_by("row", "mark").alias("row")).select("row.*"))
