import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tuplewise.llm import queries, simhash
from tuplewise.llm.common import materialise


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """rows: (id, fingerprint); the smallest id that each can reach."""
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(rows):
        for j in range(i):
            if (a ^ rows[j][1]).bit_count() <= 2:
                x, y = top(i), top(j)
                parent[max(x, y)] = min(x, y)
    groups = {}
    for i, (doc, _) in enumerate(rows):
        groups.setdefault(top(i), []).append(doc)
    least = {g: min((d for d in own if d is not None), default=None) for g, own in groups.items()}
    return [least[top(i)] for i in range(len(rows))]


def test_the_query_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in docs]
    want = sorted((d, f"{f:016x}", c) for (d, f), c in zip(rows, plain_components(rows)))
    assert sorted(tuple(r) for r in queries.op5_simhash(spark, sf).collect()) == want


@pytest.mark.parametrize("bucket", [1, 3, 48])
def test_links_of_dense_groups(spark, bucket):
    """Groups of close fingerprints, chains of links, and strangers; whatever the size of a bucket that counts as hot."""
    rng = np.random.default_rng(bucket)
    prints = []
    for centre in rng.integers(0, 2**63, 12):
        for _ in range(40):
            flips = rng.choice(64, rng.integers(0, 4), replace=False)
            prints.append(int(centre) ^ sum(1 << int(b) for b in flips))
    prints += [int(x) for x in rng.integers(0, 2**63, 150)]
    walk = 0
    for b in rng.permutation(64)[:40]:
        walk ^= 1 << int(b)
        prints.append(walk)
    prints = list(dict.fromkeys(prints))
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    df = materialise(spark.createDataFrame([(p, i) for i, p in enumerate(signed)], "print long, node long"))
    roots = {r.node: r.root for r in simhash.components(simhash.links(df, bucket)).collect()}
    assert [roots.get(i, i) for i in range(len(prints))] == plain_components(list(enumerate(prints)))


def test_every_near_pair_passes_some_chain():
    rng = np.random.default_rng(9)
    for _ in range(300):
        differ = sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 3), replace=False))
        assert any(all((differ & simhash._mask(i, n)).bit_count() <= simhash.budget(n) for n in range(1, 10)) for i in range(9))


def test_nulls_empty_long_repeated_and_clashing(spark):
    rows = [(5, "A b c d"), (3, "a B\tc d"), (3, "a B\tc d"), (None, "a b c d"), (9, None), (8, ""), (7, " \n"), (4, "w " * 100_000), (None, "alone here now"), (2, "é x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("print", F.lit("clash")).withColumn("node", F.lit(1)).withColumn("component_id", F.lit(2))
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect())
    prints = [(d, plain_fingerprint(t)) for d, t in rows]
    assert got == sorted((str(d), f"{f:016x}", c) for (d, f), c in zip(prints, plain_components(prints)))
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    kept = simhash.one_each(df)
    assert kept.columns == df.columns
    assert sorted((str(r.doc_id), r.text[:5]) for r in kept.collect()) == [("2", "é x"), ("3", "a B\tc"), ("4", "w w w"), ("7", " \n"), ("None", "alone")]


def test_texts_that_share_an_id_are_not_lost(spark):
    same, other = "one two three four five six", "quite another text stands right here now"
    rows = [(3, same), (5, same), (5, other), (8, same), (None, other + " alone"), (None, other + " alone"), (7, "x y z"), (7, "x y z")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("gone", F.lit(1)).withColumn("again", F.lit("c"))
    got = sorted((str(r.doc_id), r.text) for r in simhash.one_each(df).collect())
    assert got == sorted([("3", same), ("5", other), ("None", other + " alone"), ("7", "x y z")])
    assert simhash.one_each(df.limit(0)).count() == 0
    # a shared id links nothing
    marks = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()}
    assert (5, 3) in marks and (5, 5) in marks


def test_one_row_of_each_group_against_brute_force(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 40, 30)) for _ in range(12)] + ["", None, "é"]
    rows = [(None if rng.random() < 0.1 else int(rng.integers(0, 25)), texts[rng.integers(len(texts))]) for _ in range(90)]
    prints = [(d, plain_fingerprint(t)) for d, t in rows]
    parent = plain_components([(i, f) for i, (_, f) in enumerate(prints)])
    want = []
    for g in set(parent):
        own = [((d is None, d or 0, f if f < 2**63 else f - 2**64), t) for (d, f), (_, t), p in zip(prints, rows, parent) if p == g]
        want.append(min(own, key=lambda x: x[0])[0])
    kept = simhash.one_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    signed = [(r.doc_id is None, r.doc_id or 0, f if f < 2**63 else f - 2**64) for r in kept for f in [plain_fingerprint(r.text)]]
    assert sorted(signed) == sorted(want)
