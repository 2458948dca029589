import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tuplewise.llm import langid, quality, queries, urls


def test_the_url_query_is_its_sql(spark, sf, same):
    same(queries.op6_urls(spark, sf), queries.oracle_sql()["op6_urls"])


URLS = [
    ("https://Www.Example.NET/en/x?y=1", "www.example.net", "/en/x", "example.net/en/", "allow"),
    ("http://example.net/de/", "example.net", "/de/", "net/", "block"),
    ("http://a.net?x=/en/", "a.net", "", None, None),
    ("x://notexample.net/en/", "notexample.net", "/en/", "net/", "block"),
    ("http://m.example.com/de/1#f", "m.example.com", "/de/1", "example.com/de/", "block"),
    ("http://example.com/DE/1", "example.com", "/DE/1", None, None),
    ("http://a.org/fr/?q", "a.org", "/fr/", "org/fr/", "allow"),
    ("a.org/fr/", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("", "", "", None, "allow"),
    ("http://É.Org#x://y", "É.org", "", None, None),
    ("http://u@h:80/p\nq?", "u@h:80", "/p\nq", None, None),
]


def test_urls(spark):
    df = spark.createDataFrame([(i, u[0]) for i, u in enumerate(URLS)], "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("verdict", F.lit("clash"))
    got = urls.judge(df).orderBy("page_id").collect()
    for (url, host, path, rule, verdict), r in zip(URLS, got):
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block") and verdict in (None, r.verdict)
        assert urls.split_url(url or "") == (host, path)
    assert urls.judge(df.limit(0)).count() == 0
    assert urls.judge(spark.createDataFrame([(1, "http://" + "a." * 20_000 + "org/" + "p" * 50_000)], "page_id long, url string")).first().verdict in ("allow", "block")


def test_precision_and_recall_on_names_that_were_held_out(spark):
    table = urls.labelled_urls()
    host = lambda u: u.split("/")[2]
    assert len({u for u, _, _ in table}) == len(table) and {bad for _, bad, held in table if held} == {0, 1}
    df = spark.createDataFrame([(i, u) for i, (u, _, _) in enumerate(table)], "page_id long, url string")
    got = {r.page_id: r.verdict == "block" for r in urls.judge(df, rules=()).collect()}
    for held, precision, recall in ((False, 0.98, 0.98), (True, 0.95, 0.9)):
        own = [(got[i], bad) for i, (_, bad, h) in enumerate(table) if h == held]
        right = sum(b and p for p, b in own)
        assert right / sum(p for p, _ in own) > precision and right / sum(b for _, b in own) > recall
    known = {host(u) for u, _, held in table if not held}
    assert all(host(u).partition(".")[2] not in known for u, _, held in table if held)


def test_the_regression_against_its_own_sums(spark):
    bias, weights = urls.train()
    texts = ["http://www.casino-house.org/x", "https://city-library.info/en/", "http://é.com/ü?x", "http://a/", ""] + [u for u, _, _ in urls.labelled_urls()[::97]]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(texts)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in urls.judge(df, rules=()).collect()}
    for i, u in enumerate(texts):
        own = urls._buckets(*urls.split_url(u))
        assert got[i] == ("block" if bias * max(1, len(own)) ** 0.5 + sum(weights[b] for b in own) > 0 else "allow")
    assert got[0] == "block" and got[1] == "allow"


def test_language_accuracy_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.op7_langid(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.95
    assert sum(r.rejected for r in held) / len(held) < 0.05


def test_language_of_odd_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").limit(150)
    odd = [(-1, None, None), (-2, "", "en"), (-3, "12 !!", "de"), (None, "the thing and the other", None), (-5, "der und die das " * 50_000, "xx"), (-5, "der und die das " * 50_000, "xx")]
    df = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string")).withColumn("score", F.lit("clash")).withColumn("text_", F.lit(1))
    got = langid.identify(df)
    assert set(got.columns) == {*df.columns, "lang_pred", "score", "rejected"}
    by = {r.doc_id: r for r in got.collect()}
    assert all(by[i].lang_pred == "und" and by[i].rejected and by[i].score == 0 for i in (-1, -2, -3))
    assert by[-5].lang_pred in ("de", "xx") and by[None].lang_pred != "und"
    assert langid.identify(df.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identify(df, dictionaries={}).collect()} == {"und"}


def test_held_out_rows_and_labels_do_not_change_a_prediction(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    one = langid.identify(docs, keep=("doc_id",))
    two = langid.identify(docs.withColumn("lang", F.when(held, F.lit("zz")).otherwise(F.col("lang"))).withColumn("source", F.lit("s")), keep=("doc_id",))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = queries.op9_quality(spark, sf).collect()
    assert len(got) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in held) / len(held) > 0.93
    good, bad = ([r.score for r in held if labels[r.doc_id] == y] for y in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert sorted(map(tuple, got)) == sorted(map(tuple, queries.op9_quality(spark, sf).collect()))


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "a b"), (3, "x\x01y " * 100_000), (3, "x")], "doc_id long, text string").withColumn("bag", F.lit(1)).withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(1, None), (None, 1), (3, 0)], "doc_id long, quality int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert quality.classify(docs, labels.limit(0)).count() == 5 and quality.classify(docs.limit(0), labels).count() == 0


def test_repeated_ids_are_learned_from_once(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    more = docs.unionByName(docs.where("doc_id < 40")).unionByName(docs.where("doc_id < 40"))
    assert langid.learn(docs, allowed=None).keys() == langid.learn(more, allowed=None).keys()
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    one, two = quality.learn(docs, labels), quality.learn(more, labels.unionByName(labels))
    assert all(np.array_equal(one.p[k], two.p[k]) for k in one.p)


def plain_passages(text):
    """Words of at most 64 bytes, 64 to a passage: (words, the passage's bytes)."""
    data, words = text.encode(), []
    for m in re.finditer(rb"[^\x20\x09-\x0d]+", data):
        words += [(m.start() + i, m[0][i : i + 64]) for i in range(0, len(m[0]), 64)]
    if not words:
        return [([], data, 0)]
    edges = [0, *(words[i][0] for i in range(64, len(words), 64)), len(data)]
    return [([w for _, w in words[k * 64 : k * 64 + 65]], data[a:b], min(64, len(words) - k * 64)) for k, (a, b) in enumerate(zip(edges, edges[1:]))]


def plain_bucket(h):
    h &= 2**64 - 1
    return ((((h ^ h >> 31) * 0x9E3779B97F4A7C15) & 2**64 - 1) >> 52)


def plain_score(model, text):
    """The forward pass with plain numbers, one passage after another."""
    tables, powers = quality._RANDOM.tolist(), quality._POWERS.tolist()
    data = text.encode()
    hs, attention, at = [], [], 0
    for words, own, n in plain_passages(text):
        word = lambda w: sum(tables[0][c] * powers[i] for i, c in enumerate(w.lower())) & 2**64 - 1
        hashes = [word(w) for w in words]
        low = (data + b"\n")[at : at + len(own) + 2].lower()
        at += len(own)
        three = [sum(tables[j + 1][low[i + j]] for j in range(3)) for i in range(len(own)) if own[i] not in b" \t\n\r\x0b\x0c" and i + 2 < len(low)]
        grams = [[plain_bucket(h) for h in hashes[:n]], [4096 + plain_bucket(a * 3 + b) for a, b in zip(hashes[:n], hashes[1:])], [8192 + plain_bucket(h) for h in three]]
        kinds = [sum(map(f, own)) for f in (lambda c: 97 <= c <= 122, lambda c: 65 <= c <= 90, lambda c: 48 <= c <= 57, lambda c: c in b" \t\r\x0b\x0c", lambda c: c == 10, lambda c: 33 <= c <= 126 and not chr(c).isalnum(), lambda c: c >= 128, lambda c: c < 32 and c not in b"\t\n\r\x0b\x0c" or c == 127)]
        same = sum(a == b for a, b in zip(hashes[:n], hashes[1:]))
        style = [k / max(1, len(own)) for k in kinds] + [len(own) / max(1, n) / 10, same / max(1, n), math.log1p(n) / 5]
        pre = (np.array(style) - model.mean) / model.scale @ model.p["W"] + model.p["b"]
        for rows in grams:
            if rows:
                pre = pre + sum(model.p["E"][r] for r in rows) / len(rows)
        h = np.tanh(pre)
        hs.append(h)
        attention.append(float((np.tanh(h @ model.p["V"]) / (1 + np.exp(-h @ model.p["U"]))) @ model.p["w"]))
    share = np.exp(np.array(attention) - max(attention))
    return 1 / (1 + math.exp(-float((share / share.sum()) @ np.array(hs) @ model.p["c"] + model.p["d"][0])))


def test_scores_against_a_plain_forward_pass():
    rng = random.Random(1)
    texts = ["", " \n", "a", "x" * 1000, "Ab cd"] + ["".join(rng.choice(["ab ", "C1", "é", "\n", "  ", ". ", "\x01", "the ", "漢" * 50]) for _ in range(n)) for n in (3, 80, 500, 2000)]
    model = quality.Model()
    model.p = {k: np.random.default_rng(3).normal(0, 0.3, w.shape) for k, w in model.p.items()}
    model.mean, model.scale = np.full(quality.STYLE, 0.1), np.full(quality.STYLE, 0.7)
    got = model.score(quality.encode([t.encode() for t in texts]))
    assert np.allclose(got, [plain_score(model, t) for t in texts], atol=1e-5)
    alone = [model.score(quality.encode([t.encode()]))[0] for t in texts]
    assert np.allclose(got, alone, atol=1e-9)
    back = quality.Bags.join([quality.encode([t.encode()]).to_bytes() for t in texts])
    assert np.allclose(model.score(back), got, atol=1e-5)


def test_passages_cover_the_whole_text():
    rng = random.Random(1)
    for n in (1, 63, 64, 65, 1000):
        text = " \n".join("ab|C1é"[rng.randrange(6)] * rng.randrange(1, 5) for _ in range(n))
        got = quality.encode([text.encode()])
        assert got.sizes.tolist() == [-(-n // 64)] and [len(r) for r, _ in got.grams][:2] == [n, n - 1]
        sizes = got.style[:, quality.CLASSES] * 10 * np.array([min(64, n - i) for i in range(0, n, 64)])
        assert round(float(sizes.sum())) == len(text.encode())


def test_gradients_against_differences():
    texts = [b"one two three", b"red green " * 80, b"x", b"blue " * 70]
    bags, y = quality.encode(texts), np.array([1.0, 0.0, 1.0, 0.0])
    model = quality.Model()
    model.p["E"] = np.random.default_rng(2).normal(0, 0.2, model.p["E"].shape)
    loss = lambda: -np.mean(y * np.log(model.score(bags)) + (1 - y) * np.log(1 - model.score(bags)))
    grads = model.gradients(bags, y)
    for k, w in model.p.items():
        at = np.unravel_index(np.abs(grads[k]).argmax(), w.shape)
        before, step = w[at], 1e-3
        w[at] = before + step
        up = loss()
        w[at] = before - step
        down = loss()
        w[at] = before
        assert abs((up - down) / (2 * step) - grads[k][at]) < 2e-3 * max(1, abs(grads[k][at])) + 1e-5


SUBJECTS, VERBS, THINGS = "the farmer|a teacher|my sister|the old captain|our neighbour".split("|"), "sells|watches|paints|repairs|remembers".split("|"), "a wooden boat|the red barn|an apple tree|two small dogs|the quiet village".split("|")


def sentences(rng, n):
    return [f"{rng.choice(SUBJECTS)} {rng.choice(VERBS)} {rng.choice(THINGS)}" for _ in range(n)]


def test_fluent_nonsense_scores_below_prose():
    """The same words and signs, in no order: only word pairs and trigrams across words tell it from prose."""
    rng = random.Random(7)
    texts, labels = [], []
    for i in range(300):
        own = sentences(rng, rng.randint(8, 30))
        if i % 2:
            words = " ".join(own).split()
            rng.shuffle(words)
            own = [" ".join(words)]
        texts.append((" ".join(own)).encode())
        labels.append(1.0 - i % 2)
    model = quality.Model().fit(quality.encode(texts[:200]), np.array(labels[:200]), epochs=30)
    got, y = model.score(quality.encode(texts[200:])), np.array(labels[200:])
    assert np.mean(got[y == 1][:, None] > got[y == 0][None, :]) > 0.95


def test_one_bad_passage_is_found():
    """Documents of good passages, half of them with one passage of junk somewhere."""
    rng = random.Random(8)
    texts = []
    for i in range(240):
        parts = [" ".join(sentences(rng, 9)) for _ in range(rng.randint(3, 6))]
        if i % 2:
            parts[rng.randrange(len(parts))] = " ".join(rng.choice(["click", "buy", "now", "win", "cash"]) for _ in range(64))
        texts.append(" ".join(parts).encode())
    y = np.array([1.0 - i % 2 for i in range(240)])
    model = quality.Model().fit(quality.encode(texts[:180]), y[:180], epochs=20)
    assert np.mean((model.score(quality.encode(texts[180:])) > 0.5) == y[180:]) > 0.9


def test_languages_against_a_plain_compress_and_compare():
    """Each text with each dictionary by the plain interface of zstandard, no sizes shared."""
    import zstandard

    made = {"en": b"the and of to in that is was for with as on be at by this " * 40, "de": b"der und die das ist nicht ein mit sich des auf dem von zu " * 40, "fr": b"le la les et des une est que dans pour qui sur pas au " * 40}
    codes = langid._compressors(made)
    for text in ["the way of the world is that", "und das ist nicht der", "que la vie est dans les", "x", "", None, "12 34", "The THE der", "la der the " * 500, "é"]:
        name, score, rejected = langid.predict(text, codes)
        if text is None or not any(c.isalpha() for c in text):
            assert (name, score, rejected) == ("und", 0.0, True)
            continue
        data, sizes = "".join(c for c in text.lower() if c.isalpha() or ord(c) > 127 or c in " \t\n\x7f" or ord(c) < 33).encode(), {}
        for lang, own in made.items():
            params = zstandard.ZstdCompressionParameters.from_level(langid.LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0)
            sizes[lang] = len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(own, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params).compress(data))
        least, second = sorted(sizes.values())[:2]
        assert sizes[name] == least and name == next(x for x in made if sizes[x] == least)
        assert rejected == (second - least < 1 or second - least < 0.004 * min(len(data), 1000))
        assert math.isclose(score, 1 / sum(2.0 ** -min(60, v - least) for v in sizes.values()))


@pytest.mark.parametrize("text", ["a", "the " * 30, "Ä" * 50])
def test_compression_prefers_its_own_language(text):
    codes = langid._compressors({"en": b"the and of to in that is " * 50, "de": b"der und die das ist nicht " * 50})
    assert langid.predict("that is the end of and to", codes)[0] == "en"
    assert 0 <= langid.predict(text, codes)[1] <= 1
