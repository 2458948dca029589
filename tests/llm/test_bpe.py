import hashlib
import json
from pathlib import Path

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tuplewise.llm import bpe, queries

PATHS = [public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json")]
WORDS = ["Thes", "erhe***", "DON'T", "it's", "é", "É", "ÉA!!", "é", "́x", "漢字", "😀", "İI", "ΣΑΣ", "<|endoftext|>", "a<|startoftext|>b", "12", "a1.", "\x1c", "\x85", "\xa0", "ß,", "x" * 70, "...", "''s", "of", "the"]


def want(path, text):
    tok = Tokenizer.from_file(path)
    ids = tok.encode(text, add_special_tokens=False).ids
    return " ".join(map(str, ids)).encode(), tok.decode(ids, skip_special_tokens=False).encode()


@pytest.mark.parametrize("path", PATHS)
@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(WORDS), st.sampled_from([" ", "\n", "  ", "\t\n", "\r\n"])), max_size=700))
def test_any_text_is_encoded_as_the_library_does(path, pieces):
    text = "".join(a + b for a, b in pieces)
    assert bpe.encoder(path).encode(text) == want(path, text)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=400))
def test_odd_texts(text):
    assert bpe.encoder(PATHS[0]).encode(text) == want(PATHS[0], text)


def test_shared_passages_fall_into_the_same_chunks():
    shared = " ".join(f"word{i * 7919 % 10007}x" for i in range(3000)).encode()
    one, two = shared, b"something else before it " + shared
    parts = lambda d: {d[a:b] for a, b in zip([0, *bpe.cuts(d)], [*bpe.cuts(d), len(d)])}
    assert len(parts(one) & parts(two)) >= len(parts(one)) - 2 > 3


def test_chunks_that_disagree_are_merged(monkeypatch):
    """The byte-level tokenizer keeps a space with the word after it, so its chunks never agree."""
    own = bpe.Encoder(PATHS[1])
    text = " ".join(f"word{i}" for i in range(2000))
    assert len(bpe.cuts(text.encode())) > 3 and own.encode(text) == want(PATHS[1], text)
    assert set(own.chunks) == {text.encode()} and {v[0] for v in own.joins.values()} == {b""}


def test_chunks_of_a_batch_are_encoded_once(monkeypatch):
    shared = " ".join(f"word{i * 7919 % 10007}x" for i in range(3000))
    texts = [f"{n} stands before it {shared} and {n} after".encode() for n in ("one", "two", "three")]
    own, seen = bpe.Encoder(PATHS[0]), []
    plain = own._encode
    monkeypatch.setattr(own, "_encode", lambda some: seen.extend(some) or plain(some))
    assert own.encode_all(texts) == [want(PATHS[0], t.decode()) for t in texts]
    parts = [data[a:b] for data in texts for a, b in zip([0, *bpe.cuts(data)], [*bpe.cuts(data), len(data)])]
    assert len(own.chunks) == len(set(parts)) < len(parts) / 2
    words = [w for w in seen if w.isalnum()]
    assert len(words) - len(set(words)) < len(own.joins) * 2 + 1
    seen.clear()
    assert own.encode_all(texts[::-1])[0] == want(PATHS[0], texts[2].decode()) and not seen


def test_the_file_proves_that_words_stand_apart():
    spec = json.loads(Path(PATHS[0]).read_text())
    assert bpe.words_apart(spec) and not bpe.words_apart(json.loads(Path(PATHS[1]).read_text()))
    for change in ({"post_processor": {"type": "x"}}, {"normalizer": {"type": "Prepend"}}, {"pre_tokenizer": None}, {"added_tokens": [{"content": "a b", "lstrip": False, "rstrip": False, "single_word": False}]}):
        assert not bpe.words_apart(spec | change)
    first = spec["pre_tokenizer"]["pretokenizers"][0]
    for pattern in (r"\s?[\p{L}]+", r"[^\p{L}]+", "."):
        assert not bpe.words_apart(spec | {"pre_tokenizer": {"type": "Sequence", "pretokenizers": [first | {"pattern": {"Regex": pattern}}]}})


def test_stores_forget_the_older_generation():
    store = bpe.Store(3 * bpe.ENTRY)
    for i in range(4):
        store.learn(b"%d" % i, (b"x", b"y"), 1)
    store.trim()
    assert len(store) == 0 and store.held == 0 and store.known(b"2") and list(store) == [b"2"] and not store.known(b"9")


def test_stores_are_bounded_in_bytes(monkeypatch):
    monkeypatch.setattr(bpe, "WORDS", 200_000)
    monkeypatch.setattr(bpe, "CHUNKS", 200_000)
    own = bpe.Encoder(PATHS[0])
    for i in range(60):
        own.encode(chr(0x4E00 + i) * 20_000 + " end")
        assert sum(len(k) + len(v[0]) + len(v[1]) for s in (own.words, own.chunks) for g in (s, s.old) for k, v in g.items()) < 1_500_000


@pytest.mark.parametrize("letter", ["a", "é", "漢", "😀"])
@pytest.mark.parametrize("size", [1, 2, 7, 8, 9, 63, 4095, 4097, 70_000])
def test_words_of_any_length_and_width(letter, size):
    for text in (letter * size, f"{letter * size} x {letter * size}\nend", f" {letter * size}"):
        assert bpe.encoder(PATHS[0]).encode(text) == want(PATHS[0], text)


def test_a_word_of_a_megabyte():
    text = "ab" * 500_000 + " and more"
    assert bpe.encoder(PATHS[0]).encode(text) == want(PATHS[0], text)


def test_small_stores_give_the_same_ids(monkeypatch):
    monkeypatch.setattr(bpe, "WORDS", 4000)
    monkeypatch.setattr(bpe, "CHUNKS", 1000)
    monkeypatch.setattr(bpe, "JOINS", 500)
    own = bpe.Encoder(PATHS[0])
    for seed in range(5):
        text = " ".join(WORDS[(i * (seed + 3)) % len(WORDS)] + str(i % 9) for i in range(900))
        assert own.encode(text) == want(PATHS[0], text)


def test_the_query_against_the_library(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r.doc_id: r for r in queries.op3_bpe(spark, sf).collect()}
    assert len(got) == len(rows)
    for r in rows:
        ids, text = want(PATHS[0], r.text)
        g = got[r.doc_id]
        assert (g.n_tokens, g.ids_sha256, g.decoded_sha256) == (len(ids.split()), hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest())


def test_null_empty_long_and_clashing(spark):
    rows = [(1, None), (1, ""), (None, " "), (2, "Ab " * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = sorted((r.doc_id or 0, r.n_tokens, len(r.ids), len(r.decoded)) for r in bpe.encode(df).collect())
    assert got[:3] == [(0, 0, 0, 0), (1, 0, 0, 0), (1, 0, 0, 0)] and got[3][1] == got[3][2] == 200_000
    assert bpe.encode(df.limit(0)).count() == 0
    back = bpe.decode(bpe.encode(df, outputs=("ids",))).collect()
    assert {len(r.decoded) for r in back} == {0, got[3][3]}


@pytest.mark.parametrize("path", PATHS)
def test_a_long_word_before_a_cut(path):
    texts = ["漢" * 1500 + f"{i:04d} next words" for i in range(2000)]
    cut = [t for t in texts if t.index(" ") + 3001 in bpe.cuts(t.encode())][:3]
    own = bpe.Encoder(path)
    assert len(cut) == 3 and all(own.encode(t) == want(path, t) for t in cut)
    assert own._ends(("b é" + "é" * 3000 + " ").encode(), b"x y") == (("é" * 3001 + " ").encode(), b"x")
