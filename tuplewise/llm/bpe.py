"""BPE encoding and decoding with content-defined chunks.

A rolling hash over the text's bytes cuts it into chunks, always where a word
starts, so that passages which documents share fall into the same chunks. The
texts of a batch are cut together: each distinct chunk that the worker's store
doesn't hold is encoded once, whatever documents it came from. Chunk joins are
then repaired: the words on both sides of a join are encoded together and must
give the tokens that they give apart; where they don't, the chunks are merged and
encoded again, until all joins agree.

Where the tokenizer's file proves that white space leaves no trace in ids
(``words_apart``), a new chunk is put together from its words, each distinct word
of a batch being encoded once.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from tuplewise.llm.common import keep as keep_
from tuplewise.llm.common import small_batches

#: Bytes that the rolling hash sees; a chunk begins at a word start whose hash has its top BITS bits 0, one in 2**BITS.
WINDOW, BITS = 8, 7
#: Bytes that a worker keeps of chunks, words and joins in each of a store's two generations, and what an entry takes besides its texts.
CHUNKS, WORDS, JOINS, ENTRY = 3_000_000, 16_000_000, 2_000_000, 300
#: Bytes of text that are cut and encoded together, unless one text is longer; pieces in one call of the tokenizer.
BATCH, CALL = 1_000_000, 512
_SPACE = b" \t\n\r\x0b\x0c"
_WORD = re.compile(rb"[^\x20\x09-\x0d]+")
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


class Store(dict):
    """A dictionary of two generations, bounded in bytes: once the younger is full it becomes the older, and that one goes.

    What is looked up in the older one moves to the younger, so common entries stay.
    """

    def __init__(self, limit: int):
        self.limit, self.held, self.old = limit, 0, {}

    def learn(self, key, value: tuple[bytes, bytes], size: int) -> None:
        self[key] = value
        self.held += size + len(value[0]) + len(value[1]) + ENTRY

    def known(self, key) -> bool:
        """Whether ``key`` is held; if only by the older generation, it moves."""
        if key in self:
            return True
        value = self.old.get(key)
        if value is None:
            return False
        self.learn(key, value, len(key) if isinstance(key, bytes) else sum(map(len, key)))
        return True

    def trim(self) -> None:
        if self.held > self.limit:
            self.old = dict(self)
            self.clear()
            self.held = 0


def cuts(data: bytes) -> list[int]:
    """Byte offsets where chunks begin, 0 not included: word starts chosen by a hash of the 8 bytes before them."""
    if len(data) <= WINDOW:
        return []
    raw = np.frombuffer(data, np.uint8)
    starts = np.flatnonzero(raw[WINDOW - 1 : -1] <= 32) + WINDOW
    windows = np.ndarray((len(data) - WINDOW + 1,), "<u8", buffer=data, strides=(1,))
    rolled = windows[starts - WINDOW] * _MULTIPLY
    chosen = starts[rolled >> np.uint64(64 - BITS) == 0].tolist()
    return [i for i in chosen if data[i - 1] in _SPACE and data[i] not in _SPACE]


#: An alternative of a split pattern that can't match white space: a clitic, letters, a digit, or other signs.
_TIGHT = re.compile(r"'[a-z]+|\[?\\p\{[LN]\}\]?\+?|\[\^\\s(?:\\p\{[LN]\})*\]\+")


def words_apart(spec: dict) -> bool:
    """Whether a tokenizer's file proves that the ids of a text are those of its words, one word after another.

    Words are what ASCII white space separates. Each step must keep to one word: NFC
    and lower-casing look across no space; white space is at most made one space;
    the split keeps only matches, and its pattern matches no white space; bytes are
    then mapped within a match; no added token holds or strips white space; and
    nothing is put around the whole.
    """
    steps = spec.get("normalizer") or {}
    for n in steps.get("normalizers", [steps]):
        collapse = n.get("type") == "Replace" and n.get("pattern") == {"Regex": r"\s+"} and n.get("content") == " "
        if n.get("type") not in (None, "NFC", "Lowercase") and not collapse:
            return False
    first, *others = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    split = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True
    if not split or not all(map(_TIGHT.fullmatch, first["pattern"].get("Regex", "").split("|"))):
        return False
    if not all(o.get("type") == "ByteLevel" and not o.get("add_prefix_space") and not o.get("use_regex") for o in others):
        return False
    added = spec.get("added_tokens") or []
    return not spec.get("post_processor") and not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)


class Encoder:
    """One worker's tokenizer and what it has encoded: (ids as decimal text, decoded text), in bytes.

    Pieces that agree at their joins are put together by one space.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        # a task has one core; threads of its own would only keep memory of their own
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tok = Tokenizer.from_file(path)
        self.tok.no_padding()
        self.tok.no_truncation()
        self.chunks, self.words, self.joins = Store(CHUNKS), Store(WORDS), Store(JOINS)
        size = self.tok.get_vocab_size()
        self.shown = [str(i).encode() for i in range(size)]
        #: Without a decoder tokens are joined by spaces, so decoding is a lookup.
        self.plain = self.tok.decoder is None
        self.names = [(self.tok.id_to_token(i) or "").encode() for i in range(size)]
        self.by_word = self.plain and words_apart(json.loads(Path(path).read_text("utf-8")))

    def _pair(self, ids: list[int]) -> tuple[bytes, bytes]:
        return b" ".join([self.shown[i] for i in ids]), b" ".join([self.names[i] for i in ids]) if self.plain else b""

    def _encode(self, texts: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        for at in range(0, len(texts), CALL):
            for got in self.tok.encode_batch_fast([t.decode() for t in texts[at : at + CALL]], add_special_tokens=False):
                yield self._pair(got.ids)

    def _learn(self, store: Store, texts: Iterable[bytes], by_word: bool) -> None:
        """Have ``store`` hold each of ``texts``, encoding the new ones together."""
        new = [t for t in dict.fromkeys(texts) if not store.known(t)]
        if not by_word:
            for text, pair in zip(new, self._encode(new)):
                store.learn(text, pair, len(text))
            return
        cut = [t.split() for t in new]
        get = self.words.get
        missing = [w for own in cut for w in own if get(w) is None]
        if missing:
            self._learn(self.words, missing, False)
        for text, own in zip(new, cut):
            got = [x for x in map(get, own) if x[0]]
            ids, names = zip(*got) if got else ((), ())
            store.learn(text, (b" ".join(ids), b" ".join(names)), len(text))

    def _ends(self, left: bytes, right: bytes) -> tuple[bytes, bytes]:
        """The last word of ``left`` with the white space after it, and the first of ``right``."""
        last = left.rsplit(None, 1)
        begin = _WORD.search(right)
        return left[len(left.rstrip()) - len(last[-1]) :] if last else left, right[: begin.end()] if begin else right

    def _agreed(self, joins: list[tuple[bytes, bytes]]) -> None:
        """Have ``joins`` hold of each pair whether it encodes together to what its parts encode to apart."""
        new = [j for j in dict.fromkeys(joins) if not self.joins.known(j)]
        if new:
            got = [x for x, _ in self._encode([t for a, b in new for t in (a, b, a + b)])]
            for j, a, b, both in zip(new, got[::3], got[1::3], got[2::3]):
                self.joins.learn(j, (b"1" if b" ".join(x for x in (a, b) if x) == both else b"", b""), len(j[0]) + len(j[1]))

    def encode_all(self, texts: list[bytes]) -> list[tuple[bytes, bytes]]:
        """The ids of each text as decimal text, and the decoded text."""
        parts = []
        for data in texts:
            bounds = [0, *cuts(data), len(data)]
            parts.append([data[a:b] for a, b in zip(bounds, bounds[1:])])
        # a chunk begins with a word, so what stands at a join stays the same when chunks are merged
        ends = [[self._ends(a, b) for a, b in zip(own, own[1:])] for own in parts]
        self._agreed([e for own in ends for e in own])
        for own, at in zip(parts, ends):
            merged = own[:1]
            for part, e in zip(own[1:], at):
                if self.joins[e][0]:
                    merged.append(part)
                else:
                    merged[-1] += part
            own[:] = merged
        self._learn(self.chunks, (p for own in parts for p in own), self.by_word)
        out = []
        for own in parts:
            got = [x for x in map(self.chunks.__getitem__, own) if x[0]]
            ids = b" ".join([x for x, _ in got])
            if self.plain:
                out.append((ids, b" ".join([x for _, x in got])))
            else:
                out.append((ids, self.tok.decode([int(i) for i in ids.split()], skip_special_tokens=False).encode()))
        for store in (self.chunks, self.joins, self.words):
            store.trim()
        return out

    def encode(self, text: str) -> tuple[bytes, bytes]:
        return self.encode_all([text.encode()])[0]


def encoder(path: str) -> Encoder:
    """This worker's encoder for the tokenizer at ``path``, kept between tasks; its stores are bounded in bytes."""
    return keep_("bpe", path, lambda: Encoder(path))


def _groups(texts: pa.Array) -> Iterator[list[bytes]]:
    """The texts in lists of BATCH bytes at most, or of one text."""
    held, size = [], 0
    for x in texts:
        data = (x.as_py() or "").encode()
        if held and size + len(data) > BATCH:
            yield held
            held, size = [], 0
        held.append(data)
        size += len(data)
    if held:
        yield held


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: name: (Spark type, Arrow type, from the ids as text and the decoded text)
OUTPUTS = {
    "n_tokens": ("long", pa.int64(), lambda ids, text: ids.count(b" ") + 1 if ids else 0),
    "ids": ("array<int>", pa.list_(pa.int32()), lambda ids, text: np.fromstring(ids, np.int32, sep=" ") if ids else []),
    "decoded": ("string", pa.string(), lambda ids, text: text.decode()),
    "ids_sha256": ("string", pa.string(), lambda ids, text: hashlib.sha256(ids).hexdigest()),
    "decoded_sha256": ("string", pa.string(), lambda ids, text: hashlib.sha256(text).hexdigest()),
}


def encode(df: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", path: str | None = None, outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded")) -> DataFrame:
    """The columns ``keep`` of ``df`` and the asked ``outputs`` of each whole text.

    Ids are those of the tokenizers library without added special tokens,
    truncation or padding; ``decoded`` is its decode() of them with special tokens
    kept. ``path`` names the tokenizer file (the public word BPE by default).
    Null and empty texts have no tokens and decode to the empty text. Each row is
    encoded alone, so repeated rows repeat and an empty table gives none; columns
    outside ``keep`` are not read.
    """
    small_batches(df.sparkSession)
    path = path or default_path()
    kept = df.select(*[f"`{c}`" for c in keep])
    schema = StructType([*kept.schema.fields, *StructType.fromDDL(", ".join(f"{o} {OUTPUTS[o][0]}" for o in outputs)).fields])
    names = [*keep, *outputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            made: list[list] = [[] for _ in outputs]
            for texts in _groups(batch.column(len(keep))):
                for ids, decoded in own.encode_all(texts):
                    for to, o in zip(made, outputs):
                        to.append(OUTPUTS[o][2](ids, decoded))
            new = [pa.array(x, OUTPUTS[o][1]) for x, o in zip(made, outputs)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *new], names)

    return df.select(*[f"`{c}`" for c in keep], f"`{text}`").mapInArrow(run, schema)


def decode(df: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """``df`` with column ``decoded``: the text of each id array; a null array decodes to the empty text."""
    small_batches(df.sparkSession)
    path = path or default_path()
    keep = [c for c in df.columns if c != "decoded"]
    kept = df.select(*[f"`{c}`" for c in keep])
    schema = StructType([*kept.schema.fields, *StructType.fromDDL("decoded string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = encoder(path).tok
        for batch in batches:
            texts = tok.decode_batch([x or [] for x in batch.column(keep.index(ids)).to_pylist()], skip_special_tokens=False)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*keep, "decoded"])

    return kept.mapInArrow(run, schema)
