"""Quality classifier: attention-based multiple-instance learning over a document's passages.

A document is a bag of passages of WORDS words. A passage is encoded by learned
vectors of its hashed words, word pairs and character trigrams, averaged by kind,
together with how it is written (shares of kinds of bytes, lengths). A small
network learns from document labels alone what passages look like and which of
them matter (gated attention), and scores their weighted sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuplewise.llm.common import held_out, small_batches

#: Words of a passage, and bytes of a word, a longer one being cut into words of that size.
WORDS, LONG = 64, 64
#: The bound of the sample: labelled documents that are fitted, and passages of each, evenly spread over its whole text.
SAMPLE, PASSAGES = 2000, 6
#: Buckets for each of the three kinds of n-gram, sizes of the two layers.
BUCKETS, HIDDEN, GATE = 4096, 16, 8
#: Documents of a training step, passes over the sample, step size, and how much weights decay.
STEP, EPOCHS, RATE, DECAY = 64, 6, 0.01, 1e-4
#: Scores from here on predict label 1.
CUT = 0.3
#: Bytes of texts that are encoded together, unless one text is longer; passages whose n-grams are looked up together.
BATCH, SLICE = 400_000, 512

#: Kinds of bytes: lower, upper, digit, space, line feed, punctuation, beyond ASCII, control.
CLASSES = 8
_CLASS = np.full(256, 7, np.uint8)
for _i, _own in enumerate((range(97, 123), range(65, 91), range(48, 58), b" \t\r\x0b\x0c", b"\n")):
    _CLASS[list(_own)] = _i
_CLASS[[x for x in range(33, 127) if not chr(x).isalnum()]] = 5
_CLASS[128:] = 6
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
_BLANK = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
STYLE = CLASSES + 3
_RANDOM = np.random.default_rng(11).integers(0, 2**64, (4, 256), np.uint64)
_POWERS = np.random.default_rng(12).integers(0, 2**63, LONG, np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(64 - (BUCKETS - 1).bit_length())


def _bucket(h: np.ndarray) -> np.ndarray:
    return (((h ^ (h >> np.uint64(31))) * _MIX) >> _SHIFT).astype(np.int32)


class Bags:
    """Passages of some documents: ``sizes`` by document, ``style`` by passage, and for each kind of n-gram its
    rows in the table of vectors with the number of them by passage."""

    def __init__(self, sizes: np.ndarray, style: np.ndarray, grams: list[tuple[np.ndarray, np.ndarray]]):
        self.sizes, self.style, self.grams = sizes, style, grams

    def pick(self, chosen: np.ndarray, sizes: np.ndarray) -> "Bags":
        """Only the passages numbered ``chosen``, rising."""
        grams = []
        for rows, counts in self.grams:
            keep = np.zeros(len(counts), bool)
            keep[chosen] = True
            grams.append((rows[np.repeat(keep, counts)], counts[chosen]))
        return Bags(sizes, self.style[chosen], grams)

    def to_bytes(self) -> bytes:
        parts = [np.array([len(self.sizes), len(self.style), *(len(r) for r, _ in self.grams)], np.int64), self.sizes.astype(np.int64), self.style.astype(np.float32)]
        return b"".join(x.tobytes() for x in [*parts, *(y.astype(np.int32) for g in self.grams for y in g)])

    @staticmethod
    def join(all_: list[bytes]) -> "Bags":
        """One of several that to_bytes() has made."""
        sizes, style, grams = [], [], [([], []), ([], []), ([], [])]
        for data in all_:
            n, p, *held = np.frombuffer(data, np.int64, 5).tolist()
            at = 40
            sizes.append(np.frombuffer(data, np.int64, n, at))
            style.append(np.frombuffer(data, np.float32, p * STYLE, at + 8 * n).reshape(p, STYLE))
            at += 8 * n + 4 * p * STYLE
            for k, m in enumerate(held):
                grams[k][0].append(np.frombuffer(data, np.int32, m, at))
                grams[k][1].append(np.frombuffer(data, np.int32, p, at + 4 * m))
                at += 4 * (m + p)
        return Bags(np.concatenate(sizes), np.concatenate(style), [(np.concatenate(r), np.concatenate(c)) for r, c in grams])


def encode(texts: list[bytes]) -> Bags:
    """The passages of whole texts; a text without words has one passage of nothing."""
    raw = np.frombuffer(b"".join(t + b"\n" for t in texts), np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    begins = np.concatenate([[0], ends[:-1]])
    full = ~_BLANK[raw]
    edge = np.diff(np.concatenate([[False], full]).astype(np.int8))
    starts = np.flatnonzero(edge == 1)
    lengths = np.flatnonzero(edge == -1) - starts
    pieces = -(-lengths // LONG)
    if (pieces > 1).any():
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts, lengths = np.repeat(starts, pieces) + nth * LONG, np.minimum(np.repeat(lengths, pieces) - nth * LONG, LONG)
    first = np.searchsorted(starts, begins)
    held = np.diff(np.append(first, len(starts)))
    sizes = np.maximum(1, -(-held // WORDS))
    offset = np.cumsum(sizes) - sizes
    n = int(sizes.sum())
    doc = np.repeat(np.arange(len(texts)), held)
    nth = np.arange(len(starts)) - first[doc]
    of_word = offset[doc] + nth // WORDS
    # a passage begins at its first word, a document's first one at its beginning
    at = np.zeros(n, np.int64)
    at[offset] = begins
    later = (nth % WORDS == 0) & (nth > 0)
    at[of_word[later]] = starts[later]
    of_byte = np.repeat(np.arange(n), np.diff(np.append(at, len(raw))))
    kinds = np.bincount(of_byte * CLASSES + _CLASS[raw], minlength=n * CLASSES).reshape(n, CLASSES)
    kinds[offset + sizes - 1, 4] -= 1  # the line feed that was put after each text
    size, words = kinds.sum(1), np.bincount(of_word, minlength=n)
    low = _LOWER[raw]
    letters = np.flatnonzero(full)
    place = np.arange(len(letters)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    hashes = np.add.reduceat(_RANDOM[0][low[letters]] * _POWERS[place], np.cumsum(lengths) - lengths) if len(starts) else np.zeros(0, np.uint64)
    paired = np.flatnonzero(doc[1:] == doc[:-1])
    same = np.bincount(of_word[paired[hashes[paired] == hashes[paired + 1]]], minlength=n)
    style = np.concatenate([kinds / np.maximum(size, 1)[:, None], (size / np.maximum(words, 1) / 10)[:, None], (same / np.maximum(words, 1))[:, None], np.log1p(words)[:, None] / 5], 1)
    three = letters[letters + 2 < np.repeat(ends, np.diff(ends, prepend=0))[letters]]
    grams = [
        (_bucket(hashes), words),
        (_bucket(hashes[paired] * np.uint64(3) + hashes[paired + 1]) + BUCKETS, np.bincount(of_word[paired], minlength=n)),
        (_bucket(_RANDOM[1][low[three]] + _RANDOM[2][low[three + 1]] + _RANDOM[3][low[three + 2]]) + 2 * BUCKETS, np.bincount(of_byte[three], minlength=n)),
    ]
    return Bags(sizes, style.astype(np.float32), grams)


def _by_passage(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive rows, ``counts`` of them at a time, none giving zeros."""
    begins = np.cumsum(counts) - counts
    out = np.add.reduceat(np.concatenate([values, np.zeros((1, values.shape[1]), values.dtype)]), begins, axis=0)
    out[counts == 0] = 0
    return out


class Model:
    """h = tanh(style W + means of vectors E + b); attention softmax(w . (tanh(h V) * sigmoid(h U))); score sigmoid(c . sum a h + d)."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        draw = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
        self.p = {"E": np.zeros((3 * BUCKETS, HIDDEN)), "W": draw(STYLE, HIDDEN), "b": np.zeros(HIDDEN), "V": draw(HIDDEN, GATE), "U": draw(HIDDEN, GATE), "w": draw(GATE), "c": draw(HIDDEN), "d": np.zeros(1)}
        self.mean, self.scale = np.zeros(STYLE), np.ones(STYLE)

    @staticmethod
    def level() -> "Model":
        """A model that scores everything one half."""
        own = Model()
        own.p["c"][:] = 0
        return own

    def _means(self, bags: Bags) -> np.ndarray:
        out = np.zeros((len(bags.style), HIDDEN))
        table = self.p["E"].astype(np.float32)
        for rows, counts in bags.grams:
            ends = np.cumsum(counts)
            for a in range(0, len(counts), SLICE):
                own = counts[a : a + SLICE]
                part = _by_passage(table[rows[ends[a] - own[0] : ends[a + len(own) - 1]]], own)
                out[a : a + SLICE] += part / np.maximum(own, 1)[:, None]
        return out

    def forward(self, bags: Bags):
        p, sizes = self.p, bags.sizes
        begins, bag = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
        h = np.tanh(((bags.style - self.mean) / self.scale) @ p["W"] + self._means(bags) + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-h @ p["U"]))
        s = (t * g) @ p["w"]
        e = np.exp(s - np.maximum.reduceat(s, begins)[bag])
        a = e / np.add.reduceat(e, begins)[bag]
        z = np.add.reduceat(a[:, None] * h, begins)
        return h, t, g, a, z, 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -40, 40)))

    def gradients(self, bags: Bags, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss."""
        p, sizes = self.p, bags.sizes
        begins, bag = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
        h, t, g, a, z, y = self.forward(bags)
        miss = (y - labels) / len(sizes)
        dz = miss[:, None] * p["c"][None, :]
        da = (dz[bag] * h).sum(1)
        ds = a * (da - np.add.reduceat(a * da, begins)[bag])
        dtg = ds[:, None] * p["w"][None, :]
        dv, du = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
        dh = (a[:, None] * dz[bag] + dv @ p["V"].T + du @ p["U"].T) * (1 - h * h)
        vectors = np.zeros_like(p["E"])
        for rows, counts in bags.grams:
            order = np.argsort(rows, kind="stable")
            if len(order):
                share = (dh / np.maximum(counts, 1)[:, None])[np.repeat(np.arange(len(counts)), counts)[order]]
                seen, at = np.unique(rows[order], return_index=True)
                vectors[seen] += np.add.reduceat(share, at)
        return {"E": vectors, "W": ((bags.style - self.mean) / self.scale).T @ dh, "b": dh.sum(0), "V": h.T @ dv, "U": h.T @ du, "w": (t * g).T @ ds, "c": z.T @ miss, "d": np.array([miss.sum()])}

    def fit(self, bags: Bags, labels: np.ndarray, epochs: int = EPOCHS) -> "Model":
        """Adam over steps of STEP documents in a fixed order, so that reruns agree."""
        self.mean, self.scale = bags.style.mean(0, dtype=float), bags.style.std(0, dtype=float) + 1e-2
        m, v = ({k: np.zeros_like(w) for k, w in self.p.items()} for _ in range(2))
        last = np.cumsum(bags.sizes)
        steps = []
        for i in range(0, len(labels), STEP):
            own = bags.sizes[i : i + STEP]
            steps.append((bags.pick(np.arange(last[i] - own[0], last[i + len(own) - 1]), own), labels[i : i + STEP]))
        r = 0
        for _ in range(epochs):
            for own, y in steps:
                r += 1
                for k, grad in self.gradients(own, y).items():
                    grad += DECAY * self.p[k]
                    m[k] += 0.1 * (grad - m[k])
                    v[k] += 0.001 * (grad * grad - v[k])
                    self.p[k] -= RATE * (m[k] / (1 - 0.9**r)) / (np.sqrt(v[k] / (1 - 0.999**r)) + 1e-8)
        return self

    def score(self, bags: Bags) -> np.ndarray:
        return self.forward(bags)[-1]


def _spread(bags: Bags, most: int) -> Bags:
    """At most ``most`` passages of each document, evenly spread over it."""
    sizes = np.minimum(bags.sizes, most)
    begins = np.cumsum(bags.sizes) - bags.sizes
    chosen = np.concatenate([b + (np.arange(k) * n) // k for b, n, k in zip(begins, bags.sizes, sizes)])
    return bags.pick(chosen, sizes)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, passages: int = PASSAGES) -> Model:
    """Fit on at most ``sample`` labelled ids that are not held out, those of the smallest id hashes, and ``passages`` of each.

    Of contradictory labels of one id the largest counts; of texts that share an id,
    the one whose encoding is smallest. Only the ids and the encoded passages of the
    sample reach the driver. Without any label all documents score one half; with
    labels of one kind only, the model leans to that kind.
    """
    small_batches(docs.sparkSession)
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    ids = known.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    wanted = {r.id: float(r.y > 0) for r in ids.orderBy(F.xxhash64("id"), "id").limit(sample).collect()}
    if not wanted:
        return Model.level()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [_spread(encode([(x.as_py() or "").encode()]), passages).to_bytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bags, pa.binary())], ["id", "bag"])

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).where(F.col("id").isin(list(wanted)))
    rows = own.mapInArrow(run, "id long, bag binary").groupBy("id").agg(F.min("bag").alias("bag")).collect()
    if not rows:
        return Model.level()
    # in the order of the hashes by which the ids were chosen, which is no order of anything in the texts
    at = {x: i for i, x in enumerate(wanted)}
    rows.sort(key=lambda r: at[r.id])
    return Model().fit(Bags.join([r.bag for r in rows]), np.array([wanted[r.id] for r in rows]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text", cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted for every row.

    The whole text counts, passage by passage. Null and empty texts are one empty
    passage and are scored like any other. Repeated rows repeat; an empty table
    gives none; other columns are not read.
    """
    small_batches(docs.sparkSession)
    names = ["doc_id", "held_out", "score", "predicted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got, held, size = [np.zeros(0)], [], 0
            for x in batch.column(2):
                data = (x.as_py() or "").encode()
                if held and size + len(data) > BATCH:
                    got.append(model.score(encode(held)))
                    held, size = [], 0
                held.append(data)
                size += len(data)
            if held:
                got.append(model.score(encode(held)))
            made = np.concatenate(got)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(made), pa.array((made >= cut).astype(np.int32))], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """learn() from the labelled rows that are not held out, then score() every row."""
    return score(docs, learn(docs, labels))
