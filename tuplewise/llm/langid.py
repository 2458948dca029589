"""Language identification by compression: the dictionary that shrinks a text most names its language."""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tuplewise.llm.common import held_out, small_batches
from tuplewise.llm.common import keep as keep_

#: Sample: documents for each language, bytes taken of each, bytes of a dictionary; and the compression level.
SAMPLE_DOCS, SAMPLE_BYTES, DICTIONARY, LEVEL = 192, 2048, 98_304, 5
#: Bytes by which the best must beat the second, and as a share of the text, else the text is rejected.
MARGIN_BYTES, MARGIN_SHARE = 1, 0.004
UNKNOWN = "und"
ADDED = "lang_pred string, score double, rejected boolean"
_SIGNS = bytes(x for x in range(33, 127) if not chr(x).isalpha())


def learn(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", allowed=None) -> dict[str, bytes]:
    """Raw-content dictionaries, one for each language of the labelled rows, the commonest first.

    A bounded sample is fitted: per language the documents of smallest id hash in
    each of SAMPLE_DOCS hash classes, SAMPLE_BYTES of each, DICTIONARY bytes in
    all. Only the minima of the hashes and the chosen texts reach the driver; of
    rows that repeat an id in a language the smallest text counts, once.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.length(text) > 0) & F.col(id_col).isNotNull())
    if allowed is not None:
        known = known.where(allowed)
    mark = F.xxhash64(F.col(id_col).cast("string"))
    least = known.groupBy(F.col(lang).alias("lang"), F.pmod(mark, F.lit(SAMPLE_DOCS)).alias("c")).agg(F.min(mark).alias("h"), F.count("*").alias("n")).collect()
    if not least:
        return {}
    share: dict[str, int] = {}
    for r in least:
        share[r.lang] = share.get(r.lang, 0) + r.n
    # one text for each language and id, however often a row repeats
    rows = known.where(mark.isin(sorted({r.h for r in least}))).groupBy(F.col(lang).alias("lang"), mark.alias("h")).agg(F.min(F.substring(text, 1, SAMPLE_BYTES)).alias("text"))
    texts: dict[str, list[tuple]] = {}
    for r in rows.collect():
        texts.setdefault(r.lang, []).append((r.h, plain(r.text)))
    return dictionaries({name: [data for _, data in sorted(texts[name])] for name in sorted(texts, key=lambda x: (-share.get(x, 0), x))})


def plain(text: str) -> bytes:
    """What is compressed: the whole text in lower case, without ASCII digits and signs."""
    return text.lower().encode().translate(None, _SIGNS)


def dictionaries(texts: dict[str, list[bytes]]) -> dict[str, bytes]:
    """Dictionaries from the texts that agree with their label.

    Labels are noisy and texts mix languages, so each half of the sample is told
    apart with the dictionaries of the other half, and texts that another language
    shrinks more are left out (unless that leaves a language without any).
    """

    def join(own: list[bytes]) -> bytes:
        return b"\n".join(own)[-DICTIONARY:]

    kept: dict[str, list[bytes]] = {}
    for half in (0, 1):
        codes = _compressors({name: join(own[half::2] or own) for name, own in texts.items()})
        for name, own in texts.items():
            fits = [x for x in own[1 - half :: 2] if x.strip() and min(codes, key=lambda c: len(c[1].compress(x)))[0] == name]
            kept.setdefault(name, []).extend(fits)
    return {name: join(kept[name] or own) for name, own in texts.items()}


def _compressors(dictionaries: dict[str, bytes]) -> list:
    """(name, compressor) of each language, kept by the worker."""
    import zstandard

    def made() -> list:
        shape = {"format": zstandard.FORMAT_ZSTD1_MAGICLESS, "write_content_size": 0, "write_checksum": 0, "write_dict_id": 0}
        out = []
        for name, data in dictionaries.items():
            own = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            own.precompute_compress(compression_params=zstandard.ZstdCompressionParameters.from_level(LEVEL, **shape))
            params = zstandard.ZstdCompressionParameters.from_level(LEVEL, **shape)
            out.append((name, zstandard.ZstdCompressor(dict_data=own, compression_params=params)))
        return out

    return keep_("langid", tuple(dictionaries.items()), made)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text)) or any(unicodedata.category(c)[0] == "L" for c in text)


def predict(text: str | None, compressors: list) -> tuple[str, float, bool]:
    """Language, score and whether it is rejected."""
    if text is None or not compressors or not has_letter(text):
        return UNKNOWN, 0.0, True
    data = plain(text)
    sizes = sorted(((len(c.compress(data)), name) for name, c in compressors), key=lambda x: x[0])
    if len(sizes) == 1:
        return sizes[0][1], 1.0, False
    gap = sizes[1][0] - sizes[0][0]
    # each byte saved doubles the odds, as long as texts are short
    odds = [math.exp(-math.log(2) * min(60, s - sizes[0][0])) for s, _ in sizes]
    return sizes[0][1], 1 / sum(odds), gap < MARGIN_BYTES or gap < MARGIN_SHARE * min(len(data), 1000)


def identify(docs: DataFrame, text: str = "text", id_col: str = "doc_id", lang: str = "lang", dictionaries: dict[str, bytes] | None = None, keep: tuple[str, ...] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with lang_pred, score and rejected.

    A whole text is compressed with each language's zstandard raw-content
    dictionary; the smallest result names the language, ties the one with most labelled rows.
    ``score`` is a softmax over saved bytes, 0 to 1. ``rejected``: the text is
    null or has no letter (then lang_pred is ``und`` and the score 0), or the
    best beats the second by too little. Without ``dictionaries`` they are learned
    from the rows whose id is not held out and whose language is not null; without
    any such row everything is ``und``. Repeated rows repeat, an empty table gives
    none, and columns of the added names are replaced.
    """
    small_batches(docs.sparkSession)
    if dictionaries is None:
        dictionaries = learn(docs, id_col, text, lang, ~held_out(id_col))
    added = [x.split()[0] for x in ADDED.split(", ")]
    keep = [c for c in (keep or docs.columns) if c not in added]
    picked = docs.select(*[f"`{c}`" for c in keep])
    schema = StructType([*picked.schema.fields, *StructType.fromDDL(ADDED).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _compressors(dictionaries)
        for batch in batches:
            got = [predict(x.as_py(), own) for x in batch.column(len(keep))]
            new = [pa.array([g[i] for g in got], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *new], [*keep, *added])

    own = "text_"
    while own in keep:
        own += "_"
    return docs.select(*[f"`{c}`" for c in keep], F.col(text).alias(own)).mapInArrow(run, schema)
