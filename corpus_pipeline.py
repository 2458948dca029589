"""The corpus pipeline: what a raw table of documents becomes on its way to tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's ``docs``. Columns beyond those of
``documents`` are kept up to the last stage; repeated rows and ids are rows like
any other; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuplewise.llm import bpe, langid, mixing, pii, simhash
from tuplewise.llm.common import materialise, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told apart; the others go. ``lang`` becomes the predicted language.

    Null texts and texts without a letter have no language and go.
    """
    told = langid.identify(docs).where("not rejected")
    return told.select(*[F.col("lang_pred").alias(c) if c == "lang" else F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id.

    Documents are told apart by id and fingerprint, so a text whose id another text
    has too is not lost; null ids come after all others.
    """
    return simhash.one_each(docs)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it replaced in the text; ``n_chars`` follows.

    All rows stay; null texts stay null.
    """
    clean = pii.sanitise(docs)
    return clean.select(*[F.length("text").cast(kind).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c, kind in clean.dtypes])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, never oftener than three times.

    A null source is a source of its own; documents without words go.
    """
    return mixing.apply(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every remaining document as tokens: doc_id, n_tokens, ids and the digests of ids and decoded text.

    Null and empty texts have no tokens.
    """
    return bpe.encode(docs, outputs=("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("pii", sanitise), ("mixing", mix_sources), ("bpe", encode)]

#: The first stage compresses texts, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
