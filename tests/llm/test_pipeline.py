from collections import Counter

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from tuplewise.llm import langid, mixing, pii, simhash
from tuplewise.llm.common import materialise, table


def test_stages_follow_each_other(spark):
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    told = {r.doc_id: r for r in langid.identify(docs).collect()}
    kept = materialise(corpus_pipeline.language_id(spark, docs, sf))
    assert kept.columns == docs.columns and {r.doc_id: r.lang for r in kept.collect()} == {i: r.lang_pred for i, r in told.items() if not r.rejected}
    alone = materialise(corpus_pipeline.near_dedup(spark, kept, sf))
    assert {r.doc_id for r in alone.collect()} == {r.component_id for r in simhash.near_duplicates(kept).collect()}
    clean = materialise(corpus_pipeline.sanitise(spark, alone, sf))
    assert clean.columns == docs.columns and clean.where("n_chars != length(text)").count() == 0
    again = pii.find(clean)
    assert again.where("size(email) + size(ip) + size(card) + size(phone) > 0").count() == 0
    mixed = materialise(corpus_pipeline.mix_sources(spark, clean, sf))
    want = {r.doc_id: r.taken // r["size"] for r in mixing.mix(clean).collect() if r.taken}
    assert mixed.columns == docs.columns and Counter(r.doc_id for r in mixed.collect()) == want
    tokens = corpus_pipeline.encode(spark, mixed, sf).collect()
    tok, texts = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), {r.doc_id: r.text for r in clean.collect()}
    assert len(tokens) == sum(want.values()) and all(r.ids == tok.encode(texts[r.doc_id], add_special_tokens=False).ids for r in tokens[:60])
    ran = entry.queries()["pipeline"](spark, sf)
    assert Counter((r.doc_id, r.ids_sha256) for r in ran.collect()) == Counter((r.doc_id, r.ids_sha256) for r in tokens)


def test_odd_tables_go_through_every_stage(spark, tmp_path):
    """Nulls in every column, empty and long texts, repeated ids and rows, a column of another name; then no row at all."""
    base = table(spark, "/root/testdata/sf0.001", "documents").limit(60)
    long = "this is the one text that goes on and on with all of the words " * 3000
    odd = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "the house and the garden are by the river", None, None, None), (1, "a quite different text of the same id is here", "en", "s", 5)]
    odd += [(900, long, "en", "s", 1)] * 2 + [(None, "the mail of nobody is at no@where.example.com and that is it", "en", None, 2)] * 3
    docs = base.unionByName(spark.createDataFrame(odd, base.schema)).withColumn("print", F.lit("clash")).withColumn("placed_", F.lit(1))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    now = table(spark, str(tmp_path), "documents")
    for name, stage in corpus_pipeline.STAGES:
        out = materialise(stage(spark, now, str(tmp_path)))
        if name != "bpe":
            assert out.columns == docs.columns
        if name == "near_dedup":
            of = lambda df, i: sorted({r.text for r in df.where(F.col("doc_id") == i).collect()})
            assert all(of(out, i) == of(now, i) for i in (1, 900)) and out.where("doc_id = 900").count() <= 1
        now = out
    assert now.count() > 20
    none = base.limit(0)
    none.write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_it_is_registered():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "pii", "mixing", "bpe"] and "pipeline" in entry.queries()
