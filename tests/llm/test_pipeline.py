"""The pipeline against its stages done by hand."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from lodemine.llm import mixing, neardup, secrets
from lodemine.llm.common import read

ROWS = [
    (1, "the quick brown fox jumps over the lazy dog again and again today", "en", "a", 1),
    (2, "The quick brown fox jumps over the lazy dog again and again today", "en", "a", 1),
    (3, "my password = hunter2secret and more words here", "en", "b", 1),
    (4, None, None, None, None),
    (5, "", "en", "c", 0),
    (None, "no id at all", "en", "c", 1),
    (6, "entirely different words stand in this document of ours", "de", "b", 1),
]


@pytest.fixture()
def docs(spark):
    return spark.createDataFrame([(*r, "x") for r in ROWS], "doc_id long, text string, lang string, source string, n_chars long, copies string")


def test_stages_keep_the_columns(spark, sf, docs):
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == P.COLUMNS
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_near_duplicates_go(spark, sf, docs):
    ids = [r.doc_id for r in P.drop_near_duplicates(spark, docs, sf).collect()]
    assert sorted(ids, key=lambda i: i or 0) == [None, 1, 3, 4, 5, 6]


def test_the_first_text_of_a_repeated_id_stays(spark, sf):
    rows = [(7, f"{n:03d} text number {n} with words of its own {n * n}", "en", "a", n) for n in range(400)]
    rows += [(8, None, "en", "a", 1), (8, "some text of document eight", "en", "a", 1)]
    for seed in (1, 2):
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(7).orderBy(F.rand(seed))
        got = {r.doc_id: r.text for r in P.drop_near_duplicates(spark, docs, sf).collect()}
        assert got == {7: rows[0][1], 8: None}


def test_secrets_are_masked(spark, sf, docs):
    got = {r.doc_id: r for r in P.mask_secrets(spark, docs, sf).collect()}
    assert got[3].text == "my [SECRET] and more words here" and got[3].n_chars == len(got[3].text)
    assert got[1].text == ROWS[0][1] and got[4].text is None and len(got) == len(ROWS)


def test_mix_repeats_documents(spark, sf, docs):
    want = {r.doc_id: r.copies if r.size else 1 for r in mixing.mix(docs.filter("doc_id IS NOT NULL")).collect()}
    got = {r.doc_id: r["count"] for r in P.mix_sources(spark, docs.filter("doc_id IS NOT NULL"), sf).groupBy("doc_id").count().collect()}
    assert got == {k: v for k, v in want.items() if v}


def test_run_is_the_stages_in_order(spark, sf):
    got = P.run(spark, sf)
    assert got.columns == ["doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256"]
    docs = read(spark, sf, "documents").select(*P.COLUMNS)
    clean = P.drop_toxic(spark, docs, sf)
    labels = read(spark, sf, "labels")
    gone = docs.join(clean, "doc_id", "left_anti").join(labels, "doc_id", "left").collect()
    assert all(r.toxic != 0 for r in gone)
    unique = neardup.near_duplicates(clean.select("doc_id", "text")).filter("kept").select("doc_id")
    kept = clean.join(unique, "doc_id", "left_semi")
    masked = secrets.redact(secrets.scan(kept))
    copies = {r.doc_id: (r.copies if r.size else 1) for r in mixing.mix(masked).collect()}
    counts = {r.doc_id: r["count"] for r in got.groupBy("doc_id").count().collect()}
    assert counts == {k: v for k, v in copies.items() if v}
    assert got.agg(F.sum("n_tokens")).first()[0] > 0 and hashlib


def test_the_product_is_token_ids(spark, sf, docs):
    import __spark_entry__ as entry
    from lodemine.llm import bpe

    assert entry.queries()["pipeline"] is P.tokens
    model = bpe.BpeModel(bpe.tokenizer_path())
    texts = {r[0]: r[1] or "" for r in ROWS}
    got = P.STAGES[-1][1](spark, docs, sf).collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert r.token_ids == model.encode_ids(texts[r.doc_id]) and r.n_tokens == len(r.token_ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.token_ids)).encode()).hexdigest()
