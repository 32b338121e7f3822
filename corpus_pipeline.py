"""The corpus pipeline: documents in, token ids out.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame; tokens()
writes each stage's rows to the shared folder and reads them back as the next one's docs. All but
the last stage return the columns of documents (doc_id, text, lang, source, n_chars).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemine.llm import bpe, mixing, neardup, secrets, toxicity
from lodemine.llm.common import drop_tables, fold_remainder, materialize, read

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches 0.5 go. The model learns from the labelled rows
    among docs that are not held out."""
    docs = docs.select(*COLUMNS)
    labels = read(spark, sf_dir, "labels").filter(fold_remainder("doc_id", 5) != 0)
    model = toxicity.fit(docs.select("doc_id", "text"), labels)
    return toxicity.score(docs, model).filter("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the document with the smallest doc_id stays. Rows that
    repeat a doc_id are one document, of which the first by its columns, nulls first, stays; rows
    without one stay."""
    kept = neardup.near_duplicates(docs.select("doc_id", "text")).filter("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    rows = docs.select(*COLUMNS).join(kept, "doc_id", "left_semi")
    stay = rows.groupBy("doc_id").agg(F.min(F.struct(*COLUMNS)).alias("_first")).select("_first.*")
    return stay.unionByName(docs.select(*COLUMNS).filter("doc_id IS NULL"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; every document stays."""
    masked = secrets.redact(secrets.scan(docs.select(*COLUMNS)))
    return masked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document is repeated as often as the mix takes it, 0 to 3 times. Documents without
    words carry no weight in any source and stay once."""
    docs = docs.select(*COLUMNS)
    copies = mixing.mix(docs).select("doc_id", "size", "copies")
    return mixing.repeat(docs, copies).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with the digests of ids and of the decoded text."""
    return bpe.encode(docs.select("doc_id", "source", "text"), digests=True, cache_words=40_000).drop("text")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("bpe", encode),
]


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline: token_ids, n_tokens and digests of every document that is left."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            drop_tables(spark, before)
        before = docs
    return docs


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tokens() in short, without the ids."""
    return tokens(spark, sf_dir).drop("token_ids")


#: The first stage is a trained model and the fourth a random rounding, which SQL can't express.
ORACLE_SQL = None
