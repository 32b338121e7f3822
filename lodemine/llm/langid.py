"""Language identification by the nearest centroid of TF-IDF n-gram vectors.

A text becomes the counts of its byte 2- to 4-grams (lower case, anything but letters as a space)
hashed to ``dims`` columns, dampened, weighted by inverse document frequency and normalised. Each
language has up to ``centroids`` spherical k-means centroids; a text gets the language of the
centroid with the largest cosine. Below the language's rejection distance (the ``reject`` quantile
of its own training texts) the column ``rejected`` is true.

Document frequencies count all rows to learn from. The centroids are fitted on a bounded sample: the
first ``sample`` // (number of languages) texts of each language by a hash of doc_id. Every text is
classified whole.

Texts that are null or have no letter get ``und`` and score 0, not rejected; so does every text if
no language could be learned. Ties go to the language that is first in order, repeated rows are
classified each, an empty table gives no rows; extra columns are kept but for those that have the name
of a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemine.llm.common import fold_remainder, free_name, read, sample_by_hash

DIMS = 4096
_letter = regex.compile(r"\p{L}")
_plain = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def counts(text: str, dims: int = DIMS, block: int = 1 << 20) -> np.ndarray:
    """Hashed n-gram counts of the whole text, block by block."""
    raw = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "replace").translate(_plain), np.uint8)
    out = np.zeros(dims, np.int64)
    shift = np.uint32(32 - (dims.bit_length() - 1))
    for at in range(0, len(raw), block):
        b = raw[max(0, at - 3) : at + block].astype(np.uint32)
        new = 0 if not at else 3
        code = b
        for n in (2, 3, 4):
            code = (code[:-1] << np.uint32(8)) | b[n - 1 :]
            part = code[max(0, new - n + 1) :]
            out += np.bincount((part * np.uint32(2654435761) + np.uint32(n * 40503)) * np.uint32(2246822519) >> shift, minlength=dims)
    return out


class Centroids:
    def __init__(self, langs: list[str], of: np.ndarray, matrix: np.ndarray, idf: np.ndarray, least: np.ndarray):
        self.langs, self.of, self.matrix, self.idf, self.least = langs, of, matrix, idf, least

    @classmethod
    def fit(cls, vectors: np.ndarray, langs: list[str], df: np.ndarray, of_rows: int, centroids: int = 4, reject: float = 0.002, rounds: int = 8, seed: int = 3) -> Centroids:
        """df: in how many of_rows rows of the corpus each column occurs."""
        names = sorted(set(langs))
        y = np.asarray([names.index(x) for x in langs])
        idf = (np.log((1 + of_rows) / (1 + df)) + 0.05).astype(np.float32)
        x = vectors.astype(np.float32)
        np.log1p(x, out=x)
        x *= idf
        x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-12)[:, None]
        rng = np.random.default_rng(seed)
        of, rows, least = [], [], []
        for k in range(len(names)):
            own = x[y == k]
            c = own[rng.choice(len(own), min(centroids, len(own)), replace=False)]
            for _ in range(rounds):
                near = (own @ c.T).argmax(1)
                c = _normalise(np.stack([own[near == j].sum(0) if (near == j).any() else c[j] for j in range(len(c))]))
            rows.append(c)
            of += [k] * len(c)
            least.append(np.quantile((own @ c.T).max(1), reject))
        return cls(names, np.asarray(of), np.concatenate(rows).astype(np.float32), idf, np.asarray(least))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not self.langs or not text or not _letter.search(text):
            return "und", 0.0, False
        c = counts(text, len(self.idf))
        at = np.flatnonzero(c)
        v = np.log1p(c[at].astype(np.float32)) * self.idf[at]
        cos = self.matrix[:, at] @ v / max(float(np.sqrt((v * v).sum())), 1e-12)
        best = int(cos.argmax())
        k = int(self.of[best])
        return self.langs[k], float(min(max(cos[best], 0.0), 1.0)), bool(cos[best] < self.least[k])


def _normalise(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """In how many rows each column of counts() occurs, and the number of rows. Each task counts its
    rows and passes on one number a column."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIMS, np.int64), 0
        for batch in batches:
            for t in batch.column(0):
                df += counts(t.as_py() or "") > 0
                n += 1
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(DIMS + 1), pa.int32()), pa.array([*df.tolist(), n], pa.int64())], ["at", "n"])

    got = docs.select(text).mapInArrow(counted, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(DIMS + 1, np.int64)
    for r in got:
        out[r["at"]] = r["n"]
    return out[:DIMS], int(out[DIMS])


def fit(docs: DataFrame, sample: int = 3000, most_languages: int = 1000, **options) -> Centroids:
    """docs: doc_id, text, lang of the rows to learn from: at most ``sample`` texts, or one for each
    language. Of more than ``most_languages`` values of lang those with the most rows are learned, as
    the model, which goes to every task, grows with them."""
    rows = docs.filter("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    found = [r["lang"] for r in rows.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(most_languages + 1).collect()]
    n = min(len(found), most_languages)
    if len(found) > most_languages:
        rows = rows.join(F.broadcast(docs.sparkSession.createDataFrame([(x,) for x in found[:n]], "lang string")), "lang", "left_semi")
    none = Centroids([], np.zeros(0, int), np.zeros((0, DIMS), np.float32), np.zeros(DIMS, np.float32), np.zeros(0))
    if not n:
        return none
    picked = sample_by_hash(rows, "lang", "doc_id", max(1, sample // n))

    @F.pandas_udf("array<int>")
    def vector(col: pd.Series) -> pd.Series:
        def one(t: str) -> np.ndarray:
            c = counts(t)
            at = np.flatnonzero(c)
            return np.stack([at, np.minimum(c[at], 2**31 - 1)], 1).ravel().astype(np.int32)

        return pd.Series([one(t) for t in col])

    one = rows.join(F.broadcast(picked), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    got = one.select("doc_id", "lang", vector("text").alias("v")).toPandas().sort_values(["doc_id", "lang"], ignore_index=True)
    x = np.zeros((len(got), DIMS), np.int32)
    for i, v in enumerate(got["v"]):
        v = np.asarray(v)
        x[i, v[0::2]] = v[1::2]
    return Centroids.fit(x, list(got["lang"]), *document_frequencies(rows), **options) if len(got) else none


def identify(docs: DataFrame, model: Centroids, text: str = "text") -> DataFrame:
    """Adds lang_pred, score and rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # dims x centroids x languages

    @F.arrow_udf("lang_pred string, score double, rejected boolean")
    def predicted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for col in batches:
            rows = [m.predict(t.as_py()) for t in col]
            yield pa.StructArray.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))], ["lang_pred", "score", "rejected"])

    p = free_name(docs, "_p")
    kept = docs.withColumn(p, predicted(F.col(text))).drop("lang_pred", "score", "rejected")
    return kept.select("*", f"{p}.*").drop(p)


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held = fold_remainder("doc_id", 3) == 1
    model = fit(docs.select("doc_id", "text", "lang").filter(~held))
    return identify(docs.select("doc_id", "text", held.alias("held_out")), model).drop("text")
