"""Toxicity by subword-bag embeddings: character n-gram vectors averaged into a linear softmax.

A word's vector is the mean of the vectors of its character 3- to 5-grams and of itself, all
hashed into ``buckets`` rows; a bag's vector is the mean over its words (a word that repeats its
predecessor counts once, and a bag of fewer words is filled up with zero vectors); a linear softmax on top
gives the probability. It is calibrated on scores of the sample's parts by fits on the other parts:
0.5 weighs errors on both classes alike (``share`` 0.5), but no more than ``most_wrong`` of the clean
texts may reach it. Vectors and softmax are trained jointly with Adagrad in numpy. Abuse is a
few words in a long text, so bags are windows of ``window`` words: a text is as toxic as its worst
window. Training starts on random windows of all texts and turns, round by round, to the ``top``
worst windows of toxic and of clean texts.

The model is fitted on a bounded sample of labelled rows (``per_class`` rows of each class, first
by a hash of doc_id, and of those as many whole texts as have ``max_chars`` characters in all, which
is counted before any goes to the driver; of several rows of a doc_id the first text); every text is
scored whole. A run
of more than ``LONGEST`` letters and digits counts as the words that its consecutive pieces make;
pieces overlap by one less than the largest n-gram, so that no n-gram of the run is lost. As
all layers are linear, the fitted model folds into one number per bucket, which is what executors
get. Misspellings that were never seen share most of their n-grams with the words that were.

Null and wordless texts score the bag of no words. Labels other than 0 and 1 are ignored; of
several labels of a doc_id the highest counts. With labels of one class or none the score is that
class's prior (0 without labels). Repeated rows are scored each; an empty table gives no rows; columns
of the input named score or predicted are replaced.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemine.llm.common import Recent, drop_tables, fold_remainder, give_back, materialize, read, sample_by_hash

_words = re.compile(r"[^\W_]+")
LONGEST, OVERLAP = 60, 4


def words(text: str) -> list[str]:
    """The runs of letters and digits in lower case, long ones in pieces."""
    found = _words.findall(text.lower())
    if max(map(len, found), default=0) <= LONGEST:
        return found
    return [w[i : i + LONGEST] for w in found for i in range(0, max(1, len(w) - OVERLAP), LONGEST - OVERLAP)]


class SubwordBags:
    def __init__(self, buckets: int = 1 << 17, dim: int = 8, window: int = 2, smallest: int = 3, largest: int = 5):
        self.buckets, self.dim, self.window, self.smallest, self.largest = buckets, dim, window, smallest, largest
        self.folded = np.zeros(buckets, np.float32)
        self.bias, self.scale = 0.0, 1.0
        self.prior: float | None = 0.0  # if not None, the score of every text
        self.layers: tuple | None = None  # the embeddings, the softmax and its bias before folding
        self.table: list[float] | None = None  # folded as Python's floats, for single words
        self.cache = Recent(self.value, 200_000)

    # -- features

    def grams(self, word: str) -> list[int]:
        s = f"<{word}>"
        crc, m = zlib.crc32, self.buckets
        raw = s.encode()
        out = [crc(raw) % m]
        if len(raw) == len(s):
            for n in range(self.smallest, self.largest + 1):
                out += [crc(raw[i : i + n]) % m for i in range(len(s) - n + 1)]
        else:
            for n in range(self.smallest, self.largest + 1):
                out += [crc(s[i : i + n].encode()) % m for i in range(len(s) - n + 1)]
        return out

    # -- fitting

    def fit(self, texts: list[str], labels: list[int], seed: int = 7, rounds: int = 6, epochs: int = 1, top: int = 4, first_windows: int = 60_000, least_steps: int = 30, rate: float = 0.5, folds: int = 3, share: float = 0.5, most_wrong: float = 0.015) -> SubwordBags:
        """folds: parts that are scored by a fit on the others, for calibration; share: of toxic texts,
        for which scores are calibrated; most_wrong: the part of the clean texts that may reach 0.5;
        least_steps: of a round, so that few bags are passed over more often."""
        y = np.asarray(labels, np.int64)
        if len(set(labels)) < 2:
            self.prior = float(y.mean()) if len(y) else 0.0
            return self
        self.prior = None
        if folds:
            options = seed, rounds, epochs, top, first_windows, least_steps, rate, 0
            z, fold = np.zeros(len(y)), np.arange(len(y)) % folds
            for k in range(folds):
                rest, own = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
                part = SubwordBags(self.buckets, self.dim, self.window, self.smallest, self.largest).fit([texts[i] for i in rest], y[rest].tolist(), *options)
                if part.prior is None:
                    z[own] = [part.logit(texts[i]) for i in own]
                    part.cache.forget()
            self.fit(texts, labels, *options)
            self.scale, shift = _platt(z, y, share)
            clean = np.sort(z[y == 0])[::-1]
            shift = min(shift, -self.scale * float(clean[int(len(clean) * most_wrong)]) - 1e-3)
            self.bias = self.bias * self.scale + shift
            return self
        rng = np.random.default_rng(seed)
        index: dict[str, int] = {}
        docs = [_once(np.fromiter((index.setdefault(w, len(index)) for w in words(t)), np.int32)) for t in texts]
        grams_of, sizes_of = array("i"), array("i")
        for word in index:
            grams_of.extend(found := self.grams(word))
            sizes_of.append(len(found))
        flat, sizes = np.frombuffer(grams_of, np.int32), np.frombuffer(sizes_of, np.int32).astype(np.int64)
        del index
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        e = rng.uniform(-1 / self.dim, 1 / self.dim, (self.buckets, self.dim)).astype(np.float32)
        w = rng.normal(0, 0.1, (self.dim, 2)).astype(np.float32)
        b = np.zeros(2, np.float32)
        ge, gw, gb = np.full((self.buckets, self.dim), 1e-6, np.float32), np.full_like(w, 1e-6), np.full_like(b, 1e-6)

        def spans(word_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """n-grams of the words, and the number of n-grams of each."""
            k = sizes[word_ids]
            first = np.repeat(starts[word_ids] - np.concatenate([[0], np.cumsum(k)[:-1]]), k)
            return flat[first + np.arange(int(k.sum()))], k

        def step(bags: list[np.ndarray], target: np.ndarray) -> None:
            nonlocal e, w, b
            lens = np.fromiter(map(len, bags), np.int64, len(bags))
            grams, k = spans(np.concatenate(bags))
            weight = (1 / (np.repeat(np.maximum(lens, n), lens) * k)).astype(np.float32)  # of a gram in its bag
            weight = np.repeat(weight, k)
            bag = np.repeat(np.repeat(np.arange(len(bags)), lens), k)
            x = np.stack([np.bincount(bag, e[grams, d] * weight, len(bags)) for d in range(self.dim)], 1).astype(np.float32)
            z = x @ w + b
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(bags)), target] -= 1
            dx = p @ w.T
            dw, db = x.T @ p, p.sum(0)
            used, back = np.unique(grams, return_inverse=True)
            de = np.stack([np.bincount(back, dx[bag, d] * weight, len(used)) for d in range(self.dim)], 1).astype(np.float32)
            ge[used] += de * de
            e[used] -= rate * de / np.sqrt(ge[used])
            gw[...] += dw * dw
            w -= 0.2 * rate * dw / np.sqrt(gw)
            gb[...] += db * db
            b -= 0.2 * rate * db / np.sqrt(gb)

        n = self.window
        random_windows = min(max(first_windows // len(docs), 12), 48)
        for r in range(rounds):
            bags: list[np.ndarray] = []
            target: list[int] = []
            if r:
                word_value = np.add.reduceat((e @ (w[:, 1] - w[:, 0]))[flat], starts) / sizes
            for doc, label in zip(docs, y):
                if not len(doc):
                    continue
                last = max(0, len(doc) - n)
                picks = rng.integers(0, last + 1, min(random_windows if not r else 2 * (1 - label), last + 1)).tolist()
                if r:
                    score = _window_means(word_value[doc], n)
                    for _ in range(top):
                        at = int(score.argmax())
                        if score[at] == -np.inf:
                            break
                        picks.append(at)
                        score[max(0, at - n + 1) : at + n] = -np.inf
                for at in picks:
                    bags.append(doc[at : at + n])
                    target.append(int(label))
            goal = np.asarray(target)
            for _ in range(max(epochs, -(-least_steps * 512 // len(bags)))):  # small samples more often
                order = rng.permutation(len(bags))
                for a in range(0, len(order), 512):
                    take = order[a : a + 512]
                    step([bags[i] for i in take], goal[take])
        self.layers = (e, w, b)
        self.folded, self.table = (e @ (w[:, 1] - w[:, 0])).astype(np.float32), None
        self.bias = float(b[1] - b[0])
        return self

    # -- scoring

    def value(self, word: str) -> float:
        if self.table is None:
            self.table = self.folded.tolist()
        table, grams = self.table, self.grams(word)
        return sum([table[g] for g in grams]) / len(grams)

    def logit(self, text: str) -> float:
        values = _once(np.array(list(map(self.cache.__getitem__, words(text)))))
        return self.bias + self.scale * (float(_window_means(values, self.window).max()) if len(values) else 0.0)

    def score(self, text: str) -> float:
        if self.prior is not None:
            return self.prior
        return float(1 / (1 + np.exp(-min(max(self.logit(text), -500.0), 500.0))))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "cache"} | {"table": None, "layers": None}

    def __setstate__(self, state):
        self.__dict__ |= state
        self.cache = Recent(self.value, 200_000)


def _once(x: np.ndarray) -> np.ndarray:
    """Without what repeats its predecessor."""
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def _window_means(values: np.ndarray, n: int) -> np.ndarray:
    if len(values) <= n:
        return np.array([values.sum() / n])
    c = np.concatenate([[0.0], np.cumsum(values)])
    return (c[n:] - c[:-n]) / n


def _platt(z: np.ndarray, y: np.ndarray, share: float, steps: int = 50) -> tuple[float, float]:
    """Scale and shift of a logistic fit of y on z with smoothed targets (Platt, 1999)."""
    n = np.bincount(y, minlength=2)
    t = np.where(y == 1, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))
    w = np.where(y == 1, share / n[1], (1 - share) / n[0])
    w = w / w.mean()
    x = np.column_stack([z, np.ones(len(z))])
    v = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -60, 60)))
        h = x.T @ (x * (w * p * (1 - p))[:, None]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (w * (p - t)) + 1e-6 * (v - [1.0, 0.0]))
        v = v - np.clip(step, -2, 2)
    return (float(v[0]), float(v[1])) if v[0] > 0 else (1.0, 0.0)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 2500, max_chars: int = 40_000_000, **options) -> SubwordBags:
    """Learns from at most per_class rows of each class. The rows are picked from the labels alone;
    the pick is bounded, so that it is broadcast to the scan of the texts."""
    known = labels.filter("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = sample_by_hash(known, "toxic", "doc_id", per_class)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    rows = materialize(rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "toxicity-sample")
    sizes = rows.select("doc_id", F.length("text").alias("n")).toPandas().sort_values("doc_id").sample(frac=1, random_state=11)
    whole, left = [], max_chars
    for doc_id, n in zip(sizes["doc_id"].tolist(), sizes["n"].tolist()):
        if n <= left:  # a text that no longer fits as a whole is passed over
            whole.append(doc_id)
            left -= n
    got = rows.join(F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in whole], "doc_id long")), "doc_id", "left_semi").toPandas().set_index("doc_id").reindex(whole)
    drop_tables(docs.sparkSession, rows)
    texts, classes = got["text"].tolist(), got["toxic"].astype(int).tolist()
    model = SubwordBags().fit(texts, classes, **options)
    del got, texts, classes
    give_back()
    return model


def score(docs: DataFrame, model: SubwordBags, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Adds score (0 to 1) and predicted (0 or 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size: 4 bytes a bucket

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        try:
            for col in batches:
                yield pa.array([m.score(t.as_py() or "") for t in col], pa.float64())
        finally:
            m.cache.forget()
            give_back()

    return docs.withColumn("score", scored(F.col(text))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").filter(fold_remainder("doc_id", 5) != 0)
    model = fit(docs, labels)
    return score(docs, model).select("doc_id", (fold_remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
