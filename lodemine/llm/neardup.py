"""MinHash near-duplicates with sequential Bayesian verification.

1. Each text becomes its set of 5-word shingles (64-bit hashes), a MinHash signature, and one key
   per band. Texts with equal sets form a class, whichever rows they stand in.
2. Classes that share a band key are candidates. Of each bucket the member that meets most others
   over all bands is the pivot, and each member is paired with it: a group of near-copies costs one
   pair per member, not one per pair.
3. A pair's signatures are compared batch by batch. Under a uniform prior, n hashes with m matches
   leave the similarity at or above the threshold with probability Binomial(n + 1, t)(<= m); a pair
   is dropped once that is below the miss probability. Survivors are verified on the full sets.
4. Verified pairs are linked; components by large and small stars. Pairs of one component need no
   test. The rest is complete: buckets that still hold several components are cut into parts, each
   two parts meet as a block, and every pair across components is pruned in the same way. The members
   of surviving pairs meet again in their block with their full sets, and only links leave that task,
   so that what is passed on grows with the members of the buckets and not with their pairs.

Null and empty texts have empty sets and link with nothing. Rows without doc_id take no part: their
component_id is null and they are kept. Rows that share a doc_id are linked, whatever their texts (and
are kept or go together): all of its texts count. Repeated texts are one class. An empty table gives
no rows. Only the key and the text are read. Intermediate tables are deleted; the result is a table in
the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemine.llm.common import Recent, drop_tables, give_back, materialize, read
from lodemine.llm.components import components

ROWS, BANDS = 5, 32
HASHES = ROWS * BANDS
#: Ids of at most this many rows are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 50_000

_P = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes() -> Recent:
    """A cache for one task."""
    return Recent(xxhash.xxh64_intdigest, 150_000)


def shingle_set(text: str | None, hash_of: Recent, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the text's k-word shingles (ASCII letters lower-cased; fewer than
    k words: the whole sequence)."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hash_of.__getitem__, words), np.uint64, len(words))
    width = min(k, len(h))
    s = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        s = s * _P + h[i : len(h) - width + 1 + i]
    return np.unique(_mix(s))


@lru_cache(maxsize=1)
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(0, 1 << 32, (HASHES, 1), np.uint32), rng.integers(0, 1 << 31, (HASHES, 1), np.uint32) * np.uint32(2) + np.uint32(1)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each of HASHES permutations (32 bits)."""
    x, a = _permutations()
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(low), 2048):
        h = (low[at : at + 2048] ^ x) * a
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(13)
        np.minimum(out, h.min(1), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """Of the 16-bit signature, so that two documents share a key if and only if that band of
    their stored signatures agrees."""
    s = np.arange(BANDS, dtype=np.uint64)
    for column in sig.reshape(BANDS, ROWS).T:
        s = s * _P + column.astype(np.uint64) + np.uint64(1)
    return _mix(s).view(np.int64)


def sketches(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, hash (of the text), n (size of the set), fp (of the set; null if empty), sig (16 bits of
    each hash), bands."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hash_of = word_hashes()
        for batch in batches:
            n, fp, sig, bands = [], [], [], []
            for t in batch.column(2):
                s = shingle_set(t.as_py(), hash_of)
                n.append(len(s))
                if len(s):
                    v = signature(s).astype(np.uint16)
                    fp.append(xxhash.xxh3_128_digest(s.tobytes()))
                    sig.append(v.tobytes())
                    bands.append(band_keys(v))
                else:
                    fp.append(None)
                    sig.append(None)
                    bands.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "hash", "n", "fp", "sig", "bands"])
        hash_of.forget()
        give_back()

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("hash"), F.col(text).alias("text")).mapInArrow(rows, "doc_id long, hash long, n long, fp binary, sig binary, bands array<long>")


@lru_cache(maxsize=8)
def least_matches(threshold: float, miss: float, batch: int = 32) -> tuple[tuple[int, int], ...]:
    """(n, m): after n hashes a pair with fewer than m matches is dropped."""
    out = []
    for n in range(batch, HASHES + 1, batch):
        p, total, m = (1 - threshold) ** (n + 1), 0.0, 0
        while total + p < miss and m <= n:
            total += p
            p *= (n + 1 - m) / (m + 1) * threshold / (1 - threshold)
            m += 1
        out.append((n, m))
    return tuple(out)


def surviving(a: np.ndarray, b: np.ndarray, threshold: float, miss: float) -> np.ndarray:
    """Which rows of two signature matrices are still in question after all batches."""
    left, matches, at = np.arange(len(a)), np.zeros(len(a), np.int32), 0
    for n, m in least_matches(threshold, miss):
        if not len(left):
            break
        matches = matches + (a[left, at:n] == b[left, at:n]).sum(1, dtype=np.int32)
        keep = matches >= m
        left, matches, at = left[keep], matches[keep], n
    return left


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, HASHES)


def prune(pairs: DataFrame, sigs: DataFrame, threshold: float, miss: float) -> DataFrame:
    """The pairs (a, b) whose signatures don't rule the threshold out."""
    side = lambda c: sigs.select(F.col("id").alias(c), F.col("sig").alias(f"sig_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sig_a", "sig_b")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                kept = surviving(_matrix(batch.column(2)), _matrix(batch.column(3)), threshold, miss)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept)), batch.column(1).take(pa.array(kept))], ["a", "b"])

    return both.mapInArrow(rows, "a long, b long")


def _bounded_broadcast(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _sets(ids: DataFrame, classes: DataFrame, docs: DataFrame, name: str) -> DataFrame:
    """id, set of the classes named, built from the text of one row each."""
    named = classes.join(_bounded_broadcast(ids), "id").select("id", F.col("rep").alias("doc_id"), "hash")
    held = docs.withColumn("hash", F.xxhash64("text")).join(_bounded_broadcast(named), ["doc_id", "hash"])
    held = held.groupBy("id").agg(F.min("text").alias("text"))  # of repeated rows one

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hash_of = word_hashes()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t.as_py(), hash_of).tobytes() for t in batch.column(1)], pa.binary())], ["id", "set"])
        hash_of.forget()
        give_back()

    return materialize(held.mapInArrow(build, "id long, set binary"), f"{name}-sets")


def linked(s: np.ndarray, t: np.ndarray, share: int) -> bool:
    """Whether 100 * common >= share * union, for sorted sets."""
    if len(s) > len(t):
        s, t = t, s
    if not len(s) or 100 * len(s) < share * len(t):
        return False
    at = np.searchsorted(t, s)
    common = int((t[np.minimum(at, len(t) - 1)] == s).sum())
    return 100 * common >= share * (len(s) + len(t) - common)


def verify(pairs: DataFrame, classes: DataFrame, docs: DataFrame, threshold: float, name: str) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold. Sets are built for the classes of the
    pairs only."""
    pairs = materialize(pairs, f"{name}-survivors")
    ids = materialize(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), f"{name}-ids")
    sets = _sets(ids, classes, docs, name)
    side = lambda c: sets.select(F.col("id").alias(c), F.col("set").alias(f"set_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "set_a", "set_b")
    share = round(threshold * 100)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [i for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))) if linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), share)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int64())), batch.column(1).take(pa.array(kept, pa.int64()))], ["a", "b"])

    links = materialize(both.mapInArrow(rows, "a long, b long"), f"{name}-links")
    drop_tables(docs.sparkSession, pairs, ids, sets)
    return links


def _blocks(rows: DataFrame, chunk: int = 1024) -> DataFrame:
    """rows: key, band, id, n, label, sig of buckets with several labels, with the bucket's commonest
    label (main), its rows (n_main) and all rows (n_all). Buckets are cut into parts of about ``chunk``
    rows, those of the commonest label apart from the others. A block p, q is where two parts meet, and
    each two do, but for two of the commonest label: a large component with few others beside it is
    read once, not once for each of its parts."""
    of = lambda n: F.greatest(F.ceil(n / chunk), F.lit(1)).cast("int")
    rows = rows.withColumn("_mains", of(F.col("n_main"))).withColumn("_rest", of(F.col("n_all") - F.col("n_main")))
    inside, h = F.col("label") == F.col("main"), F.xxhash64("id")
    rows = rows.withColumn("_part", F.when(inside, F.pmod(h, F.col("_mains"))).otherwise(F.col("_mains") + F.pmod(h, F.col("_rest"))).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.when(inside, F.col("_mains")).otherwise(F.lit(0)), F.col("_mains") + F.col("_rest") - 1)))
    return rows.select("key", F.least("_part", "_other").alias("p"), F.greatest("_part", "_other").alias("q"), (F.col("_part") <= F.col("_other")).alias("left"), "band", "id", "n", "label", "sig")


def _across(rows: DataFrame, threshold: float, miss: float) -> DataFrame:
    """rows: those of _blocks(), with set or not. A pair of different labels counts in the first band
    that both share. Without sets: key, p, q, id of the members of pairs that survive pruning in their
    block. With sets: links a, b between labels, as many as join them."""
    exact = "set" in rows.columns
    rows = rows.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "id")
    share = round(threshold * 100)

    def group(t: pa.Table) -> list[tuple]:
        key, p, q, band = (t.column(c)[0].as_py() for c in ("key", "p", "q", "band"))
        ids, n, label, left = (t.column(c).to_numpy() for c in ("id", "n", "label", "left"))
        sig, band, m = _matrix(t.column("sig")), band * ROWS, len(t)
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("set")] if exact else []
        root = {x: x for x in label.tolist()}

        def find(x: int) -> int:
            while root[x] != x:
                x = root[x]
            return x

        involved, links = np.zeros(m, bool), []
        for i in range(m):
            if p == q:
                j = np.arange(i + 1, m)
            elif left[i]:
                j = np.flatnonzero(~left)
            else:
                continue
            j = j[(label[j] != label[i]) & (100 * np.minimum(n[i], n[j]) >= share * np.maximum(n[i], n[j]))]
            if len(j):
                j = j[surviving(np.broadcast_to(sig[i], (len(j), HASHES)), sig[j], threshold, miss)]
            if len(j) and band:
                j = j[~(sig[j, :band] == sig[i, :band]).reshape(len(j), -1, ROWS).all(2).any(1)]
            if not exact:
                involved[j] = True
                involved[i] |= len(j) > 0
                continue
            for k in j.tolist():
                a, b = find(int(label[i])), find(int(label[k]))
                if a != b and linked(sets[i], sets[k], share):
                    root[max(a, b)] = min(a, b)
                    links.append((int(min(ids[i], ids[k])), int(max(ids[i], ids[k]))))
        return links if exact else [(key, p, q, int(x)) for x in ids[involved]]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("a", "b") if exact else ("key", "p", "q", "id")
        kinds, held = {"p": pa.int32(), "q": pa.int32()}, None

        def out(t: pa.Table) -> pa.RecordBatch:
            k, p, q = (t.column(c).to_numpy() for c in ("key", "p", "q"))
            cut = np.flatnonzero((k[1:] != k[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])) + 1
            found = [x for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(k)]) if b - a > 1 for x in group(t.slice(a, b - a).combine_chunks())]
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], kinds.get(c, pa.int64())) for i, c in enumerate(names)], list(names))

        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            last = [held.column(c)[-1].as_py() for c in ("key", "p", "q")]
            same = np.logical_and.reduce([held.column(c).to_numpy() == v for c, v in zip(("key", "p", "q"), last)])
            first = int(same.argmax())  # rows from here on may go on in the next batch
            if first:
                yield out(held.slice(0, first).combine_chunks())
                held = held.slice(first).combine_chunks()
        if held is not None and held.num_rows:
            yield out(held)
        held = None
        give_back()

    return rows.mapInArrow(stream, "a long, b long" if exact else "key long, p int, q int, id long")


def near_duplicates(docs: DataFrame, threshold: float = 0.75, miss: float = 1e-4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row per row of docs."""
    spark = docs.sparkSession
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    base = materialize(sketches(docs).withColumn("row", F.monotonically_increasing_id()), "sketches")
    known = base.filter("doc_id IS NOT NULL AND fp IS NOT NULL")
    # rep: the smallest doc_id with this set, of which one row stands for the class
    classes = known.groupBy("fp").agg(F.min(F.struct("doc_id", "row", "hash")).alias("_m"), F.count("*").alias("copies"))
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("id"), "fp", F.col("_m.doc_id").alias("rep"), F.col("_m.row").alias("row"), F.col("_m.hash").alias("hash"), "copies"), "classes")
    reps = materialize(known.select("row", "n", "sig", "bands").join(classes.select("id", "row"), "row").drop("row"), "reps")
    sigs = reps.select("id", "sig")

    exploded = reps.select("id", "n", F.posexplode("bands").alias("band", "key"))
    shared = materialize(exploded.groupBy("key").agg(F.count("*").alias("cnt")).filter("cnt > 1"), "shared-keys")
    members = materialize(exploded.join(_bounded_broadcast(shared), "key"), "members")

    # pivots
    met = members.groupBy("id").agg(F.sum("cnt").alias("met"))
    ranked = members.join(met, "id")
    pivots = ranked.groupBy("key").agg(F.max(F.struct("met", (-F.col("id")).alias("neg"), "n")).alias("top")).select("key", (-F.col("top.neg")).alias("pivot"), F.col("top.n").alias("pivot_n"))
    share = round(threshold * 100)
    fits = lambda x, y: F.least(x, y) * 100 >= F.greatest(x, y) * share
    stars = members.join(pivots, "key").filter("id <> pivot").filter(fits(F.col("n"), F.col("pivot_n")))
    stars = stars.select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()
    starred = verify(prune(stars, sigs, threshold, miss), classes, docs, threshold, "star")

    # several texts under one doc_id: their classes are linked, each with the first of them
    prints = base.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("fp").alias("low"), F.max("fp").alias("high"), F.count("*").alias("rows"), F.count("fp").alias("texts"))
    several = materialize(prints.filter("low <> high OR texts > 0 AND texts < rows").select("doc_id", (F.col("low") != F.col("high")).alias("differ"), (F.col("texts") < F.col("rows")).alias("empty")), "several-texts")
    own = known.join(_bounded_broadcast(several.filter("differ")), "doc_id").select("doc_id", "fp").distinct()
    own = materialize(own.join(classes.select("id", "fp"), "fp").select("doc_id", "id"), "own-classes")
    first = own.groupBy("doc_id").agg(F.min("id").alias("a"))
    linked_rows = own.withColumnRenamed("id", "b").join(_bounded_broadcast(first), "doc_id").filter("a <> b").select("a", "b")
    links = materialize(starred.unionByName(linked_rows), "row-links")

    early = components(links)
    rows = members.join(early, "id", "left").withColumn("label", F.coalesce("label", "id"))
    counts = rows.groupBy("key", "label").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "label")).alias("m"), F.sum("c").alias("n_all"))
    mixed = counts.select("key", F.col("m.label").alias("main"), F.col("m.c").alias("n_main"), "n_all").filter("n_main < n_all")
    blocks = _blocks(rows.join(mixed, "key").join(sigs, "id"))
    involved = materialize(_across(blocks, threshold, miss), "involved")
    ids = materialize(involved.select("id").distinct(), "across-ids")
    sets = _sets(ids, classes, docs, "across")
    found = _across(blocks.join(_bounded_broadcast(involved), ["key", "p", "q", "id"]).join(sets, "id"), threshold, miss)
    everything = materialize(links.unionByName(found), "links")
    labels = components(everything)

    # a component goes by its smallest doc_id
    inside = labels.unionByName(labels.select(F.col("label").alias("id"), "label").distinct())
    inside = materialize(inside.join(classes.select("id", "fp", "rep", "copies"), "id"), "linked-classes")
    lowest = materialize(inside.groupBy("label").agg(F.min("rep").alias("component_id")), "lowest")
    named = inside.join(_bounded_broadcast(lowest), "label").select("id", "component_id")
    named = materialize(classes.join(named, "id", "left").select("fp", "copies", F.coalesce("component_id", "rep").alias("component_id")), "named")
    # texts with over a thousandth of all rows, at most a thousand, are broadcast, so that none is a hot key
    bound = known.count() / 1000
    often = F.broadcast(named.filter(F.col("copies") > bound).select("fp", "component_id"))
    seldom = named.filter(F.col("copies") <= bound).select("fp", "component_id")
    out = known.join(often, "fp").unionByName(known.join(often.drop("component_id"), "fp", "left_anti").join(seldom, "fp"))
    alone = base.filter("doc_id IS NULL OR fp IS NULL").select("doc_id", "n")
    beside = known.join(_bounded_broadcast(several.filter("empty")), "doc_id").select("doc_id", "fp").join(named, "fp").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    alone = alone.join(_bounded_broadcast(beside), "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    out = out.select("doc_id", "n", "component_id").unionByName(alone.select("doc_id", "n", "component_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
    out = materialize(out, "near-duplicates")
    drop_tables(spark, base, classes, reps, shared, members, involved, ids, sets, starred, links, early, everything, labels, inside, lowest, named, several, own)
    return out


def op8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
