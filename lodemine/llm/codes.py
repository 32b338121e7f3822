"""Vector codes: vectors cut into parts, each replaced by the nearest entry of its position's codebook.

The nearest entry is found by annular norm pruning. A codebook's entries are sorted by norm; an entry
nearer to a part than the best one so far has a norm within that distance of the part's norm, so that
only the entries of this interval (ends included), found by binary search, are evaluated exactly, and
the interval shrinks as better entries turn up. Ties go to the entry with the lower index.

All is whole numbers: components are floor(scale * x), saturated at +-2^27, so that squared distances
of parts of up to 32 components fit a long. Codebooks start as the parts of the smallest ids and are moved by
rounds of Lloyd's algorithm. A round is one pass over the vectors: each task sums the parts of each
entry, and one row for each component of a codebook goes to the driver, however many vectors there are.

Vectors that are null or hold null or non-finite components are dropped, as are empty ones. Vectors of
different length have codebooks of their own (their number, times the size of a codebook, is what the
driver and each task hold; more than ``MOST_LENGTHS`` are refused). A length that ``parts`` doesn't
divide gives the first parts one component more; a part without components has code 0 and error 0. Rows
without an id are encoded but start no codebook; of rows that share an id the smallest vector in order
starts one; with fewer ids than entries a codebook is shorter. Repeated rows are encoded and counted
as often as they stand there; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodemine.llm.common import drop_tables, free_name, materialize, read

LARGEST = 1 << 27
MOST_LENGTHS = 1024
#: Labels up to this number are broadcast with their sums.
BROADCAST_LABELS = 100_000

#: By length of the vectors: for each part position entries x components of the part.
Books = dict[int, list[np.ndarray]]


def whole(vectors: DataFrame, vector: str, scale: int = 4096) -> DataFrame:
    """The rows whose vector is sound, with ``_whole``: floor(scale * x) of its components."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    floor = F.transform(vector, lambda x: F.least(F.greatest(F.floor(x.cast("double") * scale).cast("double"), F.lit(-float(LARGEST))), F.lit(float(LARGEST))).cast("int"))
    return vectors.filter(F.coalesce((F.size(vector) > 0) & sound, F.lit(False))).withColumn("_whole", floor)


def bounds(length: int, parts: int) -> list[tuple[int, int]]:
    at = [0]
    for i in range(parts):
        at.append(at[-1] + length // parts + (i < length % parts))
    return list(zip(at, at[1:]))


def by_annulus(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Of each row of x the nearest entry and its squared distance; and how many distances were
    evaluated. x, entries: whole numbers."""
    n, k = len(x), len(entries)
    # float sums of squares are only used for pruning, with room for their rounding
    norms = np.sqrt((entries.astype(np.float64) ** 2).sum(1))
    order = np.lexsort((np.arange(k), norms))
    norms = norms[order]
    own = np.sqrt((x.astype(np.float64) ** 2).sum(1))
    room = 1e-9 * (own + (norms[-1] if k else 0)) + 1e-6

    def distance(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        d = x[rows] - entries[order[at]]
        return (d * d).sum(1)

    first = np.clip(np.searchsorted(norms, own), 0, k - 1)
    best, code = distance(np.arange(n), first), order[first]
    evaluated = n
    reach = np.sqrt(best.astype(np.float64)) + room
    low, high = np.searchsorted(norms, own - reach, "left"), np.searchsorted(norms, own + reach, "right")
    # outwards from the first on both sides, by one entry a step; rows leave as their interval is done
    for side in (-1, 1):
        rows, at = np.arange(n), first + side
        while True:
            live = (at >= low[rows]) & (at < high[rows])
            rows, at = rows[live], at[live]
            if not len(rows):
                break
            d, c = distance(rows, at), order[at]
            evaluated += len(rows)
            won = (d < best[rows]) | (d == best[rows]) & (c < code[rows])
            better = rows[won]
            best[better], code[better] = d[won], c[won]
            reach = np.sqrt(best[better].astype(np.float64)) + room[better]
            low[better], high[better] = np.searchsorted(norms, own[better] - reach, "left"), np.searchsorted(norms, own[better] + reach, "right")
            at = at + side
    return code, best, evaluated


def _blocks(vectors: pa.ListArray, rows: int = 1 << 14) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """length, positions and vectors as rows, for the lengths that occur; in blocks of bounded size."""
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    for length in np.unique(lengths):
        for at in np.array_split(places := np.flatnonzero(lengths == length), -(-len(places) // rows)):
            flat = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
            yield int(length), at, flat.astype(np.int64).reshape(len(at), -1)


def first_books(table: DataFrame, parts: int, entries: int, key: str) -> Books:
    """The vectors of the smallest ids, cut. Ids are combined before they are ranked."""
    ids = table.filter(F.col(key).isNotNull()).select(F.size("_whole").alias("_n"), F.col(key).alias("_id")).distinct()
    smallest = ids.withColumn("_at", F.row_number().over(Window.partitionBy("_n").orderBy("_id"))).filter(F.col("_at") <= entries)
    side = table.select(F.size("_whole").alias("_n"), F.col(key).alias("_id"), "_whole")
    held = side.join(F.broadcast(smallest), ["_n", "_id"]).groupBy("_n", "_id", "_at").agg(F.min("_whole").alias("v")).collect()
    books: Books = {}
    for n in {r["_n"] for r in held}:
        rows = np.array([r["v"] for r in sorted((r for r in held if r["_n"] == n), key=lambda r: r["_at"])], np.int64)
        books[n] = [np.ascontiguousarray(rows[:, a:b]) for a, b in bounds(n, parts)]
    return books


def _moved(table: DataFrame, books: Books) -> Books:
    """One round: every entry goes to the floored mean of its parts, unused entries stay."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {n: [(np.zeros(len(b), np.int64), np.zeros(b.shape, np.int64)) for b in book] for n, book in books.items()}
        for batch in batches:
            for n, _, x in _blocks(batch.column(0)):
                for (count, add), book, (a, b) in zip(total.get(n, ()), books.get(n, ()), bounds(n, len(books.get(n, ())) or 1)):
                    code, _, _ = by_annulus(part := x[:, a:b], book)
                    order = np.argsort(code.astype(np.uint16), kind="stable")
                    there, starts = np.unique(code[order], return_index=True)
                    count += np.bincount(code, minlength=len(book))
                    if b > a:
                        add[there] += np.add.reduceat(part[order], starts, axis=0)
        for n, positions in total.items():
            for p, (count, add) in enumerate(positions):
                used = np.flatnonzero(count)
                # the count stands as component -1
                values = np.column_stack([count[used], add[used]])
                e, c = np.meshgrid(used, np.arange(-1, add.shape[1]), indexing="ij")
                columns = [np.full(values.size, n), np.full(values.size, p), e.ravel(), c.ravel(), values.ravel()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, [pa.int32()] * 4 + [pa.int64()])], ["n", "part", "entry", "at", "value"])

    rows = table.select("_whole").mapInArrow(sums, "n int, part int, entry int, at int, value long")
    # sums over all tasks may exceed a long
    got = rows.groupBy("n", "part", "entry", "at").agg(F.sum(F.col("value").cast("decimal(19,0)")).alias("value")).collect()
    found = {(r["n"], r["part"], r["entry"], r["at"]): int(r["value"]) for r in got}
    out = {n: [b.copy() for b in book] for n, book in books.items()}
    for (n, p, e, at), value in found.items():
        if at >= 0:
            out[n][p][e, at] = value // found[n, p, e, -1]
    return out


def train(table: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, key: str = "vec_id") -> Books:
    """table: ``whole()``'s rows, stored, as each round reads them."""
    if entries > 256:
        raise ValueError("a code has to fit two hex digits")
    lengths = [r[0] for r in table.select(F.size("_whole")).distinct().limit(MOST_LENGTHS + 1).collect()]
    if len(lengths) > MOST_LENGTHS:
        raise ValueError(f"vectors of more than {MOST_LENGTHS} lengths")
    if max(lengths, default=0) > 32 * parts:
        raise ValueError("parts of more than 32 components")
    books = first_books(table, parts, entries, key)
    for _ in range(rounds):
        books = _moved(table, books)
    return books


def encode(table: DataFrame, books: Books) -> DataFrame:
    """Adds ``code`` (two hex digits a part) and ``error``, drops ``_whole``. Vectors of a length
    without codebooks (no id has it) get neither."""

    @F.arrow_udf("struct<code:string,error:bigint>")
    def coded(vectors: pa.Array) -> pa.Array:
        codes, errors = np.full(len(vectors), None, object), np.zeros(len(vectors), np.int64)
        known = np.zeros(len(vectors), bool)
        for n, rows, x in _blocks(vectors):
            if n not in books:
                continue
            both = [by_annulus(x[:, a:b], book)[:2] for book, (a, b) in zip(books[n], bounds(n, len(books[n])))]
            codes[rows] = [bytes(r).hex() for r in np.column_stack([c for c, _ in both]).astype(np.uint8)]
            errors[rows], known[rows] = sum(d for _, d in both), True
        return pa.StructArray.from_arrays([pa.array(codes, pa.string()), pa.array(errors, pa.int64(), mask=~known)], ["code", "error"])

    c = free_name(table, "_c")
    return table.withColumn(c, coded("_whole")).withColumn("code", F.col(f"{c}.code")).withColumn("error", F.col(f"{c}.error")).drop(c, "_whole")


def label_errors(coded: DataFrame, label: str = "label") -> DataFrame:
    """Adds ``label_error``: the errors of all rows with the same label, null ones together. Sums are
    made before the shuffle; few labels are broadcast, many joined by a shuffle."""
    key = free_name(coded, "_label")
    sums = materialize(coded.groupBy(F.col(label).alias(key)).agg(F.sum("error").alias("label_error")), "label-errors")
    side = F.broadcast(sums) if sums.count() <= BROADCAST_LABELS else sums
    return coded.join(side, F.col(label).eqNullSafe(F.col(key)), "left").drop(key)


def digest(books: Books) -> str:
    """Of all components by length, part, entry and position."""
    return hashlib.sha256(",".join(str(v) for n in sorted(books) for book in books[n] for v in book.ravel().tolist()).encode()).hexdigest()


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    table = materialize(whole(rows, "embedding").drop("embedding"), "whole-vectors")
    books = train(table)
    out = materialize(encode(table, books), "coded")
    drop_tables(spark, table)
    return label_errors(out).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _oracle(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """For vectors of one length that parts divides, with different ids, and at least one."""
    nearest = "SELECT p.vec_id, p.part, p.v, min({entries} * list_sum([(p.v[i] - b.v[i]) * (p.v[i] - b.v[i]) for i in range(1, len(p.v) + 1)]) + b.entry) AS d FROM p JOIN b{r} b USING (part) GROUP BY ALL"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED ({nearest.format(entries=entries, r=r)})")
        if r < rounds:
            steps.append(f"""m{r} AS (SELECT part, entry, list(CAST(floor((s - ((s % n) + n) % n) / n) AS BIGINT) ORDER BY i) AS v FROM (
  SELECT part, CAST(d % {entries} AS INT) AS entry, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM a{r}) GROUP BY ALL) GROUP BY ALL)""")
            steps.append(f"b{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM b{r} b LEFT JOIN m{r} m USING (part, entry))")
    return f"""
WITH k AS (
  SELECT vec_id, label, [CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v FROM embeddings
  WHERE len(embedding) > 0 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), p AS MATERIALIZED (
  SELECT vec_id, part, v[part * (len(v) // {parts}) + 1:(part + 1) * (len(v) // {parts})] AS v FROM (SELECT *, unnest(range({parts})) AS part FROM k)
), b0 AS MATERIALIZED (
  SELECT part, CAST(row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS INT) AS entry, v FROM p QUALIFY row_number() OVER (PARTITION BY part ORDER BY vec_id) <= {entries}
), {', '.join(steps)},
e AS (
  SELECT vec_id, string_agg(printf('%02x', CAST(d % {entries} AS INT)), '' ORDER BY part) AS code, CAST(sum(d // {entries}) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id
), l AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM e JOIN k USING (vec_id) GROUP BY label),
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})
SELECT e.vec_id, code, error, label_error, codebooks_sha256 FROM e JOIN k USING (vec_id) JOIN l ON k.label IS NOT DISTINCT FROM l.label CROSS JOIN h
"""


OP12_SQL = _oracle()
