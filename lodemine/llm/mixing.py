"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Every document of a source has the same expected number of copies, target / source size, between
0 and ``cap``. Its whole part is certain; for the fraction, mass of size x probability moves within a
pair, by chance in one of two directions, until one of the two is at 0 or 1. The sum of size x
probability over the source never changes, and every document keeps its expectation.

1. Long documents, each over 1 / ``fan``^2 of their source, of which a source has less than ``fan``^2,
   meet, longest first, the pool of all documents of the source that are shorter, which share one
   probability. Where a document is so long that one direction would take the pool out of [0, 1], it
   goes the other way: nearness to the target comes before the expectation there.
2. The pool that is left is paired document by document in a reduction tree over the cluster: groups
   of about ``fan`` documents are folded each and leave one fractional document; those meet in groups
   of the next level, down to one document per source, the only one whose rounding shifts the sum. It
   holds at most 1 / ``fan``^2 of the source. A source without such short documents ends with its
   shortest document in step 1.

All chance is a hash of the documents' own values, so that reruns agree. A null text has size 0;
documents of size 0 are taken 0 times. The null source is a source, last in order. Repeated rows
are documents of their own. An empty table gives no rows; columns besides doc_id, source and text
aren't read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemine.llm.common import WORD, drop_tables, materialize, read
from lodemine.operators.ranking import global_rank


def sizes(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, source, size in words; rows that agree in all three are counted in ``rows``, so
    that a repeated row is no hot key."""
    size = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")
    return docs.select("doc_id", "source", size.alias("size")).groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows"))


def targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """source, source_size, documents, target. One row per source, written.

    Targets are min(cap x size, level x weight) with the level that makes them sum to all sizes.
    From the level without caps on, sources over their cap are set to it and the level of the others
    rises, until none is over. Sources are numbered by ranges, and no task holds them all."""
    per = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.sum("rows").alias("documents"))
    cycle = F.array(*map(F.lit, weights))
    per = global_rank(per, [F.col("source").asc_nulls_last()], "_rank").withColumn("weight", F.get(cycle, F.pmod("_rank", F.lit(len(weights)))))
    per = materialize(per.select("source", "source_size", "documents", "weight"), "mix-sources")
    level, free = -1.0, F.lit(True)
    while True:
        total, capped, weight = per.agg(F.sum("source_size"), F.sum(F.when(~free, F.col("source_size"))), F.sum(F.when(free, F.col("weight")))).first()
        after = (total - cap * (capped or 0)) / weight if weight else math.inf
        if not total or after <= level:
            break
        level = after
        free = F.col("source_size") * cap > F.lit(level) * F.col("weight")
    target = F.least(F.lit(cap) * F.col("source_size"), F.lit(max(level, 0.0)) * F.col("weight"))
    out = materialize(per.select("source", "source_size", "documents", target.alias("target")), "mix-targets")
    drop_tables(per.sparkSession, per)
    return out


#: The fold over a source's long documents, longest first: left is what the source still has to take,
#: pool the size of the documents that aren't settled. x is their shared probability; up and down say
#: whether the rest can still meet the target after either.
_LONG = """
aggregate(items, named_struct('left', target, 'pool', cast(source_size AS double), 'done', cast(array() AS array<struct<doc_id:bigint,size:bigint,take:int>>)),
  (acc, e) -> transform(array(named_struct(
      'x', least(greatest(acc.left / acc.pool - whole, 0D), 1D),
      'u', (xxhash64(e.h, 1) & 9007199254740991) / 9007199254740992D,
      'up', acc.left - (whole + 1) * e.size >= whole * (acc.pool - e.size),
      'down', acc.left - whole * e.size <= (whole + 1) * (acc.pool - e.size))),
    z -> transform(array(CASE WHEN z.x <= 0 THEN 0 WHEN z.x >= 1 THEN 1 WHEN z.up AND NOT z.down THEN 1 WHEN z.down AND NOT z.up THEN 0 WHEN z.u < z.x THEN 1 ELSE 0 END),
      take -> named_struct(
        'left', acc.left - (whole + take) * e.size,
        'pool', acc.pool - e.size,
        'done', array_append(acc.done, named_struct('doc_id', e.doc_id, 'size', e.size, 'take', take))))[0])[0])
"""
_ITEM = "struct<o:bigint,h:bigint,doc_id:bigint,size:bigint,x:double>"
_DONE = "array<struct<doc_id:bigint,size:bigint,take:int>>"
#: The fold over a group's documents: c is the one that is still fractional, a and b are a pair.
_FOLD = f"""
aggregate(items, named_struct('c', cast(NULL AS {_ITEM}), 'done', cast(array() AS {_DONE})),
  (acc, e) -> if(acc.c IS NULL, named_struct('c', e, 'done', acc.done),
    transform(array(named_struct('a', acc.c, 'b', e,
        'up', least(acc.c.size * (1 - acc.c.x), e.size * e.x),
        'down', least(acc.c.size * acc.c.x, e.size * (1 - e.x)),
        'u', (xxhash64(acc.c.h, e.h) & 9007199254740991) / 9007199254740992D)),
      z -> CASE
        WHEN z.u * (z.up + z.down) < z.down AND z.a.size * (1 - z.a.x) <= z.b.size * z.b.x THEN named_struct(
          'c', named_struct('o', z.b.o, 'h', z.b.h, 'doc_id', z.b.doc_id, 'size', z.b.size, 'x', greatest(z.b.x - z.up / z.b.size, 0D)),
          'done', array_append(acc.done, named_struct('doc_id', z.a.doc_id, 'size', z.a.size, 'take', 1)))
        WHEN z.u * (z.up + z.down) < z.down THEN named_struct(
          'c', named_struct('o', z.a.o, 'h', z.a.h, 'doc_id', z.a.doc_id, 'size', z.a.size, 'x', least(z.a.x + z.up / z.a.size, 1D)),
          'done', array_append(acc.done, named_struct('doc_id', z.b.doc_id, 'size', z.b.size, 'take', 0)))
        WHEN z.a.size * z.a.x <= z.b.size * (1 - z.b.x) THEN named_struct(
          'c', named_struct('o', z.b.o, 'h', z.b.h, 'doc_id', z.b.doc_id, 'size', z.b.size, 'x', least(z.b.x + z.down / z.b.size, 1D)),
          'done', array_append(acc.done, named_struct('doc_id', z.a.doc_id, 'size', z.a.size, 'take', 0)))
        ELSE named_struct(
          'c', named_struct('o', z.a.o, 'h', z.a.h, 'doc_id', z.a.doc_id, 'size', z.a.size, 'x', greatest(z.a.x - z.down / z.a.size, 0D)),
          'done', array_append(acc.done, named_struct('doc_id', z.b.doc_id, 'size', z.b.size, 'take', 1)))
      END)[0]))
"""


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0, fan: int = 64, seed: int = 17, text: str = "text") -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken (words): a row per row of docs."""
    sized = materialize(sizes(docs, text), "mix-sizes")
    per = targets(sized, weights, cap)
    n, most = per.agg(F.count("*"), F.max("documents")).first()
    levels = 1 + max(0, math.ceil(math.log(max(1, math.ceil((most or 1) / fan)), fan) - 1e-9))
    mean = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # a whole mean is of the interval below, so that every document has a choice that keeps to it
    per = per.withColumn("whole", F.greatest(F.ceil(mean) - 1, F.lit(0)).cast("int"))
    constants = ["source", "source_size", "target", "whole"]

    def beside(sources: DataFrame) -> DataFrame:
        """sized beside a table of one row per source, one row for each of repeated rows."""
        side = sources.withColumnRenamed("source", "_source")
        side = F.broadcast(side) if n <= 100_000 else side
        rows = sized.join(side, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
        many = 1 << 16  # rows are counted out in two steps, so that no array is long
        rows = rows.withColumn("_lot", F.explode(F.sequence(F.lit(0), F.floor((F.col("rows") - 1) / many)))).withColumn("_in_lot", F.least(F.col("rows") - F.col("_lot") * many, F.lit(many)))
        rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_in_lot").cast("long")))).withColumn("_copy", F.col("_copy") + F.col("_lot") * many)
        return rows.withColumn("_h", F.xxhash64("doc_id", "source", "size", "_copy", F.lit(seed)))

    item = F.struct((-F.col("size")).alias("o"), F.col("_h").alias("h"), "doc_id", "size")
    rows = beside(per).filter("size > 0")
    long = F.col("size") * F.lit(fan * fan) > F.col("source_size")
    settled = rows.filter(long).groupBy(*constants).agg(F.sort_array(F.collect_list(item)).alias("items"))
    settled = materialize(settled.select(*constants, F.expr(_LONG).alias("_fold")).select(*constants, "_fold.*"), "mix-long")
    out = settled.select(*constants, F.explode("done").alias("_d")).select("_d.doc_id", "_d.size", *constants, F.col("_d.take").alias("_take"))
    pool = settled.select(F.col("source").alias("_settled"), "left", "pool", F.lit(True).alias("_some"))
    per = per.join(F.broadcast(pool) if n <= 100_000 else pool, F.col("source").eqNullSafe(F.col("_settled")), "left").drop("_settled")
    per = per.withColumn("left", F.when(F.col("_some"), F.col("left")).otherwise(F.col("target"))).withColumn("pool", F.when(F.col("_some"), F.col("pool")).otherwise(F.col("source_size")))
    per = materialize(per.withColumn("_x", F.least(F.greatest(F.coalesce(F.try_divide("left", "pool"), F.lit(0.0)) - F.col("whole"), F.lit(0.0)), F.lit(1.0))).drop("left", "pool", "_some"), "mix-pools")
    rows = beside(per)
    out = out.unionByName(rows.filter("size = 0").select("doc_id", "size", *constants, F.lit(0).alias("_take")))
    rows = rows.filter("size > 0").filter(~long)
    certain = (F.col("_x") <= 0) | (F.col("_x") >= 1)
    out = out.unionByName(rows.filter(certain).select("doc_id", "size", *constants, F.col("_x").cast("int").alias("_take")))
    groups = F.greatest(F.ceil(F.col("documents") / fan), F.lit(1))
    live = rows.filter(~certain).select(*constants, F.pmod(F.col("_h"), groups).alias("_group"), F.struct((-F.col("size")).alias("o"), F.col("_h").alias("h"), "doc_id", "size", F.col("_x").alias("x")).alias("_item"))
    for level in range(levels):
        folded = live.groupBy(*constants, "_group").agg(F.sort_array(F.collect_list("_item")).alias("items"))
        folded = materialize(folded.select(*constants, "_group", F.expr(_FOLD).alias("_fold")).select(*constants, "_group", "_fold.*"), f"mix-level{level}")
        out = out.unionByName(folded.select(*constants, F.explode("done").alias("_d")).select("_d.doc_id", "_d.size", *constants, F.col("_d.take").alias("_take")))
        live = folded.select(*constants, F.floor(F.col("_group") / fan).alias("_group"), F.col("c").alias("_item"))
    last = F.when((F.shiftrightunsigned(F.xxhash64("_item.h", F.lit(seed)), 11) / F.lit(float(1 << 53))) < F.col("_item.x"), 1).otherwise(0)
    out = out.unionByName(live.select("_item.doc_id", "_item.size", *constants, last.alias("_take")))
    copies = F.when(F.col("size") > 0, F.col("whole") + F.col("_take")).otherwise(F.lit(0)).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def repeat(docs: DataFrame, copies: DataFrame) -> DataFrame:
    """docs with each row as often as copies (doc_id, size, copies) says. Rows without doc_id or
    without words have no place in the mix and stay once; rows that share a doc_id follow the one
    of them that is taken most."""
    per = copies.filter("doc_id IS NOT NULL AND size > 0").groupBy("doc_id").agg(F.max("copies").cast("int").alias("_copies"))
    rows = docs.join(per.hint("shuffle_hash"), "doc_id", "left").withColumn("_copies", F.coalesce("_copies", F.lit(1)))
    return rows.withColumn("_copy", F.explode(F.when(F.col("_copies") > 0, F.sequence(F.lit(1), "_copies")))).drop("_copy", "_copies")


#: What SQL can say of op4_mixing: all but the random choice.
TARGETS_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [1, 2, 3][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM d GROUP BY source
), l AS (
  SELECT *, (sum(source_size) OVER () - 3.0 * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s
), t AS (
  SELECT source, source_size, least(3.0 * source_size, max(level) OVER () * weight) AS target FROM l
)
SELECT d.doc_id, d.size, t.source_size, t.target FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
"""
