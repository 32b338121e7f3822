"""Set operations and lookups that other engines write as index arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def semi(df: DataFrame, ids: DataFrame, on: str | list[str]) -> DataFrame:
    return df.join(ids, on, "left_semi")


def anti(df: DataFrame, ids: DataFrame, on: str | list[str]) -> DataFrame:
    return df.join(ids, on, "left_anti")


def member_positions(a: DataFrame, b: DataFrame, value: str, position: str) -> DataFrame:
    """The positions in b of the values of a that b has."""
    return a.select(value).distinct().join(b.select(value, position), value)


def marks(df: DataFrame, ids: DataFrame, on: str, name: str = "marked") -> DataFrame:
    """Adds whether the row's id is among ids."""
    return df.join(ids.select(on).distinct().withColumn("_m", F.lit(True)), on, "left").withColumn(name, F.col("_m").isNotNull()).drop("_m")


def lookup(wanted: DataFrame, rows: DataFrame, on: list[str], fields: list[str], order: list[str]) -> DataFrame:
    """wanted with ``found``: the rows of its key as a sorted array, empty if there are none."""
    item = F.struct(*order, *[f for f in fields if f not in order])
    got = rows.groupBy(*on).agg(F.sort_array(F.collect_list(item)).alias("found"))
    return wanted.join(got, on, "left").withColumn("found", F.coalesce("found", F.array().cast(got.schema["found"].dataType)))


def has_field(df: DataFrame, path: str) -> bool:
    """Whether the schema has a column or a nested field of that dotted name."""
    kind = df.schema
    for name in path.split("."):
        if name not in getattr(kind, "names", []):
            return False
        kind = kind[name].dataType
    return True


def laplace(pos: Column, neg: Column) -> Column:
    return (pos + 1) / (pos + neg + 2)


def ten_bins(x: Column) -> Column:
    """ceil(10 x), 0 counting as 1."""
    return F.greatest(F.ceil(x * 10), F.lit(1)).cast("int")


def running_share(df: DataFrame, keys: list[str], order: list[str], weight: str, name: str = "share") -> DataFrame:
    """The cumulative distribution of a weight within keys."""
    w = Window.partitionBy(*keys)
    upto = w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(weight).over(upto) / F.sum(weight).over(w))


def carry_forward(rows: DataFrame, keys: list[str], order: list[Column], value: str) -> DataFrame:
    """Puts in place of a null value the last one before it within keys. A key may have any number of
    rows: they are dealt by ranges of the order, carried on within each part, and the rows at the head
    of a part get the last value of the parts before (one row per part)."""
    from lodemine.sources.rounds import settle

    dealt = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    parts = settle(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()))
    within = F.last(value, ignorenulls=True).over(Window.partitionBy("_part", *keys).orderBy("_row").rowsBetween(Window.unboundedPreceding, 0))
    last = F.max(F.when(F.col(value).isNotNull(), F.struct("_row", F.struct(*keys).alias("_key"), F.col(value).alias("_value"))))
    ends = parts.groupBy("_part").agg(last.alias("_end"))
    before = ends.select("_part", F.last("_end", ignorenulls=True).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_end"))
    found = parts.withColumn("_within", within).join(F.broadcast(before), "_part")
    from_before = F.when(F.col("_end._key") == F.struct(*keys), F.col("_end._value"))
    return found.withColumn(value, F.coalesce("_within", from_before)).drop("_part", "_row", "_within", "_end")


def invert_share(draws: DataFrame, shares: DataFrame, keys: list[str], u: str, share: str, position: str) -> DataFrame:
    """For each draw the first position whose cumulative share reaches u; draws beyond all shares are
    left out. Draws and shares stand in one falling order, in which a share comes before the draws it
    equals: the last share before a draw is the least that reaches it."""
    draw = draws.filter(F.col(u).isNotNull()).select(*keys, F.col(u).cast("double").alias("_v"), F.struct(*[c for c in draws.columns if c not in keys]).alias("_draw"))
    held = shares.filter(F.col(share).isNotNull()).select(*keys, F.col(share).cast("double").alias("_v"), position)
    both = draw.unionByName(held, allowMissingColumns=True)
    order = [F.col("_v").desc(), F.col("_draw").isNotNull().asc(), F.col(position).desc()]
    found = carry_forward(both, keys, order, position).filter(F.col("_draw").isNotNull() & F.col(position).isNotNull())
    return found.select(*keys, "_draw.*", position).select(*draws.columns, position)
