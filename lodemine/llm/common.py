"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodemine.sources.rounds import shared_folder

#: A word: a run of code points outside space and \t..\r.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back: the lineage ends
    here, and a lost executor costs a re-read, not a recomputation."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lodemine/{name}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession, *frames: DataFrame) -> None:
    """Deletes the files behind materialize()d frames that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for df in frames:
        for folder in {re.sub(r"(/[^/=]+=[^/]*)*/[^/]*$", "", f) for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """name, made longer until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def text_or_empty(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def fold_remainder(doc_id: str | Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; a null id counts as the empty text."""
    text = F.coalesce((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(n))


def sample_by_hash(rows: DataFrame, group: str, key: str, k: int) -> DataFrame:
    """The k rows of each group whose key has the smallest hash, repeated rows once.

    The keys of each group are counted first (by a sketch, within about 5 %), and only rows under a
    hash bound that about 4 k keys of the group pass are ranked: what is shuffled doesn't grow with the
    input or with its partitions. Should fewer than k pass (which the counts make all but
    impossible), the sample is smaller. group has few values."""
    sizes = rows.groupBy(group).agg(F.approx_count_distinct(key).alias("_n"))
    h = F.xxhash64(key)
    near = F.pmod(h, F.lit(1 << 20)) / F.lit(float(1 << 20)) < F.lit(4.0 * k + 64) / F.col("_n")
    passed = rows.select(group, key).join(F.broadcast(sizes), group).filter(near).drop("_n").distinct()
    order = Window.partitionBy(group).orderBy(F.xxhash64(key, F.lit(1)), key)
    return passed.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= k).drop("_k")


class Recent(dict):
    """Results of a function, by text; at most about two times ``most``, what was used of late."""

    def __init__(self, of, most: int, longest: int = 64):
        self.of, self.most, self.longest, self.before = of, most, longest, {}

    def __missing__(self, text: str):
        found = self.before.get(text)
        if found is None:
            found = self.of(text)
            if len(text) > self.longest:
                return found
        if len(self) >= self.most:
            self.before = dict(self)
            self.clear()
        self[text] = found
        return found

    def forget(self) -> None:
        self.clear()
        self.before = {}


def give_back() -> None:
    """Returns freed memory to the system at the end of a task: the worker process goes on to other
    tasks and stages, beside a JVM that may need it."""
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass
