"""Stage tables: each stage of a job is written once, and a later run resumes from what is there."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession


def stage_path(base: str, name: str) -> str:
    """A dotted name as folders below base."""
    return str(PurePosixPath(base, *name.split("."))) if "://" not in base else f"{base.rstrip('/')}/{name.replace('.', '/')}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a finished table is at path: Spark's writers leave _SUCCESS behind."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def save(df: DataFrame, base: str, name: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(stage_path(base, name))


def load(spark: SparkSession, base: str, name: str, field: str | None = None) -> DataFrame:
    """field: a struct column whose fields to return instead."""
    df = spark.read.parquet(stage_path(base, name))
    return df.select(f"{field}.*") if field else df


def stage(spark: SparkSession, base: str, name: str, make: Callable[[], DataFrame], resume: bool = True) -> DataFrame:
    """The stage's table, made if it isn't there (or if resume is false). Lineage ends here."""
    if not (resume and exists(spark, stage_path(base, name))):
        save(make(), base, name)
    return load(spark, base, name)
