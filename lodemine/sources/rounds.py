"""State of iterative operators, written to the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session. Where neither the session
    nor the context names one, a temporary folder is made in local mode; a cluster has to name one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = held.get() if held.isDefined() else None
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="lodemine-rounds-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """df as written: the lineage ends here and survives the loss of an executor."""
    path = f"{shared_folder(df.sparkSession)}/lodemine/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(*frames: DataFrame) -> None:
    """Deletes the files behind settled tables that nothing reads any more."""
    for df in frames:
        context = df.sparkSession.sparkContext
        for folder in {m[0] for f in df.inputFiles() if (m := re.match(r".*/lodemine/round-[0-9a-f]{32}(?=/)", f))}:
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
