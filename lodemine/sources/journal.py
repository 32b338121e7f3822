"""The journal of a running job: after each step its state is committed, and a new driver goes on from
the last commit.

An entry names the state (a small dict) and the tables that belong to it. Tables are written first, and
then the entry, by renaming a finished file to the next number: an entry is there as a whole or not at
all, and what a lost driver wrote without committing is never read. Tables that a step leaves alone are
taken over by path. Entries are only added; tables that neither of the last two entries names, and those
of steps that were not committed, are deleted.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from lodemine.sources.stages import stage_path


class Journal:
    def __init__(self, spark: SparkSession, base: str, name: str, resume: bool = True):
        self.spark, self.folder = spark, stage_path(base, name)
        self.number, self.state, self.before = 0, None, {}
        self._tables: dict[str, dict] = {}
        if not resume:
            self._delete(self.folder)
        for number, path in sorted(self._listed("log", r"(\d{8})\.json"), reverse=True):
            entry = json.loads(spark.read.text(path, wholetext=True).first()[0])
            self.number, self.state, self._tables = number, entry["state"], entry["tables"]
            break

    def _path(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _delete(self, path: str) -> None:
        p, fs = self._path(path)
        fs.delete(p, True)

    def _listed(self, folder: str, pattern: str) -> list[tuple]:
        p, fs = self._path(f"{self.folder}/{folder}")
        found = []
        for status in fs.listStatus(p) if fs.exists(p) else []:
            if m := re.fullmatch(pattern, status.getPath().getName()):
                found.append((int(m[1]), status.getPath().toString()))
        return found

    def __contains__(self, name: str) -> bool:
        return name in self._tables

    def table(self, name: str) -> DataFrame:
        held = self._tables[name]
        return self.spark.read.schema(StructType.fromJson(held["schema"])).parquet(held["path"])

    def commit(self, state: dict, **tables: DataFrame | None) -> None:
        """tables: what the step made anew; None: the table is done with."""
        number, now = self.number + 1, {k: v for k, v in self._tables.items() if k not in tables}
        for name, df in tables.items():
            if df is not None:
                path = f"{self.folder}/tables/{number:08d}-{name}-{uuid.uuid4().hex}"
                df.write.parquet(path)
                now[name] = {"path": path, "schema": df.schema.jsonValue()}
        final, fs = self._path(f"{self.folder}/log/{number:08d}.json")
        made, _ = self._path(f"{self.folder}/log/.{number:08d}-{uuid.uuid4().hex}")
        out = fs.create(made, False)
        out.write(json.dumps({"state": state, "tables": now}).encode())
        out.close()
        if fs.exists(final) or not fs.rename(made, final):
            raise RuntimeError(f"step {number} of {self.folder} was committed by another driver")
        self.before, self._tables, self.number, self.state = self._tables, now, number, state
        self._sweep()

    def _sweep(self) -> None:
        named = {t["path"].rsplit("/", 1)[-1] for held in (self.before, self._tables) for t in held.values()}
        for number, path in self._listed("tables", r"(\d{8})-.*"):
            if number <= self.number and path.rsplit("/", 1)[-1] not in named:
                self._delete(path)
