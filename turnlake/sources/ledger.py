"""Appends that a rerun neither loses nor doubles: parts of data, each with a mark that is written last.

A part is a folder of its own. Its mark says that all of it is there; what has no mark is as if it weren't, and is
replaced when the part is written again.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Folder:
    """A folder of any file system that Spark knows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._at(name))

    def names(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(name))) if self.exists(name) else []

    def delete(self, name: str = "") -> None:
        self._fs.delete(self._at(name), True)

    def write(self, name: str, text: str) -> None:
        """A small file, there as a whole or not at all."""
        parent, _, base = name.rpartition("/")
        fresh, final = self._at(f"{parent}/.{base}.new" if parent else f".{base}.new"), self._at(name)
        out = self._fs.create(fresh, True)
        out.write(bytearray(text.encode()))
        out.close()
        if not self._fs.rename(fresh, final):  # some file systems replace nothing
            self._fs.delete(final, False)
            self._fs.rename(fresh, final)

    def text(self, name: str) -> str:
        return "\n".join(r.value for r in self.spark.read.text(f"{self.path}/{name}").collect())


class Ledger:
    """Parts of a table by name, under path/data/part=name, with marks under path/marks."""

    def __init__(self, spark: SparkSession, path: str, format: str = "parquet"):
        self.spark, self.path, self.format = spark, path.rstrip("/"), format
        self.folder = Folder(spark, path)

    def committed(self) -> list[str]:
        return [n for n in self.folder.names("marks") if not n.startswith(".")]

    def write(self, part: str, rows: DataFrame, **about) -> bool:
        """Whether the part was written now; False if it had been."""
        if not re.fullmatch(r"[A-Za-z0-9_-]+", part):
            raise ValueError(f"a part's name is of letters, digits, _ and -: {part}")
        if self.folder.exists(f"marks/{part}"):
            return False
        rows.write.mode("overwrite").format(self.format).save(f"{self.path}/data/part={part}")
        self.folder.write(f"marks/{part}", json.dumps({"part": part, **about}, sort_keys=True))
        return True

    def read(self, schema) -> DataFrame:
        """The rows of all whole parts, with their part."""
        done = self.committed()
        if not done:
            return self.spark.createDataFrame([], schema).withColumn("part", F.lit(None).cast("string"))
        rows = self.spark.read.format(self.format).schema(schema).option("basePath", f"{self.path}/data")
        found = rows.load([f"{self.path}/data/part={p}" for p in done])
        return found.withColumn("part", F.col("part").cast("string"))


RUN_SCHEMA = "run_id string, stage string, started_at double, config_snapshot string, args_snapshot string, host string"


class RunLog:
    """Runs with their settings, and the rows that each appends by batch."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.schema = spark, schema
        self.runs, self.rows = Ledger(spark, f"{path}/runs", "json"), Ledger(spark, f"{path}/rows")

    def start(self, run_id: str, stage: str, config: dict, args: dict, started_at: float, host: str) -> bool:
        """Writes the run's header row; False if the run was begun before, as by the attempt that is resumed."""
        header = (run_id, stage, started_at, json.dumps(config, default=str), json.dumps(args, default=str), host)
        return self.runs.write(run_id, self.spark.createDataFrame([header], RUN_SCHEMA))

    def append(self, run_id: str, batch: int, rows: DataFrame) -> bool:
        return self.rows.write(f"{run_id}-{batch:09d}", rows.withColumn("run_id", F.lit(run_id)))

    def headers(self) -> DataFrame:
        return self.runs.read(RUN_SCHEMA).drop("part")

    def appended(self) -> DataFrame:
        return self.rows.read(f"{self.schema}, run_id string").drop("part")

    def remaining(self, jobs: DataFrame, key: str = "job_key", target: str = "target", made: str = "made") -> DataFrame:
        """jobs (key, target) with what is left of each: those whose rows are all there have 0."""
        done = self.appended().groupBy(key).agg(F.sum(made).alias("_done"))
        return jobs.join(done, key, "left").withColumn("left", F.greatest(F.lit(0), F.col(target) - F.coalesce("_done", F.lit(0)))).drop("_done")
