"""Stages chained by folders: each is a stream from the folder of the one before to a folder of its own.

A stage's checkpoint knows which files it has taken, and its sink's log which files are whole; so a sweep takes up
where the last one ended, wherever that was, and what is swept again changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..sources.ledger import Folder

Work = Callable[[DataFrame], DataFrame]


class Stages:
    """root/incoming -> root/<name of each stage>, with checkpoints under root/_state."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType, works: list[tuple[str, Work]], files_a_batch: int = 1000):
        self.spark, self.root, self.works, self.files = spark, root.rstrip("/"), works, files_a_batch
        self.schemas, self.folder = [schema], Folder(spark, root)
        for _, work in works:
            self.schemas.append(work(spark.createDataFrame([], self.schemas[-1])).schema)

    def source(self, k: int) -> str:
        return f"{self.root}/{self.works[k - 1][0] if k else 'incoming'}"

    def start(self, k: int, **trigger) -> StreamingQuery:
        """Stage k (from 0) as a stream; trigger as for DataStreamWriter."""
        name, work = self.works[k]
        rows = self.spark.readStream.schema(self.schemas[k]).option("maxFilesPerTrigger", self.files).parquet(self.source(k))
        out = work(rows).writeStream.format("parquet").option("path", f"{self.root}/{name}").option("checkpointLocation", f"{self.root}/_state/{name}")
        return out.outputMode("append").trigger(**trigger).start()

    def sweep(self, first: int = 0, last: int | None = None) -> None:
        """Everything that is there goes through the stages first to last (not included), one after another."""
        for k in range(first, len(self.works) if last is None else last):
            if self.folder.exists(self.source(k).rpartition("/")[2]):
                self.start(k, availableNow=True).awaitTermination()

    def every(self, interval: str = "90 seconds") -> list[StreamingQuery]:
        """All stages at once, each sweeping its folder again and again; the caller stops them."""
        for k in range(len(self.works)):
            self.folder._fs.mkdirs(self.folder._at(self.source(k).rpartition("/")[2]))
        return [self.start(k, processingTime=interval) for k in range(len(self.works))]

    def result(self, k: int | None = None) -> DataFrame:
        """What has come out of stage k, the last by default."""
        k = len(self.works) - 1 if k is None else k
        name = self.works[k][0]
        if not self.folder.exists(f"{name}/_spark_metadata"):
            return self.spark.createDataFrame([], self.schemas[k + 1])
        return self.spark.read.schema(self.schemas[k + 1]).parquet(f"{self.root}/{name}")
