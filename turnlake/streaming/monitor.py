"""A monitor of a stream: a log of decisions, running totals and a bounded feed, all written once for each batch.

Spark may run a batch again after a failure. Each batch writes to folders of its own and is marked when all of them are
whole; a marked batch is left as it is, an unmarked one is written anew. Totals and feed carry on from the batch before,
so that a look at them reads one small table however long the stream has run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.ledger import Folder

NEWEST = 48


class Monitor:
    """A function for foreachBatch. rows: kind (what is counted), value (what is summed), order (newest last)."""

    def __init__(self, spark: SparkSession, path: str, kind: str, value: str, order: list[str], newest: int = NEWEST):
        self.spark, self.path, self.kind, self.value, self.order, self.newest = spark, path.rstrip("/"), kind, value, order, newest
        self.folder = Folder(spark, path)

    def batches(self) -> list[int]:
        """The batches that are whole, in their order."""
        return sorted(int(n) for n in self.folder.names("marks") if n.isdigit())

    def _before(self, batch_id: int) -> int | None:
        return max((b for b in self.batches() if b < batch_id), default=None)

    def _read(self, what: str, batch: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{what}/{batch}")

    def _newest(self, rows: DataFrame) -> DataFrame:
        return rows.orderBy(*[F.col(c).desc() for c in self.order]).limit(self.newest)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if self.folder.exists(f"marks/{batch_id}"):
            return
        before = self._before(batch_id)
        rows = batch.persist()
        try:
            rows.write.mode("overwrite").json(f"{self.path}/log/batch={batch_id}")
            totals = rows.groupBy(self.kind).agg(F.count(F.lit(1)).alias("n"), F.sum(self.value).alias("total"))
            feed = self._newest(rows)
            if before is not None:
                both = self._read("totals", before).unionByName(totals)
                totals = both.groupBy(self.kind).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
                feed = self._newest(self._read("feed", before).unionByName(feed))
            totals.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/totals/{batch_id}")
            feed.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/feed/{batch_id}")
            self.folder.write(f"marks/{batch_id}", "")
        finally:
            rows.unpersist()
        for old in self.batches()[:-2]:  # a batch that is run again needs the one before
            for what in ("totals", "feed"):
                self.folder.delete(f"{what}/{old}")

    def _last(self, what: str) -> DataFrame:
        if not self.batches():
            raise ValueError("no batch is whole yet")
        return self._read(what, self.batches()[-1])

    def dashboard(self) -> DataFrame:
        """(kind, n, total) over all batches so far."""
        return self._last("totals")

    def feed(self) -> DataFrame:
        """The newest rows so far."""
        return self._last("feed")

    def log(self, schema) -> DataFrame:
        """All rows of whole batches, from the JSON log, with their batch."""
        done = self.batches()
        rows = self.spark.read.schema(schema).option("basePath", f"{self.path}/log").json([f"{self.path}/log/batch={b}" for b in done])
        return rows

    def watch(self, stream: DataFrame, checkpoint: str, **trigger) -> None:
        """Runs over what is there, or as the trigger says."""
        trigger = trigger or {"availableNow": True}
        stream.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint).trigger(**trigger).start().awaitTermination()
