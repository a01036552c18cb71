"""Parquet files for a dataset viewer: train-00003-of-00007.parquet, with the columns' features in the files' metadata.

A Spark data source writes them. Tasks write under a folder of this write; when all have ended well, the files move to
their names, which hold their place and how many there are, and the old ones go. If a task fails for good, all go.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, FloatType, IntegerType, LongType, StringType, StructType

from .ledger import Folder

ROWS_A_FILE = 10_000
#: What the viewer calls types.
DTYPES = {StringType: "string", DoubleType: "float64", FloatType: "float32", LongType: "int64", IntegerType: "int32", BooleanType: "bool"}


def feature(kind: DataType) -> dict | list:
    if isinstance(kind, ArrayType):
        return [feature(kind.elementType)]
    if isinstance(kind, StructType):
        return {f.name: feature(f.dataType) for f in kind.fields}
    return {"dtype": DTYPES.get(type(kind), "binary"), "_type": "Value"}


def features(schema: StructType, audio: dict[str, int]) -> dict:
    """What each column holds; audio columns by their sample rate."""
    return {"info": {"features": {f.name: {"sampling_rate": audio[f.name], "_type": "Audio"} if f.name in audio else feature(f.dataType) for f in schema.fields}}}


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[int, str]]


class ViewerWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.fs, self.root = fs.FileSystem.from_uri(options["path"])
        self.split, self.about, self.overwrite = options.get("split", "train"), options["features"], overwrite
        self.at = f"{self.root}/_parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """One file of this task's rows; the partition is the file's place."""
        from pyspark import TaskContext

        context = TaskContext.get()
        name = f"{self.at}/{context.partitionId()}-{context.taskAttemptId()}.parquet"
        writer = None
        try:
            for batch in iterator:
                if writer is None and batch.num_rows:
                    self.fs.create_dir(self.at, recursive=True)
                    schema = batch.schema.with_metadata({"huggingface": self.about})
                    writer = pq.ParquetWriter(name, schema, filesystem=self.fs, compression="zstd")
                if batch.num_rows:
                    writer.write_batch(batch)
        finally:
            if writer is not None:
                writer.close()
        return Written([(context.partitionId(), name)] if writer is not None else [])

    def commit(self, messages: list[Written | None]) -> None:
        files = sorted(f for m in messages if m is not None for f in m.files)
        old = [f.path for f in self.fs.get_file_info(fs.FileSelector(self.root, allow_not_found=True)) if f.base_name.startswith(f"{self.split}-") and f.base_name.endswith(".parquet")]
        if self.overwrite:
            for path in old:
                self.fs.delete_file(path)
        for k, (_, path) in enumerate(files):
            self.fs.move(path, f"{self.root}/{self.split}-{k:05d}-of-{len(files):05d}.parquet")
        self._drop()

    def abort(self, messages: list[Written | None]) -> None:
        self._drop()

    def _drop(self) -> None:
        if self.fs.get_file_info(self.at).type != fs.FileType.NotFound:
            self.fs.delete_dir(self.at)


class ViewerSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "viewer"

    def writer(self, schema: StructType, overwrite: bool) -> ViewerWriter:
        return ViewerWriter(dict(self.options), overwrite)


def numbered(rows: DataFrame, order: list[Column], into: str, work: str) -> DataFrame:
    """Adds the place of each row, from 0. Rows are ranged and numbered apart in a table at `work`, as ranges may be cut
    elsewhere when they are made anew; what is counted before each range shifts its numbers."""
    ranged = rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).sortWithinPartitions(*order)
    ranged.withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).write.parquet(work)
    ranged = rows.sparkSession.read.parquet(work)
    upto = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # a row a range
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_start"))
    return ranged.join(starts, "_range").withColumn(into, F.col("_start") + F.col("_place")).drop("_range", "_place", "_start")


def write_viewer(
    rows: DataFrame, path: str, order: list[str], rows_a_file: int = ROWS_A_FILE, audio: dict[str, int] | None = None, split: str = "train",
) -> None:
    """Files of rows_a_file rows each, the last of the rest, in the order given (which tells all rows apart)."""
    spark = rows.sparkSession
    spark.dataSource.register(ViewerSource)
    work = f"_rows-{uuid.uuid4().hex}"
    placed = numbered(rows, [F.col(c) for c in order], "_row", f"{path}/{work}").withColumn("_file", F.floor(F.col("_row") / rows_a_file).cast("int"))
    files = max(1, -(-placed.count() // rows_a_file))
    dealt = placed.repartitionById(files, "_file").sortWithinPartitions("_row").select(*rows.columns)
    about = json.dumps(features(rows.schema, audio or {}))
    dealt.write.format("viewer").option("path", path).option("split", split).option("features", about).mode("overwrite").save()
    Folder(spark, path).delete(work)
