"""What the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that the contracts name, `[\x20\x09-\x0D]`.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, from spark.checkpoint.dir.

    A folder of this machine is used only where the setting is absent and Spark runs in this one
    process, as in tests.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="turnlake-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """The rows of df from a reliable checkpoint: a lost executor costs no more than a re-read."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


class Scratch:
    """Tables in a folder of their own in the shared folder, for loops that cut their lineage each round."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.number = spark, new_path(spark, name), 0

    def table(self, df: DataFrame) -> DataFrame:
        """The rows of df, written and read again; the path goes along as an attribute, for drop()."""
        self.number += 1
        path = f"{self.folder}/{self.number}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing reads any more."""
        for t in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(t.scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def maybe_among(df: DataFrame, id_col: str, ids: DataFrame, bits: int = 1 << 24) -> DataFrame:
    """The rows of df whose id is among ids (one column), and a few others.

    ids become one bitmap of hashed ids of `bits` bits, whatever their number, which is small enough to
    broadcast; so other rows aren't shuffled to find out. With very many ids more others stay.
    """
    def place(c: Column) -> Column:
        return F.pmod(F.xxhash64(c.cast("long")), F.lit(bits))

    at = place(F.col(ids.columns[0]))
    bitmaps = ids.select(F.bitmap_bucket_number(at).alias("_bucket"), F.bitmap_bit_position(at).alias("_bit")).groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_map"))
    own = place(F.col(id_col))
    byte = F.conv(F.hex(F.substring("_map", (F.bitmap_bit_position(own) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    joined = df.join(F.broadcast(bitmaps), F.bitmap_bucket_number(own) == F.col("_bucket"))
    mask = F.element_at(F.array(*[F.lit(1 << k) for k in range(8)]), (F.bitmap_bit_position(own) % 8).cast("int") + 1)
    return joined.where(byte.bitwiseAND(mask) > 0).select(*df.columns)


def crc_fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n)


def fresh(columns: list[str], name: str) -> str:
    """name, with underscores before it until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name
