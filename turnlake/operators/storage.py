"""Keyed rows over time: last or first write, resume, packing into shards, set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import md5_mod


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key, as an upsert leaves it. Rows are reduced before they are shuffled."""
    columns = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*columns), F.struct(*order)).alias("row")
    return rows.groupBy(*keys).agg(best).select(*keys, *[F.col(f"row.{c}").alias(c) for c in columns])


def earliest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key, as an insert that ignores known keys leaves it."""
    columns = [c for c in rows.columns if c not in keys]
    best = F.min_by(F.struct(*columns), F.struct(*order)).alias("row")
    return rows.groupBy(*keys).agg(best).select(*keys, *[F.col(f"row.{c}").alias(c) for c in columns])


def pending(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return wanted.join(done.select(key).distinct(), key, "left_anti")


def corrected(rows: DataFrame, corrections: DataFrame, key: str, column: str) -> DataFrame:
    """Sets column to the correction's new_value where the row has status ok and a correction."""
    joined = rows.join(corrections.select(key, "new_value"), key, "left")
    return joined.withColumn(column, F.when((F.col("status") == "ok") & F.col("new_value").isNotNull(), F.col("new_value")).otherwise(F.col(column))).drop("new_value")


def bucket_path(name: Column, buckets: int = 200) -> Column:
    return F.format_string("bucket_%03d/%s", md5_mod(name, buckets), name)


def numbered(rows: DataFrame, order: str, block: Column, place: str = "place", total: str | None = None) -> DataFrame:
    """Adds each row's place in the order, from 1, and the number of all rows if total names a column for it.

    block is a value that never falls as the order rises: rows are counted by block and numbered within theirs from
    the rows of the blocks before, so that no task orders all rows.
    """
    blocks = rows.withColumn("_block", block)
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.groupBy("_block").agg(F.count(F.lit(1)).alias("_n")).select(
        "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    inner = F.row_number().over(Window.partitionBy("_block").orderBy(order))
    placed = blocks.withColumn("_inner", inner).join(starts.withColumnRenamed("_block", "_of"), F.col("_block").eqNullSafe(F.col("_of")))
    found = placed.withColumn("_place", F.col("_start") + F.col("_inner"))
    return found.select(*rows.columns, F.col("_place").alias(place), *([F.col("_all").alias(total)] if total else []))


def packed(items: DataFrame, order: str, files_an_item: int, most_files: int, block: Column | None = None) -> DataFrame:
    """Adds pack: consecutive items whose files together stay within most_files; numbered by blocks, by default of the first
    eight characters of the order."""
    each = max(1, most_files // files_an_item)
    placed = numbered(items, order, F.substring(order, 1, 8) if block is None else block, "_place")
    return placed.withColumn("pack", F.floor((F.col("_place") - 1) / each)).drop("_place")


def round_robin(items: DataFrame, order: str, n: int, block: Column | None = None) -> DataFrame:
    """Adds worker: items dealt in turn, numbered by blocks as in packed."""
    placed = numbered(items, order, F.substring(order, 1, 8) if block is None else block, "_place")
    return placed.withColumn("worker", ((F.col("_place") - 1) % n).cast("int")).drop("_place")


def joined_sidecars(scenarios: DataFrame, words: DataFrame, encoded: DataFrame, key: str) -> DataFrame:
    """Left joins of both sidecars; timing says where a clip's length comes from."""
    out = scenarios.join(words, key, "left").join(encoded, key, "left")
    return out.withColumn("timing", F.when(F.col("frames").isNotNull(), "encoded").when(F.col("duration_s").isNotNull(), "words").otherwise("estimate"))


def write_shards(rows: DataFrame, path: str, rows_a_file: int = 2000) -> None:
    """Parquet files of a bounded number of rows; stale files go."""
    rows.write.mode("overwrite").option("maxRecordsPerFile", rows_a_file).option("compression", "zstd").parquet(path)


def read_json_lines(spark, path: str, schema: str, strict: bool = False) -> DataFrame:
    """JSON lines; broken ones are left out, or raise if strict."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def hex_path(name: Column) -> Column:
    """The first two hex digits of the name's MD5 as a folder."""
    return F.concat(F.substring(F.md5(name.cast("binary")), 1, 2), F.lit("/"), name)


def checkpoints(saved: DataFrame, mode: str = "final", folder: str = "folder", tag: str = "tag", at: str = "at") -> DataFrame:
    """Which checkpoints of each folder go out: `single` the folder's own (with an empty tag), `all` every tag, `final` the
    tag of that name or, while there is none, the newest."""
    if mode == "single":
        return saved.where(F.col(tag) == "")
    tags = saved.where(F.col(tag) != "")
    if mode == "all":
        return tags
    if mode != "final":
        raise ValueError(f"no such mode: {mode}")
    return latest(tags, [folder], [F.col(tag) == "final", F.col(at), F.col(tag)])
