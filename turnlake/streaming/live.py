"""Structured Streaming twins of the batch operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRAILING = 96


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares; a local one only where Spark runs in this process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="turnlake-stream-")
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def stream_of(spark: SparkSession, path: str, files_a_batch: int | None = 8) -> DataFrame:
    """The rows of a Parquet table as a stream, some files a batch; all that are there in one if None.

    The path goes in as a pattern, as a table may be a single file, which the source takes in no other way.
    """
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(schema)
    if files_a_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    return reader.parquet(f"{folder}/[{name[0]}]{name[1:]}")


def arrivals(rows: DataFrame, ts: str, session: str, files: int, path: str) -> str:
    """Writes rows as a stream brings them, and gives the delay that no row exceeds: in so many appends by time, every
    seventh row an append late, then a row of session -1 so late that all others are past."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    low, high = rows.agg(F.min(at), F.max(at)).first()
    span = max(1, -(-((high or 0) - (low or 0) + 1) // files))
    own = F.floor((at - (low or 0)) / span)
    place = F.coalesce(own + (F.pmod(F.xxhash64(session, at), F.lit(7)) == 0).cast("long"), F.lit(0))
    for k in range(files + 1):
        rows.where(place == k).write.mode("append").parquet(path)
    end = rows.limit(0).unionByName(
        rows.sparkSession.range(1).select(F.lit(-1).alias(session), F.timestamp_micros(F.lit((high or 0) + 2 * span + 400 * 86_400_000_000)).alias(ts)), allowMissingColumns=True)
    end.select(*[F.col(c).cast(dict(rows.dtypes)[c]) for c in rows.columns]).write.mode("append").parquet(path)
    return f"{2 * span} microseconds"


def files_an_append(spark: SparkSession, path: str, appends: int) -> int:
    """Files of an append, on average: a larger table has more of them. A batch of so many for each of its
    appends keeps the number of batches, each of which costs every session and every partition's store, as it is."""
    return max(1, round(len(spark.read.parquet(path).inputFiles()) / appends))


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """What a stream gives once all its input is there, through a file sink and a checkpoint.

    In complete mode each batch replaces the table; a batch that is run again writes the same rows.
    """
    spark = stream.sparkSession
    out, state = shared_path(spark, name), shared_path(spark, name + "-state")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)
    if mode == "complete":
        writer = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out))
    else:
        writer = writer.format("parquet").option("path", out)
    writer.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def counters(events: DataFrame, kind: str = "event_type", value: str = "value") -> DataFrame:
    """Live counters by kind."""
    return events.groupBy(kind).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 4).alias("total"))


def windowed(events: DataFrame, ts: str, length: str, late: str | None = None) -> DataFrame:
    """Counts by window of event time. With a delay, and in append mode, a window is given once it is closed, and
    rows later than the delay are left out; in complete mode all windows are kept and counted on."""
    at = events.withColumn("at", F.col(ts).cast("timestamp"))
    if late is not None:
        at = at.withWatermark("at", late)
    return at.groupBy(F.window("at", length)).agg(F.count(F.lit(1)).alias("n")).select(F.unix_timestamp(F.col("window.start")).alias("start_s"), "n")


def first_seen(events: DataFrame, keys: list[str], ts: str | None = None, late: str | None = None) -> DataFrame:
    """A row of each key. With a delay, keys are forgotten after it and may come again; else the state is the keys."""
    if late is None:
        return events.dropDuplicates(keys)
    return events.withColumn("at", F.col(ts).cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark(keys)


def silences(events: DataFrame, session: str, ts: str, gap: str, late: str | None = None) -> DataFrame:
    """(session, start, end, n): stretches without a silence of the gap or more; what lies between two is dead air.
    With a delay, and in append mode, a stretch is given once it is closed, and forgotten."""
    at = events.select(session, F.col(ts).cast("timestamp").alias("at"))
    if late is not None:
        at = at.withWatermark("at", late)
    sessions = at.groupBy(session, F.session_window("at", gap)).agg(F.count(F.lit(1)).alias("n"))
    return sessions.select(session, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def decisions(past: list[float | None], values: list[float | None], trailing: int = TRAILING, rows: int = 4096) -> list[bool | None]:
    """Whether each value exceeds the mean of itself and those before it, trailing rows at most; null where it is null.

    Nulls count in no mean. A sum is taken value by value from the oldest one, as SQL's window takes it, so that values
    which equal their mean are rounded alike.
    """
    every = [*[None] * (trailing - 1), *past, *values][-(len(values) + trailing - 1):]
    there = np.array([x is not None for x in every], bool)
    numbers = np.array([0.0 if x is None else x for x in every], float)
    over = np.empty(len(values), bool)
    for i in range(0, len(values), rows):
        n = min(rows, len(values) - i)
        total, count = np.zeros(n), np.zeros(n, np.int64)
        for k in range(i, i + trailing):
            total += numbers[k:k + n]
            count += there[k:k + n]
        over[i:i + n] = numbers[i + trailing - 1:i + trailing - 1 + n] > total / np.maximum(count, 1)
    return [None if x is None else y for x, y in zip(values, over.tolist())]
