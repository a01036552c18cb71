"""Packed clips: a row a clip, with its frames as lists and its spoken spans as a list of JSON texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a pack holds. A reader names the columns and fields that it needs; the others aren't read.
PACK = """scenario_id string, behaviour string, language string, domain string, agent_text string, user_text string, num_frames int, audio_frames int,
cb0 array<bigint>, energy array<float>, f0 array<float>, flags array<int>, agent_state array<int>, speaking_mask array<int>, spoken_spans array<string>"""
SPAN = "frame int, text string, flag string"


def packed_clips(frames: DataFrame, spans: Column) -> DataFrame:
    """The clips with spans (an array of structs) as a list of JSON texts."""
    return frames.withColumn("spoken_spans", F.transform(spans, lambda s: F.to_json(s)))


def write_packs(clips: DataFrame, path: str, rows_a_file: int = 2000) -> None:
    clips.write.mode("overwrite").option("maxRecordsPerFile", rows_a_file).option("compression", "zstd").parquet(path)


def read_packs(spark: SparkSession, path: str) -> DataFrame:
    """The clips; columns that a file lacks are null, spans are structs. A span that is no JSON is null."""
    rows = spark.read.schema(PACK).parquet(path)
    return rows.withColumn("spoken_spans", F.transform("spoken_spans", lambda s: F.from_json(s, SPAN)))


def spans_of(packs: DataFrame) -> DataFrame:
    """(scenario_id, ord, frame, text, flag): a row a span; clips without spans have none. Lists of frames aren't read."""
    at = packs.select("scenario_id", F.posexplode("spoken_spans").alias("ord", "span")).where("span is not null")
    return at.select("scenario_id", "ord", "span.frame", "span.text", "span.flag")


def frames_of(packs: DataFrame, *columns: str) -> DataFrame:
    """(scenario_id, frame, columns): a row a frame, of the lists named."""
    zipped = F.posexplode(F.arrays_zip(*[F.col(c) for c in columns])).alias("frame", "_of")
    return packs.select("scenario_id", zipped).select("scenario_id", "frame", *[F.col(f"_of.{c}").alias(c) for c in columns])
