"""Queries of what is streamed through folders, monitored, appended, packed and delivered."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import half_even
from ..sources import codec, packs, viewer
from ..sources.ledger import RunLog
from ..streaming import live as V
from ..streaming.monitor import Monitor
from ..streaming.stages import Stages
from .registry import query


def _parts(rows, key, n, path):
    """rows as n appends to a folder, as files come in."""
    for k in range(n):
        rows.where(F.pmod(F.col(key), F.lit(n)) == k).write.mode("append").parquet(path)


@query("""SELECT doc_id, lang, CAST(round_even(n_chars / 100e0 * 12.5e0, 0) AS BIGINT) AS frames, 'bucket_' || lpad(CAST(doc_id % 7 AS VARCHAR), 3, '0') AS bucket
FROM documents WHERE n_chars > 0 AND round_even(n_chars / 100e0 * 12.5e0, 0) > 0""")
def stream_stages(spark, d):
    """Clips that are fetched, encoded and uploaded by three chained streams, swept in two halves and once more."""
    clips = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang", "n_chars")
    encode = lambda df: df.select("doc_id", "lang", half_even(F.col("n_chars") / 100 * 12.5).alias("frames")).where("frames > 0")
    upload = lambda df: df.withColumn("bucket", F.format_string("bucket_%03d", F.col("doc_id") % 7))
    root = V.shared_path(spark, "stages")
    stages = Stages(spark, root, clips.schema, [("fetched", lambda df: df.where("n_chars > 0")), ("encoded", encode), ("uploaded", upload)], files_a_batch=2)
    _parts(clips.where("doc_id % 2 = 0"), "doc_id", 3, f"{root}/incoming")
    stages.sweep(last=2)
    _parts(clips.where("doc_id % 2 = 1"), "doc_id", 3, f"{root}/incoming")
    stages.sweep()
    stages.sweep()
    return stages.result()


def _monitored(spark, d):
    path = V.shared_path(spark, "monitor")
    events = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"), "event_type", F.col("value").cast("decimal(18,4)").alias("value"))
    _parts(events, "event_id", 4, f"{path}/incoming")
    found = Monitor(spark, f"{path}/monitor", "event_type", "value", ["at_us", "event_id"])
    found.watch(V.stream_of(spark, f"{path}/incoming", 2), f"{path}/state")
    return found, events.schema


@query("SELECT event_id, epoch_us(ts) AS at_us, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 48")
def stream_feed(spark, d):
    return _monitored(spark, d)[0].feed().select("event_id", "at_us", "event_type")


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18, 4))) AS DOUBLE) AS total FROM events GROUP BY event_type")
def stream_dashboard(spark, d):
    return _monitored(spark, d)[0].dashboard().select("event_type", "n", F.col("total").cast("double").alias("total"))


@query("SELECT event_id, epoch_us(ts) AS at_us, event_type FROM events")
def stream_decision_log(spark, d):
    found, schema = _monitored(spark, d)
    return found.log(schema).select("event_id", "at_us", "event_type")


@query("""WITH n AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn) - 1 AS i, count(*) OVER () AS n FROM conversations)
SELECT 'train-' || lpad(CAST(i // 200 AS VARCHAR), 5, '0') || '-of-' || lpad(CAST((n + 199) // 200 AS VARCHAR), 5, '0') || '.parquet' AS file,
  count(*) AS rows, CAST(sum(len(text)) AS BIGINT) AS chars, min(conv_id) AS first, max(conv_id) AS last FROM n GROUP BY i // 200, n""")
def publish_viewer(spark, d):
    """Turns as viewer files of 200 rows, read back by file."""
    path = V.shared_path(spark, "viewer")
    viewer.write_viewer(spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text"), path, ["conv_id", "turn"], rows_a_file=200)
    rows = spark.read.parquet(path).withColumn("file", F.col("_metadata.file_name"))
    return rows.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length("text")).alias("chars"), F.min("conv_id").alias("first"), F.max("conv_id").alias("last"))


def _packs(spark, d):
    turns = spark.read.parquet(f"{d}/conversations.parquet").where("turn % 2 = 1").select(
        "conv_id", F.col("conv_id").cast("string").alias("conv"), F.col("turn").cast("int").alias("turn"), F.substring("text", 1, 12).alias("text"))
    said = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct((F.col("turn") * 9).alias("frame"), "text", F.lit("BARGE_SOFT").alias("flag")))).alias("spans"))
    clips = spark.read.parquet(f"{d}/embeddings.parquet").join(said, F.col("vec_id") == F.col("conv_id"), "left").select(
        F.col("vec_id").cast("string").alias("scenario_id"), F.size("embedding").alias("num_frames"), F.transform("embedding", lambda x: F.floor(x * 100).cast("bigint")).alias("cb0"),
        F.col("embedding").alias("energy"), F.transform("embedding", lambda x: (x > 0).cast("int")).alias("speaking_mask"), F.coalesce("spans", F.array()).alias("spans"))
    path = V.shared_path(spark, "packs")
    packs.write_packs(packs.packed_clips(clips, F.col("spans")).drop("spans"), path)
    return packs.read_packs(spark, path)


@query("""SELECT CAST(conv_id AS VARCHAR) AS scenario_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, left(text, 12)) - 1 AS INT) AS ord, CAST(turn * 9 AS INT) AS frame, left(text, 12) AS text, 'BARGE_SOFT' AS flag
FROM conversations JOIN embeddings ON vec_id = conv_id WHERE turn % 2 = 1""")
def packs_spans(spark, d):
    """Spoken spans of packed clips, from their JSON."""
    return packs.spans_of(_packs(spark, d))


@query("""SELECT CAST(vec_id AS VARCHAR) AS scenario_id, CAST(unnest(generate_series(0, len(embedding) - 1)) AS INT) AS frame,
  CAST(unnest(list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 100))) AS BIGINT) AS cb0, CAST(unnest(list_transform(embedding, lambda x: x > 0)) AS INT) AS speaking_mask FROM embeddings""")
def packs_frames(spark, d):
    """Frames of packed clips: two of the lists, the others aren't read."""
    return packs.frames_of(_packs(spark, d), "cb0", "speaking_mask")


@query("""WITH h AS (SELECT vec_id, unnest(generate_series(0, (len(embedding) - 1) // 16)) AS frame, embedding FROM embeddings),
s AS (SELECT vec_id, frame, list_transform(embedding[frame * 16 + 1:frame * 16 + 16], lambda x: CAST(x AS DOUBLE)) AS raw FROM h),
m AS (SELECT vec_id, frame, sqrt(list_avg(list_transform(raw, lambda x: x * x)) + 1e-9) AS rms, list_transform(raw, lambda x: x - list_avg(raw)) AS x FROM s WHERE len(raw) >= 11),
c AS (SELECT vec_id, frame, rms, list_inner_product(x, x) AS power, lag, list_inner_product(x[1:len(x) - lag], x[lag + 1:]) AS r FROM m, (SELECT unnest(generate_series(2, 10)) AS lag)),
b AS (SELECT vec_id, frame, any_value(rms) AS rms, any_value(power) AS power, arg_max(lag, r) AS lag, max(r) AS r FROM c GROUP BY vec_id, frame)
SELECT CAST(vec_id AS VARCHAR) AS vec_id, CAST(frame AS INT) AS frame, CASE WHEN rms >= 1e-3 AND power > 0 AND r / power > 0.3 THEN 800e0 / lag ELSE 0e0 END AS f0 FROM b""")
def frames_pitch(spark, d):
    """A pitch for each 16 samples of whole clips, from arrays of samples."""
    found = codec.pitch_tracks(spark.read.parquet(f"{d}/embeddings.parquet"), "vec_id", "embedding", hop=16, rate=800)
    return found.select("vec_id", F.posexplode("f0").alias("frame", "f0"))


@query("""WITH t AS (SELECT event_type AS job_key, CAST(count(*) AS BIGINT) + 5 AS target FROM events GROUP BY 1),
m AS (SELECT event_type AS job_key, CAST(sum(1 + event_id % 3) AS BIGINT) AS made FROM events WHERE event_id % 4 < 3 GROUP BY 1)
SELECT job_key, target, greatest(0, target - coalesce(made, 0)) AS "left" FROM t LEFT JOIN m USING (job_key)""")
def resume_appends(spark, d):
    """What is left of each job after batches of which one is written twice and one is lost before its mark."""
    events = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("job_key"), (1 + F.col("event_id") % 3).alias("made"), F.col("event_id").alias("id"))
    log = RunLog(spark, V.shared_path(spark, "runs"), "job_key string, made long, id long")
    log.start("run1", "generate", {"batch_size": 3}, {"limit": None}, 0.0, "host")
    for batch in (0, 1, 1, 2):
        log.append("run1", batch, events.where(F.col("id") % 4 == batch))
    events.where("id % 4 = 3").withColumn("run_id", F.lit("run1")).write.parquet(f"{log.rows.path}/data/part=run1-000000003")
    jobs = events.groupBy("job_key").agg((F.count(F.lit(1)) + 5).alias("target"))
    return log.remaining(jobs, "job_key")
