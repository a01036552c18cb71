"""Queries that run as streams over all input there is."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vocab import FLAGS, name_of
from ..operators.logs import orchestrated
from ..streaming import floor
from ..streaming import live as V
from .registry import query


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def stream_counters(spark, d):
    return V.drained(V.counters(V.stream_of(spark, f"{d}/events.parquet")), "counters", "complete")


@query("SELECT CAST(floor(epoch(ts) / 86400) * 86400 AS BIGINT) AS start_s, count(*) AS n FROM events GROUP BY 1")
def stream_daily_windows(spark, d):
    return V.drained(V.windowed(V.stream_of(spark, f"{d}/events.parquet"), "ts", "1 day"), "windows", "complete")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_first_seen(spark, d):
    rows = V.first_seen(V.stream_of(spark, f"{d}/events.parquet").select("user_id", "event_type"), ["user_id", "event_type"])
    return V.drained(rows, "first-seen")


def _arriving(spark, rows, files=6, files_a_batch=3):
    """(stream, delay) of rows that arrive in appends out of order, some appends a batch."""
    path = V.shared_path(spark, "arrivals")
    late = V.arrivals(rows, "ts", "user_id", files, path)
    return V.stream_of(spark, path, files_a_batch * V.files_an_append(spark, path, files + 2)), late


@query("SELECT user_id, event_id, value > avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 95 PRECEDING AND CURRENT ROW) AS speaking FROM events")
def stream_referee(spark, d):
    stream, late = _arriving(spark, spark.read.parquet(f"{d}/events.parquet").select("user_id", "ts", "event_id", F.col("value").cast("double").alias("value")))
    return V.drained(floor.referee(stream, "user_id", "ts", late), "referee").where("session >= 0").withColumnRenamed("session", "user_id")


@query("SELECT user_id, CAST(count(*) AS BIGINT) AS gaps FROM (SELECT user_id, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events) WHERE gap > INTERVAL 1 DAY GROUP BY user_id")
def stream_dead_air(spark, d):
    """Silences over a day: a session ends where nothing follows in time, and is forgotten then."""
    stream, late = _arriving(spark, spark.read.parquet(f"{d}/events.parquet").select("user_id", "ts"))
    found = V.drained(V.silences(stream, "user_id", "ts", "86400 seconds 1 microsecond", late), "dead-air")
    return found.where("user_id >= 0").groupBy("user_id").agg((F.count(F.lit(1)) - 1).alias("gaps")).where("gaps > 0")


@query("""WITH f AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, event_id FROM events), c AS (SELECT user_id, frame // 5 AS chunk, count(*) AS n, string_agg(event_id, ' ' ORDER BY frame) AS ids FROM f GROUP BY ALL)
SELECT user_id, CAST(chunk AS BIGINT) AS chunk, ids FROM c WHERE n = 5""")
def stream_chunks(spark, d):
    """Frames of a session in chunks of five, in the order of time."""
    stream, late = _arriving(spark, spark.read.parquet(f"{d}/events.parquet").select("user_id", "ts", "event_id"))
    return V.drained(floor.chunks(stream, "user_id", "ts", late), "chunks").where("session >= 0").select(
        F.col("session").alias("user_id"), "chunk", F.array_join(F.col("event_ids").cast("array<string>"), " ").alias("ids"))


def _steps(spark, d):
    state = F.element_at(F.array(*map(F.lit, ("IDLE", "LLM_GEN", "TTS_SPEAKING"))), (F.col("event_id") % 3 + 1).cast("int"))
    return spark.read.parquet(f"{d}/events.parquet").select(
        "user_id", "ts", "event_id", name_of(FLAGS, F.col("event_id") % 11).alias("flag"), state.alias("agent_state"), F.when(F.col("event_id") % 5 == 0, "ok").otherwise("").alias("spoken"))


ORCHESTRATOR_SQL = f"""WITH s AS (
  SELECT user_id, epoch_us(ts) AS at_us, event_id, split_part('{",".join(FLAGS)}', ',', CAST(event_id % 11 + 1 AS INT)) AS flag, split_part('IDLE,LLM_GEN,TTS_SPEAKING', ',', CAST(event_id % 3 + 1 AS INT)) AS agent_state,
    CASE WHEN event_id % 5 = 0 THEN 'ok' ELSE '' END AS spoken, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ahead FROM events),
a AS (SELECT user_id, at_us, event_id, flag, agent_state, spoken FROM s UNION ALL
  SELECT user_id, at_us + 86400000000, NULL, 'SILENCE_BREAK', '', '' FROM s WHERE ahead IS NULL OR ahead > at_us + 86400000000),
b AS (SELECT *, coalesce(last_value(CASE WHEN flag = 'PREFETCH_LLM' AND agent_state <> 'LLM_GEN' THEN 1 WHEN flag IN ('COMMIT_LLM', 'CANCEL_LLM') THEN 0 END IGNORE NULLS)
  OVER (PARTITION BY user_id ORDER BY at_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prefetch_active FROM a)
SELECT user_id, at_us, event_id, flag, prefetch_active, concat_ws(',', CASE flag WHEN 'BARGE_HARD' THEN 'barge_hard' WHEN 'BARGE_SOFT' THEN 'barge_soft'
  WHEN 'PREFETCH_LLM' THEN CASE WHEN agent_state <> 'LLM_GEN' THEN 'prefetch' END WHEN 'COMMIT_LLM' THEN 'commit' WHEN 'CANCEL_LLM' THEN 'cancel'
  WHEN 'TURN_END' THEN CASE WHEN prefetch_active = 0 THEN 'prefetch,turn_end' ELSE 'turn_end' END WHEN 'SILENCE_BREAK' THEN 'say' END,
  CASE WHEN spoken <> '' AND flag <> 'SILENCE_BREAK' THEN 'say' END) AS actions FROM b"""


@query(ORCHESTRATOR_SQL)
def stream_orchestrator(spark, d):
    """What the floor does at each flag and in each silence of a day, by timers."""
    stream, late = _arriving(spark, _steps(spark, d))
    found = V.drained(floor.orchestrator(stream, "user_id", "ts", late, 86400.0), "orchestrator").where("session >= 0")
    return found.select(F.col("session").alias("user_id"), "at_us", "event_id", "flag", "prefetch_active", F.array_join("actions", ",").alias("actions"))


@query(ORCHESTRATOR_SQL)
def orchestrator_silences(spark, d):
    """The batch twin of stream_orchestrator."""
    steps = _steps(spark, d).withColumn("at_us", F.unix_micros(F.col("ts").cast("timestamp")))
    return orchestrated(steps, "user_id", "at_us", "event_id", 86_400_000_000).withColumn("actions", F.array_join("actions", ","))
