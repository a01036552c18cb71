"""Queries of the log family."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import clipped
from ..functions.vocab import FLAGS, name_of
from ..operators import logs as L
from ..sources.adapters import CALLS, FRAMES, RENDERS, adapted, oracle
from .registry import query

COST = "(prompt_tokens * 0.108e0 + completion_tokens * 0.398e0) / 1e6"
SPEECH = "(chars * 0.3e0 * 4e0 / 1e6 + duration_s / 3600e0 * 30000e0 * 21.5e0 / 1e6)"
C = f"c AS (SELECT *, {COST} AS cost_usd FROM ({oracle(CALLS)}))"
R = f"r AS (SELECT *, {SPEECH} AS cost FROM ({oracle(RENDERS)}))"
FR = oracle(FRAMES)


def _calls(spark, d):
    return adapted(spark, d, CALLS)


def _renders(spark, d):
    return adapted(spark, d, RENDERS)


@query(f"WITH {C} SELECT coalesce(status, 'unknown') AS status, count(*) AS n FROM c GROUP BY 1")
def ops_status_counts(spark, d):
    return L.status_counts(_calls(spark, d))


@query(f"""WITH {C} SELECT count(*) AS calls, CAST(sum(requested_n) AS BIGINT) AS requested, CAST(sum(valid_n) AS BIGINT) AS valid, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens,
CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, round(sum(cost_usd), 4) AS cost_usd, round(sum(valid_n) / CAST(sum(requested_n) AS DOUBLE), 6) AS pass_rate,
round(count(*) FILTER (status = 'ok') / CAST(count(*) AS DOUBLE), 6) AS call_pass_rate FROM c""")
def ops_totals(spark, d):
    return L.totals(_calls(spark, d))


@query(f"WITH {C}, l AS (SELECT * FROM c ORDER BY id DESC LIMIT 5000) SELECT round(avg(latency_ms), 6) AS mean_ms, round(quantile_cont(latency_ms, 0.5), 6) AS p50_ms, round(quantile_cont(latency_ms, 0.95), 6) AS p95_ms, round(avg(latency_ms / requested_n), 6) AS per_item_ms FROM l")
def ops_latency(spark, d):
    found = L.latency(_calls(spark, d))
    return found.select(*[F.round(x, 6).alias(x) for x in found.columns])


@query(f"WITH {R} SELECT count(*) AS clips, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'rate_limited') AS rate_limited, round(sum(CASE WHEN status = 'ok' THEN duration_s END) / 3600, 6) AS hours, round(sum(CASE WHEN status = 'ok' THEN cost END), 4) AS cost_usd FROM r")
def ops_render_totals(spark, d):
    return L.render_totals(_renders(spark, d))


@query(f"""WITH {C}, t AS (SELECT max(created_at) AS now FROM c), l AS (SELECT * FROM c ORDER BY id DESC LIMIT 5000), w AS (SELECT coalesce(sum(valid_n), 0) AS n, max(created_at) - min(created_at) AS span FROM l, t WHERE created_at >= now - 600),
a AS (SELECT sum(valid_n) AS n, greatest(30e0, max(created_at) - min(created_at)) AS span FROM c)
SELECT coalesce(w.span >= 30, false) AS recent, round(CASE WHEN w.span >= 30 THEN w.n / w.span ELSE a.n / a.span END * 60, 6) AS per_minute FROM w, a""")
def ops_throughput(spark, d):
    calls = _calls(spark, d)
    now = calls.agg(F.max("created_at")).first()[0]
    return L.throughput(calls, F.lit(now))


@query(f"WITH {C} SELECT id, round(CAST(sum(CAST(cost_usd AS DECIMAL(18,9))) OVER (ORDER BY id) AS DOUBLE), 9) AS cumulative FROM c")
def ops_cumulative_cost(spark, d):
    return L.cumulative_cost(_calls(spark, d)).select("id", F.round("cumulative", 9).alias("cumulative"))


@query(f"WITH {C}, j AS (SELECT job_key, count(*) AS n FROM c GROUP BY 1), p AS (SELECT *, row_number() OVER (ORDER BY job_key) AS k, count(*) OVER () AS m FROM j) SELECT job_key, n FROM p WHERE k % greatest(1, m // 20) = 0 OR k = m")
def ops_thinned(spark, d):
    jobs = _calls(spark, d).groupBy("job_key").agg(F.count(F.lit(1)).alias("n"))
    return L.thinned(jobs, "job_key", 20, F.substring("job_key", 1, 8))


@query(f"WITH {C} SELECT split_part(job_key, '|', 1) AS name, CAST(sum(valid_n) AS BIGINT) AS valid, round(sum(cost_usd), 6) AS cost_usd, count(*) FILTER (coalesce(status, '') <> 'ok') AS failed FROM c GROUP BY 1")
def ops_by_behaviour(spark, d):
    return L.by_key_part(_calls(spark, d), 1)


@query(f"""WITH {C}, a AS (SELECT split_part(job_key, '|', 2) AS name, sum(valid_n) AS valid FROM c GROUP BY 1), p AS (SELECT * FROM (VALUES ('hi', 9000), ('en', 8000), ('gu', 7000), ('ta', 100)) t(name, planned))
SELECT name, coalesce(planned, 0) AS planned, CAST(coalesce(valid, 0) AS BIGINT) AS valid, CASE WHEN coalesce(planned, 0) = 0 THEN 0 ELSE round(100 * coalesce(valid, 0) / CAST(planned AS DOUBLE), 1) END AS pct FROM a FULL JOIN p USING (name)""")
def ops_actual_vs_plan(spark, d):
    planned = spark.sql("SELECT * FROM (VALUES ('hi', 9000), ('en', 8000), ('gu', 7000), ('ta', 100)) AS t(name, planned)")
    return L.against_plan(planned, L.by_key_part(_calls(spark, d), 2))


@query(f"WITH {C}, {R} SELECT 'llm' AS kind, id, run_id, coalesce(status, 'unknown') AS status, round(cost_usd, 9) AS cost_usd FROM c UNION ALL SELECT 'tts', id, run_id, status, round(cost, 9) FROM r")
def ops_cost_export(spark, d):
    return L.flat_costs(_calls(spark, d), _renders(spark, d))


@query(f"""WITH {C}, {R}, a AS (SELECT sum(valid_n) AS v, round(sum(cost_usd), 4) AS x FROM c), b AS (SELECT count(*) AS n, round(sum(cost), 4) AS y FROM r WHERE status = 'ok')
SELECT round(x + y, 4) AS spent, round(x / v * 9000 + y / n * 9000, 2) AS projected, round(100 * (x / v * 9000 + y / n * 9000) / 250e0, 2) AS pct FROM a, b""")
def ops_budget(spark, d):
    return L.budget(_calls(spark, d), _renders(spark, d), 9000, 250.0)


@query(f"WITH {R} SELECT id, run_id, count(*) OVER (PARTITION BY run_id ORDER BY CAST(floor(created_at) AS BIGINT) RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS in_window FROM r")
def ops_rate_audit(spark, d):
    starts = _renders(spark, d).withColumn("at", F.floor("created_at"))
    return L.rate_audit(starts, "run_id", "at", 3600).select("id", "run_id", "in_window")


@query(f"WITH {C} SELECT id, job_key, 'fail' || CAST(row_number() OVER (PARTITION BY job_key ORDER BY id) AS VARCHAR) AS fail_flag FROM c WHERE coalesce(status, '') <> 'ok'")
def ops_fail_numbers(spark, d):
    return L.numbered_failures(_calls(spark, d))


@query(f"WITH {C} SELECT id, status, error FROM c WHERE error IS NOT NULL ORDER BY id DESC LIMIT 5")
def ops_last_errors(spark, d):
    return L.last_rows(_calls(spark, d).where("error is not null").select("id", "status", "error"), 5)


@query(f"WITH {C} SELECT run_id, count(*) AS calls, round(sum(cost_usd), 6) AS cost_usd, CAST(sum(valid_n) AS BIGINT) AS valid FROM c GROUP BY 1")
def ops_run_summary(spark, d):
    return L.priced(_calls(spark, d)).groupBy("run_id").agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("cost_usd"), 6).alias("cost_usd"), F.sum("valid_n").alias("valid"))


@query(f"""WITH f AS (SELECT clip, frame, list_extract(['{"','".join(FLAGS)}'], CAST((flag + event_id) % 11 + 1 AS INT)) AS flag, list_extract(['IDLE', 'LLM_GEN', 'TTS_SPEAKING'], CAST(event_id % 3 + 1 AS INT)) AS agent_state,
  CASE WHEN event_id % 5 = 0 THEN 'ok' ELSE '' END AS spoken FROM ({FR})),
b AS (SELECT *, coalesce(last_value(CASE WHEN flag = 'PREFETCH_LLM' AND agent_state <> 'LLM_GEN' THEN 1 WHEN flag IN ('COMMIT_LLM', 'CANCEL_LLM') THEN 0 END IGNORE NULLS) OVER (PARTITION BY clip ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prefetch_active FROM f)
SELECT clip, frame, prefetch_active, concat_ws(',', CASE flag WHEN 'BARGE_HARD' THEN 'barge_hard' WHEN 'BARGE_SOFT' THEN 'barge_soft' WHEN 'PREFETCH_LLM' THEN CASE WHEN agent_state <> 'LLM_GEN' THEN 'prefetch' END
  WHEN 'COMMIT_LLM' THEN 'commit' WHEN 'CANCEL_LLM' THEN 'cancel' WHEN 'TURN_END' THEN CASE WHEN prefetch_active = 0 THEN 'prefetch,turn_end' ELSE 'turn_end' END WHEN 'SILENCE_BREAK' THEN 'say' END,
  CASE WHEN spoken <> '' AND flag <> 'SILENCE_BREAK' THEN 'say' END) AS actions FROM b""")
def orchestrator_actions(spark, d):
    state = F.element_at(F.array(*map(F.lit, ("IDLE", "LLM_GEN", "TTS_SPEAKING"))), (F.col("event_id") % 3 + 1).cast("int"))
    steps = adapted(spark, d, FRAMES).withColumn("flag", name_of(FLAGS, (F.col("flag") + F.col("event_id")) % 11)).withColumn("agent_state", state)
    steps = steps.withColumn("spoken", F.when(F.col("event_id") % 5 == 0, "ok").otherwise(""))
    return L.actions(steps, "clip", "frame").select("clip", "frame", "prefetch_active", F.array_join("actions", ",").alias("actions"))


@query(f"WITH {C} SELECT CAST(to_timestamp(floor(created_at / 3600) * 3600) AT TIME ZONE 'UTC' AS VARCHAR) AS hour, count(*) AS calls, CAST(sum(valid_n) AS BIGINT) AS valid FROM c GROUP BY 1")
def ops_hourly(spark, d):
    hour = F.from_unixtime(F.floor(F.col("created_at") / 3600) * 3600, "yyyy-MM-dd HH:mm:ss")
    return _calls(spark, d).groupBy(hour.alias("hour")).agg(F.count(F.lit(1)).alias("calls"), F.sum("valid_n").alias("valid"))


@query("SELECT event_id, CASE WHEN length(props) > 7 THEN substr(props, 1, 6) || '…' ELSE props END AS shown FROM events")
def ops_error_excerpt(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", clipped(F.col("props"), 7).alias("shown"))


@query(f"""WITH {C}, {R}, a AS (SELECT run_id, count(*) AS calls, CAST(sum(valid_n) AS BIGINT) AS valid, sum(cost_usd) AS llm FROM c GROUP BY 1),
b AS (SELECT run_id, count(*) AS clips, count(*) FILTER (status = 'ok') AS ok, sum(cost) AS tts FROM r GROUP BY 1)
SELECT run_id, coalesce(calls, 0) AS calls, coalesce(valid, 0) AS valid, coalesce(clips, 0) AS clips, coalesce(ok, 0) AS ok, round(coalesce(llm, 0), 6) AS llm_usd, round(coalesce(tts, 0), 6) AS tts_usd
FROM a FULL JOIN b USING (run_id)""")
def ops_run_totals(spark, d):
    return L.run_totals(_calls(spark, d), _renders(spark, d))


@query(f"""WITH {C}, {R}, e AS (SELECT 'llm' AS kind, run_id, round(cost_usd, 9) AS cost_usd FROM c UNION ALL SELECT 'tts', run_id, round(cost, 9) FROM r)
SELECT kind, run_id, count(*) AS rows, round(sum(cost_usd), 6) AS cost_usd FROM e GROUP BY ROLLUP (kind, run_id)""")
def ops_cost_totals(spark, d):
    return L.cost_totals(L.flat_costs(_calls(spark, d), _renders(spark, d)))
