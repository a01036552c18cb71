"""Call logs: totals, latency, throughput, budgets, plan against actual."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import llm_cost, ratio, tts_cost
from .storage import numbered


def priced(calls: DataFrame) -> DataFrame:
    return calls.withColumn("cost_usd", llm_cost(F.col("prompt_tokens"), F.col("completion_tokens")))


def status_counts(calls: DataFrame) -> DataFrame:
    return calls.groupBy(F.coalesce("status", F.lit("unknown")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def last_rows(calls: DataFrame, most: int, order: str = "id") -> DataFrame:
    """The newest rows; each partition sends as many at most."""
    return calls.orderBy(F.desc(order)).limit(most)


def latency(calls: DataFrame, most: int = 5000) -> DataFrame:
    """One row over the newest calls: mean, p50, p95 of latency, and mean latency by requested item."""
    recent = last_rows(calls.where("latency_ms is not null"), most)
    return recent.agg(
        F.avg("latency_ms").alias("mean_ms"), F.percentile("latency_ms", 0.5).alias("p50_ms"), F.percentile("latency_ms", 0.95).alias("p95_ms"),
        F.avg(ratio(F.col("latency_ms"), F.col("requested_n"))).alias("per_item_ms"))


def totals(calls: DataFrame) -> DataFrame:
    return priced(calls).agg(
        F.count(F.lit(1)).alias("calls"), F.sum("requested_n").alias("requested"), F.sum("valid_n").alias("valid"), F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"), F.round(F.sum("cost_usd"), 4).alias("cost_usd"), F.round(ratio(F.sum("valid_n"), F.sum("requested_n")), 6).alias("pass_rate"),
        F.round(ratio(F.count_if(F.col("status") == "ok"), F.count(F.lit(1))), 6).alias("call_pass_rate"))


def render_totals(renders: DataFrame) -> DataFrame:
    ok = F.col("status") == "ok"
    hours = F.sum(F.when(ok, F.col("duration_s"))) / 3600
    cost = F.sum(F.when(ok, tts_cost(F.col("chars"), F.col("duration_s"))))
    return renders.agg(
        F.count(F.lit(1)).alias("clips"), F.count_if(ok).alias("ok"), F.count_if(F.col("status") == "rate_limited").alias("rate_limited"),
        F.round(hours, 6).alias("hours"), F.round(cost, 4).alias("cost_usd"))


def throughput(calls: DataFrame, now: Column, window_s: float = 600, least_s: float = 30, most: int = 5000) -> DataFrame:
    """One row: valid items a minute in the last window_s seconds; if these span under least_s, over all time."""
    recent = last_rows(calls, most).withColumn("now", now).where(F.col("created_at") >= F.col("now") - window_s)
    near = recent.agg(F.coalesce(F.sum("valid_n"), F.lit(0)).alias("n"), (F.max("created_at") - F.min("created_at")).alias("span"))
    every = calls.agg(F.sum("valid_n").alias("all_n"), F.greatest(F.lit(float(least_s)), F.max("created_at") - F.min("created_at")).alias("all_span"))
    both = near.join(F.broadcast(every))  # one row each
    usable = F.coalesce(F.col("span") >= least_s, F.lit(False))
    return both.select(usable.alias("recent"), F.round(F.when(usable, F.col("n") / F.col("span")).otherwise(F.col("all_n") / F.col("all_span")) * 60, 6).alias("per_minute"))


def cumulative_cost(calls: DataFrame, span: int = 1 << 14, order: str = "id") -> DataFrame:
    """(id, cumulative): running cost in the order of id. Blocks of ids are summed apart and shifted by the
    totals of the blocks before, so that no task orders the whole log; decimals make the sums exact."""
    blocks = priced(calls).withColumn("cost_usd", F.col("cost_usd").cast("decimal(18,9)")).withColumn("block", F.floor(F.col(order) / span))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.groupBy("block").agg(F.sum("cost_usd").alias("total")).select("block", F.coalesce(F.sum("total").over(before), F.lit(0).cast("decimal(18,9)")).alias("start"))
    inner = F.sum("cost_usd").over(Window.partitionBy("block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return blocks.withColumn("inner", inner).join(starts, "block").select(order, (F.col("start").cast("decimal(28,9)") + F.col("inner").cast("decimal(28,9)")).cast("double").alias("cumulative"))


def thinned(rows: DataFrame, order: str, points: int = 200, block: Column | None = None) -> DataFrame:
    """Every k-th row and the last, about `points` rows; no two rows share their place in the order.

    Rows are numbered by blocks of the order, by default of 16384 whole numbers.
    """
    placed = numbered(rows, order, F.floor(F.col(order) / (1 << 14)) if block is None else block, "_place", "_all")
    step = F.greatest(F.lit(1), F.floor(F.col("_all") / points))
    return placed.where((F.col("_place") % step == 0) | (F.col("_place") == F.col("_all"))).select(*rows.columns)


def by_key_part(calls: DataFrame, part: int) -> DataFrame:
    """(name, valid, cost_usd, failed) by a part of the job key."""
    name = F.split_part("job_key", F.lit("|"), F.lit(part)).alias("name")
    return priced(calls).groupBy(name).agg(
        F.sum("valid_n").alias("valid"), F.round(F.sum("cost_usd"), 6).alias("cost_usd"), F.count_if(F.coalesce(F.col("status"), F.lit("")) != "ok").alias("failed"))


def against_plan(planned: DataFrame, actual: DataFrame) -> DataFrame:
    """planned (name, planned), actual (name, valid): all names of either, missing numbers 0, and pct."""
    both = planned.join(actual, "name", "full_outer").select("name", F.coalesce("planned", F.lit(0)).alias("planned"), F.coalesce("valid", F.lit(0)).alias("valid"))
    return both.withColumn("pct", F.round(ratio(100 * F.col("valid"), F.col("planned")), 1))


def flat_costs(calls: DataFrame, renders: DataFrame) -> DataFrame:
    """Both logs in one layout, one row a call."""
    a = priced(calls).select(F.lit("llm").alias("kind"), "id", "run_id", F.coalesce("status", F.lit("unknown")).alias("status"), F.round("cost_usd", 9).alias("cost_usd"))
    b = renders.select(F.lit("tts").alias("kind"), "id", "run_id", "status", F.round(tts_cost(F.col("chars"), F.col("duration_s")), 9).alias("cost_usd"))
    return a.unionByName(b)


def budget(calls: DataFrame, renders: DataFrame, target: int, limit_usd: float) -> DataFrame:
    """One row: spent so far, projected for the target, and its part of the limit."""
    spent = totals(calls).select("valid", F.col("cost_usd").alias("llm")).join(F.broadcast(render_totals(renders).select("ok", F.col("cost_usd").alias("tts"))))
    projected = ratio(F.col("llm"), F.col("valid")) * target + ratio(F.col("tts"), F.col("ok")) * target
    return spent.select(F.round(F.col("llm") + F.col("tts"), 4).alias("spent"), F.round(projected, 2).alias("projected"), F.round(100 * projected / limit_usd, 2).alias("pct"))


def rate_audit(starts: DataFrame, key: str, at: str, window_s: int = 60) -> DataFrame:
    """Adds in_window: starts of the key in the window_s seconds up to each."""
    w = Window.partitionBy(key).orderBy(F.col(at)).rangeBetween(-window_s, 0)
    return starts.withColumn("in_window", F.count(F.lit(1)).over(w))


def numbered_failures(calls: DataFrame) -> DataFrame:
    """(id, job_key, fail_flag): failures of a job numbered in the order of id."""
    failed = calls.where(F.coalesce("status", F.lit("")) != "ok")
    return failed.select("id", "job_key", F.concat(F.lit("fail"), F.row_number().over(Window.partitionBy("job_key").orderBy("id")).cast("string")).alias("fail_flag"))


def actions(steps: DataFrame, session: str, order: str) -> DataFrame:
    """Adds prefetch_active, as it was before the step, and actions: what an orchestrator does at each flag.

    A prefetch starts unless the agent is already generating; commit and cancel end it, other flags leave it. An
    end of turn prefetches if none is active. Speech goes out with any flag, with SILENCE_BREAK even if empty. The
    bit is the last flag that sets or resets it, so no state needs to be carried row by row.
    """
    flag, speaks = F.col("flag"), F.coalesce(F.col("spoken"), F.lit("")) != ""
    starts = (flag == "PREFETCH_LLM") & (F.coalesce("agent_state", F.lit("")) != "LLM_GEN")
    bit = F.when(starts, 1).when(flag.isin("COMMIT_LLM", "CANCEL_LLM"), 0)
    before = F.coalesce(F.last(bit, ignorenulls=True).over(Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    named = {"BARGE_HARD": "barge_hard", "BARGE_SOFT": "barge_soft", "COMMIT_LLM": "commit", "CANCEL_LLM": "cancel", "TURN_END": "turn_end"}
    done = F.array_compact(F.array(
        F.when(starts | (flag == "TURN_END") & (F.col("prefetch_active") == 0), "prefetch"), *[F.when(flag == k, v) for k, v in named.items()],
        F.when((flag == "SILENCE_BREAK") | speaks, "say")))
    return steps.withColumn("prefetch_active", before).withColumn("actions", done)


def orchestrated(steps: DataFrame, session: str, at_us: str, order: str, silence_us: int = 2_500_000) -> DataFrame:
    """(session, at_us, order, flag, prefetch_active, actions) of all steps, and of a SILENCE_BREAK where none follows
    for silence_us; its order is null."""
    ahead = F.lead(at_us).over(Window.partitionBy(session).orderBy(at_us, order))
    own = steps.select(session, F.col(at_us).alias("at_us"), order, "flag", "agent_state", "spoken", ahead.alias("ahead"))
    quiet = own.where(F.col("ahead").isNull() | (F.col("ahead") > F.col("at_us") + silence_us))
    breaks = quiet.select(session, (F.col("at_us") + silence_us).alias("at_us"), F.lit(None).cast("long").alias(order), F.lit("SILENCE_BREAK").alias("flag"),
                          F.lit("").alias("agent_state"), F.lit("").alias("spoken"))
    rows = own.drop("ahead").unionByName(breaks).withColumn("turn", F.struct("at_us", order))
    return actions(rows, session, "turn").select(session, "at_us", order, "flag", "prefetch_active", "actions")


def run_totals(calls: DataFrame, renders: DataFrame) -> DataFrame:
    """(run_id, calls, valid, clips, ok, llm_usd, tts_usd): a row a run, of both logs; a run that one lacks has 0 there."""
    a = priced(calls).groupBy("run_id").agg(F.count(F.lit(1)).alias("calls"), F.sum("valid_n").alias("valid"), F.sum("cost_usd").alias("llm_usd"))
    b = renders.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("clips"), F.count_if(F.col("status") == "ok").alias("ok"), F.sum(tts_cost(F.col("chars"), F.col("duration_s"))).alias("tts_usd"))
    both = a.join(b, "run_id", "full_outer")
    return both.select("run_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("calls", "valid", "clips", "ok")], *[F.round(F.coalesce(c, F.lit(0.0)), 6).alias(c) for c in ("llm_usd", "tts_usd")])


def cost_totals(export: DataFrame) -> DataFrame:
    """(kind, run_id, rows, cost_usd) of a cost export, with the totals of each kind and of all under nulls."""
    sums = export.rollup("kind", "run_id").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("cost_usd"), 6).alias("cost_usd"))
    return sums.select("kind", "run_id", "rows", "cost_usd")
