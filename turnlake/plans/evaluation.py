"""Queries of the evaluation family."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..sources.adapters import FRAMES, adapted, oracle
from .registry import query

FR = oracle(FRAMES)
ENUM = "k AS (SELECT CAST(unnest(range(0, 11)) AS INT) AS flag)"
SAFE = "CASE WHEN {b} = 0 THEN 0e0 ELSE {a} / CAST({b} AS DOUBLE) END"
PRF = f"""round({SAFE.format(a='tp', b='(tp + fp)')}, 9) AS precision, round({SAFE.format(a='tp', b='(tp + fn)')}, 9) AS recall, round({SAFE.format(a='2 * tp', b='(2 * tp + fp + fn)')}, 9) AS f1"""
COUNTS = f"""f AS ({FR}), {ENUM}, x AS (SELECT k.flag, count(*) FILTER (f.flag = k.flag AND pred = k.flag) AS tp, count(*) FILTER (f.flag <> k.flag AND pred = k.flag) AS fp,
count(*) FILTER (f.flag = k.flag AND pred <> k.flag) AS fn FROM k CROSS JOIN (SELECT * FROM f WHERE valid) f GROUP BY k.flag)"""
NUMBERS = ("precision", "recall", "f1")


def _frames(spark, d):
    return adapted(spark, d, FRAMES)


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 9) for n in names})


@query(f"WITH f AS ({FR}), {ENUM}, c AS (SELECT flag, pred, count(*) AS n FROM f WHERE valid GROUP BY ALL) SELECT a.flag AS truth, b.flag AS pred, coalesce(n, 0) AS n FROM k a CROSS JOIN k b LEFT JOIN c ON c.flag = a.flag AND c.pred = b.flag")
def eval_confusion(spark, d):
    return E.confusion(_frames(spark, d))


@query(f"WITH {COUNTS} SELECT flag, {PRF} FROM x")
def eval_per_flag_f1(spark, d):
    return _rounded(E.per_flag(E.confusion(_frames(spark, d))), *NUMBERS)


@query(f"WITH {COUNTS}, s AS (SELECT flag, {PRF} FROM x) SELECT round(avg(f1), 6) AS macro_f1 FROM s")
def eval_macro_f1(spark, d):
    return E.per_flag(E.confusion(_frames(spark, d))).agg(F.round(F.avg("f1"), 6).alias("macro_f1"))


@query(f"""WITH f AS ({FR}), {ENUM}, m AS (SELECT clip, frame, valid, k.flag, CAST(f.flag = k.flag AND valid AS INT) AS t, CAST(pred = k.flag AND valid AS INT) AS p FROM f CROSS JOIN k),
w AS (SELECT *, max(t) OVER n AS wt, max(p) OVER n AS wp FROM m WINDOW n AS (PARTITION BY clip, flag ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
s AS (SELECT flag, sum(t) AS t, sum(p) AS p, sum(t * wp) AS found, sum(p * wt) AS good FROM w WHERE valid GROUP BY flag),
r AS (SELECT flag, {SAFE.format(a='good', b='p')} AS pr, {SAFE.format(a='found', b='t')} AS re FROM s)
SELECT flag, round(pr, 9) AS precision, round(re, 9) AS recall, round({SAFE.format(a='2 * pr * re', b='(pr + re)')}, 9) AS f1 FROM r""")
def eval_tolerant_f1(spark, d):
    return _rounded(E.tolerant(_frames(spark, d)), *NUMBERS)


@query(f"""WITH f AS ({FR}), c AS (SELECT count(*) FILTER (flag IN (4, 5) AND pred IN (4, 5)) AS tp, count(*) FILTER (flag NOT IN (4, 5) AND pred IN (4, 5)) AS fp,
count(*) FILTER (flag IN (4, 5) AND pred NOT IN (4, 5)) AS fn, count(*) FILTER (flag NOT IN (4, 5)) AS other FROM f) SELECT {PRF}, round({SAFE.format(a='fp', b='other')}, 9) AS false_barge_rate FROM c""")
def eval_barge(spark, d):
    return _rounded(E.barge(_frames(spark, d)), *NUMBERS, "false_barge_rate")


SCORES = f"s AS (SELECT value AS logit, flag IN (0, 1) AS truth FROM ({FR}))"
SWEEP = f"""{SCORES}, b AS (SELECT DISTINCT unnest(quantile_cont(logit, [{', '.join(str(0.01 + 0.98 * k / 40) for k in range(41))}])) AS threshold FROM s),
w AS (SELECT threshold, count(*) FILTER (logit > threshold AND truth) AS tp, count(*) FILTER (logit > threshold AND NOT truth) AS fp, count(*) FILTER (logit <= threshold AND truth) AS fn FROM b CROSS JOIN s GROUP BY threshold)"""


def _scores(spark, d):
    return _frames(spark, d).select(F.col("value").alias("logit"), F.col("flag").isin(0, 1).alias("truth"))


@query(f"WITH {SWEEP} SELECT round(threshold, 6) AS threshold, round({SAFE.format(a='2 * tp', b='(2 * tp + fp + fn)')}, 9) AS f1 FROM w")
def eval_threshold_sweep(spark, d):
    return E.threshold_sweep(_scores(spark, d)).select(F.round("threshold", 6).alias("threshold"), F.round("f1", 9).alias("f1"))


@query(f"WITH {SWEEP}, g AS (SELECT threshold, {SAFE.format(a='2 * tp', b='(2 * tp + fp + fn)')} AS f1 FROM w) SELECT round(threshold, 6) AS threshold, round(f1, 9) AS f1 FROM g ORDER BY g.f1 DESC, g.threshold LIMIT 1")
def eval_best_threshold(spark, d):
    return E.best_threshold(E.threshold_sweep(_scores(spark, d))).select(F.round("threshold", 6).alias("threshold"), F.round("f1", 9).alias("f1"))


@query(f"""WITH f AS ({FR}), x AS (SELECT clip, min(frame) FILTER (flag = 3) AS t, min(frame) FILTER (pred = 3) AS p FROM f GROUP BY clip), y AS (SELECT abs(p - t) * 80e0 AS ms FROM x WHERE t IS NOT NULL AND p IS NOT NULL)
SELECT coalesce(quantile_cont(ms, 0.5), 0) AS p50_ms, round(coalesce(quantile_cont(ms, 0.95), 0), 6) AS p95_ms, count(*) AS n FROM y""")
def eval_endpoint_latency(spark, d):
    return E.endpoint_latency(_frames(spark, d)).withColumn("p95_ms", F.round("p95_ms", 6))


@query(f"""WITH f AS ({FR}), c AS (SELECT count(*) FILTER (flag IN (4, 5) AND pred IN (4, 5)) AS tp, count(*) FILTER (flag NOT IN (4, 5) AND pred IN (4, 5)) AS fp,
count(*) FILTER (flag IN (4, 5) AND pred NOT IN (4, 5)) AS fn, count(*) FILTER (flag NOT IN (4, 5)) AS other FROM f)
SELECT 'barge_f1' AS metric, round({SAFE.format(a='2 * tp', b='(2 * tp + fp + fn)')}, 9) AS value, 0.85e0 AS bar, 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) >= 0.85e0 AS met FROM c
UNION ALL SELECT 'false_barge_rate', round(fp / CAST(other AS DOUBLE), 9), 0.05e0, fp / CAST(other AS DOUBLE) <= 0.05e0 FROM c""")
def eval_targets(spark, d):
    row = E.barge(_frames(spark, d)).withColumnRenamed("f1", "barge_f1")
    metrics = row.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.round(m, 9).alias("value")) for m in ("barge_f1", "false_barge_rate")])).alias("x")).select("x.*")
    return E.against_targets(metrics)


@query(f"""WITH f AS ({FR}), b AS (SELECT clip, frame, value, coalesce(value < min(value) OVER (PARTITION BY clip ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved,
min(value) OVER (PARTITION BY clip ORDER BY frame) AS best FROM f)
SELECT clip, frame, round(best, 6) AS best, improved, frame - max(CASE WHEN improved THEN frame END) OVER (PARTITION BY clip ORDER BY frame) AS stale FROM b""")
def eval_best_checkpoint(spark, d):
    return E.best_so_far(_frames(spark, d), "clip", "frame", "value").select("clip", "frame", F.round("best", 6).alias("best"), "improved", "stale")


@query(f"""WITH f AS ({FR}), b AS (SELECT clip, frame, value, coalesce(value < min(value) OVER (PARTITION BY clip ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved,
min(value) OVER (PARTITION BY clip ORDER BY frame) AS best FROM f)
SELECT clip, frame, round(best, 6) AS best, improved, frame - max(CASE WHEN improved THEN frame END) OVER (PARTITION BY clip ORDER BY frame) AS stale FROM b""")
def eval_best_checkpoint_whole(spark, d):
    """eval_best_checkpoint, under the name it had beside a query of first frames."""
    return E.best_so_far(_frames(spark, d), "clip", "frame", "value").select("clip", "frame", F.round("best", 6).alias("best"), "improved", "stale")


@query(f"""WITH f AS (SELECT (event_id % 97 + 1) / 99e0 AS p, flag, valid, clip FROM ({FR}))
SELECT round(avg(pow(1 - p, 2) * -ln(p) * 0.25e0), 8) AS focal, round(avg(-(flag % 2 * ln(p) + (1 - flag % 2) * ln(1 - p))), 8) AS bce, round(exp(avg(-ln(p))), 8) AS perplexity FROM f WHERE valid""")
def eval_losses(spark, d):
    p, truth = F.col("p"), F.col("flag") % 2
    rows = _frames(spark, d).where("valid").withColumn("p", (F.col("event_id") % 97 + 1) / 99.0)
    return rows.agg(F.round(F.avg(E.focal(p, F.lit(0.25))), 8).alias("focal"), F.round(F.avg(E.binary_cross_entropy(p, truth)), 8).alias("bce"), F.round(F.exp(F.avg(-F.log(p))), 8).alias("perplexity"))


@query(f"""WITH f AS ({FR}), {ENUM}, c AS (SELECT k.flag, count(f.flag) AS n FROM k LEFT JOIN f ON f.flag = k.flag GROUP BY k.flag),
r AS (SELECT flag, n, CASE WHEN n > 0 THEN pow(1e0 / n, 0.75) END AS w FROM c), u AS (SELECT flag, n, coalesce(w, max(w) OVER (), 1) AS w FROM r),
v AS (SELECT flag, n, least(w, 2 * min(w) OVER ()) AS w FROM u) SELECT flag, n, round(w / avg(w) OVER (), 8) AS weight FROM v""")
def eval_class_weights(spark, d):
    found = _frames(spark, d).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))
    every = spark.range(11).select(F.col("id").cast("int").alias("flag")).join(found, "flag", "left").select("flag", F.coalesce("n", F.lit(0)).alias("n"))
    return E.class_weights(every, 0.75, 2.0).withColumn("weight", F.round("weight", 8))


@query(f"WITH f AS ({FR}), b AS (SELECT clip, avg(value) AS m, count(*) FILTER (flag = 1 AND pred = 1) AS tp, count(*) FILTER (pred = 1) AS p, count(*) FILTER (flag = 1) AS t FROM f GROUP BY clip) SELECT round(avg(m), 6) AS loss, round(2 * sum(tp) / CAST(sum(p) + sum(t) AS DOUBLE), 8) AS vad_f1, CAST(sum(p) AS BIGINT) AS predicted, CAST(sum(t) AS BIGINT) AS truth FROM b")
def eval_validation_rollup(spark, d):
    batches = _frames(spark, d).groupBy("clip").agg(F.avg("value").alias("m"), F.count_if((F.col("flag") == 1) & (F.col("pred") == 1)).alias("tp"), F.count_if(F.col("pred") == 1).alias("p"), F.count_if(F.col("flag") == 1).alias("t"))
    return batches.agg(F.round(F.avg("m"), 6).alias("loss"), F.round(2 * F.sum("tp") / (F.sum("p") + F.sum("t")), 8).alias("vad_f1"), F.sum("p").alias("predicted"), F.sum("t").alias("truth"))


@query(f"WITH f AS ({FR}) SELECT clip, round(list_reduce(list(CAST(value AS DOUBLE) ORDER BY frame), lambda a, x: 0.9e0 * a + (1 - 0.9e0) * x), 6) AS ema FROM f GROUP BY clip")
def eval_moving_average(spark, d):
    return E.moving_average(_frames(spark, d), "clip", ["frame"], "value").select("clip", F.round("ema", 6).alias("ema"))


@query(f"WITH f AS ({FR}) SELECT clip, round(list_reduce(list(CAST(value AS DOUBLE) ORDER BY frame), lambda a, x: 0.9e0 * a + (1 - 0.9e0) * x), 6) AS ema FROM f GROUP BY clip")
def eval_moving_average_whole(spark, d):
    """eval_moving_average, under the name it had beside a query of first frames."""
    return E.moving_average(_frames(spark, d), "clip", ["frame"], "value").select("clip", F.round("ema", 6).alias("ema"))
