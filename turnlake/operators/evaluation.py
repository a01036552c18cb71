"""Scores of frame predictions: counts are summed per group first, ratios taken after."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import f1, ratio
from ..functions.vocab import FLAGS, FRAME_MS


def confusion(frames: DataFrame, truth: str = "flag", pred: str = "pred", mask: str = "valid") -> DataFrame:
    """(truth, pred, n) for all pairs of flags, 0 where none occur."""
    spark = frames.sparkSession
    ids = spark.range(len(FLAGS))
    pairs = ids.select(F.col("id").cast("int").alias("truth")).join(F.broadcast(ids.select(F.col("id").cast("int").alias("pred"))))
    found = frames.where(F.col(mask)).groupBy(F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    return pairs.join(found, ["truth", "pred"], "left").select("truth", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def per_flag(counts: DataFrame) -> DataFrame:
    """(flag, precision, recall, f1) of every flag, from a confusion table; absent flags have 0."""
    sides = counts.select(F.col("truth").alias("flag"), F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0).alias("tp"), F.lit(0).alias("fp"), F.when(F.col("truth") != F.col("pred"), F.col("n")).otherwise(0).alias("fn"))
    other = counts.where("truth != pred").select(F.col("pred").alias("flag"), F.lit(0).alias("tp"), F.col("n").alias("fp"), F.lit(0).alias("fn"))
    sums = sides.unionByName(other).groupBy("flag").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    p, r, f = f1(F.col("tp"), F.col("fp"), F.col("fn"))
    return sums.select("flag", p.alias("precision"), r.alias("recall"), f.alias("f1"))


def tolerant(frames: DataFrame, tolerance: int = 3, clip: str = "clip", frame: str = "frame", truth: str = "flag", pred: str = "pred", mask: str = "valid") -> DataFrame:
    """(flag, precision, recall, f1): a prediction counts if the flag is true within the tolerance, and the other way round.

    Widened marks count in valid frames only; recall and precision have hits of their own. The flags near a frame are bits
    of one number, and frames are counted by what they hold before flags are told apart.
    """
    near = Window.partitionBy(clip).orderBy(frame).rowsBetween(-tolerance, tolerance)
    bit = lambda c: F.when(F.col(c).between(0, len(FLAGS) - 1), F.call_function("shiftleft", F.lit(1), F.col(c).cast("int")))
    wide = lambda c: F.coalesce(F.bit_or(F.when(F.col(mask), bit(c))).over(near), F.lit(0))
    met = lambda around, c: F.coalesce(around.bitwiseAND(bit(c)) != 0, F.lit(False))
    marked = frames.select(F.col(truth).alias("truth"), F.col(pred).alias("pred"), F.col(mask).alias("ok"), wide(truth).alias("wide_t"), wide(pred).alias("wide_p")).where("ok")
    cells = marked.groupBy("truth", "pred", met(F.col("wide_p"), "truth").alias("found"), met(F.col("wide_t"), "pred").alias("right")).agg(F.count(F.lit(1)).alias("n"))
    k, n = F.col("flag"), F.col("n")
    total = lambda hit: F.sum(F.when(hit, n).otherwise(0))
    sums = cells.withColumn("flag", F.explode(F.sequence(F.lit(0), F.lit(len(FLAGS) - 1)))).groupBy("flag").agg(
        total(k == F.col("truth")).alias("t"), total(k == F.col("pred")).alias("p"), total((k == F.col("truth")) & F.col("found")).alias("found"), total((k == F.col("pred")) & F.col("right")).alias("right"))
    p, r = ratio(F.col("right"), F.col("p")), ratio(F.col("found"), F.col("t"))
    return sums.select("flag", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"))


#: Behaviours in which any interruption is a false one.
NO_BARGE = ["barge_lookalike", "overlap_coop", "backchannel"]


def barge(frames: DataFrame, truth: str = "flag", pred: str = "pred", behaviour: str | None = None) -> DataFrame:
    """One row: F1 of both barge flags as one, and the share of predicted ones among the frames of NO_BARGE, or,
    without a behaviour, of false ones among frames without."""
    hard_soft = [FLAGS.index("BARGE_SOFT"), FLAGS.index("BARGE_HARD")]
    t, p = F.col(truth).isin(hard_soft), F.col(pred).isin(hard_soft)
    calm = ~t if behaviour is None else F.col(behaviour).isin(NO_BARGE)
    counts = frames.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(calm & p).alias("wrong"), F.count_if(calm).alias("calm"))
    precision, recall, score = f1(F.col("tp"), F.col("fp"), F.col("fn"))
    return counts.select(precision.alias("precision"), recall.alias("recall"), score.alias("f1"), ratio(F.col("wrong"), F.col("calm")).alias("false_barge_rate"))


def percentiles(rows: DataFrame, column: str, marks: list[float], bins: int = 1024) -> list[float | None]:
    """The exact percentiles of a column, interpolated between neighbours; nulls if there is no value.

    Ranks are closed in on by histograms: each round splits the value ranges that still hold a wanted rank into bins and
    keeps the bin with the rank, until it holds one value. A round is one pass with bins of counts; no values are sorted.
    """
    values = rows.select(F.col(column).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    n, low, high = values.agg(F.count(F.lit(1)), F.min("v"), F.max("v")).first()
    if not n:
        return [None] * len(marks)
    wanted = sorted({k for p in marks for k in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))})
    within = {k: (low, high, 0) for k in wanted}  # the range that holds rank k, and how many values come before it
    while open_ := sorted({r for r in within.values() if r[0] < r[1]}):
        own = F
        for i, (a, b, _) in enumerate(open_):
            own = own.when(F.col("v").between(a, b), i)
        of = lambda numbers: F.get(F.array(*map(F.lit, numbers)), F.col("own"))
        scale = [1.0 if math.isfinite(b - a) else 0.5 for a, b, _ in open_]
        lows, spans = of([a * s for (a, _, _), s in zip(open_, scale)]), of([b * s - a * s for (a, b, _), s in zip(open_, scale)])
        bin_ = F.least(F.lit(bins - 1), F.floor((F.col("v") * of(scale) - lows) / spans * bins).cast("int"))
        placed = values.select("v", own.alias("own")).where("own is not null").select("v", "own", bin_.alias("bin"))
        counts = placed.groupBy("own", "bin").agg(F.count(F.lit(1)), F.min("v"), F.max("v")).collect()
        for i, r in enumerate(open_):
            before = r[2]
            for _, _, size, a, b in sorted(c for c in counts if c[0] == i):
                for k in (k for k in wanted if within[k] == r and before <= k < before + size):
                    within[k] = (a, b, before)
                before += size
    at = {k: r[0] for k, r in within.items()}
    place = [(p * (n - 1), math.floor(p * (n - 1)), math.ceil(p * (n - 1))) for p in marks]
    return [at[f] if at[f] == at[c] else (c - x) * at[f] + (x - f) * at[c] for x, f, c in place]  # equal neighbours stay what they are


def threshold_sweep(scores: DataFrame, score: str = "logit", truth: str = "truth", places: int = 41) -> DataFrame:
    """(threshold, f1) at the different quantiles from 1 % to 99 %; a score must exceed the threshold.

    A score falls in one place between thresholds, so counts are summed by place and then from above:
    no score meets every threshold, and the quantiles are found without a task that holds all scores.
    """
    bars = sorted({x for x in percentiles(scores, score, [0.01 + 0.98 * k / (places - 1) for k in range(places)]) if x is not None})
    place = F.size(F.filter(F.array(*map(F.lit, bars)).cast("array<double>"), lambda b: b < F.col(score)))
    counts = scores.groupBy(place.alias("place")).agg(F.count_if(F.col(truth)).alias("t"), F.count_if(~F.col(truth)).alias("f"))
    every = scores.sparkSession.createDataFrame([(0, None), *enumerate(bars, 1)], "place int, threshold double")
    from_top = Window.orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, 0)
    summed = every.join(counts, "place", "left").select(
        "threshold", F.sum(F.coalesce("t", F.lit(0))).over(from_top).alias("tp"), F.sum(F.coalesce("f", F.lit(0))).over(from_top).alias("fp"),
        F.sum(F.coalesce("t", F.lit(0))).over(Window.partitionBy()).alias("positive"))
    _, _, score_ = f1(F.col("tp"), F.col("fp"), F.col("positive") - F.col("tp"))
    return summed.where("threshold is not null").select("threshold", score_.alias("f1"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The row with the highest F1, the lowest threshold of equal ones; (0, 0) if no F1 exceeds 0."""
    best = sweep.where("f1 > 0").agg(F.max(F.struct("f1", (-F.col("threshold")).alias("minus"))).alias("b"))
    return best.select(F.coalesce(-F.col("b.minus"), F.lit(0.0)).alias("threshold"), F.coalesce("b.f1", F.lit(0.0)).alias("f1"))


def endpoint_latency(frames: DataFrame, clip: str = "clip", frame: str = "frame", truth: str = "flag", pred: str = "pred") -> DataFrame:
    """One row: p50 and p95 of |first predicted - first true end of turn| in ms, over clips that have both."""
    end = FLAGS.index("TURN_END")
    firsts = frames.groupBy(clip).agg(F.min(F.when(F.col(truth) == end, F.col(frame))).alias("t"), F.min(F.when(F.col(pred) == end, F.col(frame))).alias("p"))
    apart = firsts.where("t is not null and p is not null").select((F.abs(F.col("p") - F.col("t")) * FRAME_MS).alias("ms"))
    return apart.agg(F.coalesce(F.percentile("ms", 0.5), F.lit(0.0)).alias("p50_ms"), F.coalesce(F.percentile("ms", 0.95), F.lit(0.0)).alias("p95_ms"), F.count(F.lit(1)).alias("n"))


#: Bars that metrics are held to (fixed values).
TARGETS = [("vad_f1", ">=", 0.85), ("barge_f1", ">=", 0.85), ("false_barge_rate", "<=", 0.05), ("cutoff_rate", "<=", 0.03), ("endpoint_p95_ms", "<=", 300.0), ("decode_p95_ms", "<=", 40.0)]


def against_targets(metrics: DataFrame) -> DataFrame:
    """metrics (metric, value) -> (metric, value, bar, met); metrics without a bar, and bars without a metric, are left out."""
    rows = ", ".join(f"('{m}', '{o}', {b}e0)" for m, o, b in TARGETS)
    bars = metrics.sparkSession.sql(f"SELECT * FROM (VALUES {rows}) AS t(metric, op, bar)")
    met = F.when(F.col("op") == ">=", F.col("value") >= F.col("bar")).otherwise(F.col("value") <= F.col("bar"))
    return metrics.join(F.broadcast(bars), "metric").select("metric", "value", "bar", met.alias("met"))


def best_so_far(scores: DataFrame, run: str, step: str, score: str) -> DataFrame:
    """Adds best (the running minimum), improved, and stale: steps since the last improvement."""
    w = Window.partitionBy(run).orderBy(step)
    before = F.min(score).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = scores.withColumn("best", F.min(score).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("improved", F.coalesce(F.col(score) < before, F.lit(True)))
    last = F.last(F.when(F.col("improved"), F.col(step)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("stale", F.col(step) - last)


def focal(p: Column, alpha: Column, gamma: float = 2.0) -> Column:
    """Loss of a frame whose true class has probability p."""
    return alpha * F.pow(1 - p, F.lit(gamma)) * -F.log(p)


def binary_cross_entropy(p: Column, truth: Column, weight: float = 1.0) -> Column:
    return -(weight * truth * F.log(p) + (1 - truth) * F.log(1 - p))


def class_weights(counts: DataFrame, power: float = 0.5, most_ratio: float = 0.0) -> DataFrame:
    """counts (flag, n) of all flags -> weight: (1 / n) ** power, the largest for unseen ones, over their mean.

    With a ratio above 1, no weight exceeds the smallest by more than that. Without any flag seen all are 1.
    """
    every = Window.partitionBy()
    raw = counts.withColumn("w", F.when(F.col("n") > 0, F.pow(1.0 / F.col("n"), F.lit(power))))
    full = raw.withColumn("w", F.coalesce("w", F.max("w").over(every), F.lit(1.0)))
    if most_ratio > 1:
        full = full.withColumn("w", F.least("w", F.min("w").over(every) * most_ratio))
    return full.select("flag", "n", (F.col("w") / F.avg("w").over(every)).alias("weight"))


def rates(counts: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """One row of ratios by name, each of two sums of columns of counts; 0 where there is nothing to divide by."""
    return counts.agg(*[ratio(F.sum(a), F.sum(b)).alias(name) for name, (a, b) in pairs.items()])


def ablation_band(intact: Column, ablated: Column) -> Column:
    """What taking the audio away does to the loss; a loss that can't be is suspect."""
    delta = ablated - intact
    return F.when((intact > 8.0) | (delta < -0.05), "suspect").when(delta < 0.05, "ignored").when(delta < 0.3, "weak").otherwise("used")


def weighted_total(parts: dict[str, float]) -> Column:
    """Sum of loss columns by weight."""
    total = F.lit(0.0)
    for name, weight in parts.items():
        total = total + F.col(name) * weight
    return total


def moving_average(rows: DataFrame, group: str, order: list[str], value: str, keep: float = 0.9) -> DataFrame:
    """(group, ema): each value moves the average by 1 - keep, starting from the first. A group is one run's steps.

    A value's weight follows from the number of values after it, so the average is a sum with partial sums; a null makes it null.
    """
    w = Window.partitionBy(group).orderBy(*[F.desc(c) for c in dict.fromkeys([*order, value])])
    placed = rows.select(group, F.col(value).cast("double").alias("x"), (F.row_number().over(w) - 1).alias("after"), F.lead(F.lit(1)).over(w).isNull().alias("first"))
    weight = F.pow(F.lit(keep), F.col("after")) * F.when(F.col("first"), 1.0).otherwise(1 - keep)
    return placed.groupBy(group).agg(F.when(F.count("x") == F.count(F.lit(1)), F.sum(weight * F.col("x"))).alias("ema"))
