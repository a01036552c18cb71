"""Planning: how many scenarios of each kind, with exact integer rounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import half_even, md5_mod, ratio


def build_plan(dims: DataFrame, total: int | Column, silent_share: float = 0.35) -> DataFrame:
    """Splits total over cells (behaviour, language, domain) with the shares k_share of the behaviour's kind,
    b_share of the behaviour within it, l_share and d_share.

    Each level rounds half to even, the remainder of a cell goes to male, and of back-channels with two
    or more a share is silent. Cells without scenarios are left out.
    """
    n = half_even(F.lit(total).cast("double") * F.col("k_share"))
    for share in ("b_share", "l_share", "d_share"):
        n = half_even(n * F.col(share))
    cells = dims.withColumn("n", n)
    half = F.floor(F.col("n") / 2)
    by_gender = cells.withColumn("g", F.explode(F.array(
        F.struct(F.lit("female").alias("gender"), half.alias("count")), F.struct(F.lit("male").alias("gender"), (F.col("n") - half).alias("count")))))
    by_gender = by_gender.select("behaviour", "language", "domain", "g.gender", "g.count")
    silent = F.when((F.col("behaviour") == "backchannel") & (F.col("count") >= 2), half_even(F.col("count") * silent_share)).otherwise(F.lit(0))
    parts = by_gender.withColumn("p", F.explode(F.array(
        F.struct(F.lit(False).alias("force_silence"), (F.col("count") - silent).alias("n")), F.struct(F.lit(True).alias("force_silence"), silent.alias("n")))))
    return parts.select("behaviour", "language", "domain", "gender", F.col("p.force_silence").alias("force_silence"), F.col("p.n").cast("long").alias("count")).where("count > 0")


def job_key(plan: DataFrame) -> Column:
    silent = plan["force_silence"].cast("int").cast("string")
    return F.concat_ws("|", plan["behaviour"], plan["language"], plan["domain"], plan["gender"], silent)


def partition_plan(plan: DataFrame, parts: int) -> DataFrame:
    """Adds the job's key and its part, the key's MD5 modulo the number of parts."""
    keyed = plan.withColumn("job_key", job_key(plan))
    return keyed.withColumn("part", md5_mod(F.col("job_key"), parts))


def plan_summary(plan: DataFrame) -> DataFrame:
    """(kind, name, n): marginals, total and silent back-channels, by one pass over grouping sets."""
    sets = plan.groupingSets([["behaviour"], ["language"], ["gender"], []], "behaviour", "language", "gender").agg(
        F.sum("count").alias("n"), F.sum(F.when(F.col("force_silence"), F.col("count")).otherwise(0)).alias("silent"), F.grouping_id().alias("g"))
    kind = F.when(F.col("g") == 3, "behaviour").when(F.col("g") == 5, "language").when(F.col("g") == 6, "gender").otherwise("total")
    name = F.coalesce("behaviour", "language", "gender", F.lit("all"))
    return sets.select(kind.alias("kind"), name.alias("name"), F.col("n").cast("long").alias("n"), F.col("silent").cast("long").alias("silent"))


def largest_remainder(weights: DataFrame, total: int, key: str = "name", weight: str = "weight") -> DataFrame:
    """Adds quota: the floor of each share of the total, and one more for the largest fractions, ties by key.

    No more than the weights' sum is shared out, so no whole-numbered weight is exceeded; without weights all
    quotas are 0.
    """
    every = Window.partitionBy()
    whole = F.sum(weight).over(every)
    shared = F.least(F.lit(total), whole)
    exact = F.coalesce(F.try_divide(F.col(weight) * shared, whole), F.lit(0.0))
    floors = weights.withColumn("exact", exact).withColumn("floor", F.floor("exact")).withColumn("shared", F.greatest(F.lit(0), shared))
    rank = F.row_number().over(Window.orderBy(F.desc(F.round(F.col("exact") - F.col("floor"), 9)), key))
    rest = F.col("shared") - F.sum("floor").over(every)
    return floors.withColumn("rank", rank).withColumn("quota", (F.col("floor") + (F.col("rank") <= rest).cast("int")).cast("long")).drop("exact", "floor", "rank", "shared")


def normalised(df: DataFrame, value: str) -> DataFrame:
    """Adds share, the value's part of the total; a total of 0 counts as 1."""
    total = F.sum(value).over(Window.partitionBy())
    return df.withColumn("share", ratio(F.col(value), F.when(total == 0, 1).otherwise(total)))


def deterministic_id(*parts: Column) -> Column:
    """The first 16 hex digits of the MD5 of the parts, joined by |."""
    return F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 16)


def index_spans(jobs: DataFrame, order: str, count: str) -> DataFrame:
    """Adds [start_index, end_index) of each job in the running sum of counts.

    For plans, which have one row a cell; the order is global.
    """
    upto = F.sum(count).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return jobs.withColumn("end_index", upto.cast("long")).withColumn("start_index", (F.col("end_index") - F.col(count)).cast("long"))


def spans_in_range(spans: DataFrame, low: int, high: int) -> DataFrame:
    """The parts of spans within [low, high)."""
    cut = spans.withColumn("lo", F.greatest("start_index", F.lit(low))).withColumn("hi", F.least("end_index", F.lit(high)))
    return cut.where("hi > lo")


def warmup_cosine(step: Column, warmup: int | Column, total: int | Column) -> Column:
    """Linear up to warmup, then half a cosine down to 0 at total."""
    warmup, total = F.lit(warmup), F.lit(total)
    progress = F.least(F.lit(1.0), (step - warmup) / F.greatest(F.lit(1), total - warmup).cast("double"))
    return F.when(step < warmup, step / F.greatest(F.lit(1), warmup).cast("double")).otherwise(0.5 * (1 + F.cos(F.lit(3.141592653589793) * progress)))


def random_split(df: DataFrame, key: str, seed: str, train: float, validation: float) -> DataFrame:
    """Adds split by the rank of the seeded MD5 of key: exact fractions, the same at each run.

    Ranks come from counts of 4096 hash buckets and the rank within a bucket, so no task orders all rows.
    """
    digest = F.md5(F.concat(F.lit(seed + "|"), F.col(key).cast("string")).cast("binary"))
    hashed = df.withColumn("h", digest).withColumn("bucket", F.substring("h", 1, 3))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = hashed.groupBy("bucket").count()
    starts = counts.select("bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"), F.sum("count").over(Window.partitionBy()).alias("n"))
    inner = F.row_number().over(Window.partitionBy("bucket").orderBy("h", key))
    ranked = hashed.withColumn("inner", inner).join(F.broadcast(starts), "bucket").withColumn("place", F.col("start") + F.col("inner") - 1)
    first, second = F.floor(F.col("n") * train), F.floor(F.col("n") * validation)
    split = F.when(F.col("place") < first, "train").when(F.col("place") < first + second, "val").otherwise("test")
    return ranked.withColumn("split", split).drop("h", "bucket", "inner", "start", "n", "place")


def prompt() -> Column:
    """What a plan's row asks of a writer."""
    end = F.when(F.col("force_silence"), "; the right answer is silence.").otherwise(".")
    return F.format_string("Write %d %s dialogues in %s for %s, caller %s%s", "count", "behaviour", "language", "domain", "gender", end)
