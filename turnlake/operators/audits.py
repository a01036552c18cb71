"""Coverage of flags, what is short, and what to generate next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import ratio, word_count
from ..functions.vocab import FLAGS, WORDS_PER_SECOND

#: Behaviours that produce a flag, the main one first (fixed values); weights go 2 : 1 : 1.
PRODUCERS = {
    "TURN_END": ["endpoint_end", "correction", "prefetch"], "BARGE_SOFT": ["overlap_coop", "overlap_comp"], "BARGE_HARD": ["barge_real"],
    "PREFETCH_LLM": ["prefetch", "endpoint_end"], "COMMIT_LLM": ["endpoint_end", "correction"], "CANCEL_LLM": ["correction", "barge_real"], "SILENCE_BREAK": ["silence_break"],
}


def coverage(frames: DataFrame, clip: str = "clip", flag: str = "flag") -> DataFrame:
    """(flag, frames, share, clips) of every flag; clips are counted distinct by summing up each clip first."""
    by_clip = frames.groupBy(flag, clip).agg(F.count(F.lit(1)).alias("n"))
    found = by_clip.groupBy(flag).agg(F.sum("n").alias("frames"), F.count(F.lit(1)).alias("clips"))
    every = frames.sparkSession.range(len(FLAGS)).select(F.col("id").cast("int").alias(flag)).join(found, flag, "left").fillna(0, ["frames", "clips"])
    return every.withColumn("share", ratio(F.col("frames"), F.sum("frames").over(Window.partitionBy())))


def deficits(covered: DataFrame, least_clips: int, names: list[str] = FLAGS) -> DataFrame:
    """(flag, name, short): flags with fewer clips than wanted."""
    name = F.element_at(F.array(*map(F.lit, names)), F.col("flag") + 1)
    return covered.select("flag", name.alias("name"), (F.lit(least_clips) - F.col("clips")).alias("short")).where("short > 0")


def producer_table(spark) -> DataFrame:
    rows = ", ".join(f"('{f}', '{b}', {2 if i == 0 else 1})" for f, bs in PRODUCERS.items() for i, b in enumerate(bs))
    return spark.sql(f"SELECT * FROM (VALUES {rows}) AS t(name, behaviour, weight)")


def behaviour_shares(short: DataFrame) -> DataFrame:
    """(behaviour, share): each flag's deficit split over its producers by weight, as parts of the whole."""
    bridge = producer_table(short.sparkSession)
    per_flag = bridge.withColumn("part", F.col("weight") / F.sum("weight").over(Window.partitionBy("name")))
    needed = short.join(F.broadcast(per_flag), "name").groupBy("behaviour").agg(F.sum(F.col("short") * F.col("part")).alias("need"))
    return needed.select("behaviour", F.round(ratio(F.col("need"), F.sum("need").over(Window.partitionBy())), 4).alias("share"))


def top_producers(frames: DataFrame, flag: str, behaviour: str, k: int = 2) -> DataFrame:
    """The k behaviours with most frames of each flag, ties by name."""
    counts = frames.groupBy(flag, behaviour).agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy(flag).orderBy(F.desc("n"), behaviour))
    return counts.withColumn("place", place).where(F.col("place") <= k)


def quota_filled(clips: DataFrame, group: list[str], order: str, amount: str, quota: float, buckets: int = 1024, span: int = 1) -> DataFrame:
    """Clips of each group in order, until the amounts before a clip reach the quota; the crossing one is kept.

    Sums by blocks of the order come first, so a large group is never summed in one task.
    """
    blocks = clips.withColumn("_block", F.floor(F.col(order) / span))
    before = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.groupBy(*group, "_block").agg(F.sum(amount).alias("_total")).withColumn("_start", F.coalesce(F.sum("_total").over(before), F.lit(0.0))).drop("_total")
    open_ = starts.where(F.col("_start") < quota)
    inner = Window.partitionBy(*group, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return blocks.join(open_, [*group, "_block"]).withColumn("_sum", F.col("_start") + F.coalesce(F.sum(amount).over(inner), F.lit(0.0))).where(F.col("_sum") < quota).drop("_block", "_start", "_sum")


def manifest_stats(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("clips"), F.round(F.sum("duration_s") / 3600, 6).alias("hours"), F.count_if(F.lower("gender").startswith("f")).alias("female"), F.count_if(F.lower("gender").startswith("m")).alias("male"))


def speaking_rates(frames: DataFrame, clip: str, value: str) -> DataFrame:
    """One row: the rate over all frames, and the percentiles of clips' rates."""
    clips = frames.groupBy(clip).agg(F.sum(value).alias("on"), F.count(F.lit(1)).alias("n"))
    return clips.agg(F.round(ratio(F.sum("on"), F.sum("n")), 6).alias("rate"), *[F.round(F.percentile(F.col("on") / F.col("n"), p), 6).alias(f"p{int(100 * p)}") for p in (0.1, 0.5, 0.9)])


def verdict(rate, events, total):
    """What a corpus' label rates tell."""
    return F.when((rate < 0.02) | (rate > 0.98), "degenerate").when(events == 0, "missing").when((events < 500) | (events / total < 0.005), "rare").otherwise("fine")


def topup_hours(short: DataFrame, seconds_a_clip: float = 22.0, least: float = 0.1) -> DataFrame:
    """One row: hours to generate so that the largest deficit goes, least at least."""
    return short.agg(F.round(F.greatest(F.lit(least), F.coalesce(F.max("short"), F.lit(0)) * seconds_a_clip / 3600), 6).alias("hours"))


def rendered_hours(scenarios: DataFrame, sidecars: DataFrame, key: str = "scenario_id") -> DataFrame:
    """(band, n, rendered, real_s, projected_s), and all bands under total: seconds of the clips that have a sidecar with a
    duration above 0, and those with the others' seconds guessed by their words, one at least. A clip without a band is short."""
    seconds = sidecars.where("duration_s > 0").groupBy(key).agg(F.max("duration_s").alias("real"))
    rows = scenarios.select(key, F.coalesce(F.nullif("length_band", F.lit("")), F.lit("short")).alias("band"), word_count(F.col("user_text")).alias("words")).join(seconds, key, "left")
    guessed = F.greatest(F.lit(1), F.col("words")) / F.lit(WORDS_PER_SECOND)
    return rows.rollup("band").agg(
        F.count(F.lit(1)).alias("n"), F.count("real").alias("rendered"), F.round(F.coalesce(F.sum("real"), F.lit(0.0)), 4).alias("real_s"),
        F.round(F.sum(F.coalesce("real", guessed)), 4).alias("projected_s")).withColumn("band", F.coalesce("band", F.lit("total")))


def hash_sample(rows: DataFrame, key: str, n: int) -> DataFrame:
    """n rows in the order of their key's MD5: a sample that is the same at each run."""
    return rows.orderBy(F.md5(F.col(key).cast("string").cast("binary")), key).limit(n)


def speaking_rate_sample(clips: DataFrame, key: str, track: str, n: int = 400) -> DataFrame:
    """One row: the mean of the clips' mean speaking rates over n clips, chosen by hash; clips without frames don't count."""
    chosen = hash_sample(clips.where(F.size(track) > 0), key, n)
    rate = F.aggregate(F.col(track), F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(track)
    return chosen.agg(F.avg(rate).alias("rate"), F.count(F.lit(1)).alias("clips"))


def corpus_report(frames: DataFrame, clip: str = "clip", flag: str = "flag", spoken: str = "spoken", least_clips: int = 2000, names: list[str] = FLAGS, frames_an_hour: int = 45_000) -> DataFrame:
    """One row, one column report: the corpus as one JSON text, with counts by flag, behaviour and language as maps.

    frames has a row a frame, with the clip's behaviour and language. Frames are counted by clip and flag first; all
    counts come from one grouping of these rows, so that the frames are read once.
    """
    by_flag = frames.groupBy(clip, "behaviour", "language", flag).agg(F.count(F.lit(1)).alias("n"), F.bool_or(spoken).alias("said"))
    by_clip = by_flag.groupBy(clip, "behaviour", "language").agg(F.sort_array(F.collect_list(F.struct(flag, "n"))).alias("flags"), F.bool_or("said").alias("said"))
    rows = by_clip.select("behaviour", "language", "said", F.posexplode("flags").alias("k", "of")).select(
        "behaviour", "language", "said", F.col(f"of.{flag}").alias("flag"), F.col("of.n").alias("n"), (F.col("k") == 0).cast("int").alias("first"))
    sets = rows.groupingSets([[], ["flag"], ["behaviour"], ["language"]], "flag", "behaviour", "language").agg(
        F.grouping_id().alias("set"), F.sum("n").alias("frames"), F.count(F.lit(1)).alias("with_flag"), F.sum("first").alias("clips"), F.sum(F.col("first") * F.col("said").cast("int")).alias("said"))
    whole, by = 7, {"flag": 3, "behaviour": 5, "language": 6}
    name = F.element_at(F.array(*map(F.lit, names)), F.col("flag") + 1)

    def folded(of: str, key: Column, value: Column) -> Column:
        pairs = F.array_sort(F.collect_list(F.when((F.col("set") == by[of]) & key.isNotNull() & value.isNotNull(), F.struct(key.alias("key"), value.alias("value")))))
        return F.map_from_entries(pairs)

    total = lambda c: F.max(F.when(F.col("set") == whole, F.col(c)))
    one = sets.agg(
        total("clips").alias("clips"), total("frames").alias("frames"), F.round(total("frames") / frames_an_hour, 2).alias("hours"),
        folded("flag", name, F.col("frames")).alias("frame_counts"), folded("flag", name, F.col("with_flag")).alias("clip_counts"),
        folded("behaviour", F.col("behaviour"), F.col("clips")).alias("by_behaviour"), folded("language", F.col("language"), F.col("clips")).alias("by_language"),
        total("said").alias("clips_with_spoken_text"))
    flags = F.array(*map(F.lit, names))
    short = F.filter(F.transform(flags, lambda f: F.struct(f.alias("key"), (F.lit(least_clips) - F.coalesce(F.try_element_at(F.col("clip_counts"), f), F.lit(0))).alias("value"))), lambda e: e["value"] > 0)
    return one.withColumn("min_clips_per_flag", F.lit(least_clips)).withColumn("deficits", F.map_from_entries(short)).select(F.to_json(F.struct("*")).alias("report"))
