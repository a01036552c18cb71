"""Speech tracks from frame energy: hysteresis, then short gaps and short bursts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ON, OFF, LEAST_GAP, LEAST_RUN = 0.45, 0.30, 3, 2


def hysteresis(energy: DataFrame, clip: str = "clip", frame: str = "frame", value: str = "e", on: float = ON, off: float = OFF) -> DataFrame:
    """Adds speaking (0/1). A clip's range goes from its 5th to its 95th percentile; a range under 1 is all
    speech. Speech starts above on and lasts until off is reached.

    As off lies below on, a frame's own energy decides unless it lies between: the last decision holds.
    """
    clips = energy.groupBy(clip).agg(F.percentile(F.col(value).cast("double"), 0.05).alias("floor"), F.percentile(F.col(value).cast("double"), 0.95).alias("peak"))
    known = energy.join(clips, clip)
    span = F.col("peak") - F.col("floor")
    decided = F.when(F.col(value) > F.col("floor") + on * span, 1).when(F.col(value) <= F.col("floor") + off * span, 0)
    w = Window.partitionBy(clip).orderBy(frame).rowsBetween(Window.unboundedPreceding, 0)
    track = F.when(span < 1, 1).otherwise(F.coalesce(F.last(decided, ignorenulls=True).over(w), F.lit(0)))
    return known.withColumn("speaking", track).drop("floor", "peak")


def flipped_runs(track: DataFrame, clip: str, frame: str, value: str, of: int, least: int) -> DataFrame:
    """Turns runs of `of` that are shorter than least, those at the edges too."""
    order = Window.partitionBy(clip).orderBy(frame)
    change = F.coalesce((F.col(value) != F.lag(value).over(order)).cast("int"), F.lit(0))
    island = track.withColumn("_change", change).withColumn("_island", F.sum("_change").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    length = F.count(F.lit(1)).over(Window.partitionBy(clip, "_island"))
    return island.withColumn(value, F.when((F.col(value) == of) & (length < least), 1 - of).otherwise(F.col(value))).drop("_change", "_island")


def smoothed(track: DataFrame, clip: str = "clip", frame: str = "frame", value: str = "speaking") -> DataFrame:
    """Fills gaps under LEAST_GAP frames, then drops bursts under LEAST_RUN."""
    return flipped_runs(flipped_runs(track, clip, frame, value, 0, LEAST_GAP), clip, frame, value, 1, LEAST_RUN)


def _held(value: Column, body) -> Column:
    """body of a value that is worked out once, whatever lambdas it stands in."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _quantile(ordered: Column, share: float) -> Column:
    """As percentile() has it, of an array in order."""
    at = (F.size(ordered) - 1) * F.lit(share)
    low, high = F.floor(at).cast("int"), F.ceil(at).cast("int")
    a, b = F.get(ordered, low), F.get(ordered, high)
    return F.when(a == b, a).otherwise((high - at) * a + (at - low) * b)


def heard_track(energy: Column, on: float = ON, off: float = OFF, least_gap: int = LEAST_GAP, least_run: int = LEAST_RUN) -> Column:
    """hysteresis() and smoothed() of a clip's energy as one array in the order of frames: an array of 0 and 1.

    Frames are a text of a sign each, which is worked on run by run: linear in the frames, and none is shuffled.
    """
    values = F.transform(energy, lambda x: x.cast("double"))

    def signs(v: Column, bounds: Column) -> Column:
        floor, span = bounds["floor"], bounds["peak"] - bounds["floor"]
        sign = lambda x: F.when(span < 1, "1").when(x > floor + on * span, "1").when(x <= floor + off * span, "0").otherwise("?")
        return F.array_join(F.transform(v, sign), "")

    def bounds(v: Column) -> Column:
        ordered = F.array_sort(F.filter(v, lambda x: x.isNotNull()))
        return _held(ordered, lambda o: F.struct(_quantile(o, 0.05).alias("floor"), _quantile(o, 0.95).alias("peak")))

    text = _held(values, lambda v: _held(bounds(v), lambda b: signs(v, b)))
    text = F.translate(F.regexp_replace(text, r"(?:(?<=1)|(?<!^)\G)\?", "1"), "?", "0")  # the last decision holds, at first 0
    for of, to, least in (("0", "1", least_gap), ("1", "0", least_run)):
        for n in range(1, least):
            text = F.regexp_replace(text, f"(?<!{of}){of * n}(?!{of})", to * n)
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: c.cast("int"))


def frame_energy(samples: DataFrame, clip: str = "clip", place: str = "i", value: str = "x", block: int = 1920) -> DataFrame:
    """(clip, frame, energy): log root mean square of each block of samples; a short block counts as filled up with 0."""
    frames = samples.groupBy(clip, F.floor(F.col(place) / block).cast("int").alias("frame")).agg((F.sum(F.col(value) * F.col(value)) / block).alias("power"))
    return frames.select(clip, "frame", F.log(F.sqrt(F.col("power") + 1e-9) + 1e-6).alias("energy"))
