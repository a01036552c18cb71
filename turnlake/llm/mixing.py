"""Mixing sources to target weights by Pareto order sampling, with DataFrame operations only.

Each source gets a target in words. A document is first given as many certain whole copies as the
target holds its source; one further copy of some documents fills the rest. These are chosen by Pareto
order sampling: documents are ranked by q = (u / (1 - u)) / (p / (1 - p)), with a random u and an
inclusion probability p of their own, and the first ones are taken until their words come nearest to
what is missing. p is min(1, factor * (0.5 + 0.5 size / mean size)), with the source's factor solved so that
p times size sums up to what is missing; documents whose p reaches 1 are certain and taken first.

A source may hold most of the rows: its ranking isn't sorted as a whole. Words are summed by bucket of
q (the certain ones apart), the bucket in which the sum crosses the rest is found on one row a source and
bucket, and only this bucket is ordered row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, fresh

SEED = "pareto-1"
BUCKETS = 4096


def word_count(text: Column) -> Column:
    """Number of runs of characters outside [\\x20\\x09-\\x0D]; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(doc_id: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) that only the id and the seed decide."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":" + seed)).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, most: float = 3.0) -> DataFrame:
    """sizes: (source, source_size, n); adds target by filling up in proportion to weight below the caps.

    One row a source. With sources in the order of cap / weight, those before the first uncapped one
    take their cap, the others share the rest by weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("double")).withColumn("cap", most * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    level = (
        F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    ) / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    filled = weighed.withColumn("level", level)
    reached = F.min(F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(everything)
    filled = filled.withColumn("level", F.coalesce(reached["level"], F.lit(float("inf"))))
    return filled.withColumn("target", F.least("cap", F.col("level") * F.col("weight"))).select("source", "source_size", "n", "target")


def inclusion_factors(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """(f_source, factor): with rows (source, size) and goals (source, missing, mean), the factor for which the p of a
    source's rows, times their sizes, sum up to what it misses.

    With sizes from the largest down, those before the first whose p stays within 1 are certain. Sums are of whole
    numbers, over one row a source and size.
    """
    sizes = rows.where("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    words, squares = F.col("size") * F.col("n"), F.col("size").cast("decimal(38,0)") * F.col("size") * F.col("n")
    larger = Window.partitionBy("source").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("decimal(38,0)")
    every = Window.partitionBy("source")
    summed = sizes.select(
        "source", "size", F.coalesce(F.sum(words).over(larger), F.lit(0)).alias("certain"), F.sum(words).over(every).alias("all"),
        F.coalesce(F.sum(squares.cast("decimal(28,0)")).over(larger), none).alias("certain_2"), F.sum(squares.cast("decimal(28,0)")).over(every).alias("all_2"))
    joined = summed.join(goals.select(F.col("source").alias("f_source"), "missing", "mean"), F.col("source").eqNullSafe(F.col("f_source")))
    rest = 0.5 * (F.col("all") - F.col("certain")) + 0.5 * (F.col("all_2") - F.col("certain_2")).cast("double") / F.col("mean")
    tried = joined.withColumn("factor", (F.col("missing") - F.col("certain")) / rest)
    within = tried.where(F.col("factor") * (0.5 + 0.5 * F.col("size") / F.col("mean")) <= 1.0)
    return within.groupBy("f_source").agg(F.max_by("factor", "size").alias("factor"))


def _certain(size: Column, factor: Column, mean: Column) -> Column:
    return factor * (0.5 + 0.5 * size / mean) >= 1.0


def _rank(size: Column, doc_id: Column, factor: Column, mean: Column) -> Column:
    """q / (1 + q), in [0, 1]: ranks as q does."""
    odds = F.greatest(factor, F.lit(1.0 / (1 << 20)))  # away from 0, where a source misses nothing and no rank is taken
    p = F.least(F.lit(1.0), odds * (0.5 + 0.5 * size / mean))
    u = uniform(doc_id)
    q = F.when(p >= 1.0, 0.0).otherwise((u / (1.0 - u)) / (p / (1.0 - p)))
    return q / (1.0 + q)


def pareto_mix(
    docs: DataFrame, size: Column, id_col: str = "doc_id", source_col: str = "source",
    most: float = 3.0, buckets: int = BUCKETS,
) -> DataFrame:
    """Adds size, source_size, target, copies and taken (size times copies) to the rows of docs.

    Half of a document's inclusion odds is even and half goes by its size. Results depend on ids,
    sizes and sources alone, so reruns agree.

    Defined results: a null source is a source of its own and comes last; a null size is 0; documents
    of size 0 take 0 words; rows that repeat an id share its random number and are taken or left
    together, whatever their sizes; an empty table gives an empty one. Columns of docs that are called as the added ones are
    replaced, other columns are kept.
    """
    added = ["size", "source_size", "target", "copies", "taken"]
    kept = [c for c in docs.columns if c not in added]
    clash = fresh(docs.columns, "own_size")
    sized = docs.withColumn(clash, F.coalesce(size, F.lit(0)).cast("long")).drop(*added).withColumnRenamed(clash, "size")
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = scratch.table(sized.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), "size"))

    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # Tables of one row a source: Spark broadcasts them while their files are small, by its own limit.
    goals = (
        source_targets(per_source, most)
        .withColumn("whole", F.floor(ratio).cast("long"))
        .withColumn("missing", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
        .withColumn("mean", F.greatest(F.lit(1.0), F.col("source_size") / F.col("n")))
    )
    goals = scratch.table(goals)
    factors = inclusion_factors(rows, goals)
    goals = scratch.table(goals.join(factors, goals["source"].eqNullSafe(factors["f_source"]), "left").drop("f_source").withColumn("factor", F.coalesce("factor", F.lit(0.0))))

    def bucket_of(rank: Column, certain: Column) -> Column:
        """Certain rows are in no bucket that may be cut."""
        return F.when(certain, -1).otherwise(F.least(F.floor(rank * buckets), F.lit(buckets - 1))).cast("int")

    ranked = (
        rows.join(goals.withColumnRenamed("source", "g_source"), F.col("source").eqNullSafe(F.col("g_source")))
        .withColumn("rank", _rank(F.col("size"), F.col("id"), F.col("factor"), F.col("mean")))
        .select("id", "source", "size", "missing", "rank", bucket_of(F.col("rank"), _certain(F.col("size"), F.col("factor"), F.col("mean"))).alias("bucket"))
    )
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    crossing = (
        ranked.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.first("missing").alias("missing"))
        .withColumn("before", F.sum("words").over(upto) - F.col("words"))
        .where((F.col("bucket") >= 0) & (F.col("before") < F.col("missing")) & (F.col("before") + F.col("words") >= F.col("missing")))
        .select(F.col("source").alias("c_source"), F.col("bucket").alias("c_bucket"), "before")
    )
    c = scratch.table(crossing)  # one row a source at most
    inside = ranked.join(c, ranked["source"].eqNullSafe(c["c_source"]) & (ranked["bucket"] == c["c_bucket"]))
    # Rows of equal rank and id are taken or left together.
    steps = Window.partitionBy("source").orderBy("rank", "id").rangeBetween(Window.unboundedPreceding, 0)
    off = F.abs(F.col("before") + F.sum("size").over(steps) - F.col("missing"))
    last = (
        inside.withColumn("off", off)
        .groupBy("source", "c_bucket").agg(F.min(F.struct("off", "rank", "id")).alias("best"), F.first(F.col("missing") - F.col("before")).alias("none_off"))
        .select(F.col("source").alias("l_source"), "c_bucket", F.when(F.col("best.off") < F.col("none_off"), F.struct("best.rank", "best.id")).alias("last"))
    )
    of = fresh([*sized.columns, *added], "cut_of_source")
    cuts = goals.join(last, goals["source"].eqNullSafe(last["l_source"]), "left")
    cuts = scratch.table(cuts.select(F.struct("source", "source_size", "target", "whole", "mean", "factor", "c_bucket", "last").alias(of)))

    g = F.col(of)
    out = sized.join(cuts, F.col(source_col).eqNullSafe(g["source"]))
    rank = _rank(F.col("size"), F.col(id_col), g["factor"], g["mean"])
    certain = _certain(F.col("size"), g["factor"], g["mean"])
    at, place = bucket_of(rank, certain), F.struct(rank.alias("rank"), F.col(id_col).alias("id"))
    chosen = certain | F.coalesce((at < g["c_bucket"]) | ((at == g["c_bucket"]) & (place <= g["last"])), F.lit(False))
    copies = g["whole"] + chosen.cast("int")
    return out.select(*kept, "size", g["source_size"].alias("source_size"), g["target"].alias("target"), copies.alias("copies"), (copies * F.col("size")).alias("taken"))
