"""Minimax contiguous sharding of atomic groups, with DataFrame operations only.

Rows with equal texts form an atomic group. Groups stand in the order of the SHA-256 of their text and
are cut into contiguous shards; the largest shard is as small as any such cut allows. The smallest
feasible capacity is found by binary search, each capacity checked greedily on running sums.

The sums are looked at in ever smaller ranges of hashes: at first all groups are summed by the head of
their hash, and the search goes as far as these sums decide it; only the ranges that a cut may fall in
are then summed again by a longer head. A group's place is its hash, so a shard is a range of hashes:
once the cuts are known, rows find their shard without a join, however many rows one group holds.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, fresh

#: Hex digits of the hash that groups are first summed by, and further ones in each closer look.
FIRST_DIGITS, MORE_DIGITS = 3, 2
#: Rows of a cell, about: what is numbered as a whole.
CELL_ROWS = 1 << 12


def text_size(text: Column) -> Column:
    """UTF-8 bytes of the text plus 1; a null text has no bytes."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def text_group(text: Column) -> Column:
    """SHA-256 of the text; a null text goes with the empty one."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


@dataclass
class Runs:
    """Consecutive runs of groups in hash order: of each the head that its hashes share, the sum of the sizes
    up to its end, its number of groups, its last hash, and its largest size."""

    heads: list[str]
    ends: list[int]
    counts: list[int]
    lasts: list[bytes]
    largest: int

    @property
    def total(self) -> int:
        return self.ends[-1] if self.ends else 0

    def reach(self, low: int, high: int) -> tuple[int, int, int | None]:
        """(least, greatest) end of the last group that ends at most at a position in [low, high], and the run
        that a closer look would have to part, if these differ or aren't group ends."""
        k = bisect.bisect_right(self.ends, low)
        least = self.ends[k - 1] if k else 0
        j = bisect.bisect_right(self.ends, high)
        if j < len(self.ends) and self.counts[j] > 1:
            return least, high, j
        return least, self.ends[j - 1] if j else 0, None


def summed(groups: DataFrame, digits: int, within: list[str] | None = None) -> list:
    """(head, size, n, last, largest) of the groups by the first digits of their hash, in their order."""
    hashed = groups.withColumn("hex", F.hex("grp"))
    if within is not None:
        hashed = hashed.where(F.substring("hex", 1, len(within[0])).isin(within))
    return sorted(hashed.groupBy(F.substring("hex", 1, digits).alias("head")).agg(
        F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"), F.max("grp").alias("last"), F.max("size").alias("largest")).collect())


def runs_of(rows: list) -> Runs:
    ends, at = [], 0
    for r in rows:
        at += r.size
        ends.append(at)
    return Runs([r["head"] for r in rows], ends, [r.n for r in rows], [bytes(r["last"]) for r in rows], max((r.largest for r in rows), default=0))


def parted(runs: Runs, chosen: list[int], rows: list) -> Runs:
    """runs with the chosen ones in parts."""
    by_head: dict[str, list] = {}
    for r in rows:
        by_head.setdefault(r["head"][:len(runs.heads[chosen[0]])], []).append(r)
    heads, ends, counts, lasts, at, which = [], [], [], [], 0, set(chosen)
    for k, head in enumerate(runs.heads):
        for part in by_head[head] if k in which else (None,):
            at = at + part.size if part else runs.ends[k]
            heads.append(part["head"] if part else head)
            ends.append(at)
            counts.append(part.n if part else runs.counts[k])
            lasts.append(bytes(part["last"]) if part else runs.lasts[k])
    return Runs(heads, ends, counts, lasts, runs.largest)


def chain(runs: Runs, capacity: int, shards: int) -> tuple[bool | None, list[tuple[int, int]], set[int]]:
    """(whether the capacity fits, null if the sums can't tell; the range that each greedy cut lies in; the
    runs that these ranges touch and that hold several groups)."""
    low = high = 0
    cuts, open_runs = [], set()
    for _ in range(shards):
        low, high, _ = runs.reach(low + capacity, high + capacity)
        cuts.append((low, high))
        if low < high or (low and runs.ends[bisect.bisect_left(runs.ends, low)] != low):
            a, b = bisect.bisect_right(runs.ends, low), bisect.bisect_left(runs.ends, high)
            open_runs.update(k for k in range(a, min(b, len(runs.ends) - 1) + 1) if runs.counts[k] > 1)
    fits = True if low >= runs.total else False if high < runs.total else None
    return fits, cuts, open_runs


def smallest_cuts(groups: DataFrame, shards: int, digits: int = FIRST_DIGITS, more: int = MORE_DIGITS) -> tuple[int, list[bytes]]:
    """The smallest capacity, and the last hash of each shard but the final one; groups (grp, size).

    What reaches the driver is one row for each of 16 ** digits heads, then 16 ** more for each run that
    a cut may fall in: numbers that don't grow with the groups.
    """
    runs = runs_of(summed(groups, digits))
    if not runs.total:
        return 0, []
    low = max(runs.largest, -(-runs.total // shards))  # no smaller capacity can do
    high = -(-runs.total // shards) + runs.largest  # greedy filling always fits this one
    while True:
        # the smallest capacity that surely fits, and the smallest that isn't surely too small
        a, b = low, high
        while a < b:
            mid = (a + b) // 2
            if chain(runs, mid, shards)[0] is True:
                b = mid
            else:
                a = mid + 1
        high = a
        a, b = low, high
        while a < b:
            mid = (a + b) // 2
            if chain(runs, mid, shards)[0] is False:
                a = mid + 1
            else:
                b = mid
        low = a
        _, cuts, open_runs = chain(runs, high, shards)
        if low == high and not open_runs:
            break
        # a smaller capacity cuts no later: what lies between the cuts of both ends is looked at
        for (first, _), (_, last) in zip(chain(runs, low, shards)[1], cuts):
            a, b = bisect.bisect_right(runs.ends, first), bisect.bisect_left(runs.ends, last)
            open_runs.update(k for k in range(a, min(b, len(runs.ends) - 1) + 1) if runs.counts[k] > 1)
        if not open_runs:  # all runs in question are single groups: the two searches above are exact
            break
        shortest = min(len(runs.heads[k]) for k in open_runs)
        chosen = sorted(k for k in open_runs if len(runs.heads[k]) == shortest)
        runs = parted(runs, chosen, summed(groups, shortest + more, [runs.heads[k] for k in chosen]))
    lasts = dict(zip(runs.ends, runs.lasts))
    return high, [lasts[end] for end, _ in chain(runs, high, shards)[1][:shards - 1]]


def minimax_shards(
    docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", group_col: str | None = None, size_col: str | None = None,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """Adds shard and slot to the rows of docs; equal texts share a shard.

    group_col and size_col name columns that already hold text_group and text_size of the text; text_col
    isn't read then, and needn't be there. slot numbers the rows of a shard from 0 without gaps, in the
    order of (cell, id, text's hash), a cell being the rows of a shard whose hashed ids and texts agree;
    their number grows with the rows, and they are numbered apart, so that no task holds a shard.

    Defined results: null texts go with empty ones, null ids are ordinary rows, repeated rows take one
    slot each, texts of any length are one group each, more shards than groups leave shards empty, an
    empty table gives an empty one. Columns of docs that are called shard or slot are replaced; any
    others are kept as they are.
    """
    spark = docs.sparkSession
    docs = docs.drop("shard", "slot")
    grp, cell, first, number = (fresh(docs.columns, x) for x in ("grp", "cell", "first_slot", "cell_rows"))
    group = text_group(F.col(text_col)) if group_col is None else F.col(group_col)
    size = text_size(F.col(text_col)) if size_col is None else F.col(size_col)
    scratch = Scratch(spark, "sharding")
    narrow = scratch.table(docs.select(group.alias(grp), F.col(id_col), size.alias(number)))
    groups = scratch.table(narrow.groupBy(F.col(grp).alias("grp")).agg(F.sum(number).alias("size"), F.count(F.lit(1)).alias("n")))
    _, ends = smallest_cuts(groups, shards)
    cells = max(1, -(-(groups.agg(F.sum("n")).first()[0] or 0) // (cell_rows * shards)))

    def shard_of(g: Column) -> Column:
        return sum(((g > F.lit(e)).cast("int") for e in ends), F.lit(0)).cast("int")

    placed = (
        docs.withColumn(grp, group).withColumn("shard", shard_of(F.col(grp)))
        .withColumn(cell, F.pmod(F.xxhash64(F.col(id_col), F.col(grp)), F.lit(cells)))
    )
    before = Window.partitionBy("shard").orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        narrow.groupBy(shard_of(F.col(grp)).alias("shard"), F.pmod(F.xxhash64(F.col(id_col), F.col(grp)), F.lit(cells)).alias(cell)).agg(F.count(F.lit(1)).alias(number))
        .select("shard", cell, F.coalesce(F.sum(number).over(before), F.lit(0)).alias(first))
    )
    # One row a cell, CELL_ROWS times fewer than rows: Spark broadcasts them while they are small, by its own limit.
    rank = F.row_number().over(Window.partitionBy("shard", cell).orderBy(F.col(id_col), F.col(grp)))
    out = placed.join(starts, ["shard", cell]).withColumn("slot", (F.col(first) + rank - 1).cast("long"))
    return out.select(*docs.columns, "shard", "slot")
