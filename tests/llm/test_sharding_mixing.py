"""Sharding and mixing against brute force, and their defined results."""

import hashlib
import itertools

import pytest
from pyspark.sql import functions as F

from turnlake.llm import queries as Q
from turnlake.llm.mixing import pareto_mix, source_targets, word_count
from turnlake.llm.sharding import minimax_shards

SCHEMA = "doc_id long, text string, source string, shard string, rank int"
ROWS = [
    (1, "aaaa bb", "a", "x", 1), (2, "aaaa bb", "b", "x", 1), (3, None, None, "x", 1), (4, "", "a", None, 1), (5, "ß é", "b", "x", 1), (6, "w " * 200, "c", "x", 1),
    (6, "w " * 200, "c", "x", 1), (None, "one two", "a", "x", 1), (8, "   ", None, "x", 1), (9, "three words here", "b", "x", None),
]


def smallest(sizes, shards):
    """The smallest largest shard of all contiguous cuts, by trying them all."""
    best = sum(sizes)
    for cuts in itertools.combinations_with_replacement(range(len(sizes) + 1), shards - 1):
        ends = [0, *cuts, len(sizes)]
        best = min(best, max(sum(sizes[a:b]) for a, b in zip(ends, ends[1:])))
    return best


def test_shards(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    found = minimax_shards(docs, 3).collect()
    assert len(found) == len(ROWS) and set(found[0].asDict()) == {"doc_id", "text", "source", "rank", "shard", "slot"}
    size = lambda t: len((t or "").encode()) + 1
    groups, shard_of = {}, {}
    for r in found:
        key = hashlib.sha256((r.text or "").encode()).digest()
        groups[key] = groups.get(key, 0) + size(r.text)
        assert shard_of.setdefault(key, r.shard) == r.shard
    largest = max(sum(size(r.text) for r in found if r.shard == k) for k in range(3))
    assert largest == smallest([groups[k] for k in sorted(groups)], 3)
    for k in range(3):
        assert sorted(r.slot for r in found if r.shard == k) == list(range(sum(r.shard == k for r in found)))


@pytest.mark.parametrize("shards", [1, 2, 5, 40])
def test_shards_of_many(spark, shards):
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") * 37 % 23).cast("int")).alias("text"))
    found = minimax_shards(docs, shards).groupBy("shard").agg(F.sum(F.length("text") + 1).alias("n")).collect()
    groups = {}
    for i in range(60):
        t = "x" * (i * 37 % 23)
        groups[hashlib.sha256(t.encode()).digest()] = groups.get(hashlib.sha256(t.encode()).digest(), 0) + len(t) + 1
    sizes = [groups[k] for k in sorted(groups)]
    if shards <= 2:
        assert max(r.n for r in found) == smallest(sizes, shards)
    assert max(r.n for r in found) >= max(sizes) and sum(r.n for r in found) == sum(sizes) and len(found) <= shards


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert minimax_shards(none, 8).count() == 0 and pareto_mix(none, word_count(F.col("text"))).count() == 0


def filled(sizes, weights, most=3.0):
    """Targets by sharing again and again what the caps leave over."""
    total, capped = sum(sizes), [False] * len(sizes)
    while True:
        rest = total - sum(most * s for s, c in zip(sizes, capped) if c)
        w = sum(x for x, c in zip(weights, capped) if not c)
        out = [most * s if c else (rest * x / w if w else 0.0) for s, x, c in zip(sizes, weights, capped)]
        over = [i for i, (o, s) in enumerate(zip(out, sizes)) if o > most * s * (1 + 1e-12) and not capped[i]]
        if not over:
            return out
        for i in over:
            capped[i] = True


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 1000, 1, 5, 900], [0, 7, 0, 100], [5], [3, 1, 1, 1, 1, 500]])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(chr(97 + i), s, 1) for i, s in enumerate(sizes)], "source string, source_size long, n long")
    found = {r.source: r.target for r in source_targets(df).collect()}
    want = filled(sizes, [i % 3 + 1 for i in range(len(sizes))])
    assert [found[chr(97 + i)] for i in range(len(sizes))] == pytest.approx(want)


def test_mix(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    found = pareto_mix(docs, word_count(F.col("text"))).collect()
    assert len(found) == len(ROWS) and all(0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size for r in found)
    assert {r.source_size for r in found if r.source is None} == {0}
    again = pareto_mix(docs.repartition(3), word_count(F.col("text"))).collect()
    assert sorted(map(repr, found)) == sorted(map(repr, again))


def test_mix_of_a_hot_source(spark):
    docs = spark.range(6000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("source"),
        (F.col("id") * 7919 % 50).alias("words"), F.lit(1).alias("target"), F.lit(2).alias("mean"))
    mixed = pareto_mix(docs, F.col("words"))
    assert mixed.columns == ["doc_id", "source", "words", "mean", "size", "source_size", "target", "copies", "taken"]
    for r in mixed.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r.taken - r.target) <= 50


def test_queries_are_registered():
    names = list(Q.queries())
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 14)]
