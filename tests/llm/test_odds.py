"""Odds: of toxicity at any size of the sample, and of inclusion in the mix."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnlake.llm.mixing import _certain, inclusion_factors, pareto_mix
from turnlake.llm.toxicity import fit_logistic, learn_lexicon


def test_a_row_of_weight_ten_counts_as_ten():
    rng = np.random.default_rng(1)
    x, y = np.concatenate([rng.normal(0, 1, 200), rng.normal(2, 1, 40)]), np.array([0.0] * 200 + [1.0] * 40)
    many = np.where(y == 0, 10, 1)
    assert np.allclose(fit_logistic(x, y, many.astype(float)), fit_logistic(np.repeat(x, many), np.repeat(y, many)))
    assert np.allclose(fit_logistic(x, y), fit_logistic(x, y, np.ones(240)))


@pytest.mark.parametrize("toxic, clean, odd", [(2.6, 23, 3), (260, 2300, 3), (1, 3, 0), (26, 230, 40)])
def test_fit_ends_where_few_rows_overlap(toxic, clean, odd):
    """Rows that are told apart but for a few: the fit ends, at the least loss, and finds the toxic ones."""
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.uniform(6.2, 9, 4000), np.zeros(4000 - odd), rng.uniform(3, 6.1, odd)])
    y = np.repeat([1.0, 0.0], 4000)
    weights = np.repeat([float(toxic), float(clean)], 4000)
    slope, bias = fit_logistic(x, y, weights)
    assert np.allclose(fit_logistic(x, y, weights, 201), (slope, bias))
    score = 1 / (1 + np.exp(-(slope * x + bias)))
    assert abs(weights @ (score - y) + 0.02 * bias) < 1e-3 * weights.sum() and slope > 0
    assert np.mean(score[:4000] >= 0.7) > 0.95 and np.mean(score[4000:] >= 0.7) < 0.01


def test_odds_are_those_of_all_labels(spark):
    """A sample of fewer clean rows than there are gives nearly the bias of all of them."""
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["idiotic", "stupidly"] if k % 9 == 0 and i % 8 == 0 else ["calm", "words", "here", "again", "more"]) for k in range(30)), int(i % 8 == 0)) for i in range(4000)]
    docs = spark.createDataFrame([r[:2] for r in rows], "id long, text string")
    labels = spark.createDataFrame([(r[0], r[2] if r[0] % 29 else 1 - r[2]) for r in rows], "id long, toxic int")
    whole, part = learn_lexicon(docs, labels), learn_lexicon(docs, labels, sample_rows=600)
    score = lambda x, lexicon: 1 / (1 + np.exp(-(lexicon.slope * x + lexicon.bias)))
    assert abs(score(0.0, whole) - score(0.0, part)) < 0.02


@pytest.mark.parametrize("seed", range(3))
def test_inclusion_sums_to_what_is_missing(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", None]), rng.choice([0, 1, 3, rng.randrange(1, 400), 5000 if i % 60 == 0 else 7])) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, words long")
    sizes = docs.groupBy("source").agg(F.sum("words").alias("all"), F.count("*").alias("n")).collect()
    goals = [(r.source, r["all"] * f, max(1.0, r["all"] / r.n)) for r, f in zip(sizes, (0.02, 0.5, 0.9, 0.99))]
    goals = spark.createDataFrame(goals, "source string, missing double, mean double")
    found = inclusion_factors(docs.select("source", F.col("words").alias("size")), goals)
    b = 0.5 + 0.5 * F.col("words") / F.col("mean")
    joined = docs.join(goals.withColumnRenamed("source", "g"), F.col("source").eqNullSafe(F.col("g"))).join(found, F.col("source").eqNullSafe(F.col("f_source")))
    for r in joined.groupBy("source", "missing").agg(F.sum(F.least(F.lit(1.0), F.col("factor") * b) * F.col("words")).alias("sum")).collect():
        assert abs(r["sum"] - r.missing) <= 1e-6 * r.missing
    certain = joined.where(_certain(F.col("words"), F.col("factor"), F.col("mean"))).select("doc_id")
    assert certain.count() > 0
    mixed = pareto_mix(docs, F.col("words"))
    for r in mixed.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("words").alias("most")).collect():
        assert abs(r.taken - r.target) <= r.most
