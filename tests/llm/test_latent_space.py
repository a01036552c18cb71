"""The latent space of decontamination: fitted on every passage of every document and item."""

import random

import numpy as np

from turnlake.llm import decontaminate as D


def test_range_is_of_all_passages(spark):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(300)]
    texts = [" ".join(rng.choice(words[:rng.choice([3, 300])]) for _ in range(rng.choice([0, 1, 15, 16, 17, 40, 90, 700]))) for _ in range(60)] + [None]
    idf = np.random.default_rng(1).uniform(0.1, 8, D.BUCKETS).astype(np.float32)
    y, passages = D.range_of(spark.createDataFrame([(t,) for t in texts], "text string").repartition(7), idf, "text", 8)
    omega, want, n = D.projection(rank=8), np.zeros((D.BUCKETS, 8)), 0
    for t in texts:
        own = D.buckets_of(D.hashed_words([(t or "").encode()], D.LETTERS)[0])
        for k in range(0, len(own), D.HALF):
            p = own[k:k + 2 * D.HALF]
            row = np.zeros(D.BUCKETS)
            np.add.at(row, p, idf[p])
            want += np.outer(row, row @ omega / (idf[p].astype(float) ** 2).sum()) if k < len(own) else 0
            n += 1
    assert passages == n and np.allclose(y, want, rtol=1e-4, atol=1e-4 * np.abs(want).max())


def test_space_reads_every_document(spark, monkeypatch):
    """More documents than the space was fitted on before; each has a word of its own, which the space knows."""
    seen = []
    monkeypatch.setattr(D, "spectrum", lambda a, b, f=D.spectrum: seen.append(b) or f(a, b))
    docs = spark.createDataFrame([(i, f"only{i} stands here") for i in range(6000)], "doc_id long, text string")
    D.find_leaks(docs, spark.createDataFrame([(1, "one item of a benchmark")], "item_id long, text string")).count()
    own = D.buckets_of(D.hashed_words([f"only{i}".encode() for i in range(6000)], D.LETTERS)[0])
    assert (np.abs(seen[0]).sum(1) > 0)[own].all()
