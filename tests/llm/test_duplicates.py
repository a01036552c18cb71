"""Exact dedup and the n-gram join against brute force."""

import hashlib
import os
import random

import numpy as np
import pytest

from turnlake.llm import ngram_join as N
from turnlake.llm.exact_dedup import deduplicated, exact_dedup
from turnlake.llm.patricia import SpillingTrie

SCHEMA = "doc_id long, text string, sha string, id long, keep_id string"


def rows_of(texts):
    return [(i, t, "x", 0, "y") for i, t in enumerate(texts)]


@pytest.mark.parametrize("limit", [1 << 30, 3000, 500])
def test_trie(limit):
    rng = random.Random(limit)
    keys = ["".join(rng.choice("ab") for _ in range(rng.randrange(12))).encode() for _ in range(3000)]
    trie, want = SpillingTrie(limit), {}
    folder = trie.folder
    for i, k in enumerate(keys):
        rank = (rng.randrange(50), i)
        trie.insert(k, rank, 1, k)
        best, n = want.get(k, (rank, 0))
        want[k] = (min(best, rank), n + 1)
    assert {t: (r, n) for t, r, n in trie.owners()} == want
    assert (trie.spills > 0) == (limit < 1 << 20) and not os.path.exists(folder)


def test_exact(spark):
    texts = ["a b", "ab", " a\tb\n", None, "", "  ", "é", "é ", "x" * 200_000, "x" * 200_000 + " ", "nbsp\xa0", "nbsp"]
    rows = [*rows_of(texts), (0, "a b", "x", 0, "y"), (None, "ab  ", "x", 0, "y")]
    found = exact_dedup(spark.createDataFrame(rows, SCHEMA).repartition(3), trie_bytes=2000).collect()
    norm = lambda t: (t or "").translate(dict.fromkeys(map(ord, " \t\n\x0b\x0c\r")))
    assert len(found) == len(rows)
    for r, (i, t) in zip(sorted(found, key=lambda r: (r.doc_id is None, r.doc_id)), sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is None, r[0]))):
        same = [(j, u) for j, u, *_ in rows if norm(u) == norm(t)]
        keep = min(same, key=lambda x: (-len(x[1] or ""), x[0] is None, x[0]))[0]
        assert (r.doc_id, r.keep_id, r.group_size, r.kept) == (i, keep, len(same), i == keep)
        assert r.text_sha256 == hashlib.sha256(norm(t).encode()).hexdigest()
    assert exact_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    kept = deduplicated(spark.createDataFrame(rows_of(texts), SCHEMA))
    assert kept.columns == ["doc_id", "text", "sha", "id", "keep_id"] and kept.count() == len({norm(t) for t in texts})


def brute(texts, similarity=0.8):
    grams = []
    for t in texts:
        w = (t or "").lower().split()
        grams.append({tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    top = list(range(len(texts)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if grams[i] and grams[j] and len(grams[i] & grams[j]) >= similarity * len(grams[i] | grams[j]):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def changed(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def test_join(spark):
    rng = random.Random(4)
    texts = [None, "", " \n ", "one two", "one two", "One  two", "one two three"]
    for _ in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 200))]
        texts += [changed(rng, base, k) for k in (0, 1, 1, 2, 2, 4, 9)] + [" ".join(base)]
    texts += [" ".join(f"w{rng.randrange(5000)}" for _ in range(80)) for _ in range(40)]
    docs = spark.createDataFrame([*rows_of(texts), (None, "one two", "x", 0, "y")], SCHEMA)
    found = N.near_duplicates(docs).collect()
    assert len(found) == len(texts) + 1
    by = {r.doc_id: r for r in found}
    assert [by[i].class_id for i in range(len(texts))] == brute(texts)
    assert by[0].n_links == by[1].n_links == by[2].n_links == 0 and by[3].copies == 3 and by[3].n_links == 2
    assert by[None].class_id is None and by[None].n_links == 0
    left = N.one_of_each(docs)
    assert left.columns == ["doc_id", "text", "sha", "id", "keep_id"]
    assert sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == sorted(set(brute(texts)))
    assert N.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_large_group(spark, monkeypatch):
    """Many different near copies: blocks of few sets, links as many as it takes."""
    monkeypatch.setattr(N, "BLOCK", 16)
    rng = random.Random(9)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    texts = [changed(rng, base, rng.randrange(1, 6)) for _ in range(120)]
    found = N.near_duplicates(spark.createDataFrame(rows_of(texts), SCHEMA)).collect()
    by = {r.doc_id: r.class_id for r in found}
    assert [by[i] for i in range(len(texts))] == brute(texts)


@pytest.mark.parametrize("block", [16, 256])
def test_links_of_a_large_group(spark, monkeypatch, block):
    """n_links counts every similar row, also of pairs that share no hub, once, in one block and in several."""
    monkeypatch.setattr(N, "BLOCK", block)
    rng = random.Random(9)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    texts = [changed(rng, base, rng.randrange(1, 6)) for _ in range(120)]
    texts += texts[:7] + texts[:3]
    grams = [frozenset(zip(*(t.split()[k:] for k in range(5)))) for t in texts]
    want = [sum(len(a & b) >= 0.8 * len(a | b) for b in grams) - 1 for a in grams]
    found = {r.doc_id: r.n_links for r in N.near_duplicates(spark.createDataFrame(rows_of(texts), SCHEMA)).collect()}
    assert [found[i] for i in range(len(texts))] == want


def test_bands():
    bands, rows = N.bands_for(0.8, 0.999)
    assert 1 - (1 - 0.8 ** rows) ** bands >= 0.999 and bands * rows <= 64 and rows >= 4


def test_intersections():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 90)).astype(np.uint64)) for _ in range(30)]
    want = [[len(np.intersect1d(a, b)) if i != j else None for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    found = N.intersections(sets, columns=7)
    assert all(want[i][j] is None or found[i, j] == want[i][j] for i in range(30) for j in range(30))


def test_ids_of_several_texts(spark):
    """An id that stands for two texts joins nothing: rows go by their own text."""
    rng = random.Random(2)
    a, b, c = ([f"{x}{rng.randrange(5000)}" for _ in range(60)] for x in "abc")
    rows = [(5, a), (5, b), (6, b), (7, a), (8, c), (9, c[:-1] + ["other"]), (5, c)]
    docs = spark.createDataFrame([(i, " ".join(t), "x", 0, "y") for i, t in rows], SCHEMA)
    found = N.near_duplicates(docs).collect()
    assert len(found) == len(rows)
    of = {r.doc_id: r for r in found if r.doc_id != 5}
    assert len({of[6].class_id, of[7].class_id, of[8].class_id}) == 3 and of[8].class_id == of[9].class_id
    assert sorted((r.doc_id, r.n_links) for r in found) == [(5, 1), (5, 1), (5, 2), (6, 1), (7, 1), (8, 2), (9, 2)]
    assert {r.class_id for r in found if r.doc_id == 5} == {of[6].class_id, of[7].class_id, of[8].class_id} and 5 in {r.class_id for r in found}
    left = sorted((r.doc_id, r.text[0]) for r in N.one_of_each(docs).collect())
    assert left == [(5, "a"), (5, "b"), (5, "c")]


def test_long_texts_and_ties(spark):
    rng = random.Random(3)
    long = [f"w{rng.randrange(9000)}" for _ in range(120_000)]
    rows = [(4, " ".join(long)), (3, " ".join(long)), (9, changed(rng, long, 300)), (1, "word " * 50_000), (2, "word " * 7), (None, "word")]
    found = {r.doc_id: r for r in N.near_duplicates(spark.createDataFrame([(*r, "x", 0, "y") for r in rows], SCHEMA)).collect()}
    assert [found[i].class_id for i in (1, 2, 3, 4, 9)] == [1, 1, 3, 3, 3] and [found[i].n_links for i in (1, 2, 3, 4, 9)] == [1, 1, 2, 2, 2]
