"""Collocations, exact inner product search and fill-in-the-middle, each against a plain version."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from turnlake.llm.collocations import collapsed, collocations, prefix_counts, suffix_keys
from turnlake.llm.fill_middle import fill_in_middle, restored
from turnlake.llm.kd_search import build_tree, search, top_products

DOCS = "doc_id long, text string, lang string"


def plain_collocations(rows, least, top=2000, max_n=5):
    f, n = defaultdict(Counter), Counter()
    for text, lang in [(t, "und" if x is None else x) for t, x in rows]:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            w = [x for x in re.split("[ \t]", piece) if x]
            n[lang] += len(w)
            f[lang].update(tuple(w[i:i + k]) for i in range(len(w)) for k in range(1, max_n + 1) if i + k <= len(w))
    out = set()
    for lang, count in f.items():
        good = {g: c for g, c in count.items() if c >= least}
        inside = {}
        for g, c in good.items():
            for k in range(2, len(g)):
                for i in range(len(g) - k + 1):
                    inside[g[i:i + k]] = max(inside.get(g[i:i + k], 0), c)
        found = []
        for g, a in good.items():
            if len(g) > 1 and inside.get(g, 0) < a:
                score, _, l, r = min((1000 * a * n[lang] // (count[g[:k]] * count[g[k:]]), k, count[g[:k]], count[g[k:]]) for k in range(1, len(g)))
                found.append((-score, -a, " ".join(g).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return out


def as_tuples(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


PHRASE_COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def test_collocations_equal_a_plain_count(spark):
    rng = random.Random(1)
    words = ["the", "of", "The", "a\x00", "a\x00b", "a\x01", "ÉTÉ", "été", "x\x05", "\U0001f600", "new", "york", " "]
    rows = []
    for i in range(300):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ";"]) for _ in range(rng.randrange(0, 60)))
        rows.append((i, rng.choice([text, text, "in the city of new york"]), rng.choice(["en", "en", "en", None, "und", "f\x00r", ""])))
    rows += [(1, None, "en"), (2, "", "en"), (3, "", "xx"), (None, "new york " * 5000, "en"), *[(9, "one hot line with seven words in", "en")] * 150]
    docs = spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", rank int").repartition(5)
    for least, top in ((3, 2000), (40, 7)):
        assert sorted(as_tuples(collocations(docs, least_count=least, top=top), *PHRASE_COLUMNS)) == sorted(plain_collocations([r[1:] for r in rows], least, top))


def test_overlaps_count(spark):
    docs = spark.createDataFrame([(1, "la " * 120, None)], DOCS)
    rows = {r.phrase: (r.a, r.n) for r in collocations(docs).collect()}
    assert rows["la la"] == (119, 120) and rows["la la la la la"] == (116, 120)


def test_no_documents_no_phrases(spark):
    assert collocations(spark.createDataFrame([], DOCS)).count() == 0
    assert collocations(spark.createDataFrame([(1, None, None), (2, "  .. \n", "en")], DOCS)).count() == 0


words_ = st.lists(st.lists(st.sampled_from(["a", "b", "c", "ab"]), min_size=1, max_size=4), min_size=1, max_size=60)


@settings(max_examples=200, deadline=None)
@given(words_, st.integers(1, 6), st.integers(1, 5), st.integers(1, 7))
def test_stack_counts_prefixes_over_any_ranges(lists, least, ranges, batch):
    keys = Counter("\x00".join(["en", *x]) for x in lists)
    order = sorted(keys, reverse=True)
    found = Counter()
    for r in range(ranges):
        part = order[len(order) * r // ranges:len(order) * (r + 1) // ranges]

        def rows():
            for i in range(0, len(part), batch):
                own = part[i:i + batch]
                pairs = ["\x00".join(k.split("\x00")[:3]) for k in own]
                k, n = collapsed(pa.array(own), np.array([keys[x] for x in own]), pa.array(pairs), least)
                yield from zip(k.to_pylist(), n.tolist())

        for key, n in prefix_counts(rows(), least):
            found[key] += n
    plain = Counter()
    for key, n in keys.items():
        parts = key.split("\x00")
        for k in range(1, len(parts) + 1):
            plain["\x00".join(parts[:k])] += n
    assert {k: n for k, n in found.items() if n >= least} == {k: n for k, n in plain.items() if n >= least}


def test_suffixes_stay_within_pieces():
    keys = [k for a in suffix_keys(pa.array(["en", None]), pa.array(["A b. c", "d"]), 3, most_words=2) for k in a.to_pylist()]
    assert keys == ["en\0a\0b", "en\0b", "en\0c", "und\0d"]


def plain_top(rows, k=10):
    ok = [(i, vid, [int(np.floor(1024 * float(x))) for x in v]) for i, (vid, v) in enumerate(rows) if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q, a in ok:
        if q is not None and q % 100 == 0:
            scored = [(-sum(x * y for x, y in zip(a, b)), (vid is None, vid or 0), j, vid) for j, vid, b in ok if j != i and len(b) == len(a)]
            out += [(q, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


SEARCH = "vec_id long, embedding array<double>, score string"


def test_search_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).round(2).tolist()) for i in range(700)]
    rows += [(1000 + i, [0.5] * 6) for i in range(400)]  # a hot vector: ties go by id
    rows += [(2000, None), (2100, [1.0, None] + [0.0] * 4), (2200, [float("nan")] * 6), (2300, [float("inf")] * 6), (None, [0.5] * 6), (2400, [1.0, 2.0]), (2401, [3.0, 4.0]), (2500, []), (200, [0.5] * 6)]
    df = spark.createDataFrame([(*r, "x") for r in rows], SEARCH).repartition(3)
    asks = F.col("vec_id") % 100 == 0
    for sizes in ({}, {"shard_rows": 60, "part_rows": 3, "leaf": 5}):
        found = top_products(df, asks, **sizes)
        assert sorted(as_tuples(found, "query_id", "rank", "vec_id", "score"), key=str) == plain_top(rows)


def test_search_of_huge_components_and_few_rows(spark):
    rows = [(0, [3e38, -3e38]), (1, [3e38, 1.0]), (2, [1.0, -2e38]), (3, [-3e38, 0.0]), (100, [2e9, 1e9]), (101, [1.5e9, -1e9])]
    found = as_tuples(top_products(spark.createDataFrame([(*r, "") for r in rows], SEARCH), F.col("vec_id") % 100 == 0), "query_id", "rank", "vec_id", "score")
    clip = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
    number = {i: [int(np.floor(1024 * x)) for x in v] for i, v in rows}
    plain = []
    for q in (0, 100):
        order = sorted((-clip(sum(x * y for x, y in zip(number[q], number[i]))), i) for i in number if i != q)
        plain += [(q, rank, i, -s) for rank, (s, i) in enumerate(order, 1)]
    assert sorted(found) == plain
    assert top_products(spark.createDataFrame([], SEARCH), F.col("vec_id") % 100 == 0).count() == 0


def test_boxes_are_tight_and_bounds_spare_leaves():
    rng = np.random.default_rng(5)
    points = np.floor(1024 * np.concatenate([rng.normal(c, 0.05, (200, 3)) for c in ([1, 0, 0], [0, 1, 0], [-1, -1, 0])]))
    ids = np.arange(len(points))
    order, nodes, boxes = build_tree(points, ids, leaf=16)
    for (start, stop, *_), (low, high) in zip(nodes, boxes):
        own = points[order[start:stop]]
        assert (own.min(0) == low).all() and (own.max(0) == high).all()
    leaves = nodes[nodes[:, 2] < 0]
    assert sorted(i for start, stop in leaves[:, :2] for i in range(start, stop)) == list(range(len(points)))

    class Counted(np.ndarray):
        seen = 0

        def __matmul__(self, other):
            if other.ndim == 1:
                Counted.seen += len(self)
            return np.asarray(self) @ np.asarray(other)

    q = np.array([[1024.0, 0.0, 0.0]])
    found = search(points[order].view(Counted), ids[order], ids[order], nodes, boxes, q, np.array([-1]), [None], 10)[0]
    assert [-i for _, i, _ in found] == sorted(range(len(points)), key=lambda i: (-points[i] @ q[0], i))[:10]
    assert 0 < Counted.seen < len(points) / 3


def plain_middle(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    alphabet = ["a", "Zz", "<", "P", ">", "S", "M", "\n", "\r", "é", "\U0001f600", " ", "1", "\x00", "\\", "$1", "|", "<S", "M>", " "]
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 40)))) for i in range(600)]
    return rows + [(1, None), (2, ""), (None, "no id"), (3, "<P>"), (4, "x<S>y"), (5, "<M"), (6, "word " * 200_000), (7, "same"), (7, "same"), (-8, "S>a<S")]


def test_middle_equals_a_plain_version_and_is_restored(spark, texts):
    df = spark.createDataFrame([(*r, "kept", "old") for r in texts], "doc_id long, text string, fim string, n string")
    made = fill_in_middle(df).withColumn("again", restored(F.col("output"), F.col("form")))
    rows = made.collect()
    assert len(rows) == len(texts) and all(r.fim == "kept" and r.again == (r.text or "") for r in rows)
    got = Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in rows)
    assert got == Counter((i, *plain_middle(i, t)) for i, t in texts)
    assert {"plain", "psm", "spm"} == {r.form for r in rows}


def test_middle_of_nothing(spark):
    assert fill_in_middle(spark.createDataFrame([], DOCS)).count() == 0
