"""License scans against brute force and their defined results."""

import itertools
import random
from collections import Counter

import numpy as np

from turnlake.llm import licenses as S


def test_increasing():
    rng = random.Random(3)
    for _ in range(100):
        places = rng.sample(range(30), rng.randrange(0, 9))
        best = max((len(c) for n in range(len(places) + 1) for c in itertools.combinations(places, n) if list(c) == sorted(c)), default=0)
        found = [places[k] for k in S.increasing(places)]
        assert found == sorted(found) and len(found) == best


def test_patience_aligns_equal_words():
    rng = random.Random(5)
    for _ in range(200):
        a = [rng.randrange(20) for _ in range(rng.randrange(0, 25))]
        b = [w for w in a if rng.random() < 0.8] + [rng.randrange(20) for _ in range(4)]
        pairs = S.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        assert len(pairs) <= len(S._common(a, b))
    words = list(range(50))
    assert S.patience(words, words) == [(k, k) for k in range(50)]


def test_most_aligned_against_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        template = [rng.randrange(8) for _ in range(rng.randrange(2, 9))]
        texts = [[rng.randrange(12) for _ in range(rng.randrange(0, 40))] for _ in range(3)]
        offsets, words = np.cumsum([0] + [len(t) for t in texts]), np.array(sum(texts, []), np.int64)
        counts, span = np.bincount(template, minlength=12), S.span_of(len(template))
        own = np.flatnonzero(counts[words] > 0)
        text = np.searchsorted(offsets, own, "right") - 1
        found = S.most_aligned(own, words[own], offsets[text], counts, span)
        assert found.tolist() == [sum((Counter(words[s:min(offsets[t + 1], s + span)].tolist()) & Counter(template)).values()) for s, t in zip(own, text)]


def test_scan(spark):
    rng = random.Random(8)
    filler = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    mit = S.TEMPLATES["mit"].split()
    changed = " ".join(w for k, w in enumerate(mit) if k % 9)
    texts = [
        None, "", filler(300), filler(50) + " Licensed under CC BY-NC 4.0. " + filler(50), "ALL RIGHTS RESERVED", "all rights, reserved! " * 3,
        filler(20) + " " + " ".join(mit) + " " + filler(20), changed, "the of and to in " * 400, "reserved rights all", "mit license under the released",
        filler(200_000) + " Released under the MIT License.",
    ]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(4, "All rights reserved.", "x")], "doc_id long, text string, license_id string")
    found = S.scan_licenses(docs.repartition(2)).collect()
    by = {(r.doc_id, r.license_id): r for r in found}
    assert by[3, "cc-by-nc-4.0-notice"].coverage == 1.0 and by[3, "cc-by-nc-4.0-notice"].first_word == 50
    assert by[5, "all-rights-reserved"].n_places == 3 and sum(r.doc_id == 4 for r in found) == 2
    assert by[6, "mit"].coverage == 1.0 and 0.8 <= by[7, "mit"].coverage < 1.0 and by[11, "mit-notice"].first_word == 200_000
    assert not {r.doc_id for r in found} & {0, 1, 2, 8, 9, 10}
    assert [k for i, k in by if i == 3] == ["cc-by-nc-4.0-notice"] and [k for i, k in by if i == 6] == ["mit"]
    left = S.without_licenses(docs, ["cc-by-nc-4.0-notice"])
    assert left.columns == docs.columns and left.count() == docs.count() - 1
    assert S.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0 and S.scan_licenses(docs, {"none": " . "}).count() == 0


def test_every_notice_is_found(spark):
    """Against a plain search of whole notices."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    found = {(r.doc_id, r.license_id) for r in S.scan_licenses(docs).collect()}
    want = {(r.doc_id, k) for r in docs.collect() for k, t in S.TEMPLATES.items() if t in r.text}
    assert want and want <= found


def test_short_notices_count_word_by_word(spark):
    texts = [
        "Released under the BSD License.", "Licensed under CC BY-ND 4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Released under the new MIT License.",
    ]
    found = S.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.license_id) for r in found) == [(0, "bsd-notice"), (1, "cc-by-nd-4.0-notice"), (3, "cc-by-nc-4.0-sentence")]


def test_spread(spark):
    """A license with other words between its own is one place as far as spread goes."""
    mit = S.TEMPLATES["mit"].split()
    rows = [(k, " ".join(w + " page footer" * (i % 2) * k for i, w in enumerate(mit))) for k in (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [(r.doc_id, r.coverage) for r in S.scan_licenses(docs).collect()] == [(0, 1.0)]
    assert sorted((r.doc_id, r.coverage) for r in S.scan_licenses(docs, spread=2.5).collect()) == [(0, 1.0), (1, 1.0)]


def test_longer_licenses_win(spark):
    texts = [S.TEMPLATES[k] for k in ("bsd-3-clause", "isc-whole", "lgpl-header", "agpl-header", "gpl-header", "zlib", "unlicense", "mpl-2.0-notice")]
    found = S.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [r.license_id for r in sorted(found)] == ["bsd-3-clause", "isc-whole", "lgpl-header", "agpl-header", "gpl-header", "zlib", "unlicense", "mpl-2.0-notice"]


def test_long_texts_of_license_words(spark):
    """Words of a license over and over, in no order: looked at in good time, and no license."""
    import time

    rng = random.Random(6)
    words = S.TEMPLATES["mit"].split()
    texts = [" ".join(rng.sample(words, len(words)) * 1)for _ in range(2)] + [" ".join(w for _ in range(120) for w in rng.sample(words, len(words))), "license " * 30_000]
    began = time.perf_counter()
    found = S.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert not found and time.perf_counter() - began < 60


def test_notices_with_changed_words(spark):
    """In the texts of documents, a word of each notice that is no name is changed, dropped, or followed by another."""
    rng = random.Random(11)
    notices = {k: t for k, t in S.TEMPLATES.items() if 4 <= len(t.split()) < 20}
    rows, want, n = [], {}, 0
    docs = [r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect() if any(t in (r.text or "") for t in notices.values())]
    for text in [r.text for r in docs] + [f"so {t} then" for t in notices.values() for _ in range(6)]:
        name = max((k for k, t in notices.items() if t in text), key=lambda k: len(notices[k]))
        words = notices[name].split()
        own = [[w for w in S.template_words(x)] for x in words]
        names = S.names_in(notices[name])
        free = [i for i in range(len(words)) if not set(own[i]) & names and len(own[i]) == 1]
        i, how = rng.choice(free), rng.choice(["changed", "dropped", "added"])
        beside = i + 1 < len(words) and set(own[i + 1]) & names
        if how == "added" and beside:
            how = "changed"
        words[i:i + 1] = {"changed": ["zzword"], "dropped": [], "added": [words[i], "zzword"]}[how]
        rows.append((n, text.replace(notices[name], " ".join(words))))
        want[n] = name
        n += 1
    found = {}
    for r in S.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        if r.license_id in notices:
            found.setdefault(r.doc_id, set()).add(r.license_id)
    hit = sum(want[k] in found.get(k, ()) for k in want)
    assert hit >= 0.9 * len(want), (hit, len(want))
    wrong = {k: found[k] for k in found if not found[k] <= {x for x, t in notices.items() if t in rows[k][1]} | {want[k]}}
    assert not wrong


def test_other_names_are_other_licenses(spark):
    texts = [
        "Released under the XYZ License.", "Licensed under CC BY-XX 4.0.", "Licensed under CC BY 3.0.", "This work is licensed under the GNU General Public License, version 4.",
        "Licensed under the Apache License, Version 1.1.", "Released under the modified BSD License.", "Licensed to the MIT and the License of all",
    ]
    assert not S.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()


def brute_places(words, template, names, least, spread):
    """Every start, by the alignment alone."""
    out, k, m = [], 0, len(template)
    span, held = S.span_of(m, spread), Counter(template)
    starts = [i for i in range(len(words)) if words[i] in held and sum((Counter(words[i:i + span]) & held).values()) >= least * m]
    while k < len(words):
        best = None
        if k in starts:
            for first in [i for i in starts if k <= i < k + span]:
                if best and best[0] == m:
                    break
                pairs = S.patience(template, words[first:first + span])
                if len(pairs) >= least * m and (best is None or len(pairs) > best[0]) and S.well_named(pairs, template, names):
                    best = (len(pairs), first + pairs[0][1], first + pairs[-1][1])
        if best:
            out.append((best[0] / m, best[1], best[2]))
            k = best[2] + 1
        else:
            k += 1
    return out


def test_scan_against_every_start(spark):
    """The operator's rows against aligning each template at each start, with words changed, dropped and added."""
    rng = random.Random(2)
    rows = []
    for n in range(60):
        words = []
        for _ in range(rng.randrange(1, 4)):
            words += [f"w{rng.randrange(50)}" for _ in range(rng.randrange(0, 12))]
            for w in rng.choice(list(S.TEMPLATES.values())).split()[:60]:
                x = rng.random()
                words += [] if x < 0.03 else ["odd"] if x < 0.06 else [w, "more"] if x < 0.09 else [w]
        rows.append((n, " ".join(words)))
    found = {(r.doc_id, r.license_id): (round(r.coverage, 9), r.n_places, r.first_word, r.last_word) for r in S.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    want = {}
    for n, text in rows:
        words, places = S.template_words(text), []
        for name, t in S.TEMPLATES.items():
            template = S.template_words(t)
            for c, first, last in brute_places(words, template, S.names_in(t), S.COVERAGE, S.SPREAD):
                places.append((round(c * len(template)), name, c, first, last))
        kept = {}
        for _, name, c, first, last in S.apart(places):
            kept.setdefault(name, []).append((-c, first, last))
        want |= {(n, name): (round(-min(x)[0], 9), len(x), *min(x)[1:]) for name, x in kept.items()}
    assert want and found == want


def test_rows_without_licenses_go_by_their_own_text(spark):
    docs = spark.createDataFrame([(1, "Released under the MIT License."), (1, "clean"), (None, "Released under the MIT License."), (None, None)], "doc_id long, text string")
    assert sorted(map(tuple, S.without_licenses(docs, ["mit-notice"]).collect()), key=repr) == [(1, "clean"), (None, None)]
