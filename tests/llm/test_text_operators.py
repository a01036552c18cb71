"""Toxicity, HTML, language, token files and decontamination: fixtures, round trips, held-out rows."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from turnlake.llm import decontaminate as D
from turnlake.llm import html_text as H
from turnlake.llm import language_id as L
from turnlake.llm import queries as Q
from turnlake.llm import token_files as T
from turnlake.llm import toxicity as X

SF = "/root/testdata/sf0.01"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
EDGES = "doc_id long, text string, score string, ids string, n_tokens int, lang string"


def edges(*texts):
    return [(i, t, "x", "y", 0, "z") for i, t in enumerate(texts)]


# Toxicity


def test_fold():
    for same in ("idiot", "1d1ot", "IDIOT!!", "іdіоt", "ídiöt", "idi​ot", "ｉｄｉｏｔ", "|diot"):
        assert X.fold(same) == X.fold("idiot"), same
    assert X.fold("a.b,c") == " a b c" and X.fold("") == " "


def test_lexicon_and_exceptions(spark):
    rng = random.Random(2)
    plain = [f"word{rng.randrange(200)}" for _ in range(4000)]
    rows = []
    for i in range(600):
        words = rng.sample(plain, 30)
        kind = i % 4
        if kind == 0:
            words.insert(5, rng.choice(["stinker", "stinkers", "st1nker", "vexumal", "vexubab"]))
        if kind == 1 and i % 8 == 1:
            words[10:10] = ["the", "stinker", "bug"]
        rows.append((i, " ".join(words), int(kind == 0)))
    docs = spark.createDataFrame([(a, b) for a, b, _ in rows], "id long, text string")
    labels = spark.createDataFrame([(a, c) for a, _, c in rows], "id long, toxic int")
    lexicon = X.learn_lexicon(docs, labels)
    assert any(t.startswith(X.fold("stinker").strip()[:6]) for t in lexicon.weights) and any(t.startswith("vexu") for t in lexicon.weights)
    assert f"the {X.fold('stinker').strip()}" in lexicon.exceptions or f"{X.fold('stinker').strip()} bug" in lexicon.exceptions
    found = X.score_toxicity(docs.withColumnRenamed("id", "doc_id"), lexicon).collect()
    right = sum((r.score >= 0.7) == bool(rows[r.doc_id][2]) for r in found)
    assert right >= 0.98 * len(rows)


def test_toxicity_edges(spark):
    lexicon = X.Lexicon({"idiot": 5.0}, slope=1.0, bias=-4.0)
    docs = spark.createDataFrame(edges(None, "", "an idiot", "an idiot", "word " * 100_000 + "idiot"), EDGES)
    found = {r.doc_id: r.score for r in X.score_toxicity(docs, lexicon).collect()}
    assert found[0] == found[1] < 0.1 and found[2] == found[3] > 0.9 and found[4] < found[2] and all(0 <= s <= 1 for s in found.values())
    assert X.keep_clean(docs, lexicon).columns == docs.columns
    assert sorted(r.doc_id for r in X.keep_clean(docs, lexicon).collect())[:2] == [0, 1]
    none = spark.createDataFrame([], EDGES)
    assert X.score_toxicity(none, lexicon).count() == 0
    empty = X.learn_lexicon(none.select(F.col("doc_id").alias("id"), "text"), spark.createDataFrame([], "id long, toxic int"))
    assert empty.weights == {} and X.score_toxicity(docs, empty).count() == 5


def slow_score(lexicon, text):
    """The score by looking for every term and every exception phrase at every place."""
    folded = X.fold(text or "") + " "
    at = lambda term: [k for k in range(len(folded)) if folded.startswith(" " + term, k)]
    spared = [(k, k + 1 + len(p)) for p in lexicon.exceptions for k in at(p)]
    weight = hits = 0
    for term, w in lexicon.weights.items():
        for k in at(term):
            if not any(a <= k and k + 1 + len(term.rstrip()) <= b for a, b in spared):
                weight, hits = weight + w, hits + 1
    z = lexicon.slope * np.log1p(1e4 * weight / (folded.count(" "))) + lexicon.bias
    return 1 / (1 + np.exp(-np.clip(z, -30, 30))), hits


def test_toxicity_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    lexicon = Q.toxicity_lexicon(spark, docs, SF)
    extra = X.Lexicon({**lexicon.weights, "bad ": 3.0, "ba": 1.0}, [*lexicon.exceptions, "bad hair day", "hair day", "not bad"], lexicon.slope, lexicon.bias)
    texts = [r.text for r in docs.orderBy("doc_id").collect()] + ["so bad", "not bad at all", "bad hair day, bad", "badly not badly", "b4d !", "", "a bad hair", None]
    rows = spark.createDataFrame(edges(*texts), EDGES)
    for one in (lexicon, extra):
        found = {r.doc_id: r for r in X.score_toxicity(rows, one).collect()}
        for i, text in enumerate(texts):
            score, hits = slow_score(one, text)
            assert found[i].hits == hits and found[i].score == pytest.approx(score, abs=1e-12), text
    assert found[len(texts) - 8].hits == 2 and found[len(texts) - 7].hits == 0


def test_short_words_are_terms(spark):
    rows = [(i, f"you {'pox' if i % 2 else 'fox'} and {i} others, {'kek' if i % 2 else 'keks'} there") for i in range(200)]
    docs = spark.createDataFrame(rows, "id long, text string")
    lexicon = X.learn_lexicon(docs, spark.createDataFrame([(i, i % 2) for i, _ in rows], "id long, toxic int"))
    assert {X.fold(w)[1:] + " " for w in ("pox", "kek")} <= set(lexicon.weights)
    found = X.score_toxicity(docs, lexicon, "id").collect()
    assert all((r.score > 0.7) == bool(r.id % 2) for r in found)


def test_toxicity_held_out(spark):
    found = Q.op4_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in found) >= 0.95 * len(found)
    assert not [r for r in found if r.predicted and not r.toxic]


# HTML

PAGE = """<html><head><title>T</title><style>p{{}}</style></head><body class="has-sidebar"><div class="cookie-notice"><p>We use cookies</p></div>
<header><a href="/">Home</a></header><nav><ul><li>News<li>Sport</ul></nav><div class="x7"><span>Share this page now</span></div>
<article><header><h1>Title {n} &amp; more</h1></header><p>First   para &lt;{n}&gt;<br>goes&nbsp;on <b>bold<p>Second {n}</p><!-- <p>no</p> --><script>if (a < b) "</p>"</script>
<div class="comments"><p>Nice {n}</p></div><form><input>Search</form></article><aside>Side {n}</aside><div class="ad">Buy {n}</div><footer>&copy; site</footer></body></html>"""


def test_html(spark):
    rows = [(n, f"http://a.example/{n}", PAGE.format(n=n), "x") for n in range(12)]
    rows += [(20, None, None, "x"), (21, "http://b.example/", "", "x"), (22, "http://b.example/", "plain &amp text", "x"), (23, "http://c.example/", "<p>only<p>two</p></b>", "x"), (24, "u", "<div><!-- open", "x")]
    found = {r.page_id: r for r in H.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    for n in range(12):
        assert found[n].text == f"Title {n} & more\nFirst para <{n}> goes on bold\nSecond {n}"
    assert found[20].text == found[21].text == found[24].text == "" and found[22].text == "plain & text" and found[23].text == "only\ntwo"
    assert all(r.n_chars == len(r.text) for r in found.values())
    assert H.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def site_importances(pages):
    """Importances of a site's branches by putting its different pages together."""
    import math
    from collections import Counter, defaultdict

    pages = sorted(set(pages))
    texts, shapes, ups = defaultdict(list), defaultdict(list), {}
    for page in pages:
        elements, found = H.parsed(page)
        first = {}
        for e in elements:
            first.setdefault(e.place, e)
        for place, e in first.items():
            shapes[place].append(" ".join(dict.fromkeys(e.children)))
            ups[place], x = [], e
            while x is not None:
                ups[place].append(x.place)
                x = x.parent
        own = defaultdict(Counter)
        for e, t in found:
            own[e.place][t] += 1
        for place, c in own.items():
            texts[place].append(c)

    def entropy(counts):
        return -sum(c / sum(counts) * math.log(c / sum(counts)) for c in counts)

    content, many, weighed, size = {}, {}, Counter(), Counter()
    for place, counts in texts.items():
        m = len(shapes[place])
        total = sum(sum(c.values()) for c in counts)
        spread = sum(sum(cs) * entropy(cs) for cs in ([c[t] for c in counts if t in c] for t in set().union(*counts))) / total
        content[place], many[place] = (max(0.0, 1 - spread / math.log(m)) if m > 1 else 1.0), total
        for up in ups[place]:
            weighed[up] += content[place] * total
            size[up] += total
    out = {}
    for place, n in size.items():
        m = len(shapes[place])
        shape = entropy(list(Counter(shapes[place]).values())) / math.log(m) if m > 1 else 1.0
        x = H.OWN_SHARE * shape + (1 - H.OWN_SHARE) * weighed[place] / n
        out[place] = (x * (m - 1) + H.PRIOR_PAGES) / (m - 1 + H.PRIOR_PAGES)
    return out


def test_importances_against_brute_force(spark):
    pages = [(n, "http://h.example/", PAGE.format(n=n % 5).replace("Second", "Second" * (n % 3))) for n in range(19)] + [(30, "http://i.example/", PAGE.format(n=1)), (31, None, PAGE.format(n=2))]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    found = {(r.host, r.place): r.importance for r in H.importances(frame).collect()}
    want = {(h, p): x for h in ("h.example", "i.example", "") for p, x in site_importances([t for _, u, t in pages if H.host_of(u) == h]).items()}
    assert found.keys() == want.keys() and all(found[k] == pytest.approx(want[k], abs=1e-9) for k in want)


SITE = """<html><body><div class="x1"><p>Menu of the site</p></div><main><h1>Story {n}</h1><p>What happened, told in {n} parts.</p><p>More of {n}.</p>
<div class="x7"><p>Become a friend of ours today</p></div></main></body></html>"""


@pytest.mark.parametrize("most", [50_000, 0])
def test_tree_decides_inside_main_too(spark, most):
    """What all pages of a host share goes, unnamed and inside main; by both ways of bringing importances to pages."""
    rows = [(n, "http://big.example/", SITE.format(n=n)) for n in range(8)] + [(100 + n, f"http://small{n}.example/", SITE.format(n=n)) for n in range(3)] + [(200, None, SITE.format(n=7))]
    found = {r.page_id: r.text for r in H.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), broadcast_places=most).collect()}
    for n in range(8):
        story = f"Story {n}\nWhat happened, told in {n} parts.\nMore of {n}."
        assert found[n] == story
        assert H.main_text(SITE.format(n=n), {}) == f"Menu of the site\n{story}\nBecome a friend of ours today"
    assert found[100] == H.main_text(SITE.format(n=0), {}) and found[200] == H.main_text(SITE.format(n=7), {})


def test_copies_of_one_page_keep_their_text(spark):
    rows = [(n, "http://c.example/", SITE.format(n=1)) for n in range(9)]
    found = {r.text for r in H.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {H.main_text(SITE.format(n=1), {})}


@pytest.mark.parametrize("page, text", [
    ("<div class='layout has-sidebar'><article><p>a</p></article></div>", "a"), ("<div id='search-page'><main><p>a</p></main></div>", "a"),
    ("<section class='post no-comments'><p>a</p></section>", "a"), ("<form action='x'><article><p>a</p><button>go</button></article></form>", "a"),
    ("<article><p>a</p><section class='comments'><article><p>b</p></article></section></article>", "a"), ("<aside><article>b</article></aside><p>a</p>", "a"),
    ("<p>1 < 2 <b>and</b> it's <a href='x>y'>fine</a> <math><mi>x</mi></math>", "1 < 2 and it's fine x"), ("<p class=it's>a</p><p>b's</p>", "a\nb's"),
    ("<table><tr><td>a<td>b<tr><td>c</table>d<table><tr><td><table><tr><td>e</table>f</table>", "a\nb\nc\nd\ne\nf"), ("a<!-- > --><![CDATA[b]]><?c ?>d<p", "ad<p"),
])
def test_markup(page, text):
    assert H.main_text(page, {}) == text


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "deep", "<div><p>" * 50_000 + "x", '<a "' * 100_000, '<a "' * 100_000 + ">", "<li><div>" * 40_000, "<table>" + "<div>" * 50_000 + "<td>x</td>" * 20_000, "<script" * 50_000 + ">", "<a href='" * 50_000 + ">"])
def test_time_is_linear(page):
    import time

    began = time.perf_counter()
    H.main_text(page, {})
    assert time.perf_counter() - began < 10


# Language


def test_gradients():
    net = L.new_network(["a", "b"], units=4, seed=3)
    rng = np.random.default_rng(0)
    x, y = rng.integers(60, 70, (7, 5)), rng.integers(0, 2, 5)
    weight = np.ones((7, 5), np.float32)
    _, grads = L.gradients(net, x, y, weight)
    near = 0
    for name in ("fUz", "bUr", "fUn", "bEn", "fEz", "fW", "b"):
        v = net.parts[name]
        at = np.unravel_index(np.abs(grads[name]).argmax(), v.shape)
        old, step = v[at], np.float32(2e-3)
        v[at] = old + step
        up, _ = L.gradients(net, x, y, weight)
        v[at] = old - step
        down, _ = L.gradients(net, x, y, weight)
        v[at] = old
        near += abs((up - down) / (2 * step) - grads[name][at]) < 0.1 * abs(grads[name][at]) + 1e-3
    assert near >= 6


def test_segments_cover_texts():
    first, last = L.segments_of(np.array([0, 3, 3]), np.array([3, 3, 10]), 4)
    assert first.tolist() == [0, 3, 7] and last.tolist() == [3, 7, 10]


def slow_probabilities(net, text, segment):
    """Mean label of a text's letters by a network that goes byte by byte."""
    clip = lambda v, low: [min(1.0, max(low, x)) for x in v]
    times = lambda h, u: [sum(h[i] * float(u[i][j]) for i in range(len(h))) for j in range(len(h))]
    data, p, total, n = text.encode(), net.parts, [0.0] * len(net.langs), 0
    for at in range(0, len(data), segment):
        part = data[at:at + segment]
        logits = [[float(x) for x in p["b"]] for _ in part]
        for d in "fb":
            h = [0.0] * len(p[f"{d}Uz"])
            for t in range(len(part)) if d == "f" else reversed(range(len(part))):
                c = part[t]
                z = clip([float(p[f"{d}Ez"][c][j]) + x for j, x in enumerate(times(h, p[f"{d}Uz"]))], 0.0)
                r = clip([float(p[f"{d}Er"][c][j]) + x for j, x in enumerate(times(h, p[f"{d}Ur"]))], 0.0)
                g = clip([float(p[f"{d}En"][c][j]) + r[j] * x for j, x in enumerate(times(h, p[f"{d}Un"]))], -1.0)
                h = [z[j] * h[j] + (1 - z[j]) * g[j] for j in range(len(h))]
                for k in range(len(net.langs)):
                    logits[t][k] += sum(h[j] * float(p[f"{d}W"][j][k]) for j in range(len(h)))
        for c, row in zip(part, logits):
            if L.LETTER_BYTES[c]:
                top = [np.exp(x - max(row)) for x in row]
                total = [a + x / sum(top) for a, x in zip(total, top)]
                n += 1
    return [x / max(1, n) for x in total]


def test_language_against_a_slow_network(spark):
    net = L.new_network(["de", "en", "fr"], units=5, seed=4)
    texts = ["the cat", "é", "wörter und 12 zahlen " * 9, "x" * 70, "a b c d e f " * 30, "q"]
    docs = spark.createDataFrame(edges(None, *texts), EDGES).repartition(2)
    found = {r.doc_id: r for r in L.predict_language(docs, net, segment=100).collect()}
    for i, text in enumerate(texts, 1):
        want = slow_probabilities(net, text, 100)
        assert found[i].lang_pred == net.langs[int(np.argmax(want))] and found[i].score == pytest.approx(max(want), abs=1e-4)


def test_language_held_out(spark):
    found = Q.op7_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.97 * len(found)


def test_language_edges(spark):
    net = L.new_network(["en", "fr"])
    docs = spark.createDataFrame(edges(None, "", "123 !?", "abc", "abc", "é" * 300_000), EDGES)
    found = {r.doc_id: r for r in L.predict_language(docs, net).collect()}
    assert [found[i].lang_pred for i in range(3)] == ["und"] * 3 and found[3][1:] == found[4][1:] and found[5].lang_pred in ("en", "fr")
    assert all(0 <= r.score <= 1 for r in found.values()) and L.predict_language(spark.createDataFrame([], EDGES), net).count() == 0


# Token files


def test_encoder_equals_library():
    encoder = T.WordEncoder(TOKENIZER, cached=50)
    rng = random.Random(0)
    letters = "aZé ß'<|>sŚİſ9½\n\t\xa0\x1c!#日́"
    texts = ["", " ", "it's DON'T 12", "a<|endoftext|>b", "Σίσυφος ΟΔΟΣ", "\x00n", "👍🏽 ok", *["".join(rng.choice(letters) for _ in range(rng.randrange(25))) for _ in range(400)]]
    for i in range(0, len(texts), 40):
        part = texts[i:i + 40]
        offsets, ids = encoder.encode(part, 1)
        for k, t in enumerate(part):
            assert ids[offsets[k]:offsets[k + 1]].tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids + [1]


def test_encoder_equals_library_on_documents_and_all_of_unicode():
    """Every whole text of the documents, and strings of any characters, ordinary ones between them."""
    import pyarrow.parquet as pq

    encoder = T.WordEncoder(TOKENIZER)
    rng = random.Random(1)
    anything = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    strings = ["".join(rng.choice(anything) if rng.random() < 0.3 else rng.choice("ab Z'9.\n") for _ in range(rng.randrange(120))) for _ in range(3000)]
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()] + strings
    for i in range(0, len(texts), 100):
        part = texts[i:i + 100]
        offsets, ids = encoder.encode(part, 1)
        whole = encoder.tokenizer.encode_batch(part, add_special_tokens=False)
        for k in range(len(part)):
            assert ids[offsets[k]:offsets[k + 1]].tolist() == whole[k].ids + [1], repr(part[k][:200])


def test_token_files(spark, tmp_path):
    docs = spark.createDataFrame(edges("b c", None, "", "héllo wörld " * 3000, "x") + [(2, "again", "x", "y", 0, "z"), (None, "none", "x", "y", 0, "z")], EDGES).repartition(3)
    path = str(tmp_path / "tokens")
    T.write_token_files(docs, path, TOKENIZER)
    library = T.WordEncoder(TOKENIZER).tokenizer
    want = {(r.doc_id, r.text): library.encode(r.text or "", add_special_tokens=False).ids + [1] for r in docs.collect()}
    assert sorted(map(repr, ((r.doc_id, list(r.ids)) for r in T.read_tokens(spark, path).collect()))) == sorted(map(repr, ((k[0], v) for k, v in want.items())))
    assert {r.doc_id for r in T.read_tokens(spark, path, 2, 3).collect()} == {2, 3} and T.read_metadata(spark, path).columns == ["doc_id", "n_tokens"]
    index = sorted(T.token_index(spark, path).collect(), key=lambda r: r.start)
    at = 0
    for r in index:
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in index] == [None, 0, 1, 2, 2, 3, 4]
    assert {r.ids_crc32 for r in index} == {zlib.crc32(np.array(v, "<u4").tobytes()) for v in want.values()}
    none = str(tmp_path / "none")
    T.write_token_files(spark.createDataFrame([], EDGES), none, TOKENIZER)


def test_index_follows_the_files(spark, tmp_path):
    """Starts and checksums belong to what stands there in the files, also where ids repeat."""
    rows = [(k // 3, f"word{k} " * (k * 7 % 5 + 1), "x", "y", 0, "z") for k in range(60)] + [(4, None, "x", "y", 0, "z"), (4, "", "x", "y", 0, "z"), (None, "a", "x", "y", 0, "z")]
    path = str(tmp_path / "tokens")
    T.write_token_files(spark.createDataFrame(rows, EDGES).repartition(4), path, TOKENIZER)
    parts = sorted((r.part, r.place, r.doc_id, r.ids) for r in spark.read.parquet(path).select("*", F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int").alias("part")).collect())
    stream = [x for *_, ids in parts for x in ids]
    assert [d for _, _, d, _ in parts] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d))
    found = T.token_index(spark, path).collect()
    assert len(found) == len(rows) and sorted(r.start for r in found) == [0, *np.cumsum([len(p[3]) for p in parts])[:-1].tolist()]
    for r in found:
        assert r.ids_crc32 == zlib.crc32(np.array(stream[r.start:r.start + r.n_tokens], "<u4").tobytes())
    none = str(tmp_path / "none")
    T.write_token_files(spark.createDataFrame([], EDGES), none, TOKENIZER)
    assert T.token_index(spark, none).count() == 0


def test_other_tokenizers_go_to_the_library(tmp_path):
    import json

    with open(TOKENIZER, encoding="utf-8") as file:
        settings = json.load(file)
    assert T.takes_pieces(settings) and isinstance(T.encoder_of(TOKENIZER), T.WordEncoder)
    settings["normalizer"]["normalizers"].pop()
    other = tmp_path / "cased.json"
    other.write_text(json.dumps(settings), encoding="utf-8")
    encoder = T.encoder_of(str(other))
    assert not T.takes_pieces(settings) and isinstance(encoder, T.TextEncoder)
    offsets, ids = encoder.encode(["It's A b", "", "é"], 1)
    for k, t in enumerate(["It's A b", "", "é"]):
        assert ids[offsets[k]:offsets[k + 1]].tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids + [1]


# Decontamination


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], (last + 1 if x == y else max(row[j + 1], row[j]))
    return row[-1]


def test_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 70))] for _ in range(2))
        assert D.common_subsequence(np.array(a), np.array(b)) == lcs(a, b)


def test_half_sums_against_brute_force():
    rng = np.random.default_rng(4)
    lengths = np.array([0, 1, 16, 17, 0, 50, 2000, 0])
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    at = rng.integers(0, D.BUCKETS, offsets[-1])
    table = D.with_zero(rng.integers(0, 9, (D.BUCKETS, 5)).astype(np.float32))
    first, last, text = D.halves_of(offsets)
    found = D.half_sums(table, D.half_words(at, first, last), rows=7)
    assert found.tolist() == [table[at[a:b]].sum(0).tolist() for a, b in zip(first, last)] and text.tolist() == sorted(text.tolist())


@pytest.fixture(scope="module")
def leaky():
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(3000)}"
    items = [(i, " ".join(word() for _ in range(rng.randrange(20, 60))) + ". " + " ".join(word() for _ in range(4))) for i in range(40)]
    items += [(90, "tiny item of six odd words"), (91, ""), (92, None)]
    docs, want = [], set()
    for k in range(300):
        base = [word() for _ in range(rng.randrange(0, 400))]
        if k % 3 == 0:
            i, text = items[(k // 3) % 40]
            own = [word() if rng.random() < 0.1 else w for w in text.split()]
            at = rng.randrange(len(base) + 1)
            base[at:at] = own
            want.add((k, i))
        docs.append((k, " ".join(base)))
    docs += [(900, "so TINY item, of six odd words!"), (901, None), (902, ""), (903, "tiny item of odd six words")]
    return docs, items, want


def test_leaks(spark, leaky):
    docs, items, want = leaky
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, cosine string").repartition(3)
    benchmark = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc_id int")
    found = {(r.doc_id, r.item_id) for r in D.find_leaks(frame, benchmark).collect()}
    assert len(want & found) >= 0.95 * len(want) and found - want == {(900, 90)}
    left = D.without_leaks(frame, benchmark)
    assert left.columns == frame.columns and {r.doc_id for r in left.collect()} == {d[0] for d in docs} - {d for d, _ in found}
    none = spark.createDataFrame([], "doc_id long, text string")
    assert D.find_leaks(none, benchmark).count() == 0 and D.find_leaks(frame, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_short_paraphrases(spark):
    """Items of 8 to 15 words with changed, dropped and inserted words, against all items word by word."""
    rng = random.Random(5)
    vocabulary = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ru", "te") for b in ("ban", "dor", "fel", "gim", "sut") for c in "aeiou"]
    common = ["the", "of", "and", "in", "to", "a", "is", "it"]

    def words(n):
        return [rng.choice(common) if rng.random() < 0.4 else rng.choice(vocabulary) + rng.choice(vocabulary) for _ in range(n)]

    items = [(k, words(8 + k % 8)) for k in range(40)]
    docs = []
    for n in range(240):
        own = list(items[n % 40][1])
        for _ in range(len(own) // 5):
            at = rng.randrange(len(own))
            own[at:at + 1] = [words(1), [], [own[at], *words(1)]][n % 3]
        docs.append((n, " ".join(words(rng.randrange(20, 90)) + own + words(rng.randrange(20, 90)))))
    docs += [(1000 + n, " ".join(words(150))) for n in range(100)]
    hashed = D.item_parts([(k, " ".join(w)) for k, w in items])
    want = set()
    for d, text in docs:
        own = D.hashed_words([text.encode()], D.LETTERS)[0]
        want |= {(d, k) for k, w, a in zip(hashed.ids, hashed.words, hashed.answers) if D.is_leak(*D.close_coverage(w, a, own), len(w))}
    assert sum(d < 1000 and k == d % 40 for d, k in want) >= 230 and len(want) < 250
    frame, benchmark = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in D.find_leaks(frame, benchmark).collect()}
    print("recall", len(want & found), "of", len(want))
    assert found <= want and len(want & found) >= 0.95 * len(want)


def test_search_recall_on_documents(spark):
    """Against all items word by word: nothing that holds eight words of an item in a row, and most of it, is missed."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    want = {(d.doc_id, i.item_id) for d in docs for i in items if i.text in d.text}
    found = {(r.doc_id, r.item_id) for r in Q.op2_decontaminate(spark, SF).collect()}
    assert want and len(want & found) >= 0.9 * len(want)
