"""The pipeline against a plain version of its stages."""

import duckdb
import pytest

import corpus_pipeline
from tests.llm.test_duplicates import brute
from turnlake.llm import decontaminate as D
from turnlake.llm import queries as Q
from turnlake.llm import toxicity as X
from turnlake.llm.vectors import LETTERS, hashed_words

FOLDER = "/root/testdata/sf0.001"


def words(text):
    return hashed_words([(text or "").lower().encode()], LETTERS)[0]


@pytest.fixture(scope="module")
def plain(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    lexicon = Q.toxicity_lexicon(spark, spark.read.parquet(f"{FOLDER}/documents.parquet"), FOLDER)
    automaton = lexicon.automaton()
    clean = []
    for d in docs:
        folded = X.fold(d[1] or "")
        z = lexicon.slope * X.density(X.matches(folded, automaton)[0], folded.count(" ")) + lexicon.bias
        if 1 / (1 + 2.718281828459045 ** -z) < 0.7:
            clean.append(d)
    clean.sort()
    classes = brute([d[1] for d in clean])
    kept = [d for i, d in enumerate(clean) if classes[i] == i]
    items = [words(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    out = []
    for d in kept:
        own = words(d[1])
        best = 0.0
        for item in items:  # every window of every item's length, word by word
            for at in range(0, max(1, len(own)), 16):
                best = max(best, D.common_subsequence(item, own[at:at + 2 * len(item)]) / len(item))
        if best < D.COVERAGE:
            out.append(d)
    return docs, clean, kept, out


def test_stages(spark, plain):
    docs, clean, kept, without = plain
    frame = spark.read.parquet(f"{FOLDER}/documents.parquet")
    stages = [f for _, f in corpus_pipeline.STAGES]
    found = stages[0](spark, frame, FOLDER)
    assert found.columns == frame.columns and {r.doc_id for r in found.collect()} == {d[0] for d in clean}
    found = stages[1](spark, spark.createDataFrame(clean, frame.schema), FOLDER)
    assert found.columns == frame.columns and sorted(r.doc_id for r in found.collect()) == [d[0] for d in kept]
    found = stages[2](spark, spark.createDataFrame(kept, frame.schema), FOLDER)
    assert found.columns == frame.columns and sorted(r.doc_id for r in found.collect()) == [d[0] for d in without]
    found = stages[3](spark, spark.createDataFrame(without, frame.schema), FOLDER)
    database = duckdb.connect()
    database.register("documents", spark.createDataFrame(without, frame.schema).toPandas())
    want = {r[0]: r[1] for r in database.execute(f"SELECT doc_id, CASE WHEN size = 0 THEN -1 ELSE taken // size END FROM ({Q.OP10_SQL})").fetchall()}
    have = {r.doc_id: r["count"] for r in found.groupBy("doc_id").count().collect()}
    assert found.columns == frame.columns and all(have.get(i, 0) == n for i, n in want.items() if n >= 0)


def test_run(spark):
    found = corpus_pipeline.run(spark, FOLDER)
    rows = found.collect()
    assert rows and set(found.columns) == {"doc_id", "text", "lang", "source", "n_chars", "shard", "slot"}
    for k in range(corpus_pipeline.SHARDS):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights", "sharding"]


def test_stages_on_odd_tables(spark):
    """Nulls in any column, empty and repeated rows, ids that repeat with other texts, clashing names, no rows."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, id long, shard string, slot string, size string, class_id string"
    tail = (None, 7, "s", None, "z", None)
    rows = [(1, "plain words of a text", "en", "web", 21, *tail), (1, "plain words of a text", "en", "web", 21, *tail), (1, "something else than that", None, None, None, *tail),
            (None, "no id at all here", "en", None, 3, *tail), (2, None, None, "web", None, *tail), (3, "", "en", "web", 0, *tail), (4, " \n ", "en", "web", 0, *tail),
            (5, "plain words of a text", "en", "news", 21, *tail)]
    docs = spark.createDataFrame(rows, schema)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, FOLDER)
        assert set(docs.columns) <= set(found.columns)
        kept[name] = sorted(((r.doc_id, r.text) for r in found.collect()), key=repr)
        assert stage(spark, docs.limit(0), FOLDER).count() == 0
    every = sorted(((r[0], r[1]) for r in rows), key=repr)
    assert kept["toxicity"] == kept["benchmark decontamination"] == kept["sharding"] == every
    assert kept["n-gram Jaccard join"] == sorted((x for x in every if x[0] != 5), key=repr)
    assert set(kept["mixing sources to target weights"]) <= set(every)


def test_leaks_go_by_their_own_text(spark):
    """A clean row that shares a leaking row's id stays; a leaking row without an id goes."""
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").orderBy("item_id").first().text
    rows = [(1, f"before it {item} after it", "a"), (1, "a clean row of that id", "b"), (None, item, "c"), (None, "clean too", "d"), (2, "x " * 30_000 + item, "e"), (2, "x " * 30_000 + item, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, leaked_id string")
    left = D.without_leaks(docs, spark.read.parquet(f"{FOLDER}/benchmark.parquet"))
    assert left.columns == docs.columns and sorted(r.leaked_id for r in left.collect()) == ["b", "d"]


def test_blocks_of_items_find_the_same(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    pairs = lambda **of: {(r.doc_id, r.item_id, r.coverage): r.cosine for r in D.find_leaks(docs, items, **of).collect()}
    whole, blocks = pairs(), pairs(block_items=7)
    assert whole.keys() == blocks.keys() and whole and all(abs(whole[k] - blocks[k]) < 1e-4 for k in whole)
    few = pairs(fit_items=10)
    assert len(few.keys() & whole.keys()) >= 0.9 * len(whole) and {k[:2] for k in few} <= {k[:2] for k in whole}
