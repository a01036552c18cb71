"""Collocations of each language, mined by suffix sorting.

At every word of a text stands a suffix, cut to max_n words and to its piece. Suffixes are dealt by language and first
word, in ranges of their order, so that a frequent first word (or phrase) spans several tasks. Each task reads its range
in reverse order and counts all prefixes with one stack of max_n + 1 counts: a prefix is complete once it leaves the
stack. Suffixes whose first two words are too rare together reach it as so many of their first word. Only those at either end of a range may go on in another task; these are given as they are and summed, of all
others only those that reach least_count leave the task. Scores come from joins of the counts with those of their parts.

A key is the language and the words, with NUL between, which sorts before all else; words that hold NUL or SOH are
escaped, so that keys sort as their lists of words do.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: What parts pieces, and what parts words within one (a space besides).
PIECE_MARKS = r"[.,;:!?\n\x0b\f\r]+"
#: Bytes of text, words, and rows that a task handles at once.
SLICE_BYTES, SLICE_WORDS, FLUSH_ROWS = 4 << 20, 200_000, 600_000
COUNTS = "key string, n long"


def escape(words: pa.Array) -> pa.Array:
    """Words without NUL, told apart as before and in the same order."""
    return pc.replace_substring(pc.replace_substring(words, "\x01", "\x01\x02"), "\x00", "\x01\x01")


def unescaped(words: Column) -> Column:
    return F.replace(F.replace(words, F.lit("\x01\x01"), F.lit("\x00")), F.lit("\x01\x02"), F.lit("\x01"))


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of about `most` bytes of text, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False) + 1)
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def suffix_keys(langs: pa.Array, texts: pa.Array, max_n: int, most_words: int = SLICE_WORDS) -> Iterator[pa.Array]:
    """Keys of the suffixes at all words of some texts."""
    text = escape(pc.ascii_lower(pc.fill_null(texts, "")))
    text = pc.replace_substring(pc.replace_substring_regex(text, PIECE_MARKS, " \n "), "\t", " ")
    listed = pc.split_pattern(pc.binary_join_element_wise(text, "\n", " "), " ")
    of, words = pc.list_parent_indices(listed), pc.list_flatten(listed)
    full = pc.not_equal(words, "")
    of, words = of.filter(full).to_numpy(), words.filter(full)
    ends = pc.equal(words, "\n").to_numpy(zero_copy_only=False)
    piece, langs = np.cumsum(ends), escape(pc.fill_null(langs, "und"))
    at = np.flatnonzero(~ends)
    for i in range(0, len(at), most_words):
        own = at[i:i + most_words]
        columns = [langs.take(pa.array(of[own])), words.take(pa.array(own))]
        for k in range(1, max_n):
            there = np.minimum(own + k, len(ends) - 1)
            columns.append(words.take(pa.array(there, mask=piece[there] != piece[own])))
        yield pc.binary_join_element_wise(*columns, "\x00", null_handling="skip")


def _sampled_keys(max_n: int, stride: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                for keys in suffix_keys(part.column("lang"), part.column("text"), max_n):
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(np.arange(0, len(keys), stride)))], ["key"])

    return run


def range_bounds(docs: DataFrame, max_n: int, parts: int) -> list[str]:
    """parts - 1 keys that part the suffixes of a bounded sample of documents evenly. They decide which task counts what,
    not what is counted."""
    documents, stride = 2000 + min(8 * parts, 80_000), 32
    share = min(1.0, documents / max(1, docs.count()))
    keys = sorted(r.key for r in docs.sample(share, 1).mapInArrow(_sampled_keys(max_n, stride), "key string").collect())
    return [keys[len(keys) * i // parts] for i in range(1, parts)] if keys else []


def _summed(chunks: list[pa.Array], bounds: list[str]) -> Iterator[pa.RecordBatch]:
    """(range, key, n), in reverse order: what is nearly sorted packs better and is sorted faster."""
    found = pa.table({"key": pa.chunked_array(chunks, pa.string())}).group_by("key").aggregate([([], "count_all")])
    keys = found["key"].combine_chunks()
    order = pc.array_sort_indices(keys, order="descending")
    keys, counts = keys.take(order), found["count_all"].combine_chunks().take(order)
    ends = [bisect.bisect_left(range(len(keys)), True, key=lambda i: keys[i].as_py() <= bound) for bound in reversed(bounds)]
    place = len(bounds) - np.searchsorted(np.array(ends, np.int64), np.arange(len(keys)), "right")
    batch = pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), keys, counts], ["range", "key", "n"])
    for i in range(0, len(keys), 50_000):
        yield batch.slice(i, 50_000)


def _suffixes(max_n: int, bounds: list[str]):
    """(lang, text) -> (range, key, n): equal suffixes of a task are counted before they are shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                for keys in suffix_keys(part.column("lang"), part.column("text"), max_n):
                    held.append(keys)
                    rows += len(keys)
                    if rows >= FLUSH_ROWS:
                        yield from _summed(held, bounds)
                        held, rows = [], 0
        if rows:
            yield from _summed(held, bounds)

    return run


def prefix_counts(rows: Iterator[tuple[str, int]], least: int) -> Iterator[tuple[str, int]]:
    """(prefix, n) of keys in reverse order: each prefix that reaches least, and those that the first or last key begins
    with, whatever they reach."""
    words: list[str] = []
    counts: list[int] = []
    edge = None  # so many words of the stack begin the first key too
    for key, n in rows:
        parts = key.split("\x00")
        common, most = 0, min(len(words), len(parts))
        while common < most and words[common] == parts[common]:
            common += 1
        while len(words) > common:
            c = counts.pop()
            if c >= least or len(words) <= edge:
                yield "\x00".join(words), c
            words.pop()
            if counts:
                counts[-1] += c
        edge = len(parts) if edge is None else min(edge, common)
        words += parts[common:]
        counts += [0] * (len(parts) - common)
        counts[-1] += n
    while words:
        c = counts.pop()
        yield "\x00".join(words), c
        words.pop()
        if counts:
            counts[-1] += c


def collapsed(keys: pa.Array, counts: np.ndarray, pairs: pa.Array, least: int) -> tuple[pa.Array, np.ndarray]:
    """The rows with those of rare pairs of words put together, as so many of their first word. pairs are the keys up to
    the second word; what may go on beyond either end stays as it is."""
    starts = np.concatenate([[0], 1 + np.flatnonzero(pc.not_equal(pairs[1:], pairs[:-1]).to_numpy(zero_copy_only=False))])
    sums = np.add.reduceat(counts, starts)
    rare = sums < least
    rare[[0, -1]] = False
    if not rare.any():
        return keys, counts
    runs = np.flatnonzero(rare)
    heads = pc.replace_substring_regex(pairs.take(pa.array(starts[runs])), r"^([^\x00]*\x00[^\x00]*)\x00[^\x00]*$", r"\1")
    new = np.concatenate([[True], (np.diff(runs) > 1) | pc.not_equal(heads[1:], heads[:-1]).to_numpy(zero_copy_only=False)])
    first = np.flatnonzero(new)
    kept = np.flatnonzero(~np.repeat(rare, np.diff(np.append(starts, len(counts)))))
    order = np.argsort(np.concatenate([kept, starts[runs[first]]]), kind="stable")
    all_keys = pa.concat_arrays([keys.take(pa.array(kept)), heads.take(pa.array(first))])
    return all_keys.take(pa.array(order)), np.concatenate([counts[kept], np.add.reduceat(sums[runs], first)])[order]


def _prefixes(least: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int]]:
        for b in batches:
            if b.num_rows:
                keys, counts = collapsed(b.column(0), b.column(1).to_numpy(), b.column(2), least)
                yield from zip(keys.to_pylist(), counts.tolist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [], []
        for key, n in prefix_counts(rows(batches), least):
            keys.append(key)
            counts.append(n)
            if len(keys) >= 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(counts, pa.int64())], ["key", "n"])
                keys, counts = [], []
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(counts, pa.int64())], ["key", "n"])

    return run


def phrase_counts(docs: DataFrame, max_n: int, least: int) -> DataFrame:
    """(key, words, f) of the phrases that reach least, and of each language (0 words) the number of its words."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = range_bounds(docs, max_n, parts)
    suffixes = docs.mapInArrow(_suffixes(max_n, bounds), "range int, key string, n long")
    dealt = suffixes.repartitionById(parts, "range").select("key", "n").sortWithinPartitions(F.col("key").desc())
    pairs = dealt.withColumn("pair", F.substring_index("key", "\x00", 3))
    counted = pairs.mapInArrow(_prefixes(least), COUNTS).groupBy("key").agg(F.sum("n").alias("f"))
    words = F.size(F.split("key", "\x00")) - 1
    return counted.withColumn("words", words).where((F.col("f") >= least) | (F.col("words") == 0))


def joined(parts: Column, start: Column, length: Column) -> Column:
    """The key of the words start (from 1) and on; parts are the language and the words."""
    return F.array_join(F.concat(F.slice(parts, 1, 1), F.slice(parts, start + 1, length)), "\x00")


def collocations(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", max_n: int = 5, least_count: int = 100, top: int = 2000, absorb_pct: int = 100,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the top phrases of 2 to max_n words of each language.

    a phrase's score is floor(1000 a n / (l r)) at its lowest-scoring cut into l and r; phrases that a longer one holds
    are left out where that is absorb_pct hundredths as frequent at least. Sums and products are exact.

    Defined results: a null language is `und`, as a language of that name; null and empty texts have no words;
    repeated rows count each time; texts of any length are taken whole; a piece may be of any length; of cuts with one
    score the first counts; phrases of one score and count go by their bytes; an empty table gives an empty one; other
    columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "collocations")
    counts = scratch.table(phrase_counts(docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")), max_n, least_count))
    parts = F.col("parts")
    known = counts.where("words > 0").select("key", "f")
    phrases = counts.where("words > 1").withColumn("parts", F.split("key", "\x00"))

    held = phrases.where("words > 2").select(
        "f", F.explode(F.expr("flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), s -> struct(s AS s, m AS m))))")).alias("at"), "parts")
    longer = held.select(joined(parts, F.col("at.s"), F.col("at.m")).alias("key"), "f").groupBy("key").agg(F.max("f").alias("longer"))
    left = phrases.join(longer, "key", "left").where(F.coalesce(100 * F.col("longer") < absorb_pct * F.col("f"), F.lit(True)))

    cut = left.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cut = cut.withColumn("l_key", joined(parts, F.lit(1), F.col("cut"))).withColumn("r_key", joined(parts, F.col("cut") + 1, F.col("words")))
    cut = cut.join(known.select(F.col("key").alias("l_key"), F.col("f").alias("l")), "l_key").join(known.select(F.col("key").alias("r_key"), F.col("f").alias("r")), "r_key")
    of_lang = counts.where("words = 0").select(F.col("key").alias("lang"), F.col("f").alias("n"))
    cut = cut.withColumn("lang", parts[0]).join(of_lang, "lang")
    whole = lambda c: F.col(c).cast("decimal(18,0)")
    cut = cut.withColumn("over", (whole("f") * 1000).cast("decimal(21,0)") * whole("n").cast("decimal(16,0)")).withColumn("under", whole("l") * whole("r"))
    scored = cut.groupBy("key").agg(
        F.min(F.struct(F.expr("over div under").alias("score"), "cut", "l", "r")).alias("low"), F.first("lang").alias("lang"), F.first("parts").alias("parts"), F.first("f").alias("a"), F.first("n").alias("n"))
    plain = scored.select(
        unescaped(F.col("lang")).alias("lang"), F.expr("array_join(slice(parts, 2, size(parts) - 1), ' ')").alias("words"), "a", F.col("low.l").alias("l"), F.col("low.r").alias("r"), "n", F.col("low.score").alias("score"))
    plain = plain.withColumn("phrase", unescaped(F.col("words")))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    some = plain.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    few = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
