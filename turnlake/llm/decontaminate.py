"""Benchmark decontamination by latent semantic retrieval.

Documents are read as passages of 32 words, every 16 words. Passages and pieces of benchmark items are
TF-IDF vectors over hashed words; document frequencies are counted over all passages. A randomised
singular value decomposition, computed on the executors, gives a latent space of a few dimensions;
every passage of every document is compared there with every piece by cosine. Candidates are then
checked word by word: the longest common subsequence of the item and the passage's surroundings must
cover the item, or most of it along with its answer, the item's last sentence. Changed, dropped and
inserted words thus don't hide an item.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh
from .vectors import LETTERS, groups_of, hashed_words

HALF = 16  # words; a passage has two halves
BUCKETS, RANK = 1 << 15, 128
COSINE, COVERAGE, WITH_ANSWER, ANSWER = 0.6, 0.8, 0.6, 0.5
#: Items of fewer words than HALF must be covered within half as many words again; of fewer than FEW, wholly.
FEW = 8
#: Items that are searched together; further ones are searched in blocks, in the same space.
BLOCK_ITEMS = 20_000
_STEP, FIT_STEP, ROWS_A_BLOCK = 192 << 10, 400 << 10, 1024
#: Cosines that a task holds at once.
CELLS = 4 << 20
FOUND = "doc_id long, text_hash long, item_id long, coverage double, answer_coverage double, cosine double"


def buckets_of(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(49)).astype(np.int64)


assert 1 << (64 - 49) == BUCKETS <= 1 << 16


def halves_of(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, last word + 1, text) of each run of HALF words of each text; a text's last may be shorter."""
    count = -(-np.diff(offsets) // HALF)
    text = np.repeat(np.arange(len(count)), count)
    first = offsets[:-1][text] + HALF * (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count))
    return first, np.minimum(first + HALF, offsets[1:][text]), text


def half_words(at: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """(HALF, halves): the buckets of each half's words; BUCKETS where a half has fewer."""
    place = first + np.arange(HALF)[:, None]
    return np.where(place < last, at[np.minimum(place, len(at) - 1)], BUCKETS)


def half_sums(table: np.ndarray, words: np.ndarray, rows: int = 512) -> np.ndarray:
    """Sums of the table's rows of each half; the table's last row, of number BUCKETS, is zero.

    Some halves at a time, word by word: what is added up stays in the processor's cache.
    """
    out = np.empty((words.shape[1], table.shape[1]), table.dtype)
    more = np.empty((rows, table.shape[1]), table.dtype)
    for i in range(0, len(out), rows):
        own = out[i:i + rows]
        np.take(table, words[0, i:i + rows], 0, out=own, mode="clip")
        for k in range(1, HALF):
            np.take(table, words[k, i:i + rows], 0, out=more[:len(own)], mode="clip")
            own += more[:len(own)]
    return out


def with_zero(table: np.ndarray) -> np.ndarray:
    return np.concatenate([table, np.zeros((1, *table.shape[1:]), table.dtype)])


def with_next(sums: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Sums over passages from sums over halves: each half with the next one of its text."""
    out = sums.copy()
    if len(out) > 1:
        same = text[:-1] == text[1:]
        out[:-1][same] += sums[1:][same]
    return out


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of HALF words that hold each bucket; the last row of a task, bucket -1, has the number of runs."""
    found, total = np.zeros(BUCKETS, np.int64), 0
    for batch in batches:
        for _, texts in groups_of(batch.column(0).to_pylist(), 1 << 20):
            words, offsets = hashed_words(texts, LETTERS)
            if not len(words):
                continue
            first, last, _ = halves_of(offsets)
            own = np.sort(np.ascontiguousarray(half_words(buckets_of(words), first, last).T, np.int32), 1)
            new = own < BUCKETS
            new[:, 1:] &= own[:, 1:] != own[:, :-1]
            found += np.bincount(own[new], minlength=BUCKETS)
            total += len(first)
    some = np.flatnonzero(found)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1).astype(np.int32)), pa.array(np.append(found[some], total))], ["bucket", "n"])


def inverse_frequencies(docs: DataFrame, text_col: str) -> np.ndarray:
    """ln((N + 1) / (n + 1)) by bucket, 0.1 at least; BUCKETS numbers, whatever the input."""
    counted = docs.select(text_col).mapInArrow(_document_counts, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    found = np.zeros(BUCKETS + 1)
    for r in counted:
        found[r.bucket] = r.n
    return np.maximum(0.1, np.log((found[-1] + 1) / (found[:-1] + 1))).astype(np.float32)


def projection(seed: int = 3, rank: int = RANK) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((BUCKETS, rank), dtype=np.float32)


def sums_by_place(rows: np.ndarray, at: np.ndarray, begin: np.ndarray, few: int = 24) -> np.ndarray:
    """Sums of rows[at] over the runs of `at` that start at begin: the first few of all runs together, the rest run by run."""
    count = np.diff(np.append(begin, len(at)))
    out = np.take(rows, at[begin], 0)
    some = np.flatnonzero(count > 1)
    for k in range(1, few):
        out[some] += np.take(rows, at[begin[some] + k], 0)
        some = some[count[some] > k + 1]
    for j in some.tolist():
        out[j] += np.take(rows, at[begin[j] + few:begin[j] + count[j]], 0).sum(0)
    return out


def _range_parts(idf: np.ndarray, rank: int, rows: int = ROWS_A_BLOCK):
    """Each task's share of A'(A Omega), A holding unit TF-IDF passages, as blocks of rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        omega, squares = with_zero(projection(rank=rank) * idf[:, None]), with_zero(idf ** 2)
        total = np.zeros((BUCKETS, rank))
        count = 0
        for batch in batches:
            for _, texts in groups_of(batch.column(0).to_pylist(), FIT_STEP):
                words, offsets = hashed_words(texts, LETTERS)
                if not len(words):
                    continue
                at = buckets_of(words)
                first, last, text = halves_of(offsets)
                own_words = half_words(at, first, last)
                along = with_next(half_sums(omega, own_words), text)
                norm = with_next(squares[own_words].sum(0), text)
                along /= np.maximum(norm, 1e-6)[:, None]
                back = along.copy()  # a half belongs to the passage that it begins and to the one before
                same = text[1:] == text[:-1]
                back[1:][same] += along[:-1][same]
                order = np.argsort(at.astype(np.uint16), kind="stable")
                own = at[order]
                begin = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                total[own[begin]] += sums_by_place(back, np.repeat(np.arange(len(first)), last - first)[order], begin)
                count += len(first)
        total = (total * idf[:, None]).astype(np.float32)
        n = BUCKETS // rows
        yield pa.RecordBatch.from_arrays([
            pa.array(np.arange(n, dtype=np.int32)), pa.array([count] + [0] * (n - 1), pa.int64()),
            pa.array([total[i * rows:(i + 1) * rows].tobytes() for i in range(n)], pa.binary()),
        ], ["block", "passages", "part"])

    return run


def _sum_parts(rows: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(p.as_py(), np.float32).astype(np.float64) for p in rows["part"])
    return pa.table({"block": rows["block"][:1], "passages": [sum(rows["passages"].to_pylist())], "part": [total.astype(np.float32).tobytes()]})


def unit_rows(buckets: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
    out = np.zeros((len(buckets), BUCKETS), np.float32)
    for row, b in zip(out, buckets):
        np.add.at(row, b, idf[b])
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def range_of(texts: DataFrame, idf: np.ndarray, text_col: str, rank: int) -> tuple[np.ndarray, int]:
    """(A'(A Omega), rows of A), A holding the passages of all texts.

    A task sends one BUCKETS x rank matrix to be summed, however many texts it has, so tasks read several partitions each:
    twice as many tasks as run at once. Only the sum reaches the driver.
    """
    schema = "block int, passages long, part binary"
    tasks = 2 * texts.sparkSession.sparkContext.defaultParallelism
    parts = texts.select(text_col).coalesce(tasks).mapInArrow(_range_parts(idf, rank), schema)
    y, passages, step = np.zeros((BUCKETS, rank), np.float32), 0, ROWS_A_BLOCK  # texts without partitions have no blocks
    for r in parts.groupBy("block").applyInArrow(_sum_parts, schema).collect():
        y[r.block * step:(r.block + 1) * step] = np.frombuffer(r.part, np.float32).reshape(-1, rank)
        passages += r.passages
    return y, passages


def latent_space(rows: DataFrame, items: DataFrame, idf: np.ndarray, text_col: str, rank: int = RANK) -> np.ndarray | None:
    """Right singular vectors (BUCKETS x rank) of the passages of all rows and all items; the items' weigh as much as the
    rows' together: so the space tells items apart. None if no item has words."""
    more, pieces = range_of(items, idf, text_col, rank)
    if not pieces:
        return None
    y, passages = range_of(rows, idf, text_col, rank)
    y += np.float32(max(1, passages) / pieces) * more
    del more
    omega = projection(rank=rank)
    values, vectors = spectrum(omega, y)
    del omega
    half = y @ (vectors / np.sqrt(values)).astype(np.float32)
    del y
    values, vectors = spectrum(half, half)
    return half @ (vectors / np.sqrt(values)).astype(np.float32)


def spectrum(a: np.ndarray, b: np.ndarray, rows: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues that matter, and their vectors, of the symmetric product a'b, summed in double precision."""
    core = sum(a[i:i + rows].T.astype(np.float64) @ b[i:i + rows] for i in range(0, len(a), rows))
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > values.max() * 1e-7
    return values[good], vectors[:, good]


@dataclass
class Items:
    """Benchmark items as hashed words; pieces of at most 2 * HALF words with their items."""

    ids: list[int]
    words: list[np.ndarray]
    answers: list[np.ndarray]
    pieces: list[np.ndarray]
    piece_item: np.ndarray


def item_parts(rows: list[tuple[int, str]]) -> Items:
    ids, words, answers, pieces, of = [], [], [], [], []
    for i, text in rows:
        text = text or ""
        own = hashed_words([text.lower().encode("utf-8", "replace")], LETTERS)[0]
        if not len(own):
            continue
        sentences = [s for s in re.split(r"[.?!:]\s+|\n", text.strip()) if s.strip(" .?!")]
        last = hashed_words([sentences[-1].lower().encode("utf-8", "replace")], LETTERS)[0] if len(sentences) > 1 else own[:0]
        for k in range(0, max(1, len(own) - HALF), HALF):
            pieces.append(buckets_of(own[k:k + 2 * HALF]))
            of.append(len(ids))
        ids.append(i)
        words.append(own)
        answers.append(last)
    return Items(ids, words, answers, pieces, np.array(of, np.int64))


def items_of(rows: DataFrame) -> Items:
    """The items of some (item, text) rows, in the order of their ids, whatever order the rows have."""
    return item_parts(sorted(((r.item, r.text) for r in rows.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")))


def common_subsequence(item: np.ndarray, text: np.ndarray) -> int:
    """Length of the longest common subsequence, a bit of one integer for each word of the item."""
    places: dict[int, int] = {}
    for k, w in enumerate(item.tolist()):
        places[w] = places.get(w, 0) | 1 << k
    full = (1 << len(item)) - 1
    row = full
    for w in text.tolist():
        hit = row & places.get(w, 0)
        if hit:
            row = (row + hit | row - hit) & full
    return len(item) - row.bit_count()


def coverage(item: np.ndarray, answer: np.ndarray, text: np.ndarray, counts: dict[int, int] | None = None) -> tuple[float, float]:
    """(share of the item, share of its answer) in the longest common subsequences; (0, 0) if even the
    words without their order are too few. counts: how often the item holds each of its words."""
    counts = Counter(item.tolist()) if counts is None else counts
    if sum(map(counts.__getitem__, counts.keys() & set(text.tolist()))) < WITH_ANSWER * len(item):
        return 0.0, 0.0
    return common_subsequence(item, text) / len(item), (common_subsequence(answer, text) / len(answer) if len(answer) else 0.0)


def close_coverage(item: np.ndarray, answer: np.ndarray, text: np.ndarray, counts: dict[int, int] | None = None) -> tuple[float, float]:
    """coverage() of a short item by the best run of half as many words again: few words stand in order by chance
    somewhere in a passage, but seldom close together."""
    counts = Counter(item.tolist()) if counts is None else counts
    size = len(item) + len(item) // 2
    held = np.flatnonzero(np.isin(text, item))
    found = [coverage(item, answer, text[k:k + size], counts) for k in held.tolist()]
    # of the runs, one that makes a leak counts before one that covers more without the answer
    return max(found, key=lambda f: (is_leak(*f, len(item)), f), default=(0.0, 0.0))


def is_leak(cover: float, answer: float, size: int = HALF) -> bool:
    """Whether an item of so many words counts as held; of fewer than FEW, all words must be there."""
    if size < FEW:
        return cover >= 1.0
    return cover >= COVERAGE or cover >= WITH_ANSWER and answer >= ANSWER


def _search(space, cosine: float):
    """space: broadcast (idf times the right singular vectors, unit latent pieces, fields of the Items)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, targets, fields = space.value
        items = Items(*fields)
        # A piece that fills only part of a passage meets it with other words around it.
        needed = cosine * np.array([min(1.0, len(p) / (2 * HALF)) ** 0.25 for p in items.pieces], np.float32)
        counts = [dict(Counter(w.tolist())) for w in items.words]
        short = [k for k, w in enumerate(items.words) if len(w) < HALF]
        for batch in batches:
            ids, hashes, out = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for base, texts in groups_of(batch.column(2).to_pylist(), _STEP):
                words, offsets = hashed_words(texts, LETTERS)
                if not len(words):
                    continue
                best: dict[tuple[int, int], tuple] = {}

                def verify(text: int, item: int, first: int, last: int, near: float) -> None:
                    known = best.get((text, item))
                    if known and known[0] >= 1.0:
                        return
                    own = items.words[item]
                    lo, hi = max(offsets[text], first - len(own)), min(offsets[text + 1], last + len(own))
                    cover, answer = (close_coverage if len(own) < HALF else coverage)(own, items.answers[item], words[lo:hi], counts[item])
                    if is_leak(cover, answer, len(own)) and (known is None or (cover, answer) > known[:2]):
                        best[text, item] = (cover, answer, near)

                at = buckets_of(words)
                first, last, text = halves_of(offsets)
                # a long text alone may exceed the step: halves are worked through some at a time
                for lo in range(0, len(first), 4000):
                    hi = min(len(first), lo + 4001)  # one more, for the last passage's second half
                    latent = with_next(half_sums(vectors, half_words(at, first[lo:hi], last[lo:hi])), text[lo:hi])[:min(4000, len(first) - lo)]
                    norms = np.sqrt(np.einsum("ij,ij->i", latent, latent))
                    some = max(1, CELLS // len(latent))
                    for p0 in range(0, len(targets), some):
                        near = latent @ targets[p0:p0 + some].T
                        for h, p in zip(*np.nonzero(near > norms[:, None] * needed[p0:p0 + some])):
                            k = lo + h
                            verify(int(text[k]), int(items.piece_item[p0 + p]), int(first[k]), int(last[k]) + HALF, float(near[h, p] / max(norms[h], 1e-9)))
                for k in short:  # a few words may have too low a cosine: beside the search, the words themselves, in their order
                    own = items.words[k]
                    if len(words) < len(own):
                        continue
                    equal = words[:len(words) - len(own) + 1] == own[0]
                    for j in range(1, len(own)):
                        equal &= words[j:len(words) - len(own) + 1 + j] == own[j]
                    for w in np.flatnonzero(equal):
                        t = int(np.searchsorted(offsets, w, "right")) - 1
                        if w + len(own) <= offsets[t + 1]:
                            best[t, k] = (1.0, 1.0, 1.0)
                out += [(ids[base + t], hashes[base + t], items.ids[k], *v) for (t, k), v in best.items()]
            yield pa.RecordBatch.from_arrays([
                pa.array([o[n] for o in out], kind) for n, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()))
            ], ["doc_id", "text_hash", "item_id", "coverage", "answer_coverage", "cosine"])

    return run


def leaking_rows(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", cosine: float = COSINE, rank: int = RANK, fit_items: int | None = None, block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """find_leaks() with text_hash, xxhash64 of the text, beside doc_id: so rows that repeat an id are told apart.

    The space is fitted once, on all passages of all documents and items (of fit_items of these, if a caller says so). Every item is searched in it, a bounded number of them at a time, which the driver holds and
    sends to the tasks; what is found doesn't depend on that number.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    known = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text"))
    n_docs = rows.count()
    size = known.count() if n_docs else 0
    if not size:
        return spark.createDataFrame([], FOUND)
    idf = inverse_frequencies(rows, "text")
    fitted = known if fit_items is None or size <= fit_items else known.where(F.col("text").rlike(r"[0-9A-Za-z\x{80}-\x{10FFFF}]")).orderBy(F.xxhash64("text"), "text", "item").limit(fit_items)
    axes = latent_space(rows, fitted, idf, "text", rank)
    if axes is None:
        return spark.createDataFrame([], FOUND)
    vectors = with_zero(axes * idf[:, None])
    blocks = -(-size // block_items)
    scratch, out = Scratch(spark, "leaks"), None
    for block in range(blocks):
        items = items_of(known if blocks == 1 else known.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block))
        if not items.pieces:
            continue
        targets = np.concatenate([unit_rows(items.pieces[i:i + 32], idf) @ axes for i in range(0, len(items.pieces), 32)])
        targets /= np.maximum(np.linalg.norm(targets, axis=1, keepdims=True), 1e-9)
        fields = (items.ids, items.words, items.answers, items.pieces, items.piece_item)
        space = spark.sparkContext.broadcast((vectors, targets, fields))  # BUCKETS x rank numbers, and block_items items with their pieces
        if blocks == 1:
            del axes, vectors
        del targets, fields
        found = scratch.table(rows.mapInArrow(_search(space, cosine), FOUND))
        space.destroy()
        out = found if out is None else out.union(found)
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, item_id, coverage, answer_coverage, cosine): documents that hold a benchmark item.

    Items are found in the latent space and checked word by word; those of fewer than 16 words must be
    covered within half as many words again, those of fewer than 8 wholly, and also count wherever their
    words stand side by side. Of several places that hold an item the one that covers most counts, then the
    one that covers more of the answer, then the first. Defined results: null and empty texts hold nothing,
    items without words are found nowhere; texts of any length are searched whole; repeated rows are found
    each; ids may be null; empty tables give an empty one; other columns are ignored.
    """
    return leaking_rows(docs, benchmark, id_col, text_col, **options).drop("text_hash")


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that hold no benchmark item, with all their columns.

    Rows go by their own id and text: another row that shares a leaking row's id stays, and a leaking row
    without an id goes.
    """
    leak_id, leak_hash = fresh(docs.columns, "leaked_id"), fresh(docs.columns, "leaked_hash")
    leaks = leaking_rows(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias(leak_id), F.col("text_hash").alias(leak_hash)).distinct()
    same = F.col(id_col).cast("long").eqNullSafe(F.col(leak_id)) & (F.xxhash64(text_col) == F.col(leak_hash))
    return docs.join(leaks, same, "left_anti")
