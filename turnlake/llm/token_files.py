"""Token ids in Parquet list columns that can be read selectively.

Documents are dealt by ranges of their id, encoded, and written in ascending order: one file a range,
ids in a list column with dictionary or delta encoding, small row groups and pages, and page indexes,
so that a filter on doc_id reads few pages and metadata is read without any token.
"""

from __future__ import annotations

import json
import re
import sys
import types
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path

#: Pieces whose ids a Python worker keeps; when full, it starts anew.
CACHED_WORDS = 300_000
#: Files whose totals, two numbers a file, are broadcast; with more, Spark chooses the join.
BROADCAST_FILES = 200_000
FILE_OPTIONS = {
    "compression": "zstd", "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "true",
    "parquet.block.size": str(32 << 20), "parquet.page.size": str(256 << 10), "parquet.page.row.count.limit": "2000",
    "parquet.dictionary.page.size": str(1 << 20), "parquet.columnindex.truncate.length": "64",
}


#: Letters and digits up to U+017F, and what the tokenizer's pre-tokenizer splits by, spelt out for these;
#: fixed values of Unicode and of the tokenizer file.
LETTER, DIGIT = r"a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f", r"0-9\xb2\xb3\xb9\xbc-\xbe"
SPLIT = re.compile(rf"[{LETTER}]+|'(?:s|t|re|ve|m|ll|d)|[{DIGIT}]|[^\s{LETTER}{DIGIT}]+")
#: Beyond these characters, normalisation or lower case may take more than a character at a time.
UNUSUAL = re.compile("[^\x01-\x1b\x20-\u012f\u0131-\u017f]|<\\|")
#: The settings of a tokenizer file that the pieces above are made for; fixed values of the tokenizer file.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PRE_TOKENIZERS = [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
RAW = "\0"
#: Byte-level tokenizers show a byte as a printable character: itself where it is one, else the next from U+0100 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
SHOWN = {b: b for b in _PRINTED} | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}


class Places(dict):
    """Numbers words as they come; new are those that came since it was last emptied, in their order."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        place = self[word] = len(self)
        self.new.append(word)
        return place


def takes_pieces(settings: dict) -> bool:
    """Whether a tokenizer file's settings are those that pieces are made for: then a text's ids are its pieces' ids."""
    normal, split, model = (settings.get(k) or {} for k in ("normalizer", "pre_tokenizer", "model"))
    added = all(a["content"].startswith("<|") and not a["normalized"] for a in settings.get("added_tokens") or [])
    return (
        normal.get("normalizers") == NORMALIZERS and split.get("pretokenizers") == PRE_TOKENIZERS and model.get("type") == "BPE"
        and not model.get("dropout") and added and not settings.get("truncation") and not settings.get("padding"))


def ended(lists: list[list[int]], end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, ids) of all lists, end_id after each."""
    offsets = np.cumsum([0] + [len(x) + 1 for x in lists]).astype(np.int32)
    return offsets, np.fromiter(chain.from_iterable(chain(x, (end_id,)) for x in lists), np.int32, int(offsets[-1]))


class TextEncoder:
    """Ids of whole texts by the library alone, for any tokenizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def encode(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        return ended([e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)], end_id)


class WordEncoder:
    """Ids of whole texts from the library's ids of their pieces, each of which is encoded once.

    For tokenizers that lower texts, split them by SPLIT and drop white space: ids of a text are those of
    its pieces, one after another. Words with unusual characters go to the library as they are.
    """

    def __init__(self, path: str, cached: int = CACHED_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), cached
        self.tokenize = self.tokenizer.model.tokenize
        self._start()

    def _start(self) -> None:
        self.place, self.known = Places(), 0
        self.flat, self.starts, self.used = np.empty(1 << 16, np.int32), np.zeros(1 << 14, np.int64), 0

    def _learn(self, words: list[str]) -> None:
        """Appends the ids of new words; starts[k] to starts[k + 1] are the k-th word's."""
        for i in range(0, len(words), 2000):
            part = words[i:i + 2000]
            found = [self._ids(w) for w in part]
            ids = np.fromiter((x for f in found for x in f), np.int32)
            known = self.known
            if self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.empty(len(self.flat) + len(ids), np.int32)])
            if known + len(part) + 1 > len(self.starts):
                self.starts = np.concatenate([self.starts, np.zeros(len(self.starts) + len(part), np.int64)])
            self.flat[self.used:self.used + len(ids)] = ids
            self.starts[known + 1:known + 1 + len(part)] = self.used + np.cumsum([len(f) for f in found])
            self.known += len(part)
            self.used += len(ids)

    def _ids(self, piece: str) -> list[int]:
        if piece[0] == RAW:
            return self.tokenizer.encode(piece[1:], add_special_tokens=False).ids
        shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(SHOWN)
        return [t.id for t in self.tokenize(shown)]

    def encode(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of all texts, end_id after each."""
        if len(self.place) > self.most:
            self._start()
        parts = [_words(t) for t in texts]
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        at = np.fromiter(map(self.place.__getitem__, chain.from_iterable(parts)), np.int64, int(counts.sum()))
        if self.place.new:
            try:
                self._learn(self.place.new)
            except BaseException:
                self._start()  # numbers without ids must not stay for this process's next task
                raise
            self.place.new = []
        n = self.starts[at + 1] - self.starts[at]
        inner = np.cumsum(n)
        total = int(inner[-1]) if len(inner) else 0
        body = self.flat[np.arange(total) + np.repeat(self.starts[at] - (inner - n), n)]
        ends = np.concatenate([[0], inner])[np.cumsum(counts)]  # ids of all texts up to each, without end ids
        ids = np.insert(body, ends, np.int32(end_id)).astype(np.int32)
        offsets = np.concatenate([[0], ends + np.arange(1, len(texts) + 1)]).astype(np.int32)
        return offsets, ids


def _words(text: str) -> list[str]:
    """The pieces of a text; a word with unusual characters is one piece, after RAW."""
    usual = not any(x in text for x in ("<|", "\0", "\x1c", "\x1d", "\x1e", "\x1f")) if text.isascii() else not UNUSUAL.search(text)
    if usual:
        return SPLIT.findall(text.lower())
    return [p for w in re.split(r"[\x20\x09-\x0D]+", text) if w for p in ([RAW + w] if UNUSUAL.search(w) else SPLIT.findall(w.lower()))]


def pieces(texts: list[str | None], most: int) -> Iterator[list[str]]:
    """Consecutive texts, most characters together or a single one."""
    out, size = [], 0
    for t in texts:
        t = t or ""
        if out and size + len(t) > most:
            yield out
            out, size = [], 0
        out.append(t)
        size += len(t)
    if out:
        yield out


def encoder_of(path: str) -> WordEncoder | TextEncoder:
    """The encoder that this process keeps from task to task: by pieces where the tokenizer file allows it."""
    kept = sys.modules.setdefault("turnlake_kept", types.ModuleType("turnlake_kept")).__dict__.setdefault("encoders", {})
    if path not in kept:
        kept.clear()
        with open(path, encoding="utf-8") as file:
            settings = json.load(file)
        kept[path] = (WordEncoder if takes_pieces(settings) else TextEncoder)(path)
    return kept[path]


def _encode(path: str, end_id: int, most: int = 1 << 19, rows: int = 500):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, place = encoder_of(path), 0
        for whole in batches:
            for first in range(0, whole.num_rows, rows):
                batch = whole.slice(first, rows)
                at = 0
                for texts in pieces(batch.column(1).to_pylist(), most):
                    offsets, ids = encoder.encode(texts, end_id)
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
                    places = pa.array(np.arange(place, place + len(texts), dtype=np.int64))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), places, pa.array(np.diff(offsets).astype(np.int64)), lists], ["doc_id", "place", "n_tokens", "ids"])
                    at += len(texts)
                    place += len(texts)

    return run


def write_token_files(
    docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text",
) -> None:
    """Writes (doc_id, place, n_tokens, ids) in ascending doc_id order, part after part; place is the row's number
    in its part.

    Defined results: a null or empty text has the end id alone; texts of any length are encoded whole; null
    ids come first; rows that repeat an id follow one another in the order of their text's hash, and may be
    dealt to several parts; an empty table gives files without rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("hash"))
    ordered = rows.repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash").select("doc_id", "text")
    encoded = ordered.mapInArrow(_encode(tokenizer_path, end_id), "doc_id long, place long, n_tokens long, ids array<int>")
    encoded.write.options(**FILE_OPTIONS).parquet(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, n_tokens): no page of ids is read."""
    return spark.read.parquet(path).select("doc_id", "n_tokens")


def read_tokens(spark: SparkSession, path: str, first_id: int | None = None, last_id: int | None = None) -> DataFrame:
    """(doc_id, ids) of the documents in [first_id, last_id]; row groups and pages outside are skipped."""
    rows = spark.read.parquet(path).select("doc_id", "ids")
    if first_id is not None:
        rows = rows.where(F.col("doc_id") >= first_id)
    if last_id is not None:
        rows = rows.where(F.col("doc_id") <= last_id)
    return rows


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(3)
        values, offsets = lists.values, lists.offsets.to_numpy()
        crcs = [zlib.crc32(values[a:b].to_numpy().astype("<u4").tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(offsets).astype(np.int64)), pa.array(crcs, pa.int64())], ["doc_id", "part", "place", "n_tokens", "ids_crc32"])


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files' ids; start counts the ids of all rows before.

    Files hold ascending ranges, so running sums are taken in each file, in the order of its rows, and
    shifted by the totals of the files before it.
    """
    part = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int")
    files = spark.read.parquet(path)
    rows = files.select("doc_id", part.alias("part"), "place", "ids").mapInArrow(_checksums, "doc_id long, part int, place long, n_tokens long, ids_crc32 long")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = read_metadata_parts(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("total")).select(
        "part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("shift"))
    inside = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    if len(files.inputFiles()) <= BROADCAST_FILES:
        shifts = F.broadcast(shifts)
    return summed.join(shifts, "part").select("doc_id", (F.col("shift") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def read_metadata_parts(spark: SparkSession, path: str) -> DataFrame:
    part = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int")
    return spark.read.parquet(path).select(part.alias("part"), "n_tokens")


def encode_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> tuple[str, DataFrame]:
    """Writes token files to the shared folder; their path and index."""
    path = new_path(docs.sparkSession, "tokens")
    write_token_files(docs, path, tokenizer_path, end_id)
    return path, token_index(docs.sparkSession, path)
