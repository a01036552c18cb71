"""Exact deduplication: owners of equal texts, found in Patricia tries.

Texts are dealt to partitions by length and content hash, copies within an Arrow batch having been
merged before. Each partition inserts full byte strings into a compressed radix trie whose terminal
nodes keep the best row of a text. Owners go back to the rows by digest, in a join whose partitions
Spark splits where one text holds many rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, fresh
from .patricia import SpillingTrie

#: Bytes of trie that a task keeps in memory before it spills a subtree.
TRIE_BYTES = 192 << 20
DELETED = SPACES.encode()


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, points, text as bytes) -> (sha, body, length, points, id, n), one row a text and batch."""
    for batch in batches:
        best: dict[bytes, list] = {}
        ids, points, texts = (batch.column(i) for i in range(3))
        for i, n, text in zip(ids.to_pylist(), points.to_pylist(), texts):
            body = text.as_buffer().to_pybytes().translate(None, DELETED) if text.is_valid else b""
            rank = (-n, i is None, i or 0)
            known = best.get(body)
            if known is None:
                best[body] = [rank, i, 1]
            else:
                known[2] += 1
                if rank < known[0]:
                    known[0], known[1] = rank, i
        yield pa.RecordBatch.from_arrays([
            pa.array([hashlib.sha256(b).digest() for b in best], pa.binary()), pa.array(best.keys(), pa.binary()),
            pa.array(map(len, best), pa.int64()), pa.array((-v[0][0] for v in best.values()), pa.int64()),
            pa.array((v[1] for v in best.values()), pa.int64()), pa.array((v[2] for v in best.values()), pa.int64()),
        ], ["sha", "body", "length", "points", "id", "n"])


def _owners(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = SpillingTrie(limit)
        for batch in batches:
            for sha, body, points, i, n in zip(*(batch.column(c).to_pylist() for c in ("sha", "body", "points", "id", "n"))):
                trie.insert(body, (-points, i is None, i or 0), n, (sha))
        out: list[tuple] = []

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([
                pa.array((t for t, _, _ in out), pa.binary()),
                pa.array((None if r[1] else r[2] for _, r, _ in out), pa.int64()), pa.array((c for _, _, c in out), pa.int64()),
            ], ["sha", "keep_id", "group_size"])

        for row in trie.owners():
            out.append(row)
            if len(out) == 20_000:
                yield full()
                out.clear()
        yield full()

    return run


def text_owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """(sha, keep_id, group_size): one row a text without the characters [\\x20\\x09-\\x0D].

    The owner is the row with the most code points, then the smallest id.
    """
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.length(text), F.lit(0)).cast("long").alias("points"),
        text.cast("binary").alias("text"),
    )
    bodies = rows.mapInArrow(_bodies, "sha binary, body binary, length long, points long, id long, n long")
    return bodies.repartition("length", "sha").mapInArrow(_owners(trie_bytes), "sha binary, keep_id long, group_size long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256), one row for each row of docs.

    Defined results: null texts count as empty, and all texts of white space alone are one group; a
    null id ranks after all others of equal length; rows that repeat the owner's id are all kept, as
    ids tell rows apart; an empty table gives an empty one; other columns are ignored.
    """
    body = F.coalesce(text_col, F.lit(""))
    for space in SPACES:
        body = F.replace(body, F.lit(space), F.lit(""))
    digests = docs.select(F.col(id_col).cast("long").alias("id"), F.unhex(F.sha2(body.cast("binary"), 256)).alias("sha"))
    owners = text_owners(docs, id_col, text_col, trie_bytes)
    kept: Column = F.col("id").eqNullSafe(F.col("keep_id"))
    return digests.join(owners, "sha").select(
        F.col("id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that own their text, with all their columns."""
    own = fresh(docs.columns, "owner_id")
    keep = text_owners(docs, id_col, text_col).select(F.col("keep_id").alias(own))
    return docs.join(keep, F.col(id_col).cast("long").eqNullSafe(F.col(own)), "left_semi")
