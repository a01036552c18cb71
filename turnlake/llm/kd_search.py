"""Exact search for the highest integer inner products, by KD-trees.

Vectors are dealt to shards of bounded size by hashed row. Each shard's tree splits at medians of the widest component
and keeps for every node its tight bounding box. A query visits a shard's nodes best first, by the highest inner product
that a node's box allows, and stops where no box reaches its kth score. Shards are searched in rounds of 1, 3, 12, 48 ...
shards; the kth score that a query has after a round is where it starts in the next.

Queries meet shards in parts of bounded size; what a query finds in a shard is k rows at most.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Vectors of a shard and queries of a part (both in expectation, by hash), and vectors of a leaf at most.
SHARD_ROWS, PART_ROWS, LEAF = 8192, 2048, 128
#: Ids that are null count as this one in ties, and stay null.
NO_ID = (1 << 63) - 1
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1

TREE = "dim int, shard int, nodes binary, boxes binary, points binary, ids array<bigint>, named array<boolean>, row_ids array<bigint>"
FOUND = "query_row bigint, score bigint, id bigint, row bigint"


def scaled(values: np.ndarray) -> np.ndarray:
    """floor(1024 x) of each component, still as doubles, which hold these integers exactly."""
    return np.floor(1024.0 * values)


def exact(a: np.ndarray, b: np.ndarray) -> type:
    """A type in which inner products of rows of a and b are exact."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    return np.float64 if top < 2.0**53 else np.int64 if top < 2.0**62 else object


def as_type(x: np.ndarray, kind: type) -> np.ndarray:
    return x.astype(kind) if kind is not object else np.array([int(v) for v in x.ravel()], object).reshape(x.shape)


def build_tree(points: np.ndarray, ids: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order of the points, nodes, boxes): a node is (start, stop, left, right, smallest id), -1 for no child; a box is
    (lowest, highest) of each component."""
    order, nodes, boxes, todo = np.arange(len(points)), [], [], [(0, len(points), -1, 0)]
    while todo:
        start, stop, parent, side = todo.pop()
        own = points[order[start:stop]]
        low, high = own.min(0), own.max(0)
        if parent >= 0:
            nodes[parent][2 + side] = len(nodes)
        nodes.append([start, stop, -1, -1, int(ids[order[start:stop]].min())])
        boxes.append((low, high))
        if stop - start > leaf:
            middle = (stop - start) // 2
            widest = int(np.argmax(high - low)) if own.shape[1] else 0
            split = np.argpartition(own[:, widest], middle) if own.shape[1] else np.arange(stop - start)
            order[start:stop] = order[start:stop][split]
            todo += [(start, start + middle, len(nodes) - 1, 0), (start + middle, stop, len(nodes) - 1, 1)]
    return order, np.array(nodes, np.int64), np.array(boxes, np.float64)


def search(points: np.ndarray, ids: np.ndarray, row_ids: np.ndarray, nodes: np.ndarray, boxes: np.ndarray,
           queries: np.ndarray, own_rows: np.ndarray, known: list[tuple[int, int, int] | None], k: int) -> list[list[tuple[int, int, int]]]:
    """For each query the (score, -id, -row) that may be among its k best, best first.

    known is a query's kth so far, in this form, or None; what doesn't exceed it isn't given.
    """
    kind = exact(queries, points)
    queries, points, boxes = (as_type(x, kind) for x in (queries, points, boxes))
    bounds = np.maximum(queries, 0) @ boxes[:, 1].T + np.minimum(queries, 0) @ boxes[:, 0].T
    starts, stops, lefts, rights, firsts = nodes.T.tolist()
    out = []
    for q, row, limits, least in zip(queries, own_rows.tolist(), bounds.tolist(), known):
        best: list[tuple[int, int, int]] = []  # a heap, its lowest first
        open_ = [(-limits[0], 0)]
        while open_:
            limit, node = heapq.heappop(open_)
            limit = max(LOWEST, min(HIGHEST, int(-limit)))
            if least is not None and limit < least[0]:
                break
            if least is not None and limit == least[0] and firsts[node] > -least[1]:
                continue
            if lefts[node] >= 0:
                heapq.heappush(open_, (-limits[lefts[node]], lefts[node]))
                heapq.heappush(open_, (-limits[rights[node]], rights[node]))
                continue
            start, stop = starts[node], stops[node]
            scores = points[start:stop] @ q
            near = np.arange(stop - start) if least is None else np.flatnonzero(scores >= least[0]) if HIGHEST > abs(least[0]) else np.arange(stop - start)
            for i in near.tolist():
                found = (max(LOWEST, min(HIGHEST, int(scores[i]))), -int(ids[start + i]), -int(row_ids[start + i]))
                if found[2] == -row or least is not None and found <= least:
                    continue
                heapq.heappush(best, found)
                if len(best) > k:
                    heapq.heappop(best)
                if len(best) == k:
                    least = best[0] if least is None else max(least, best[0])
        out.append(sorted(best, reverse=True))
    return out


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if column.num_chunks else pa.array([], pa.float64())
    return scaled(flat.to_numpy(zero_copy_only=False)).reshape(len(column), dim)


def _build(leaf: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        dim, shard = (x.as_py() for x in key)
        points, ids = _matrix(rows.column("vector"), dim), np.array([NO_ID if x is None else x for x in rows.column("id").to_pylist()], np.int64)
        order, nodes, boxes = build_tree(points, ids, leaf)
        named = np.array([x is not None for x in rows.column("id").to_pylist()], bool)
        one = lambda x, kind: pa.array([x], kind)
        return pa.table({
            "dim": one(dim, pa.int32()), "shard": one(shard, pa.int32()), "nodes": one(nodes.tobytes(), pa.binary()), "boxes": one(boxes.tobytes(), pa.binary()),
            "points": one(points[order].tobytes(), pa.binary()), "ids": one(ids[order], pa.list_(pa.int64())), "named": one(named[order], pa.list_(pa.bool_())),
            "row_ids": one(rows.column("row").to_numpy()[order], pa.list_(pa.int64()))})

    return run


def _find(k: int):
    def run(trees: pa.Table, queries: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if trees.num_rows and queries.num_rows:
            t = trees.to_pylist()[0]
            dim, ids, row_ids = t["dim"], np.array(t["ids"], np.int64), np.array(t["row_ids"], np.int64)
            nodes = np.frombuffer(t["nodes"], np.int64).reshape(-1, 5)
            points, boxes = (np.frombuffer(t[k], np.float64).reshape(shape) for k, shape in (("points", (len(ids), dim)), ("boxes", (len(nodes), 2, dim))))
            unnamed = {r for r, named in zip(t["row_ids"], t["named"]) if not named}
            least = [None if x is None else (x["score"], -(NO_ID if x["id"] is None else x["id"]), -x["row"]) for x in queries.column("least").to_pylist()]
            own = queries.column("query_row").to_numpy()
            for row, found in zip(own.tolist(), search(points, ids, row_ids, nodes, boxes, _matrix(queries.column("vector"), dim), own, least, k)):
                rows += [(row, s, None if -r in unnamed else -i, -r) for s, i, r in found]
        columns = list(zip(*rows)) if rows else [[], [], [], []]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_row", "score", "id", "row"), columns)})

    return run


def top_products(
    vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10,
    shard_rows: int = SHARD_ROWS, part_rows: int = PART_ROWS, leaf: int = LEAF,
) -> DataFrame:
    """(query_id, rank, id_col, score): for each row that is_query holds for, the k rows of highest inner product.

    Components x count as floor(1024 x). Candidates are all rows but the query's own; ties go to the smaller id.

    Defined results: vectors that are null or hold a null or non-finite component take no part; vectors of different
    lengths don't meet; rows that repeat an id are rows of their own, each a candidate to the other and a query with
    results of its own; a null id is no query, a candidate that comes last in ties, and null in results; scores beyond
    64 bits count as the largest or smallest of them; with fewer than k candidates all are given; an empty table gives
    an empty one; other columns are ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "kd-search")
    v = F.col("vector")
    valid = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = scratch.table(
        vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
        .where(valid).withColumn("row", F.monotonically_increasing_id()).withColumn("dim", F.size("vector")))
    asked = rows.where("asks and id is not null")
    shards, parts = (max(1, math.ceil(n / each)) for n, each in ((rows.count(), shard_rows), (asked.count(), part_rows)))
    trees = scratch.table(
        rows.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")).select("dim", "shard", "id", "row", "vector")
        .groupBy("dim", "shard").applyInArrow(_build(leaf), TREE))
    queries = asked.select("dim", F.pmod(F.xxhash64("row", F.lit("part")), F.lit(parts)).cast("int").alias("part"), F.col("row").alias("query_row"), "vector")
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("row")]
    place = F.row_number().over(Window.partitionBy("query_row").orderBy(*order))
    best, begin, end = None, 0, 1
    while begin < shards:
        known = queries.withColumn("least", F.lit(None).cast("struct<score:bigint,id:bigint,row:bigint>"))
        if best is not None:
            known = queries.join(best.where(F.col("place") == k).select("query_row", F.struct("score", "id", "row").alias("least")), "query_row", "left")
        stop = min(end, shards)
        meeting = known.withColumn("shard", F.explode(F.sequence(F.lit(begin), F.lit(stop - 1)))).select("dim", "shard", "part", "query_row", "vector", "least")
        ours = trees.where(F.col("shard").between(begin, stop - 1)).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        keys = ("dim", "shard", "part")
        found = ours.groupBy(*keys).cogroup(meeting.groupBy(*keys)).applyInArrow(_find(k), FOUND)
        if best is not None:
            found = best.drop("place").unionByName(found)
        best = scratch.table(found.withColumn("place", place).where(F.col("place") <= k))
        begin, end = stop, 4 * stop
    names = asked.select(F.col("row").alias("query_row"), F.col("id").alias("query_id"))
    return best.join(names, "query_row").select("query_id", F.col("place").alias("rank"), F.col("id").alias(id_col), "score")
