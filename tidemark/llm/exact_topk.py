"""Exact highest inner products by three phases with a uniform threshold.

Queries go to all tasks in blocks of bounded size; vectors stay where they are.  The components fall into ``slices``,
and each of them gives every vector a part of its score.

1. Each task takes, for each query, the vectors that lead its local list of the first slice, and sends the best of
   them with their whole scores.  The k-th best of all that is sent is a safe cutoff: at least k vectors reach it.
2. The cutoff goes to all tasks, the same to each.  Slice by slice, a task adds up parts of scores and keeps the
   entries whose sum can still reach the cutoff: what the slices not yet seen may add is at most the product of the
   norms that query and vector have there.
3. The entries that no bound rules out are resolved exactly, and those that reach the cutoff compete.

Cases: vectors that are null, empty, or hold null or non-finite components, and rows with a null vec_id, take no
part; a query meets only vectors of its own length; rows that repeat are candidates of their own, all but those
with the query's vec_id, and a query that repeats is asked once, with the first of its vectors in order; equal
scores go to the smaller vec_id; fewer than k candidates give all; scores beyond 64 bits are not defined; no queries
or an empty table give an empty table; only ``vec_id`` and ``embedding`` are read, so other columns and their names
don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import written
from tidemark.llm.textutil import small_batches

SENT = "query_id long, vec_id long, score long"
#: Vectors that meet a block of queries at once, and the bytes that bound such a block.
TILE, BLOCK_BYTES = 1024, 16 << 20
#: Vectors at the head of a local list, for each query and tile.
HEAD = 64
#: Share of entries up to which they are followed one by one instead of as a whole matrix.
SPARSE = 0.3


class Asked(NamedTuple):
    """Queries of one length: ids, whole components and cutoffs."""

    ids: np.ndarray
    x: np.ndarray
    cutoff: np.ndarray


def _whole(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(256.0 * x).reshape(len(flat), -1)


def _kind(q: np.ndarray, x: np.ndarray) -> type:
    """Doubles while all sums stay below 2**53, else 64-bit integers."""
    return np.int64 if len(q) and len(x) and q.shape[1] * np.abs(q).max() * np.abs(x).max() >= 2.0**53 else np.float64


def _edges(width: int, slices: int) -> np.ndarray:
    return np.linspace(0, width, min(slices, width) + 1).astype(int)


def _rests(x: np.ndarray, edges: np.ndarray) -> list[np.ndarray]:
    """Norms of what lies behind each slice."""
    squares = np.add.reduceat(x * x, edges[:-1], axis=1)
    return [np.sqrt(squares[:, i + 1 :].sum(1)) for i in range(squares.shape[1])]


def _best(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k best of each query, ties to the smaller vec_id."""
    order = np.lexsort((vec, -score, query))
    first = np.flatnonzero(np.diff(query[order], prepend=query[order][:1] - 1))
    rank = np.arange(len(order)) - np.repeat(first, np.diff(first, append=len(order)))
    return order[rank < k]


def leading(asked: Asked, ids: np.ndarray, x: np.ndarray, k: int, slices: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query row, vector row and score of the best of the vectors that lead the list of the first slice for each query."""
    kind, edges = _kind(asked.x, x), _edges(x.shape[1], slices)
    q, y = asked.x.astype(kind), x.astype(kind)
    part = q[:, : edges[1]] @ y[:, : edges[1]].T
    n = min(max(HEAD, k + 1), len(y))  # the query itself may be among them
    at = np.argpartition(-part, n - 1, axis=1)[:, :n].ravel()
    of = np.repeat(np.arange(len(q)), n)
    keep = asked.ids[of] != ids[at]
    of, at = of[keep], at[keep]
    score = np.einsum("ad,ad->a", q[of], y[at]).astype(np.int64)
    best = _best(of, ids[at], score, k)
    return of[best], at[best], score[best]


def reaching(asked: Asked, ids: np.ndarray, x: np.ndarray, slices: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Query row, vector row and score of all entries that reach the cutoffs, and how many were resolved to the last slice."""
    kind, edges = _kind(asked.x, x), _edges(x.shape[1], slices)
    q, y = asked.x.astype(kind), x.astype(kind)
    rest_q, rest_y = _rests(asked.x, edges), _rests(x, edges)
    # Rounding of the bounds is far below this.
    slack = 1 + 1e-9 * np.linalg.norm(asked.x, axis=1)[:, None] * np.linalg.norm(x, axis=1).max(initial=0)
    least = asked.cutoff[:, None] - slack
    last = len(edges) - 2
    part = np.zeros((len(q), len(y)), kind)
    of = at = None
    resolved = part.size
    for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        if i == last and of is not None:
            resolved = len(of)
        if of is None:
            part += q[:, a:b] @ y[:, a:b].T
            if i < last:
                alive = part + rest_q[i][:, None] * rest_y[i][None, :] >= least
                if np.count_nonzero(alive) <= SPARSE * alive.size:
                    of, at = np.nonzero(alive)
                    part = part[of, at]
        else:
            for lo in range(0, len(of), 1 << 16):
                own = slice(lo, lo + (1 << 16))
                part[own] += np.einsum("ad,ad->a", q[of[own], a:b], y[at[own], a:b])
            if i < last:
                alive = part + rest_q[i][of] * rest_y[i][at] >= least[of, 0]
                of, at, part = of[alive], at[alive], part[alive]
    if of is None:
        of, at = np.nonzero(part >= asked.cutoff[:, None])
        part = part[of, at]
    keep = (part >= asked.cutoff[of]) & (asked.ids[of] != ids[at])
    return of[keep], at[keep], part[keep].astype(np.int64), resolved


def _sent(asked: dict[int, Asked], k: int, slices: int, resolve: bool):
    """Rows of vec_id, embedding to the entries that each phase sends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column(1).offsets.to_numpy())
            for width in np.unique(sizes):
                own = asked.get(int(width))
                rows = np.flatnonzero(sizes == width)
                for lo in range(0, len(rows) if own else 0, TILE):
                    part = batch.take(pa.array(rows[lo : lo + TILE]))
                    ids, x = part.column(0).to_numpy(), _whole(part.column(1))
                    of, at, score = reaching(own, ids, x, slices)[:3] if resolve else leading(own, ids, x, k, slices)
                    best = _best(of, ids[at], score, k)
                    if len(best):
                        yield pa.RecordBatch.from_arrays([pa.array(own.ids[of[best]]), pa.array(ids[at[best]]), pa.array(score[best])], ["query_id", "vec_id", "score"])

    return run


def _block(rows: pa.Table) -> dict[int, Asked]:
    """Queries of a block by their length; without cutoffs none is ruled out."""
    flat = rows.column("embedding").combine_chunks()
    sizes = np.diff(flat.offsets.to_numpy())
    ids, out = rows.column("vec_id").to_numpy(), {}
    for width in np.unique(sizes):
        own = np.flatnonzero(sizes == width)
        out[int(width)] = Asked(ids[own], _whole(flat.take(pa.array(own))), np.full(len(own), -np.inf))
    return out


def top_products(rows: DataFrame, every: int = 50, k: int = 5, slices: int = 8, query_block: int = 2048) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` highest integer inner products of each row whose vec_id ``every`` divides.

    A block holds about ``query_block`` queries, fewer where they are so long that it would outgrow ``BLOCK_BYTES``.
    """
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    vectors = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & fine)
    queries = vectors.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    queries = written(queries, "queries")
    size = queries.agg(F.count("*").alias("n"), F.sum(8 * F.size("embedding").cast("long")).alias("bytes")).first()
    blocks = max(-(-size["n"] // query_block), -(-(size["bytes"] or 0) // BLOCK_BYTES), 1)
    small_batches(rows)
    ranked = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    parts = []
    for i in range(blocks):
        asked = _block(queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i).toArrow())
        first = vectors.mapInArrow(_sent(asked, k, slices, False), SENT).withColumn("rank", ranked).where(F.col("rank") == k)
        cutoffs = {r["query_id"]: r["score"] for r in first.select("query_id", "score").collect()}  # one row a query of the block
        asked = {w: a._replace(cutoff=np.array([cutoffs.get(int(j), -np.inf) for j in a.ids], float)) for w, a in asked.items()}
        last = vectors.mapInArrow(_sent(asked, k, slices, True), SENT).withColumn("rank", ranked).where(F.col("rank") <= k)
        last = last.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
        parts.append(last if blocks == 1 else written(last, "best"))
    return reduce(DataFrame.unionByName, parts)
