"""Exact inner-product top-k over an impact-ordered index, score at a time.

The index holds the vectors in blocks. In a block the postings (vector,
component) are grouped in segments by the size of the component: all of 32 and
more, of 16 to 31, and so on down to 1. A query block adds up the segments from
the largest sizes down, for all its queries and all vectors of the block at
once. After every segment the part of a score that is still missing is bounded
by the norms of what is left of both vectors (on components of that size or
less); when the bound proves that enough vectors are out, the rest of the
segments is skipped and the vectors that can still be members are scored exactly.
A block gives at most ``k`` rows per query, and the rows of all blocks are ranked.

Queries and index meet as a grid of blocks: every cell is one task with bounded
memory, whatever the tables' sizes.

Defined results: vectors that are null or hold null or non-finite components take
no part, as query or as candidate; vectors of different length are filled up
with zeros; a query with fewer than ``k`` candidates gets all of them; rows of one id are
candidates each, but one query (the smallest vector), and a query never meets its own
id; a null id takes no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.llm.rows import written
from logweir.session import top_k_per_group

INDEX_BLOCK = 8192
QUERY_BLOCK = 1024
#: Share of the scores of a block at which the exact scoring of the rest is cheaper than more segments.
FEW = 0.02


def whole_vectors(df: DataFrame, row_id: str, vector: str, scale: int = 64) -> DataFrame:
    """``(id, v)``: vectors of whole numbers floor(scale * x), for rows that take part."""
    x = F.col(vector).cast("array<double>")
    # Infinite or not a number: the difference of such a value with itself is not zero.
    sound = F.forall(x, lambda c: c.isNotNull() & ((c - c) == 0))
    rows = df.where(F.col(row_id).isNotNull() & x.isNotNull() & sound)
    return rows.select(
        F.col(row_id).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * scale)).alias("v")
    )


def _matrix(lists: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(lists), width), np.int64)
    for row, values in zip(out, lists, strict=True):
        row[: len(values)] = values
    return out


def _segments(matrix: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """``(size, matrix of the components of that size)``, largest sizes first."""
    sizes = np.abs(matrix)
    top = int(sizes.max(initial=0))
    least = 1 << (top.bit_length() - 1) if top else 0
    while least:
        yield least, np.where((sizes >= least) & (sizes < 2 * least), matrix, 0)
        least >>= 1


def _kind(queries: np.ndarray, matrix: np.ndarray) -> type:
    """A number type in which all sums of products are exact."""
    most = int(np.abs(queries).max(initial=0)) * int(np.abs(matrix).max(initial=0))
    most *= max(1, matrix.shape[1])
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64


def block_top(
    ids: np.ndarray, matrix: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query id, id, score)``: at most ``k`` best of one block for every query, ties to smaller ids."""
    kind = _kind(queries, matrix)
    asked = queries.astype(kind)
    score = np.zeros((len(queries), len(matrix)), kind)
    own = query_ids[:, None] == ids[None, :]
    rest = matrix.copy()
    possible = ~own
    for _, segment in _segments(matrix):
        score += asked @ segment.astype(kind).T
        rest -= segment
        # |missing part| <= |query on dimensions where anything is left| * |rest of the vector|
        left = np.sqrt((rest.astype(np.float64) ** 2).sum(axis=1))
        open_ = (rest != 0).any(axis=0)
        norm = np.sqrt((queries[:, open_].astype(np.float64) ** 2).sum(axis=1))
        if len(matrix) > k + 1:
            slack = norm * left.max() * (1 + 1e-6) + 1e-3
            safe = np.where(own, -np.inf, score)
            floor = np.partition(safe, len(matrix) - k, axis=1)[:, len(matrix) - k] - slack
            # A vector is out if even its upper bound is below k sure scores.
            possible = (score >= (floor - slack)[:, None]) & ~own
        if not left.any() or possible.mean() <= FEW:
            break
    row, col = np.nonzero(possible)
    exact = np.empty(len(row), np.int64)
    wide = matrix.astype(kind)
    for at in range(0, len(row), 65_536):
        part = slice(at, at + 65_536)
        exact[part] = np.einsum("ij,ij->i", asked[row[part]], wide[col[part]]).astype(np.int64)
    order = np.lexsort((ids[col], -exact, row))
    row, col, exact = row[order], col[order], exact[order]
    first = np.searchsorted(row, np.arange(len(queries)))
    best = np.arange(len(row)) - first[row] < k
    return query_ids[row[best]], ids[col[best]], exact[best]


def _cell(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    if not left.num_rows or not right.num_rows:
        return pa.table({n: pa.array([], pa.int64()) for n in ("query_id", "id", "score")})
    ids, query_ids = left["id"].to_numpy(), right["query_id"].to_numpy()
    order = np.argsort(ids, kind="stable")
    vectors = left["v"].to_numpy()
    asked = list(right["asked"].to_numpy())
    width = max((len(v) for v in [*vectors, *asked]), default=0)
    queries = _matrix(asked, width)
    found = []
    for at in range(0, len(order), 2048):
        some = order[at : at + 2048]
        block = _matrix([vectors[i] for i in some], width)
        found.append(block_top(ids[some], block, query_ids, queries, k))
    query, near, score = (np.concatenate(p) for p in zip(*found, strict=True))
    ranked = np.lexsort((near, -score, query))
    query, near, score = query[ranked], near[ranked], score[ranked]
    best = np.arange(len(query)) - np.searchsorted(query, query) < k
    parts = query[best], near[best], score[best]
    return pa.table(
        {n: pa.array(p, pa.int64()) for n, p in zip(("query_id", "id", "score"), parts, strict=True)}
    )


def top_k(index: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """``(query_id, rank, id, score)`` of the ``k`` highest scores of every row of ``queries``.

    Both hold ``(id, v)``, see ``whole_vectors``. Every index row is sent once per
    query block and every query once per index block.
    """
    queries = written(queries.groupBy("id").agg(F.min("v").alias("v")))
    rows, asked = index.count(), queries.count()
    tall, wide = max(1, -(-rows // INDEX_BLOCK)), max(1, -(-asked // QUERY_BLOCK))
    place = F.xxhash64("id")
    left = index.select(
        "id",
        "v",
        F.pmod(place, F.lit(tall)).alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(wide - 1))).alias("query_block"),
    )
    right = queries.select(
        F.col("id").alias("query_id"),
        F.col("v").alias("asked"),
        F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(wide)).cast("int").alias("query_block"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tall - 1).cast("long"))).alias("block"),
    )
    cells = left.groupBy("block", "query_block").cogroup(right.groupBy("block", "query_block"))
    best = cells.applyInArrow(
        lambda a, b: _cell(a, b, k), "query_id long, id long, score long"
    )
    order = [F.desc("score"), F.col("id")]
    ranked = top_k_per_group(best, ["query_id"], order, k, spread="id")
    return ranked.select("query_id", "rank", "id", "score")


def index_rows(df: DataFrame, row_id: str, vector: str, scale: int = 64) -> DataFrame:
    """The index input, computed once."""
    return written(whole_vectors(df, row_id, vector, scale))
