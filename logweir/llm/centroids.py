"""Exact integer k-means over a kept matrix of dot products.

Every vector row carries its dot products with all centroids, as whole numbers.
When a centroid moves, only the components in which it changed are multiplied:
the product of those with the change is added to the kept one. The squared
distance is |v|^2 - 2 v.c + |c|^2, so a new argmin needs no other work. A
centroid that did not move costs nothing. The first centroids are changes from zero.

The rows with their products are a table in the shared folder; each round
reads the last one and writes the next, and the last one is then deleted. Only
sums per task and centroid are shuffled, and ``k`` centroids reach the driver;
both are bounded by ``k`` times the number of components.

Defined results: vectors that are null, of another length, or that hold null or
non-finite components are left out; repeated rows are members each; a null id
is a member, but comes last when the first centroids are chosen; with fewer vectors
than ``k`` there are as many clusters as vectors; a component beyond 2^26 in size,
after scaling, counts as 2^26, so that distances stay exact in 64 bits; a sum of
distances beyond 64 bits is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType

from logweir.llm.rows import forget, packed, quoted, unpacked, written

#: Largest size of a scaled component.
MOST = 1 << 26


def whole_components(
    df: DataFrame, vector: str, dims: int, scale: int, carry: list[str] | None = None, **more
) -> DataFrame:
    """Rows with a sound vector, as ``v`` of integers floor(scale * x)."""
    x = F.col(quoted(vector)).cast("array<double>")
    # Infinite or not a number: the difference of such a value with itself is not zero.
    sound = F.forall(x, lambda c: c.isNotNull() & ((c - c) == 0))
    rows = df.where(x.isNotNull() & (F.size(x) == dims) & sound)
    most = F.lit(float(MOST))
    whole = F.transform(
        x, lambda c: F.greatest(-most, F.least(most, F.floor(F.greatest(-most, F.least(most, c)) * scale))).cast("int")
    )
    return packed(rows, carry, v=whole, **more)


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest SHA-256 of ``seed:id``, in the order of that hash."""
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    chosen = vectors.select(named.alias("name"), "v").orderBy(F.asc_nulls_last("name"), "v").limit(k)
    return np.array([r.v for r in chosen.collect()], np.int64)


def _product(block: np.ndarray, change: np.ndarray) -> np.ndarray:
    """``block @ change``, exact: in doubles where every sum stays below 2^53."""
    size = int(np.abs(block).max(initial=0)) * int(np.abs(change).max(initial=0)) * len(change)
    if size < 2**53:
        return (block.astype(np.float64) @ change.astype(np.float64)).astype(np.int64)
    return block @ change


def update_dots(block: np.ndarray, dots: np.ndarray, changes: np.ndarray) -> None:
    """Add to ``dots`` what the nonzero components of every centroid's change make."""
    for centroid, change in enumerate(changes):
        moved = np.flatnonzero(change)
        if len(moved):
            dots[:, centroid] += _product(block[:, moved], change[moved])


def nearest(block: np.ndarray, dots: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid, the smaller one on ties, and the squared distance."""
    distance = (centroids**2).sum(axis=1)[None, :] - 2 * dots
    best = distance.argmin(axis=1)
    return best, distance[np.arange(len(block)), best] + (block**2).sum(axis=1)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def assign(state: DataFrame, centroids: np.ndarray, changes: np.ndarray) -> DataFrame:
    """The next state: products after ``changes``, nearest of ``centroids``, squared distance."""
    k, width = centroids.shape
    fresh = "dots" not in state.columns

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = _matrix(batch["v"], width)
            dots = np.zeros((len(block), k), np.int64) if fresh else _matrix(batch["dots"], k)
            update_dots(block, dots, changes)
            cluster, distance = nearest(block, dots, centroids)
            ends = pa.array(np.arange(0, (len(block) + 1) * k, k, dtype=np.int32))
            yield pa.record_batch(
                {
                    "row": batch["row"],
                    "v": batch["v"],
                    "dots": pa.ListArray.from_arrays(ends, pa.array(dots.ravel())),
                    "cluster": pa.array(cluster.astype(np.int32)),
                    "distance": pa.array(distance),
                }
            )

    schema = state.select("row", "v").schema.add("dots", ArrayType(LongType()))
    schema = schema.add("cluster", IntegerType()).add("distance", LongType())
    return state.select("row", "v", *([] if fresh else ["dots"])).mapInArrow(step, schema)


def moved_centroids(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Floor of the mean of every cluster's vectors; a centroid without vectors stays."""
    k, width = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            cluster = batch["cluster"].to_numpy()
            np.add.at(total, cluster, _matrix(batch["v"], width))
            count += np.bincount(cluster, minlength=k)
        at, place = (part.ravel() for part in np.indices((k, width + 1)))
        part = np.column_stack([total, count])
        yield pa.record_batch(
            {
                "cluster": pa.array(at.astype(np.int32)),
                "place": pa.array(place.astype(np.int32)),
                "part": pa.array(part.ravel()),
            }
        )

    parts = state.select("cluster", "v").mapInArrow(sums, "cluster int, place int, part long")
    total = np.zeros((k, width + 1), np.int64)
    # k * (components + 1) rows, whatever the number of vectors.
    for r in parts.groupBy("cluster", "place").agg(F.sum("part").alias("part")).collect():
        total[r.cluster, r.place] = r.part
    count = total[:, width:]
    return np.where(count > 0, total[:, :width] // np.maximum(count, 1), centroids)


def _named(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def _long(number: int) -> int | None:
    return number if number < 2**63 else None


def cluster(
    df: DataFrame,
    row_id: str = "vec_id",
    vector: str = "embedding",
    k: int = 40,
    rounds: int = 5,
    dims: int = 64,
    scale: int = 256,
    seed: int = 2,
    carry: list[str] | None = None,
) -> DataFrame:
    """The rows of ``df`` with a sound vector, with their cluster after ``rounds`` moves of ``k`` centroids.

    New columns: ``cluster``, ``distance`` (squared, to its centroid),
    ``cluster_inertia``, ``inertia``, ``centroid`` and ``centroid_sha256``. They
    replace input columns of the same names.
    """
    columns = df.columns if carry is None else carry
    spark = df.sparkSession
    vectors = whole_components(df, vector, dims, scale, columns, id=F.col(quoted(row_id)))
    centroids = first_centroids(vectors, k, seed).reshape(-1, dims)
    if not len(centroids):
        # No vector takes part: one centroid at zero has no member.
        centroids = np.zeros((1, dims), np.int64)
    state = written(assign(vectors, centroids, centroids))
    for _ in range(rounds):
        moved = moved_centroids(state, centroids)
        changes, centroids, last = moved - centroids, moved, state
        if changes.any():
            state = written(assign(last, centroids, changes))
            forget(last)
    # One row per centroid, at most k, is collected here and broadcast below.
    sums = state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("sum"))
    sums = {r.cluster: int(r["sum"]) for r in sums.collect()}
    totals = spark.createDataFrame(
        [
            (i, c.tolist(), _named(c), _long(sums.get(i, 0)), _long(sum(sums.values())))
            for i, c in enumerate(centroids)
        ],
        "cluster int, centroid array<int>, centroid_sha256 string, cluster_inertia long, inertia long",
    )
    found = state.select("row", "cluster", "distance").join(F.broadcast(totals), "cluster")
    new = ("cluster", "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256")
    return unpacked(found, columns, **{c: F.col(c) for c in new})
