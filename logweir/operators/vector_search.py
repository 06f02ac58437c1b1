"""Exact nearest vectors for a table of queries.

A bounded block of query vectors travels with the tasks and every batch of log
vectors is multiplied with it; only the best ``k`` per query leave a task. The
log side is read once per block and is never shuffled or paired up as rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from logweir.session import top_k_per_group

QUERIES_PER_BLOCK = 1024
SCORE_DIGITS = 9


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Best ``k``, score first and then smaller id; all ties of the last place compete."""
    if len(scores) > k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = scores >= cut
        scores, ids = scores[keep], ids[keep]
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def _scan(batches: Iterator[pa.RecordBatch], queries: dict, k: int) -> Iterator[pa.RecordBatch]:
    matrix, lo, hi = queries["matrix"], queries["lo"], queries["hi"]
    found: list = [None] * len(queries["ids"])
    kinds: pa.Schema | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        kinds = batch.schema
        # All vectors have the length of a query; a missing number becomes NaN.
        flat = batch["vector"].flatten().to_numpy(zero_copy_only=False)
        vectors = flat.reshape(batch.num_rows, -1).astype(np.float64)
        norms = np.sqrt((vectors * vectors).sum(axis=1))
        usable = norms > 0
        if not usable.any():
            continue
        scores = vectors[usable] @ matrix.T / norms[usable, None] + 1.0
        scores = np.round(scores, SCORE_DIGITS)
        ids = batch["log_id"].to_pandas().to_numpy()[usable]
        times = batch["at"].to_numpy()[usable]
        for q in range(len(found)):
            inside = (times >= lo[q]) & (times <= hi[q])
            mine = (scores[inside, q], ids[inside])
            if found[q] is not None:
                mine = tuple(np.concatenate(pair) for pair in zip(found[q], mine, strict=True))
            found[q] = _best(*mine, k)
    for query_id, best in zip(queries["ids"], found, strict=True):
        if best is not None and len(best[0]):
            ids = pa.Array.from_pandas(best[1], type=kinds.field("log_id").type)
            asked = pa.array([query_id] * len(ids), queries["id_type"])
            yield pa.record_batch({"query_id": asked, "log_id": ids, "score": pa.array(best[0])})


def vector_top_k(
    logs: DataFrame,
    queries: DataFrame,
    k: int,
    vector: str = "log_vector",
) -> DataFrame:
    """``(query_id, log_id, score, rank)``: cosine + 1 of the ``k`` nearest logs.

    ``queries`` has ``query_id``, ``query_vector`` and optionally ``lo`` and
    ``hi``: an inclusive time range that is applied before scoring; logs without
    a time are outside of every range and match where none is asked. Zero
    vectors, of logs or queries, match nothing.
    """
    spark = logs.sparkSession
    ranged = {"lo", "hi"} <= set(queries.columns)
    micros = F.unix_micros if ranged else None
    asked = queries.select(
        "query_id",
        F.col("query_vector").cast("array<double>").alias("query_vector"),
        (micros("lo") if ranged else F.lit(None).cast("long")).alias("lo"),
        (micros("hi") if ranged else F.lit(None).cast("long")).alias("hi"),
    )
    out = T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("log_id", logs.schema["log_id"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )
    blocks = max(1, -(-asked.count() // QUERIES_PER_BLOCK))
    hits = None
    for block in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        scanned = _block_hits(logs, part.collect(), k, vector, out)
        hits = scanned if hits is None else hits.unionByName(scanned)
    if hits is None:
        hits = spark.createDataFrame([], out)
    order = [F.col("score").desc(), F.col("log_id").asc()]
    return top_k_per_group(hits, ["query_id"], order, k, spread="log_id")


def _block_hits(logs: DataFrame, rows: list, k: int, vector: str, out: T.StructType) -> DataFrame:
    rows = [r for r in rows if r.query_vector and any(r.query_vector)]
    if not rows:
        return logs.sparkSession.createDataFrame([], out)
    matrix = np.array([r.query_vector for r in rows], dtype=np.float64)
    matrix /= np.sqrt((matrix * matrix).sum(axis=1))[:, None]
    lowest, highest = int(np.iinfo(np.int64).min), int(np.iinfo(np.int64).max)
    lo = np.array([lowest if r.lo is None else r.lo for r in rows], dtype=np.int64)
    hi = np.array([highest if r.hi is None else r.hi for r in rows], dtype=np.int64)
    # A log without a time stands at ``lowest``: outside every range, inside where none is asked.
    lo = np.where((lo == lowest) & (hi < highest), lowest + 1, lo)
    id_type = to_arrow_type(out["query_id"].dataType)
    queries = {"ids": [r.query_id for r in rows], "id_type": id_type, "matrix": matrix, "lo": lo, "hi": hi}

    usable = logs.where(F.col(vector).isNotNull() & (F.size(vector) == matrix.shape[1]))
    if "timestamp" in logs.columns:
        at = F.unix_micros(F.col("timestamp"))
        if lo.min() > lowest + 1:
            usable = usable.where(F.col("timestamp") >= F.timestamp_micros(F.lit(int(lo.min()))))
            if "log_date" in logs.columns:  # whole partitions are left out
                first = F.to_date(F.timestamp_micros(F.lit(int(lo.min()))))
                usable = usable.where(F.col("log_date") >= first)
        if hi.max() < highest:
            usable = usable.where(F.col("timestamp") <= F.timestamp_micros(F.lit(int(hi.max()))))
            if "log_date" in logs.columns:
                last = F.to_date(F.timestamp_micros(F.lit(int(hi.max()))))
                usable = usable.where(F.col("log_date") <= last)
    else:
        at = F.lit(0).cast("long")
    at = F.coalesce(at, F.lit(lowest)).alias("at")
    narrow = usable.select("log_id", F.col(vector).alias("vector"), at)
    return narrow.mapInArrow(lambda batches: _scan(batches, queries, k), out)
