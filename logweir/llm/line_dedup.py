"""Line dedup over levelled sorted runs of line hashes.

Documents come in batches of ascending id. Each batch looks its line keys up in
the runs written before it and then adds the keys that no run holds as a run of
its own. Runs are bucketed and sorted by hash, so the lookup is a merge join
that does not move the runs. When a level holds ``fanout`` runs, they are merged
into one run of the next level. As every earlier batch has smaller ids, the id
stored with a key is always the smallest that holds it.

Defined results: a null or empty text is one empty line and is kept as it is; a
null id counts as one document after all others; rows of one id count as one
document; a document may lose all its lines (empty text).
"""

from __future__ import annotations

import uuid

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.llm.rows import map_batches, packed, texts_as_bytes, unpacked, written
from logweir.session import scratch, shuffle_parts

BLANK = b" \t\n\x0b\x0c\r"
LAST = 2**63 - 1


def line_key(line: bytes) -> bytes:
    """The compared form of a line: blanks stripped, A-Z in lower case (bytes.lower is ASCII only)."""
    return line.strip(BLANK).lower()


def _counts(key: bytes, least: int) -> bool:
    """True when the key has at least ``least`` code points; each takes one to four bytes."""
    if len(key) < least or len(key) >= 4 * least:
        return len(key) >= least
    return sum(byte & 0xC0 != 0x80 for byte in key) >= least


def _keys_of(batch: pa.RecordBatch, least: int) -> pa.RecordBatch:
    ids, digests = [], []
    for doc, text in zip(batch["doc"].to_pylist(), texts_as_bytes(batch["text"]), strict=True):
        lines = {line_key(line) for line in text.split(b"\n")} if text else ()
        own = [xxhash.xxh3_128_digest(key) for key in lines if _counts(key, least)]
        ids += [doc] * len(own)
        digests += own
    return pa.record_batch(
        {"doc": pa.array(ids, pa.int64()), "key": pa.array(digests, pa.binary())}
    )


def line_keys(docs: DataFrame, row_id: str, text: str, least: int) -> DataFrame:
    """``(doc, key)``: the distinct line keys of every document, as 128-bit hashes."""
    plain = docs.select(
        F.coalesce(F.col(row_id).cast("long"), F.lit(LAST)).alias("doc"), F.col(text).alias("text")
    )
    return map_batches(plain, lambda batch: _keys_of(batch, least), "doc long, key binary")


class Runs:
    """The levelled runs: bucketed, sorted tables ``(key, first)`` in the shared folder."""

    def __init__(self, spark: SparkSession, fanout: int):
        self.spark, self.fanout, self.buckets = spark, fanout, shuffle_parts(spark)
        self.levels: list[list[str]] = []

    def add(self, run: DataFrame, level: int = 0) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        (
            run.write.bucketBy(self.buckets, "key")
            .sortBy("key")
            .option("path", scratch(self.spark))
            .saveAsTable(name)
        )
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) == self.fanout:
            full, self.levels[level] = self.levels[level], []
            merged = self.spark.table(full[0])
            for other in full[1:]:
                merged = merged.unionByName(self.spark.table(other))
            self.add(merged.repartition(self.buckets, "key"), level + 1)
            self._forget(full)

    def look_up(self, keys: DataFrame) -> DataFrame:
        """``keys (key, first, last)`` with ``known``: the id a run holds for the key, or null."""
        found = keys.withColumn("known", F.lit(None).cast("long"))
        for name in [name for level in self.levels for name in level]:
            run = self.spark.table(name).withColumnRenamed("first", "held")
            found = found.join(run.hint("merge"), "key", "left").select(
                "key", "first", "last", F.coalesce("known", "held").alias("known")
            )
        return found

    def close(self) -> None:
        for level in self.levels:
            self._forget(level)

    def _forget(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")


def _bounds(keys: DataFrame, batches: int) -> list[int]:
    """Upper ids of all batches but the last, at even shares of the rows."""
    shares = [i / batches for i in range(1, batches)]
    cuts = keys.agg(F.percentile_approx("doc", shares, 10_000)).first()[0]
    return sorted(set(cuts or []))


def repeated_lines(
    docs: DataFrame,
    row_id: str = "doc_id",
    text: str = "text",
    least: int = 10,
    batches: int = 4,
    fanout: int = 2,
) -> DataFrame:
    """``(doc, keys)``: per document, hashes of the lines that an earlier document holds.

    ``batches`` is the number of id ranges; the result does not depend on it or
    on ``fanout``. A key in many documents is pre-aggregated before the shuffle,
    and where entries meet their first ids the adaptive plan can split it.
    """
    spark = docs.sparkSession
    cuts = _bounds(docs.select(F.coalesce(F.col(row_id).cast("long"), F.lit(LAST)).alias("doc")), batches)
    number = sum((F.when(F.col("doc") > c, 1).otherwise(0) for c in cuts), F.lit(0))
    path = scratch(spark)
    entries = line_keys(docs, row_id, text, least).withColumn("batch", number)
    entries.write.partitionBy("batch").parquet(path)
    entries = spark.read.schema("doc long, key binary, batch int").parquet(path)
    runs, dropped = Runs(spark, fanout), None
    for batch in range(len(cuts) + 1):
        own = entries.where(F.col("batch") == batch).select("doc", "key")
        keys = own.groupBy("key").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
        found = written(runs.look_up(keys))
        fresh = found.where(F.col("known").isNull()).select("key", "first")
        runs.add(fresh.repartition(runs.buckets, "key"))
        shared = found.where(F.col("known").isNotNull() | (F.col("first") < F.col("last"))).select(
            "key", F.coalesce("known", "first").alias("first")
        )
        late = own.join(shared, "key").where(F.col("doc") > F.col("first")).select("doc", "key")
        dropped = late if dropped is None else dropped.unionByName(late)
    result = written(dropped.groupBy("doc").agg(F.collect_list("key").alias("keys")))
    runs.close()
    return result


def _rest_of(batch: pa.RecordBatch) -> pa.RecordBatch:
    kept, totals, gone = [], [], []
    pairs = zip(texts_as_bytes(batch["text"]), batch["keys"].to_pylist(), strict=True)
    for text, keys in pairs:
        lines = text.split(b"\n") if text else [b""]
        totals.append(len(lines))
        if not keys:
            gone.append(0)
            kept.append(text)
            continue
        keys = set(keys)
        stay = [x for x in lines if xxhash.xxh3_128_digest(line_key(x)) not in keys]
        gone.append(len(lines) - len(stay))
        kept.append(b"\n".join(stay))
    return pa.record_batch(
        {
            "row": batch["row"],
            "kept": pa.array(kept, pa.binary()).cast(pa.string()),
            "n_lines": pa.array(totals, pa.int64()),
            "n_dropped": pa.array(gone, pa.int64()),
        }
    )


def dedup_lines(
    docs: DataFrame,
    row_id: str = "doc_id",
    text: str = "text",
    least: int = 10,
    batches: int = 4,
    fanout: int = 2,
) -> DataFrame:
    """All rows and columns of ``docs`` with the remaining lines as text, ``n_lines``, ``n_dropped``.

    A line key of at least ``least`` code points stays only in the smallest id
    that holds it, with all its copies there.
    """
    columns = docs.columns
    keys = repeated_lines(docs, row_id, text, least, batches, fanout)
    whole = packed(
        docs,
        doc=F.coalesce(F.col(row_id).cast("long"), F.lit(LAST)),
        text=F.col(text),
    )
    met = whole.join(keys, "doc", "left").select("row", "text", "keys")
    # The text travels once: inside the row it is left out and put back from ``kept``.
    slim = met.withColumn("row", F.col("row").dropFields(text)) if len(columns) > 1 else met
    kind = slim.schema["row"].dataType.simpleString()
    rest = map_batches(slim, _rest_of, f"row {kind}, kept string, n_lines long, n_dropped long")
    return unpacked(
        rest,
        columns,
        **{text: F.col("kept"), "n_lines": F.col("n_lines"), "n_dropped": F.col("n_dropped")},
    )
