"""Phrase search over a stored inverted index with positions.

An index is a folder with three tables. ``postings`` has a row per field, word
and log, in buckets by the hash of the word and sorted by word inside a file;
``known`` lists the indexed logs, sorted by date; ``sizes`` has the number of values and
words of each field per batch. The rows in ``sizes`` are written last and make a
batch count: what a stopped batch has left behind is never read. A search reads
the buckets of the asked words and no text.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweir.functions.text import words
from logweir.operators.lexical_search import (
    KEYWORD_FIELDS,
    LISTED_WORDS,
    TEXT_FIELDS,
    carried_columns,
    keyword_scores,
    query_words,
    summed,
    text_scores,
)
from logweir.session import (
    broadcast_if_small,
    forget,
    is_small,
    join_on_hot_keys,
    settle,
    shuffle_parts,
    top_k_per_group,
    written,
)
from logweir.sources.store import read_stored

#: Folders a batch is cut into; fixed by the first batch of an index.
BUCKETS = 64
#: Positions in a file; a bucket with more takes several tasks and files.
POSITIONS_PER_FILE = 4_000_000
#: Values whose words are gathered at once.
VALUES_AT_ONCE = 256

_SIZES = (
    T.StructType()
    .add("batch", T.StringType())
    .add("buckets", T.IntegerType())
    .add("id_type", T.StringType())
    .add("field", T.StringType())
    .add("docs", T.LongType())
    .add("length", T.LongType())
)
_NO_DATE = "1970-01-01"


def _bucket(word: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(buckets)).cast("int")


def _gathered(values: pa.Array) -> pa.Array:
    """For each list of words its different words with their positions, ascending."""
    sizes = values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    coded = values.flatten().dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    key = row * (len(coded.dictionary) + 1) + code
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.diff(key[order], prepend=-1))
    words = coded.dictionary.take(pa.array(code[order[first]]))
    ends = np.append(first, len(order)).astype(np.int32)
    positions = pa.ListArray.from_arrays(pa.array(ends), pa.array(place[order].astype(np.int32)))
    found = pa.StructArray.from_arrays([words, positions], ["word", "positions"])
    per_row = np.bincount(row[order[first]], minlength=len(sizes))
    ends = np.concatenate(([0], np.cumsum(per_row))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), found)


@F.arrow_udf(T.ArrayType(T.StructType().add("word", T.StringType()).add("positions", T.ArrayType(T.IntegerType()))))
def _gather(values: pa.Array) -> pa.Array:
    starts = range(0, max(len(values), 1), VALUES_AT_ONCE)
    return pa.concat_arrays([_gathered(values.slice(at, VALUES_AT_ONCE)) for at in starts])


def _values(logs: DataFrame, fields: list[str]) -> DataFrame:
    """Each field that has a value as its different words with their positions; whole values are one word.

    Words meet inside the row, so that a position is never a row of its own.
    """

    def entries(name: str) -> Column:
        if name in TEXT_FIELDS:
            found = _gather(words(F.col(name)))
        else:
            found = F.array(F.struct(F.col(name).alias("word"), F.array(F.lit(0)).alias("positions")))
        return F.when(F.col(name).isNotNull(), found).alias(name)

    return logs.select("log_id", "timestamp", "log_date", *[entries(name) for name in fields])


def _by_field(values: DataFrame, fields: list[str]) -> DataFrame:
    """One row per log and field that has a value."""
    parts = [F.struct(F.lit(name).alias("field"), F.col(name).alias("entries")) for name in fields]
    length = F.aggregate("entries", F.lit(0), lambda n, e: n + F.size(e["positions"]))
    return (
        values.select("log_id", "timestamp", F.inline(F.array(*parts)))
        .where(F.col("entries").isNotNull())
        .select("log_id", "timestamp", "field", length.alias("length"), "entries")
    )


def _words(by_field: DataFrame, buckets: int) -> DataFrame:
    """One row per log, field and word."""
    return by_field.select("log_id", "timestamp", "field", "length", F.inline("entries")).withColumn(
        "bucket", _bucket(F.col("word"), buckets)
    )


class _Index:
    """The batches of an index that count, and its tables cut down to them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        stored = read_stored(spark, f"{self.path}/sizes", _SIZES)
        # One row per batch; ``compact_index`` keeps their number low.
        batches = [] if stored is None else stored.select(*_SIZES.names[:3]).distinct().collect()
        self.names = [row.batch for row in batches]
        self.buckets = batches[0].buckets if batches else None
        self.id_type = batches[0].id_type if batches else None
        self.stored = stored

    def sizes(self) -> DataFrame:
        return self.stored.groupBy("field").agg(
            F.sum("docs").alias("docs"), F.try_divide(F.sum("length"), F.sum("docs")).alias("mean_length")
        )

    def postings(self) -> DataFrame:
        return self._table(
            "postings",
            f"field string, word string, log_id {self.id_type}, timestamp timestamp, length int, "
            "positions array<int>, batch string, bucket int",
        )

    def known(self) -> DataFrame:
        return self._table("known", f"log_id {self.id_type}, log_date date, batch string")

    def _table(self, name: str, schema: str) -> DataFrame:
        kind = T.StructType.fromDDL(schema)
        table = read_stored(self.spark, f"{self.path}/{name}", kind)
        if table is None:
            return self.spark.createDataFrame([], kind)
        return table.where(F.col("batch").isin(self.names))


def _dated(logs: DataFrame) -> DataFrame:
    return logs.withColumn("log_date", F.coalesce(F.to_date("timestamp"), F.lit(_NO_DATE).cast("date")))


def _unknown(dated: DataFrame, index: _Index) -> DataFrame:
    """Logs that no batch holds; known ids are read for the dates of ``dated`` only."""
    lo, hi = dated.agg(F.min("log_date"), F.max("log_date")).first()
    if lo is None:
        return dated
    ids = index.known().where(F.col("log_date").between(F.lit(lo), F.lit(hi)))
    keys = ["log_date", "log_id"]
    return dated.join(ids.select(*keys), keys, "left_anti")


def _files(counts: DataFrame, positions_per_file: int) -> DataFrame:
    """``(bucket, _files)``: at most one row per bucket, so it is broadcast."""
    files = F.ceil(F.sum("positions") / positions_per_file).alias("_files")
    return F.broadcast(counts.groupBy("bucket").agg(files))


def _placed(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of a bucket in one task, or by log in several where it has many."""
    return (
        rows.join(files, "bucket")
        .withColumn("_part", F.pmod(F.xxhash64("log_id"), F.col("_files")))
        .repartition(shuffle_parts(rows.sparkSession), "bucket", "_part")
    )


def _write_postings(rows: DataFrame, path: str, batch: str) -> None:
    columns = ["field", "word", "log_id", "timestamp", "length", "positions", "bucket"]
    ordered = rows.select(*columns).sortWithinPartitions("bucket", "word", "field", "log_id")
    ordered.write.partitionBy("bucket").parquet(f"{path}/postings/batch={batch}")


def append_index(
    logs: DataFrame,
    path: str,
    buckets: int = BUCKETS,
    positions_per_file: int = POSITIONS_PER_FILE,
) -> None:
    """Add the logs that the index at ``path`` does not hold yet, as one batch.

    ``logs`` has ``log_id``, any of the searched fields and optionally
    ``timestamp``; further columns are left out. A log is known by its id and
    date, so a batch can run again. A null field has no value, an empty text is
    a value without words. Rows that repeat an id inside one call are taken as
    one text after the other. Words are shuffled once, by bucket.
    """
    spark = logs.sparkSession
    if "timestamp" not in logs.columns:
        logs = logs.withColumn("timestamp", F.lit(None).cast("timestamp"))
    fields = [name for name in (*TEXT_FIELDS, *KEYWORD_FIELDS) if name in logs.columns]
    if not fields:
        raise ValueError(f"logs have none of {(*TEXT_FIELDS, *KEYWORD_FIELDS)}")
    logs = logs.select("log_id", "timestamp", *fields)
    index = _Index(spark, path)
    # Each field is named several times below; logs may be costly to parse.
    fresh = settle(_dated(logs))
    if index.names:
        fresh = _unknown(fresh, index)
    buckets = index.buckets or buckets
    batch = uuid.uuid4().hex

    # Four tables are made from the words, which are taken from the texts once.
    values = written(_values(fresh, fields))
    by_field = _by_field(values, fields)
    counts = settle(
        _words(by_field, buckets).groupBy("bucket").agg(F.sum(F.size("positions")).alias("positions"))
    )
    files = _files(counts, positions_per_file)
    # An id stands in one row, mostly; only the words of repeated ids meet those of other rows.
    repeated = settle(values.groupBy(F.col("log_id").alias("_id")).count().where("count > 1").select("_id"))
    if repeated.isEmpty():
        postings = _words(by_field, buckets)
    else:
        repeated, same = broadcast_if_small(repeated), F.col("log_id").eqNullSafe(F.col("_id"))
        once = _words(by_field.join(repeated, same, "left_anti"), buckets)
        again = _words(by_field.join(repeated, same, "left_semi"), buckets)
        merged = F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions")
        keys = [c for c in again.columns if c != "positions"]
        postings = once.unionByName(again.groupBy(*keys).agg(merged))
    postings = _placed(postings, files)
    _write_postings(postings, index.path, batch)
    _write_known(values, index.path, batch)
    per_field = by_field.groupBy("field").agg(
        F.count(F.lit(1)).alias("docs"), F.sum("length").alias("length")
    )
    every = spark.createDataFrame([(name,) for name in fields], "field string")
    per_field = every.join(per_field, "field", "left").fillna(0, ["docs", "length"])
    _commit(per_field, index.path, batch, buckets, logs.schema["log_id"].dataType.simpleString())
    forget(values)


def _write_known(dated: DataFrame, path: str, batch: str) -> None:
    # Sorted by date, so that a reader of some dates skips the other row groups.
    ids = dated.select("log_id", "log_date").distinct().sortWithinPartitions("log_date", "log_id")
    ids.write.parquet(f"{path}/known/batch={batch}")


def _commit(per_field: DataFrame, path: str, batch: str, buckets: int, id_type: str) -> None:
    rows = per_field.select(
        F.lit(batch).alias("batch"),
        F.lit(buckets).cast("int").alias("buckets"),
        F.lit(id_type).alias("id_type"),
        "field",
        F.col("docs").cast("long").alias("docs"),
        F.col("length").cast("long").alias("length"),
    )
    rows.coalesce(1).write.mode("append").parquet(f"{path}/sizes")


def compact_index(
    spark: SparkSession, path: str, target: str, positions_per_file: int = POSITIONS_PER_FILE
) -> None:
    """Write the index at ``path`` as one batch to the new folder ``target``.

    The old one stays as it is, so searches go on until they are pointed to the new.
    """
    index = _Index(spark, path)
    if not index.names:
        raise ValueError(f"no index at {path}")
    batch, target = uuid.uuid4().hex, target.rstrip("/")
    postings = index.postings().drop("batch")
    counts = postings.groupBy("bucket").agg(F.sum(F.size("positions")).alias("positions"))
    _write_postings(_placed(postings, _files(counts, positions_per_file)), target, batch)
    _write_known(index.known(), target, batch)
    totals = index.stored.groupBy("field").agg(
        F.sum("docs").alias("docs"), F.sum("length").alias("length")
    )
    _commit(totals, target, batch, index.buckets, index.id_type)


def asked_postings(index: _Index, asked: DataFrame, tokens: DataFrame) -> DataFrame:
    """Postings of the buckets that hold an asked word or token; other folders are not read.

    Up to ``LISTED_WORDS`` of them are pushed into the files, which are sorted by word.
    """
    wanted = asked.select("word").union(tokens.select("token"))
    places = wanted.select(_bucket(F.col("word"), index.buckets).alias("bucket"))
    # No more rows than the index has buckets.
    found = [row.bucket for row in places.distinct().collect()]
    postings = index.postings().where(F.col("bucket").isin(found))
    listed = [row.word for row in wanted.distinct().limit(LISTED_WORDS + 1).collect()]
    return postings.where(F.col("word").isin(listed)) if len(listed) <= LISTED_WORDS else postings


def index_hits(spark: SparkSession, path: str, tokens: DataFrame) -> DataFrame:
    """``(query_id, log_id, score)``, as ``lexical_hits`` gives for the indexed logs.

    ``tokens`` has ``query_id``, ``token_no``, ``token`` and optionally ``lo``, ``hi``.
    A token without a word, such as an empty one, is compared with whole values only.
    """
    index = _Index(spark, path)
    if not index.names:
        raise ValueError(f"no index at {path}")
    asked = query_words(tokens)
    small = is_small(asked)
    postings = asked_postings(index, asked, tokens)
    carried = carried_columns(postings, tokens)
    sizes = index.sizes()
    in_text = postings.where(F.col("field").isin(TEXT_FIELDS)).select(
        "field", "word", "log_id", *carried, "length", "positions"
    )
    vocabulary = asked.select("word").distinct()
    seen = settle(join_on_hot_keys(in_text, vocabulary, ["word"], "log_id", small_known=small))
    values = postings.where(F.col("field").isin(KEYWORD_FIELDS)).select(
        "log_id", *carried, "field", F.col("word").alias("token")
    )
    return summed(
        text_scores(seen, sizes, asked, carried, small).unionByName(
            keyword_scores(values, sizes, tokens, carried, small)
        )
    )


def index_top_k(spark: SparkSession, path: str, tokens: DataFrame, k: int) -> DataFrame:
    """The ``k`` best indexed logs per query: ``(query_id, log_id, score, rank)``."""
    order = [F.col("score").desc(), F.col("log_id").asc()]
    return top_k_per_group(index_hits(spark, path, tokens), ["query_id"], order, k, spread="log_id")
