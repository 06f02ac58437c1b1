"""The log table and the keyed tables, as Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from logweir.operators.parse import to_log_schema
from logweir.schema import LOG_SCHEMA
from logweir.session import broadcast_if_small, join_on_hot_keys, settle, shuffle_parts

ROWS_PER_FILE = 2_000_000

_STORED = T.StructType([*LOG_SCHEMA.fields, T.StructField("log_date", T.DateType())])


def read_logs(spark: SparkSession, path: str) -> DataFrame | None:
    """The log table with its partition column ``log_date``, or None before the first write."""
    return read_stored(spark, path, _STORED)


def read_stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def append_logs(
    records: DataFrame, path: str, now: Column | None = None, late: dict[str, Column] | None = None
) -> None:
    """Append records that the table does not hold yet.

    Columns ``late`` are computed from those of ``records`` for the new records only,
    after the last shuffle.

    Known ``log_id`` values are looked up only in the date partitions that the
    batch touches; a missing timestamp becomes ``now``.
    """
    spark = records.sparkSession
    stamp = F.coalesce("timestamp", now if now is not None else F.current_timestamp())
    rows = records.withColumn("timestamp", stamp).withColumn("log_date", F.to_date("timestamp"))
    files = F.ceil(F.count(F.lit(1)) / ROWS_PER_FILE).alias("_files")
    dates = settle(rows.groupBy("log_date").agg(files))
    known = read_logs(spark, path)
    if known is not None:
        lo, hi = dates.agg(F.min("log_date"), F.max("log_date")).first()
        if lo is None:
            return
        # Between the first and last date only partitions of the batch's own dates are read.
        own = broadcast_if_small(dates.select("log_date"))
        ids = known.where(F.col("log_date").between(F.lit(lo), F.lit(hi))).join(
            own, "log_date", "left_semi"
        )
        keys = ["log_date", "log_id"]
        rows = rows.join(ids.select(*keys), keys, "left_anti")
    dated = to_log_schema(_by_date(rows, dates).withColumns(late or {}), "log_date")
    dated.write.mode("append").partitionBy("log_date").parquet(path)


def _by_date(rows: DataFrame, dates: DataFrame) -> DataFrame:
    """One task per date, or several for a date with many rows; few files either way."""
    part = F.pmod(F.xxhash64("log_id"), F.col("_files"))
    placed = join_on_hot_keys(rows, dates, ["log_date"], spread="log_id")
    return (
        placed.withColumn("_part", part)
        .repartition(shuffle_parts(rows.sparkSession), "log_date", "_part")
        .drop("_files", "_part")
    )


def append_keyed(rows: DataFrame, path: str, key: str, new_keys_only: bool = True) -> None:
    """Append ``(key, value, timestamp)`` rows; keys already stored keep their value."""
    if new_keys_only:
        known = read_stored(rows.sparkSession, path, rows.schema)
        if known is not None:
            rows = rows.join(known.select(key), key, "left_anti")
    rows.write.mode("append").parquet(path)


def latest_per_key(stored: DataFrame, key: str) -> DataFrame:
    """Newest row of every key, by a partial aggregate."""
    others = [c for c in stored.columns if c not in (key, "timestamp")]
    newest = F.max_by(F.struct(*others), F.struct("timestamp", *others))
    return stored.groupBy(key).agg(
        newest.alias("_row"), F.max("timestamp").alias("timestamp")
    ).select(key, *[F.col(f"_row.{c}").alias(c) for c in others], "timestamp")


def write_csv(scored: DataFrame, path: str) -> None:
    """CSV with a header; arrays, maps and structs become JSON text."""
    nested = ("array", "map", "struct")
    columns = [
        F.to_json(name).alias(name) if kind.startswith(nested) else F.col(name)
        for name, kind in scored.dtypes
    ]
    scored.select(*columns).write.option("header", True).option("escape", '"').csv(path)

