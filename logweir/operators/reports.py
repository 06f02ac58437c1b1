"""Filters, newest-first lists, counts and bucket means over the log table.

Ties are always broken by ``log_id``. Time filters are plain ranges on
``timestamp``, so they reach the scan and, on a table partitioned by date, go
with a filter on the partition column (``between_dates``).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir.schema import ANOMALY_THRESHOLD
from logweir.session import top_k_per_group


def _newest_first() -> list[Column]:
    return [F.col("timestamp").desc(), F.col("log_id").asc()]


def anomalies(logs: DataFrame, threshold: float = ANOMALY_THRESHOLD) -> DataFrame:
    """Rows whose score reaches the threshold."""
    return logs.where(F.col("anomaly_score") >= F.lit(float(threshold)))


def recent_logs(logs: DataFrame, size: int = 100) -> DataFrame:
    return logs.orderBy(*_newest_first()).limit(size)


def recent_anomalies(
    logs: DataFrame, threshold: float = ANOMALY_THRESHOLD, size: int = 100
) -> DataFrame:
    return recent_logs(anomalies(logs, threshold), size)


def recent_messages(logs: DataFrame, size: int = 10) -> DataFrame:
    """Messages of the newest logs; a missing message leaves a shorter list."""
    return (
        recent_logs(logs.select("log_id", "timestamp", "message"), size)
        .where(F.col("message").isNotNull())
        .select("log_id", "timestamp", "message")
    )


def between(logs: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """Inclusive time range; prunes date partitions where the table has ``log_date``."""
    kept = logs.where(F.col("timestamp").between(lo, hi))
    if "log_date" in logs.columns:
        kept = kept.where(F.col("log_date").between(F.to_date(lo), F.to_date(hi)))
    return kept


def between_dates(logs: DataFrame, dates: list[dt.datetime]) -> DataFrame:
    """Inclusive range from the earliest to the latest of a list of times."""
    times = F.array(*[F.lit(d.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp") for d in dates])
    return between(logs, F.array_min(times), F.array_max(times))


def date_range_logs(logs: DataFrame, dates: list[dt.datetime], size: int = 100) -> DataFrame:
    """Search by dates only: newest first, at most ``size``."""
    return recent_logs(between_dates(logs, dates), size)


def info_last_day(logs: DataFrame, as_of: Column) -> DataFrame:
    """``INFO`` logs of the 24 hours up to ``as_of``."""
    return between(
        logs.where(F.col("level") == "INFO"), as_of - F.expr("INTERVAL 24 HOURS"), as_of
    )


def logs_per_source(logs: DataFrame, buckets: int = 10) -> DataFrame:
    """Counts of the largest sources."""
    counts = logs.groupBy("source").agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.desc("count"), "source").limit(buckets)


def newest_per_source(logs: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` logs of every source; a hot source is cut down by many tasks first."""
    return top_k_per_group(logs, ["source"], _newest_first(), n, spread="log_id")


def context_messages(logs: DataFrame, as_of: Column, n: int, buckets: int = 10) -> DataFrame:
    """Messages that fill up a training window: newest ``INFO`` logs of the largest sources."""
    recent = info_last_day(logs, as_of).select("log_id", "timestamp", "source", "message")
    largest = logs_per_source(recent, buckets).select("source")
    return newest_per_source(recent.join(F.broadcast(largest), "source", "left_semi"), n)


def bucket_means(
    logs: DataFrame, field: str, span: str = "5 minutes", timestamp: str = "timestamp"
) -> DataFrame:
    """Mean and count per time bucket; also runs on a stream with a watermark."""
    return (
        logs.groupBy(F.window(timestamp, span).alias("w"))
        .agg(F.avg(field).alias("mean"), F.count(F.lit(1)).alias("count"))
        .select(F.col("w.start").alias("bucket"), "mean", "count")
    )


def flag_buckets(means: DataFrame, span_seconds: int = 300, trailing: int = 12) -> DataFrame:
    """Flag buckets whose mean is over three deviations off the trailing baseline.

    The baseline of a bucket is the mean and deviation of the bucket means in
    the ``trailing`` spans before it. Every bucket adds itself to the baselines
    after it, so the step is a grouping by bucket and needs no global order.
    """
    slot = (F.unix_seconds(F.col("bucket")) / span_seconds).cast("long")
    numbered = means.withColumn("slot", slot)
    baseline = (
        numbered.select(
            F.col("mean").alias("past_mean"),
            F.explode(F.sequence(F.col("slot") + 1, F.col("slot") + trailing)).alias("slot"),
        )
        .groupBy("slot")
        .agg(
            F.count(F.lit(1)).alias("past_buckets"),
            F.avg("past_mean").alias("past_mean"),
            F.stddev_samp("past_mean").alias("past_stddev"),
        )
    )
    off = F.abs(F.col("mean") - F.col("past_mean")) > 3 * F.col("past_stddev")
    return (
        numbered.join(baseline, "slot", "left")
        .withColumn("anomalous", F.coalesce(off, F.lit(False)))
        .drop("slot")
    )


def with_count(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Result envelope: each row with the number of rows of its query."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))
    return rows.join(counts, keys)
