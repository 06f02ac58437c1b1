"""Memoised values: look up by message, compute only for what is missing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.session import join_on_hot_keys, settle


def lookup_or_compute(
    logs: DataFrame,
    stored: DataFrame | None,
    compute: Callable[[DataFrame], DataFrame],
    value: str,
    key: str = "message",
    spread: str = "log_id",
) -> tuple[DataFrame, DataFrame]:
    """``(logs with value, new (key, value) rows)``.

    ``compute`` gets one row per distinct missing key and returns ``(key,
    value)``. A stored value wins over a new one. Values may be wide, so beyond
    a broadcast they are not copied: the adaptive plan splits hot messages.
    """
    wanted = logs.where(F.col(key).isNotNull()).select(key).distinct()
    missing = wanted if stored is None else wanted.join(stored.select(key), key, "left_anti")
    fresh = settle(compute(missing).select(key, value))
    known = fresh
    if stored is not None:
        known = stored.select(key, value).join(wanted, key, "left_semi").unionByName(fresh)
    return join_on_hot_keys(logs, known, [key], spread, how="left", salts=1), fresh


def first_stored(stored: DataFrame, key: str) -> DataFrame:
    """First-seen value of every key: the earliest row wins."""
    others = [c for c in stored.columns if c not in (key, "timestamp")]
    earliest = F.min_by(F.struct(*others), F.struct("timestamp", *others))
    return stored.groupBy(key).agg(earliest.alias("_row")).select(
        key, *[F.col(f"_row.{c}").alias(c) for c in others]
    )


def report_lookup(logs: DataFrame, reports: DataFrame, spread: str = "log_id") -> DataFrame:
    """Latest given report of each log's message; NULL where there is none."""
    from logweir.sources.store import latest_per_key

    latest = latest_per_key(reports, "message").select("message", "llm_report")
    return join_on_hot_keys(logs, latest, ["message"], spread, how="left")
