"""Continuous ingest: new files to scored records in the log table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from logweir.functions.vectors import embed
from logweir.operators.anomaly import Detector
from logweir.operators.parse import parse_logs
from logweir.operators.reports import anomalies, bucket_means
from logweir.operators.templates import STATE, attach_templates, grow_templates, latest_state, named
from logweir.operators.word_index import append_index
from logweir.schema import ANOMALY_THRESHOLD, VECTOR_DIM
from logweir.session import forget, settle, settled_removed, shuffles_removed, written
from logweir.sources.files import stream_log_dir, with_log_ids
from logweir.sources.store import append_keyed, append_logs, read_stored

_TEMPLATES = f"{STATE}, timestamp timestamp"


def score_records(
    records: DataFrame,
    detector: Detector | None = None,
    model: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Records with vector, score and label; records that failed keep zeros.

    ``records`` are parsed logs with ``format`` telling the failed ones.
    """
    return _scored(records, detector).withColumn("log_vector", _vector(model))


def _vector(model: Callable[[Column], Column] | None) -> Column:
    zero = F.array_repeat(F.lit(0.0), VECTOR_DIM).cast("array<float>")
    return F.when(F.col("format") == "error", zero).otherwise(embed(F.col("message"), model))


def _scored(records: DataFrame, detector: Detector | None) -> DataFrame:
    detector = detector or Detector(None, None)
    failed = F.col("format") == "error"
    return detector.score(records).withColumns(
        {
            "anomaly_score": F.when(failed, 0.0).otherwise(F.col("anomaly_score")),
            "anomaly_label": F.when(failed, 0).otherwise(F.col("anomaly_label")),
        }
    )


def with_templates(records: DataFrame, path: str, now: Column) -> DataFrame:
    """Records with the template of their message, as it is after this batch.

    The table at ``path`` holds the templates of all batches, by leaf: it grows with
    the templates, not with the messages. New and changed ones are appended.
    """
    spark = records.sparkSession
    stored = read_stored(spark, path, StructType.fromDDL(_TEMPLATES))
    known = None if stored is None else settle(latest_state(stored))
    first = F.concat_ws("|", F.date_format(F.min("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS"), "message")
    messages = (
        records.where(F.col("semantic_template").isNull() & F.col("message").isNotNull())
        .groupBy("message")
        .agg(first.alias("first_id"))
    )
    placed, state = grow_templates(messages, known)
    changed = state
    if known is not None:
        changed = state.join(known, ["n_tokens", "head", "place", "tokens"], "left_anti")
    changed.withColumn("timestamp", now).write.mode("append").parquet(path)
    failed = F.col("semantic_template").alias("_failed")
    named_rows = attach_templates(records.select("*", failed).drop("semantic_template"), named(placed, state))
    return named_rows.withColumn(
        "semantic_template", F.coalesce("_failed", "semantic_template")
    ).drop("_failed")


def ingest_batch(
    lines: DataFrame,
    table: str,
    templates: str,
    alerts: str,
    detector: Detector | None = None,
    model: Callable[[Column], Column] | None = None,
    threshold: float = ANOMALY_THRESHOLD,
    index: str | None = None,
) -> None:
    """Write one batch; running it again changes nothing.

    ``index`` is the folder of a word index that takes the new logs too.

    Times that cannot be read become the time of the file, so they are equal
    on every run. Vectors are most of a log's bytes: they are made when new logs
    are written, not for known ones, and are in no table between. What a batch
    stores for itself is compressed and goes once its last reader has run.
    """
    with shuffles_removed(lines.sparkSession):
        parsed = parse_logs(with_log_ids(lines), F.col("file_time"))
        records = written(_scored(parsed, detector))
        with settled_removed():
            rows = written(with_templates(records, templates, F.current_timestamp()))
        forget(records)
        with settled_removed():
            append_logs(rows, table, late={"log_vector": _vector(model)})
            if index is not None:
                append_index(rows, index)
        alert = anomalies(rows, threshold).select(
            "log_id", "timestamp", "level", "source", "message", "anomaly_score"
        )
        # By log, not by batch number, which starts anew with every checkpoint.
        append_keyed(alert, alerts, "log_id")
        forget(rows)


def start_ingest(
    spark: SparkSession,
    path: str,
    table: str,
    templates: str,
    alerts: str,
    checkpoint: str,
    detector: Detector | None = None,
    model: Callable[[Column], Column] | None = None,
    archive: str | None = None,
    every: str | None = "40 seconds",
    files_per_batch: int | None = None,
    index: str | None = None,
) -> StreamingQuery:
    """Watch ``path`` for new log files; ``every=None`` takes what is there and stops."""

    def write(lines: DataFrame, batch_id: int) -> None:
        ingest_batch(lines, table, templates, alerts, detector, model, index=index)

    lines = stream_log_dir(spark, path, files_per_batch, archive)
    writer = lines.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.trigger(**trigger).start()


def stream_bucket_means(
    logs: DataFrame, field: str, span: str = "5 minutes", late: str = "10 minutes"
) -> DataFrame:
    """Bucket means of a stream; buckets older than ``late`` are closed and dropped from state."""
    return bucket_means(logs.withWatermark("timestamp", late), field, span)
