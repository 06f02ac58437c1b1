"""Log files as tables of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.operators.parse import parse_logs

COPIES_PER_STEP = 10_000


def is_log_file(name: Column) -> Column:
    """Suffix ``.log`` or ``.txt``, or ``log`` in the name, or no suffix."""
    lower = F.lower(name)
    has_suffix = lower.rlike(r"^.+\.[^.]+$")
    return lower.rlike(r"^.+\.(log|txt)$") | lower.contains("log") | ~has_suffix


def _lines(text: DataFrame) -> DataFrame:
    return text.select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_modification_time").alias("file_time"),
    ).where(is_log_file(F.col("file_name")) & F.col("line").rlike(r"(?U)\S"))


def scan_log_dir(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines of all log files below ``path``."""
    return _lines(spark.read.option("recursiveFileLookup", True).text(path))


def stream_log_dir(
    spark: SparkSession,
    path: str,
    files_per_batch: int | None = None,
    archive: str | None = None,
) -> DataFrame:
    """New files below ``path`` as a stream of lines; appends to known files are not seen.

    With ``archive`` the files of a finished batch are moved there. Files must
    be moved into ``path`` whole.
    """
    reader = spark.readStream.option("recursiveFileLookup", True)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return _lines(reader.text(path))


def with_log_ids(lines: DataFrame) -> DataFrame:
    """Add ``log_id``: hash of file path, line text and the number of the copy.

    Equal lines of one file differ in nothing, so they are counted (partly
    before the shuffle) and written out again from the count. A line with many
    copies is first cut into steps, and the steps are spread over the tasks.
    """
    counted = lines.groupBy("file_path", "file_name", "file_time", "line").agg(
        F.count(F.lit(1)).alias("copies")
    )
    last_step = F.floor((F.col("copies") - 1) / COPIES_PER_STEP)
    first_steps = counted.withColumn("step", F.lit(0).cast("long"))
    more_steps = (
        counted.where(F.col("copies") > COPIES_PER_STEP)
        .withColumn("step", F.explode(F.sequence(F.lit(1).cast("long"), last_step)))
        .repartition("line", "step")
    )
    start = F.col("step") * COPIES_PER_STEP + 1
    end = F.least(start + COPIES_PER_STEP - 1, F.col("copies"))
    numbered = first_steps.unionByName(more_steps).withColumn(
        "copy", F.explode(F.sequence(start, end))
    )
    key = F.concat_ws("\u0000", "file_path", "line", F.col("copy").cast("string"))
    return numbered.withColumn("log_id", F.sha2(key, 256)).drop("copies", "step", "copy")


def good_logs(spark: SparkSession, path: str) -> DataFrame:
    """Training corpus: message (else raw text), source and level of every line."""
    lines = _lines(spark.read.option("recursiveFileLookup", True).text(path))
    named = lines.select("line", F.lit("application").alias("file_name"))
    return parse_logs(named).select("message", "source", "level", "timestamp")


def raw_messages(spark: SparkSession, path: str) -> DataFrame:
    """One stripped line per row, blank lines dropped."""
    return (
        spark.read.text(path)
        .select(F.regexp_replace("value", r"(?U)^\s+|\s+$", "").alias("message"))
        .where(F.col("message") != "")
    )
