"""Session settings and the few places where a plan looks at the data first."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BROADCAST_ROWS = 50_000
BROADCAST_BYTES = 64 * 1024 * 1024
ROWS_PER_TASK = 100_000


class _Made(threading.local):
    """The tables that ``settle`` made inside ``settled_removed``."""

    tables: list[DataFrame] | None = None


_made = _Made()


def prepare(spark: SparkSession) -> SparkSession:
    """Wall-clock timestamps are read as UTC everywhere."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate files that all executors see.

    It is the one the cluster names in ``spark.checkpoint.dir``, or the
    checkpoint folder already set. A temporary one is made only for a local
    master; on a cluster its executors would not share it, so that is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
    return tempfile.mkdtemp(prefix="logweir-")


def scratch(spark: SparkSession) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage with a reliable checkpoint."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    settled = df.checkpoint(eager=True)
    if _made.tables is not None:
        _made.tables.append(settled)
    return settled


@contextmanager
def settled_removed() -> Iterator[None]:
    """Tables that ``settle`` makes inside are deleted at the end, when nothing reads them any more.

    It holds for the thread, as batches of several streams may run at once.
    """
    outer, _made.tables = _made.tables, []
    try:
        yield
    finally:
        tables, _made.tables = _made.tables, outer
        for df in tables:
            _delete(df.sparkSession, df._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get())


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, lineage cut."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Delete the files of tables that ``written`` made, once their last reader has run."""
    for df in tables:
        for folder in {name.rpartition("/")[0] for name in df.inputFiles()}:
            _delete(df.sparkSession, folder)


def _delete(spark: SparkSession, folder: str) -> None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Inside, an action deletes its shuffle files when it ends, not when the driver next collects garbage.

    For operators of many actions, whose tables are written between them.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, True)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def spread(df: DataFrame, rows_per_task: int | None = None) -> DataFrame:
    """Even out an input for work that is heavy per row.

    It is dealt anew where it comes in fewer splits than there are cores. Splits are cut by
    bytes, but a file's rows can be parted only between its row groups, and narrow rows are
    many in a split. So with ``rows_per_task`` a stored table is dealt anew too where splits
    hold more rows on average: tasks grow in number, not in length. The rows are counted,
    which reads no column of a Parquet file.
    Rows go by the hash of all columns, which needs no sort and is repeatable.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    turns = 1 if rows_per_task is None else max(1, -(-df.count() // (rows_per_task * cores)))
    parts = cores * turns
    if splits >= parts:
        return df
    return df.repartition(parts, *[c for c, kind in df.dtypes if "map<" not in kind])


def shuffle_parts(spark: SparkSession) -> int:
    """Partitions for steps whose work is not told by their bytes, so AQE must not merge them."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """True when ``df`` has at most ``rows`` rows and ``size`` bytes of text.

    Reads no more rows than the bound.
    """
    text = F.octet_length(F.to_json(F.struct("*")))
    found = (
        df.limit(rows + 1)
        .agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(text), F.lit(0)).alias("size"))
        .first()
    )
    return found.rows <= rows and found.size <= size


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint behind a row-count check, else leave the choice to AQE."""
    return F.broadcast(df) if is_small(df, rows) else df


def join_on_hot_keys(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    spread: str,
    how: str = "inner",
    salts: int = 16,
    small_known: bool | None = None,
) -> DataFrame:
    """Join a large side whose keys may be hot with a side that may be small.

    A checked-small side is broadcast: no shuffle of the large side. Beyond the
    bound the key is salted, the small side being copied once per salt, so one
    key that holds a third of the rows is still spread over ``salts`` tasks.
    ``spread`` names a column of ``big`` that tells rows of one key apart;
    ``small_known`` passes on a check made before. With one salt nothing is copied
    and hot keys are left to the adaptive plan, which suits a side of wide rows.

    A side that was found too large is never broadcast: Spark takes an array for
    one element and a text for 20 bytes, so its own estimate may be far too low.
    """
    if is_small(small) if small_known is None else small_known:
        return big.join(F.broadcast(small), on, how)
    if salts == 1:
        return big.join(small.hint("merge"), on, how)
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies.hint("merge"), [*on, "_salt"], how).drop("_salt")


def top_k_per_group(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    k: int,
    spread: str,
    salts: int = 32,
    rank: str = "rank",
) -> DataFrame:
    """First ``k`` rows of every group, in two steps.

    The first step ranks inside (group, salt), so a hot group is cut down by
    many tasks; at most ``k * salts`` rows of a group reach the second step.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    inner = Window.partitionBy(*keys, "_salt").orderBy(*order)
    outer = Window.partitionBy(*keys).orderBy(*order)
    return (
        salted.withColumn("_rn", F.row_number().over(inner))
        .where(F.col("_rn") <= k)
        .drop("_rn", "_salt")
        .withColumn(rank, F.row_number().over(outer))
        .where(F.col(rank) <= k)
    )
