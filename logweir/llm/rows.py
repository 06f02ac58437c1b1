"""Helpers the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.session import forget, shuffles_removed, written  # noqa: F401

#: White space that separates words and is stripped from lines: [\x20\x09-\x0D].
SPACE = "[\\x20\\x09-\\x0D]"
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def packed(df: DataFrame, carry: list[str] | None = None, **more: Column) -> DataFrame:
    """Columns ``carry`` of ``df`` (all if None) in one struct ``row``, beside those of ``more``.

    Whatever the input columns are called, they cannot clash with ``more``.
    """
    carried = df.columns if carry is None else carry
    row = F.struct(*[F.col(quoted(c)) for c in carried]).alias("row")
    return df.select(row, *[c.alias(n) for n, c in more.items()])


def unpacked(df: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The input columns again, with those of ``new`` in place of any of the same name."""
    kept = [
        new.pop(c).alias(c) if c in new else F.col("row").getField(c).alias(c) for c in columns
    ]
    return df.select(*kept, *[c.alias(n) for n, c in new.items()])


def map_batches(
    df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str
) -> DataFrame:
    """``function`` over the record batches of ``df``, in pieces of at most 256 rows.

    A batch has up to 10,000 rows; with long texts, what a function makes of
    all of them at once would be many times the batch.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                yield function(batch.slice(start, 256))

    return df.mapInArrow(pieces, schema)


def texts_as_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return column.cast(pa.binary()).to_pylist()
