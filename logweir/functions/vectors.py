"""Vector columns built from native expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from logweir.schema import VECTOR_DIM


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A lambda variable is a bound value, so the optimizer cannot inline the
    expression at each of its uses.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def magnitude(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x))


def is_zero(vector: Column) -> Column:
    return ~F.exists(vector, lambda x: x != 0)


def unit(vector: Column) -> Column:
    """Vector divided by its length; a zero vector stays zero."""
    return let(
        vector,
        lambda v: let(
            magnitude(v),
            lambda size: F.when(size > 0, F.transform(v, lambda x: x / size)).otherwise(v),
        ),
    )


#: Texts and characters that are turned into vectors at once.
TEXTS_AT_ONCE = 256
CHARS_AT_ONCE = 1 << 18


def _cells(bodies: list[str], dim: int) -> np.ndarray:
    """The vectors of a few texts, as one weighted count over (text, cell)."""
    sizes = np.array([len(t) for t in bodies], np.int64)
    codes = np.frombuffer("".join(bodies).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(bodies)), sizes)
    place = (np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)) % dim
    # Without any character the count has no weights, and so whole numbers.
    sums = np.bincount(row * dim + place, codes / 255.0, len(bodies) * dim).astype(float)
    sums = sums.reshape(len(bodies), dim)
    # The running sum adds in order of position, as the definition does.
    sizes = np.sqrt(np.cumsum(sums * sums, axis=1)[:, -1:])
    return np.divide(sums, sizes, out=sums, where=sizes > 0)


def _few(bodies: list[str]) -> Iterator[list[str]]:
    """The texts in order, ``TEXTS_AT_ONCE`` or ``CHARS_AT_ONCE`` at a time, one at least."""
    start = chars = 0
    for at, body in enumerate(bodies):
        if at > start and (at - start == TEXTS_AT_ONCE or chars + len(body) > CHARS_AT_ONCE):
            yield bodies[start:at]
            start, chars = at, 0
        chars += len(body)
    if bodies:
        yield bodies[start:]


def _hashed(message: Column, dim: int, kind: str) -> Column:
    numbers = {"double": np.float64, "float": np.float32}[kind]

    @F.arrow_udf(f"array<{kind}>")
    def cells(texts: pa.Array) -> pa.Array:
        parts = [_cells(few, dim).astype(numbers).ravel() for few in _few(texts.to_pylist())]
        values = np.concatenate([np.zeros(0, numbers), *parts])
        ends = np.arange(len(texts) + 1, dtype=np.int32) * dim
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))

    return cells(F.coalesce(message, F.lit("")))


def hash_embedding(message: Column, dim: int = VECTOR_DIM) -> Column:
    """Unit vector of character codes: position ``i`` adds ``code / 255`` to ``i % dim``.

    A batch is taken a few texts at a time, so a task holds little beside the vectors it returns.
    """
    return _hashed(message, dim, "double")


def embed(message: Column, model: Callable[[Column], Column] | None = None) -> Column:
    """Message vector as stored: ``model`` may be any column function or ``pandas_udf``.

    Vectors of the default model leave the Python worker as floats, not as doubles.
    """
    if model is None:
        return _hashed(message, VECTOR_DIM, "float")
    return model(message).cast("array<float>")
