"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from a hash of its code
point. The vector of an n-gram binds (multiplies) the vectors of its letters, each
permuted (rotated) by its place; a text's vector bundles (adds) those of its
n-grams, and a language's profile those of its training texts. A text gets the
language whose profile has the highest cosine with it.

n-grams run over the lower-case letters of a text, everything else is one gap.
Vectors of n-grams are made once per batch, and texts are bundled by one matrix
product, in floats that hold the whole-number sums exactly.

Defined results: a null text, or one without a letter, is ``und`` with score 0; a
language needs a training text with a letter to be predicted; ties go to the
language first in code point order; the score is the cosine, negative ones are 0;
without any training text everything is ``und``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir.llm.rows import map_batches, packed, unpacked

DIMENSIONS = 1024
ORDER = 3
UNKNOWN = "und"
#: n-grams whose vectors are in memory at once, and letters of text counted at once.
GRAMS = 512
LETTERS = 250_000


def letter_vectors(codes: np.ndarray, seed: int = 1) -> np.ndarray:
    """One row of +1 and -1 per code point, from a counter hash (splitmix64 finaliser)."""
    words = DIMENSIONS // 64
    x = codes.astype(np.uint64)[:, None] * np.uint64(words) + np.arange(words, dtype=np.uint64)
    x = (x + np.uint64(seed << 40)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    bits = np.unpackbits(x.view(np.uint8), axis=1, bitorder="little")
    return bits.astype(np.float32) * 2 - 1


def gram_vectors(grams: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Bound vectors of n-grams given as rows of places in ``letters``."""
    vectors = letter_vectors(letters)
    out = np.ones((len(grams), DIMENSIONS), np.float32)
    for place in range(grams.shape[1]):
        out *= np.roll(vectors, place, axis=1)[grams[:, place]]
    return out


_LETTER = np.zeros(0, bool)


def _letter_table() -> np.ndarray:
    """For every code point: is it a letter? Made once per worker."""
    global _LETTER
    if not len(_LETTER):
        _LETTER = np.array([chr(c).isalpha() for c in range(0x110000)], bool)
    return _LETTER


def bundles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """``(vectors, has a letter)`` of texts, one row each."""
    vectors = np.zeros((len(texts), DIMENSIONS), np.float32)
    lettered = np.zeros(len(texts), bool)
    # A gap before and after each text, so that no n-gram spans two of them.
    lowered = [f" {t.lower()} " if t else " " for t in texts]
    at = 0
    while at < len(texts):
        until, size = at, 0
        while until < len(texts) and (until == at or size + len(lowered[until]) <= LETTERS):
            size += len(lowered[until])
            until += 1
        _bundle(lowered[at:until], vectors[at:until], lettered[at:until])
        at = until
    return vectors, lettered


def _bundle(texts: list[str], vectors: np.ndarray, lettered: np.ndarray) -> None:
    sizes = np.array([len(t) for t in texts], np.int64)
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(texts)), sizes)
    letter = _letter_table()[chars]
    lettered[np.unique(row[letter])] = True
    # Runs of other characters become one gap, code point 0.
    first = np.concatenate(([True], letter[1:] | letter[:-1] | (row[1:] != row[:-1])))
    codes, row = np.where(letter, chars, 0)[first], row[first]
    seen = np.zeros(int(codes.max(initial=0)) + 1, bool)
    seen[codes] = True
    letters = np.flatnonzero(seen)
    place = np.zeros(len(seen), np.int64)
    place[letters] = np.arange(len(letters))
    code = place[codes]
    base = len(letters)
    grams, own = np.zeros(max(0, len(code) - ORDER + 1), np.int64), None
    for i in range(ORDER):
        grams = grams * base + code[i : len(code) - ORDER + 1 + i]
    # An n-gram belongs to a text when it begins and ends in it.
    inside = row[: len(grams)] == row[ORDER - 1 :]
    grams, own = grams[inside], row[: len(inside)][inside]
    kinds, which = np.unique(grams, return_inverse=True)
    for low in range(0, len(kinds), GRAMS):
        some = kinds[low : low + GRAMS]
        mine = (which >= low) & (which < low + len(some))
        counts = np.bincount(
            own[mine] * len(some) + which[mine] - low, minlength=len(texts) * len(some)
        ).reshape(len(texts), len(some))
        parts = np.stack([some // base**i % base for i in range(ORDER - 1, -1, -1)], axis=1)
        vectors += counts.astype(np.float32) @ gram_vectors(parts, letters)


@dataclass(frozen=True)
class Profiles:
    """Language names in code point order and their profiles, one unit vector each."""

    names: list[str]
    vectors: np.ndarray

    def of(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """``(language, score)`` of each text."""
        vectors, lettered = bundles(texts)
        names = [UNKNOWN] * len(texts)
        scores = np.zeros(len(texts))
        if len(self.names):
            norms = np.maximum(np.linalg.norm(vectors, axis=1), 1e-9)
            cosines = np.round((vectors @ self.vectors.T) / norms[:, None], 6).astype(np.float64)
            best = cosines.argmax(axis=1)
            scores = np.where(lettered, np.clip(cosines.max(axis=1), 0, 1), 0.0)
            names = [self.names[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)]
        return names, scores


def learn(
    docs: DataFrame,
    row_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    per_language: int = 4000,
) -> Profiles:
    """Profiles from labelled rows: about ``per_language`` texts of each language, chosen by id hash.

    That bound is the only sampling; a profile is a sum over thousands of n-grams
    and gains nothing from more. What comes to the driver is one count and one
    vector per language.
    """
    rows = docs.where(F.col(lang).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang).agg(F.count(F.lit(1))).collect()}
    if not counts:
        return Profiles([], np.zeros((0, DIMENSIONS), np.float32))
    mark = F.pmod(F.xxhash64(F.lit(3), F.col(row_id)), F.lit(1_000_000))
    shares = F.create_map(
        *[
            F.lit(v)
            for name, n in counts.items()
            for v in (name, int(min(1.0, per_language / n) * 1_000_000))
        ]
    )
    chosen = rows.where(mark < shares[F.col(lang)]).select(
        F.col(lang).alias("lang"), F.col(text).alias("text")
    )

    def sums(batch: pa.RecordBatch) -> pa.RecordBatch:
        vectors, _ = bundles(batch["text"].to_pylist())
        langs = np.array(batch["lang"].to_pylist(), object)
        names = sorted(set(langs))
        total = [vectors[langs == n].sum(axis=0, dtype=np.float64) for n in names]
        return pa.record_batch(
            {
                "lang": pa.array(names, pa.string()),
                "total": pa.array([t.astype(np.int64) for t in total], pa.list_(pa.int64())),
            }
        )

    each = map_batches(chosen, sums, "lang string, total array<long>")
    added = (
        each.select("lang", F.posexplode("total").alias("dimension", "value"))
        .groupBy("lang", "dimension")
        .agg(F.sum("value").alias("value"))
        .groupBy("lang")
        .agg(F.array_sort(F.collect_list(F.struct("dimension", "value"))).alias("total"))
        .collect()
    )
    found = {r.lang: np.array([x.value for x in r.total], np.float64) for r in added}
    found = {n: v for n, v in found.items() if v.any()}
    names = sorted(found)
    if not names:
        return Profiles([], np.zeros((0, DIMENSIONS), np.float32))
    units = np.stack([found[n] / np.linalg.norm(found[n]) for n in names])
    return Profiles(names, units.astype(np.float32))


def predict(
    docs: DataFrame, profiles: Profiles, text: str = "text", carry: list[str] | None = None
) -> DataFrame:
    """Columns ``carry`` (all if None) of every row with ``lang_pred`` and ``score``."""
    shipped = docs.sparkSession.sparkContext.broadcast(profiles)

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, scores = shipped.value.of(batch["text"].to_pylist())
        return pa.record_batch(
            {
                "row": batch["row"],
                "lang_pred": pa.array(names, pa.string()),
                "score": pa.array(scores, pa.float64()),
            }
        )

    carry = docs.columns if carry is None else carry
    whole = packed(docs, carry, text=F.col(text))
    kind = whole.schema["row"].dataType.simpleString()
    found = map_batches(whole, of, f"row {kind}, lang_pred string, score double")
    return unpacked(found, carry, lang_pred=F.col("lang_pred"), score=F.col("score"))


def bucket(row_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id is in bucket -1."""
    return F.coalesce(F.crc32(row_id.cast("string").cast("binary")) % parts, F.lit(-1))
