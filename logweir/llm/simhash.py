"""SimHash near-duplicates: fingerprints, ball hashing that meets in the middle, components.

Two fingerprints that differ in at most three of 64 bits have a variant in
common, one or two flipped bits away from either. How many bits a fingerprint
flips follows from the parity of its set bits, so that every link is met and few
variants are made:

* an odd fingerprint makes its 64 one-bit variants;
* an even one makes itself, its one-bit variants, and those two-bit variants
  whose two bits are both even or both odd positions.

Difference 1 is an even fingerprint on a variant of an odd one, difference 2 are
equal one-bit variants. At difference 3 one side is even; of the three bits two
have positions of one parity, the even side flips these and the odd side the third.

All variants with the same leading bits go to one group. A fingerprint is sent
to every group it has variants in and makes them there, so the shuffle carries
fingerprints, not variants. A crowded group is split by the hash of the variant.

Defined results: a null text has no words and the fingerprint zero; zero links
like any other; a null id is larger than all others; repeated rows stay rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.llm.components import components
from logweir.llm.rows import map_batches, packed, texts_as_bytes, unpacked, written

BITS = 64
RADIUS = 3
#: Variants that one group makes at most, about 16 bytes each.
GROUP_VARIANTS = 2_000_000
#: Stands for a null id where ids are compared.
LAST = 2**63 - 1


def shingle_hashes(text: bytes | None, words: int, seed: int) -> np.ndarray:
    """The XXH64 of all shingles of ``words`` words, in their order."""
    parts = text.lower().split() if text else []  # bytes: only A-Z, and white space as in WORD
    if not parts:
        return np.zeros(0, np.uint64)
    line = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(words, len(parts))
    spans = zip(starts[: len(parts) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[s:e], seed) for s, e in spans], np.dtype("<u8"))


def fingerprint(text: bytes | None, words: int, seed: int) -> int:
    """64 bits, each the majority of that bit in the XXH64 of all shingles of ``words`` words."""
    hashes = shingle_hashes(text, words, seed)
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 8192):
        octets = hashes[at : at + 8192].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(
    docs: DataFrame, row_id: str = "doc_id", text: str = "text", words: int = 3, seed: int = 42
) -> DataFrame:
    """``(id, fp)`` for every row; ``fp`` holds the 64 bits as a signed long."""

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [fingerprint(t, words, seed) for t in texts_as_bytes(batch["text"])]
        fp = pa.array(np.array(found, np.uint64).view(np.int64))
        return pa.record_batch({"id": batch["id"], "fp": fp})

    plain = docs.select(F.col(row_id).cast("long").alias("id"), F.col(text).alias("text"))
    return map_batches(plain, of, "id long, fp long")


def _odd(values: np.ndarray) -> np.ndarray:
    return (np.bitwise_count(values) & 1).astype(bool)


def _flips(bits: range) -> tuple[np.ndarray, np.ndarray]:
    """Masks of one bit, and of two bits whose positions have the same parity."""
    one = np.array([1 << b for b in bits], np.uint64)
    two = [(1 << a) | (1 << b) for a in bits for b in bits if a < b and (a - b) % 2 == 0]
    return one, np.array(two, np.uint64)


def _groups_of(batch: pa.RecordBatch, prefix: int) -> pa.RecordBatch:
    """``(part, fp)``: the leading bits of every variant of every fingerprint."""
    fps = batch["fp"].to_numpy(zero_copy_only=False).view(np.uint64)
    one, two = _flips(range(BITS - prefix, BITS))
    even = fps[~_odd(fps)]
    out = [(fps, np.zeros(1, np.uint64)), (fps, one), (even, two)]
    parts = [np.bitwise_xor.outer(f, m) >> np.uint64(BITS - prefix) for f, m in out]
    return pa.record_batch(
        {
            "part": pa.array(np.concatenate([p.ravel() for p in parts]).astype(np.int64)),
            "fp": pa.array(
                np.concatenate([np.repeat(f, len(m)) for f, m in out]).view(np.int64)
            ),
        }
    )


def _variants(fps: np.ndarray, part: int, prefix: int) -> tuple[np.ndarray, np.ndarray]:
    """Variants with the leading bits ``part``, and the place of the fingerprint of each."""
    low = range(BITS - prefix)
    one, two = _flips(low)
    apart = (fps >> np.uint64(BITS - prefix)) ^ np.uint64(part)
    distance, odd = np.bitwise_count(apart), _odd(fps)
    base = fps ^ (apart << np.uint64(BITS - prefix))  # the leading bits flipped to ``part``
    same = [np.array([1 << b for b in low if b % 2 == p], np.uint64) for p in (0, 1)]
    evens = np.uint64(sum(1 << b for b in range(0, BITS, 2)))
    flipped_even = ((apart << np.uint64(BITS - prefix)) & evens) != 0
    none = np.zeros(1, np.uint64)
    made = [
        (~odd, none),  # none, one or two bits flipped, all of them leading ones
        (odd & (distance == 1), none),
        ((distance == 0), one),
        (~odd & (distance == 0), two),
        (~odd & (distance == 1) & flipped_even, same[0]),
        (~odd & (distance == 1) & ~flipped_even, same[1]),
    ]
    places = [np.flatnonzero(who) for who, _ in made]
    values = [
        np.bitwise_xor.outer(base[p], m).ravel() for p, (_, m) in zip(places, made, strict=True)
    ]
    owners = [np.repeat(p, len(m)) for p, (_, m) in zip(places, made, strict=True)]
    return np.concatenate(values), np.concatenate(owners)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return values ^ (values >> np.uint64(33))


def _forest(a: np.ndarray, b: np.ndarray, nodes: int) -> np.ndarray:
    """The smallest node that each node is connected with."""
    label = np.arange(nodes)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while not np.array_equal(label, deeper := label[label]):
            label = deeper
        if np.array_equal(label, before):
            return label


def _links_of(table: pa.Table, prefix: int) -> pa.Table:
    """``(a, b)``: fingerprints of one group with the smallest they are connected with there."""
    part, salt, salts = (table[c][0].as_py() for c in ("part", "salt", "salts"))
    fps = np.unique(table["fp"].to_numpy().view(np.uint64))
    values, owners = [], []
    for at in range(0, len(fps), 512):
        value, owner = _variants(fps[at : at + 512], part, prefix)
        if salts > 1:
            mine = _mixed(value) % np.uint64(salts) == salt
            value, owner = value[mine], owner[mine]
        values.append(value)
        owners.append((owner + at).astype(np.int32))
    value, owner = np.concatenate(values), np.concatenate(owners)
    del values, owners
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    # Only variants made by more than one fingerprint matter.
    twin = value[1:] == value[:-1]
    met = np.concatenate((twin, [False])) | np.concatenate(([False], twin))
    value, owner = value[met], owner[met]
    a = b = np.zeros(0, np.int64)
    if len(value):
        start = np.concatenate(([True], value[1:] != value[:-1]))
        run = np.cumsum(start) - 1
        # On an even variant two even fingerprints that both flipped two bits may be four bits
        # apart. All others are links, so one that flipped at most one bit is met by all.
        near = np.bitwise_count(value ^ fps[owner]) <= 1
        centre = np.full(run[-1] + 1, len(fps), np.int64)
        np.minimum.at(centre, run[near], owner[near])
        a, b = owner.astype(np.int64), centre[run]
        keep = (b < len(fps)) & (a != b)
        a, b = a[keep], b[keep]
        close = np.bitwise_count(fps[a] ^ fps[b]) <= RADIUS
        a, b = a[close], b[close]
    label = _forest(a, b, len(fps))
    moved = np.flatnonzero(label != np.arange(len(fps)))
    return pa.table(
        {
            "a": pa.array(fps[moved].view(np.int64)),
            "b": pa.array(fps[label[moved]].view(np.int64)),
        }
    )


def links(fps: DataFrame, prefix: int | None = None) -> DataFrame:
    """``(a, b)``: links between distinct ``fp`` that connect all with at most three bits between them.

    ``prefix`` is the number of leading bits that make a group, from the number
    of fingerprints where it is not given; the connections do not depend on it.
    """
    fps = fps.select("fp")
    if prefix is None:
        prefix = min(32, max(8, math.ceil(math.log2(max(2, fps.count()) / 200))))
    sent = map_batches(fps, lambda batch: _groups_of(batch, prefix), "part long, fp long")
    # One row per group, at most 2^prefix.
    crowd = sent.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    most = GROUP_VARIANTS // 400
    crowd = crowd.select("part", F.ceil(F.col("n") / most).cast("int").alias("salts"))
    dealt = sent.join(crowd, "part").select(
        "part", "fp", "salts", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")
    )
    return dealt.groupBy("part", "salt").applyInArrow(
        lambda table: _links_of(table, prefix), "a long, b long"
    )


def near_duplicates(
    docs: DataFrame, row_id: str = "doc_id", text: str = "text", words: int = 3, seed: int = 42
) -> DataFrame:
    """``(id, fp, component_id)`` for every row of ``docs``; ``fp`` is a signed long.

    ``component_id`` is the smallest id reachable over links, the own one included.
    """
    marked = written(fingerprints(docs, row_id, text, words, seed))
    firsts = marked.groupBy("fp").agg(F.min("id").alias("first"))
    firsts = written(firsts)
    tied = components(links(firsts))
    roots = firsts.join(tied.withColumnRenamed("a", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("b", "fp").alias("root")
    )
    least = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    # A fingerprint or a component may hold a third of all rows: both joins are split where needed.
    classes = roots.join(least, "root").select("fp", "component_id")
    return marked.join(classes, "fp").select("id", "fp", "component_id")


def keep_first(
    docs: DataFrame,
    row_id: str = "doc_id",
    text: str = "text",
    groups: Callable[[DataFrame, str, str], DataFrame] = near_duplicates,
) -> DataFrame:
    """One row of every component of ``docs``, that of the smallest id; a null id comes last.

    ``groups`` gives the ``component_id`` of every ``id``. It is asked for texts, by their hash,
    so that unlike texts of one id, or without an id, stay apart. Rows of the same id and
    text are one; where a component's smallest id has several of its texts, one of these stays.
    """
    last, digest = F.lit(LAST), F.xxhash64(F.col(text))
    found = groups(docs.select(digest.alias("digest"), F.col(text).alias("text")), "digest", "text")
    found = found.select(F.coalesce("id", last).alias("digest"), "component_id").distinct()
    whole = packed(docs, key=F.coalesce(F.col(row_id).cast("long"), last), digest=digest)
    firsts = whole.select("key", "digest").distinct().join(found, "digest").groupBy("component_id")
    firsts = firsts.agg(F.min(F.struct("key", "digest")).alias("first")).select("first.*")
    kept = whole.join(firsts, ["key", "digest"], "left_semi")
    one = kept.groupBy("key", "digest").agg(F.first("row").alias("row"))
    return unpacked(one, docs.columns)
