"""Sampled SentencePiece segmentations: forward filtering, backward sampling; lossless decoding.

All pieces that fit a stretch of text form a lattice. Forward filtering adds up,
for every position, the weights of all ways to reach it; backward sampling then
walks from the end and draws each piece in proportion to the ways through it, so
every segmentation has exactly its share of the total weight. The draws come from
a hash of the seed, the row key, the number of the stretch in the text and the
step, so a row is cut the same way in whatever task, batch or order it comes.

Where no piece holds two neighbouring characters side by side, all segmentations
have a cut there, so a text's lattice falls apart into stretches, mostly parts of
words. Each distinct stretch of a batch is filtered once, for all its draws.

The model file ranks its pieces but has no probabilities; a piece of rank r gets
the Zipf weight (r + 2.7) ** -alpha. Smaller ``alpha`` flattens the draws.

Defined results: a null text has null ids, an empty text has none; characters
outside the vocabulary, and the blank mark itself, are spelled as byte pieces;
rows of one key are cut alike; a null key is a key of its own; decoding gives back
every character.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.llm.rows import packed, unpacked

MARK = "▁"
#: Characters below this are looked up in a table of pairs; above, stretches are not cut.
PAIRS = 0x250
#: Text bytes whose lattices are built together, and stretches drawn together.
BATCH_BYTES = 250_000
DRAWN = 60_000


@dataclass(frozen=True)
class Pieces:
    """What tasks need of a model: piece texts, byte piece ids, log weights."""

    texts: list[str | None]  # None: not a piece for text (control and byte pieces)
    spelled: list[bytes]  # what a piece decodes to
    of_byte: list[int]
    weights: list[float]

    @staticmethod
    def load(path: str, alpha: float = 1.0) -> Pieces:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        texts, spelled, weights, of_byte = [], [], [], [0] * 256
        for i in range(size):
            piece = model.id_to_piece(i)
            rank = size
            if model.is_byte(i):
                value = int(piece[1:-1], 16)
                of_byte[value] = i
                texts.append(None)
                spelled.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i):
                texts.append(None)
                spelled.append(b"")
            else:
                texts.append(piece.replace(MARK, " "))
                spelled.append(texts[-1].encode())
                rank = -model.get_score(i)
            weights.append(-alpha * float(np.log(rank + 2.7)))
        return Pieces(texts, spelled, of_byte, weights)


class Matcher:
    """The pieces as a trie, its edges in an open hash table that numpy can probe."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.joined = np.ones((PAIRS + 1, PAIRS + 1), bool)
        self.joined[:PAIRS, :PAIRS] = False
        edges: dict[tuple[int, int], int] = {}
        ends = [-1]
        for i, text in enumerate(pieces.texts):
            if text is None:
                continue
            for a, b in zip(map(ord, text), map(ord, text[1:]), strict=False):
                if a < PAIRS and b < PAIRS:
                    self.joined[a, b] = True
            node = 0
            for char in text:
                key = (node, ord(char))
                if key not in edges:
                    edges[key] = len(ends)
                    ends.append(-1)
                node = edges[key]
            ends[node] = i
        self.ends = np.array(ends, np.int32)
        self.weights = np.array(pieces.weights)
        self.byte_weights = self.weights[np.array(pieces.of_byte)]
        keys = np.array([(n << 21) | c for n, c in edges], np.uint64)
        targets = np.fromiter(edges.values(), np.int32, len(edges))
        self.bits = max(4, int(np.ceil(np.log2(4 * len(keys) + 1))))
        self.keys = np.full(1 << self.bits, np.iinfo(np.uint64).max, np.uint64)
        self.targets = np.full(1 << self.bits, -1, np.int32)
        slots = self._slot(keys)
        todo = np.arange(len(keys))
        while len(todo):
            free = self.keys[slots[todo]] == np.iinfo(np.uint64).max
            tried = todo[free]
            self.keys[slots[tried]] = keys[tried]
            self.targets[slots[tried]] = targets[tried]
            # Of several keys on one slot the last written stays, the others move on.
            todo = todo[self.keys[slots[todo]] != keys[todo]]
            slots[todo] = (slots[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, nodes: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The node behind each edge (node, char), -1 where there is none."""
        keys = (nodes.astype(np.uint64) << np.uint64(21)) | chars.astype(np.uint64)
        slots = self._slot(keys)
        out = np.full(len(keys), -1, np.int32)
        todo = np.arange(len(keys))
        while len(todo):
            seen = self.keys[slots[todo]]
            hit = seen == keys[todo]
            out[todo[hit]] = self.targets[slots[todo[hit]]]
            todo = todo[~hit & (seen != np.iinfo(np.uint64).max)]
            slots[todo] = (slots[todo] + 1) & ((1 << self.bits) - 1)
        return out

    def lattice(self, stretches: list[str]) -> Lattice:
        """Forward-filtered lattices of all ``stretches``."""
        sizes = np.array([len(s) for s in stretches], np.int64)
        chars = np.frombuffer("".join(stretches).encode("utf-32-le", "surrogatepass"), np.uint32)
        base = np.concatenate(([0], np.cumsum(sizes)))
        stretch = np.repeat(np.arange(len(sizes)), sizes)
        until = base[1:][stretch]
        place = np.arange(len(chars))
        starts, stops, ids = [], [], []
        alive, nodes, length = place, np.zeros(len(chars), np.int32), 0
        covered = np.zeros(len(chars), bool)
        while len(alive):
            nodes = self.step(nodes, chars[alive + length])
            length += 1
            on = nodes >= 0
            alive, nodes = alive[on], nodes[on]
            piece = self.ends[nodes]
            is_piece = piece >= 0
            starts.append(alive[is_piece])
            stops.append(alive[is_piece] + length)
            ids.append(piece[is_piece])
            if length == 1:
                covered[alive[is_piece]] = True
            on = alive + length < until[alive]
            alive, nodes = alive[on], nodes[on]
        # Characters without a piece of their own are spelled in bytes: id -(code point) - 1.
        bare = np.flatnonzero(~covered)
        starts.append(bare)
        stops.append(bare + 1)
        ids.append(-chars[bare].astype(np.int32) - 1)
        start, stop, piece = (np.concatenate(x) for x in (starts, stops, ids))
        weight = self.weights[np.maximum(piece, 0)]
        spelled = piece < 0
        if spelled.any():
            weight[spelled] = [
                self.byte_weights[list(_bytes(-int(p) - 1))].sum() for p in piece[spelled]
            ]
        return Lattice(base, stretch, start, stop, piece, weight)


def _bytes(code: int) -> bytes:
    return chr(code).encode("utf-8", "surrogatepass")


class Lattice:
    """Edges sorted by the position they end at, with cumulated draw shares."""

    def __init__(self, base, stretch, start, stop, piece, weight):
        # Position p of stretch s, counted from 0 (its begin), is node base[s] + p + s.
        origin = stretch[start]
        tail, head = start + origin, stop + origin
        offset = stop - base[origin]
        # Stable: into one node, shorter pieces come first, whatever else is in the batch.
        order = np.argsort((offset << 32) | head, kind="stable")
        tail, head, weight, offset = tail[order], head[order], weight[order], offset[order]
        self.piece = piece[order]
        self.tail = tail.astype(np.int32)
        first = np.flatnonzero(np.concatenate(([True], head[1:] != head[:-1]))) if len(head) else head
        total = np.full(base[-1] + len(base) - 1, 0.0)
        self.share = np.empty(len(head))
        node_at = np.searchsorted(offset[first], np.arange(1, int(offset[-1]) + 2 if len(offset) else 1))
        counts = np.diff(np.concatenate((first, [len(head)])))
        for n, m in zip(node_at[:-1], node_at[1:], strict=True):
            low, high = first[n], first[m - 1] + counts[m - 1]
            begin = first[n:m] - low
            x = total[tail[low:high]] + weight[low:high]
            most = np.maximum.reduceat(x, begin)
            x = np.exp(x - np.repeat(most, counts[n:m]))
            # Added up node by node, so that a share does not depend on its neighbours.
            for k in range(1, int(counts[n:m].max())):
                at = begin[counts[n:m] > k] + k
                x[at] += x[at - 1]
            sums = x[begin + counts[n:m] - 1]
            total[head[first[n:m]]] = most + np.log(sums)
            self.share[low:high] = np.rint(x / np.repeat(sums, counts[n:m]) * 2.0**30)
        # Draws look for (rank of the node) + u among (rank of the node) + share; both are
        # multiples of 2^-30, so a double holds the sums exactly.
        self.share *= 2.0**-30
        self.share += np.repeat(np.arange(len(first)), counts)
        self.rank = np.full(len(total), -1, np.int32)
        self.rank[head[first]] = np.arange(len(first))
        ends = np.arange(len(base) - 1)
        self.begin = base[:-1] + ends
        self.end = base[1:] + ends

    def sample(self, stretch: np.ndarray, stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(pieces, number of pieces of each)`` for draws of ``stretch`` with the numbers ``stream``."""
        at, begin = self.end[stretch].copy(), self.begin[stretch]
        live, taken, number = np.arange(len(stretch)), [], np.zeros(len(stretch), np.int64)
        step = 0
        while len(live):
            node = self.rank[at[live]]
            edge = np.searchsorted(self.share, node + uniform(stream[live], step), side="right")
            taken.append((live, self.piece[edge]))
            number[live] += 1
            at[live] = self.tail[edge]
            live = live[at[live] > begin[live]]
            step += 1
        last = np.cumsum(number)
        out = np.empty(int(last[-1]) if len(last) else 0, np.int32)
        for step, (rows, piece) in enumerate(taken):
            out[last[rows] - 1 - step] = piece
        return out, number


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a public fixed function."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(stream: np.ndarray, step: int) -> np.ndarray:
    """Numbers in [0, 1) of a stream at a step, in multiples of 2^-30."""
    odd = np.uint64((2 * step + 1) * 0x9E3779B97F4A7C15 % 2**64)
    return (_mix(stream + odd) >> np.uint64(34)) * 2.0**-30


def decode_ids(ids: list[int], spelled: list[bytes]) -> str:
    """The text of a segmentation, without the blank put before it."""
    return b"".join([spelled[i] for i in ids]).decode("utf-8", "surrogatepass")[1:]


def _segment(texts: list[str | None], keys: np.ndarray, matcher: Matcher) -> list[np.ndarray | None]:
    """Sampled ids of each text; ``keys`` are 64-bit numbers per row."""
    whole = "".join([" " + t for t in texts if t])
    sizes = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
    chars = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = np.minimum(chars, PAIRS)
    cut = np.ones(len(chars), bool)
    cut[1:] = ~matcher.joined[low[:-1], low[1:]]
    ends = np.cumsum(sizes)
    cut[(ends - sizes)[sizes > 0]] = True
    start = np.flatnonzero(cut)
    width = 1 + (chars >= 0x80).astype(np.int8) + (chars >= 0x800) + (chars >= 0x10000)
    octets = np.concatenate(([0], np.cumsum(width)))
    offsets = np.concatenate((octets[start], octets[-1:])).astype(np.int32)
    data = whole.encode("utf-8", "surrogatepass")
    flat = pa.Array.from_buffers(
        pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data)]
    ).dictionary_encode()
    stretches = [b.decode("utf-8", "surrogatepass") for b in flat.dictionary.to_pylist()]
    lattice = matcher.lattice(stretches)
    place = flat.indices.to_numpy()
    begin = np.concatenate(([0], np.searchsorted(start, ends)))
    counts = np.diff(begin)
    ordinal = np.arange(len(place), dtype=np.uint64) - np.repeat(begin[:-1], counts).astype(np.uint64)
    stream = _mix(np.repeat(keys, counts) + _mix(ordinal + np.uint64(1)))
    parts, numbers = [], []
    for at in range(0, len(place), DRAWN):
        part, number = lattice.sample(place[at : at + DRAWN], stream[at : at + DRAWN])
        parts.append(part)
        numbers.append(number)
    ids = np.concatenate([np.zeros(0, np.int32), *parts])
    numbers = np.concatenate([np.zeros(0, np.int64), *numbers])
    ids, wide = _spelled_in_bytes(ids, matcher.pieces.of_byte)
    upto = np.concatenate(([0], np.cumsum(wide)))[np.concatenate(([0], np.cumsum(numbers)))]
    bounds = upto[begin]
    return [
        None if text is None else ids[bounds[i] : bounds[i + 1]] for i, text in enumerate(texts)
    ]


def _spelled_in_bytes(ids: np.ndarray, of_byte: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """``ids`` with byte pieces in place of -(code point) - 1, and how many each id became."""
    wide = np.ones(len(ids), np.int64)
    bare = np.flatnonzero(ids < 0)
    codes, which = np.unique(-(ids[bare].astype(np.int64)) - 1, return_inverse=True)
    lists = [[of_byte[b] for b in _bytes(int(c))] for c in codes]
    sizes = np.array([len(x) for x in lists], np.int64)
    if not len(bare):
        return ids, wide
    wide[bare] = sizes[which]
    out = np.repeat(ids, wide)
    start = (np.cumsum(wide) - wide)[bare]
    within = np.arange(wide[bare].sum()) - np.repeat(np.cumsum(wide[bare]) - wide[bare], wide[bare])
    flat = np.array([i for x in lists for i in x], np.int32)
    first = np.cumsum(sizes) - sizes
    out[np.repeat(start, wide[bare]) + within] = flat[np.repeat(first[which], wide[bare]) + within]
    return out, wide


def _slices(batch: pa.RecordBatch, limit: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``limit`` text bytes."""
    sizes = pc.binary_length(batch["text"]).fill_null(0).to_numpy()
    group = np.cumsum(sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def encode(
    docs: DataFrame,
    pieces: Pieces,
    row_id: str = "doc_id",
    text: str = "text",
    seed: int = 0,
    carry: list[str] | None = None,
) -> DataFrame:
    """Columns ``carry`` (all if None) with ``ids``, ``n_pieces`` and ``lossless``.

    ``lossless`` tells whether decoding the ids gave the text back, for every row.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(pieces)
    built: list[Matcher] = []  # one per Python worker and query

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not built:
            built.append(Matcher(shipped.value))
        for whole in batches:
            for batch in _slices(whole, BATCH_BYTES):
                texts = batch["text"].to_pylist()
                keys = batch["key"].to_numpy().view(np.uint64)
                ids = _segment(texts, keys, built[0])
                spelled = shipped.value.spelled
                same = [
                    None if t is None else decode_ids(i.tolist(), spelled) == t
                    for t, i in zip(texts, ids, strict=True)
                ]
                sizes = [None if i is None else len(i) for i in ids]
                yield pa.record_batch(
                    {
                        "row": batch["row"],
                        "ids": pa.array(ids, pa.list_(pa.int32())),
                        "n_pieces": pa.array(sizes, pa.int64()),
                        "lossless": pa.array(same, pa.bool_()),
                    }
                )

    carry = docs.columns if carry is None else carry
    key = F.xxhash64(F.lit(seed), F.col(row_id))
    plain = packed(docs, carry, key=key, text=F.col(text))
    kind = plain.schema["row"].dataType.simpleString()
    cut = plain.mapInArrow(of, f"row {kind}, ids array<int>, n_pieces long, lossless boolean")
    names = ("ids", "n_pieces", "lossless")
    return unpacked(cut, carry, **{n: F.col(n) for n in names})


def decode(
    rows: DataFrame, pieces: Pieces, ids: str = "ids", carry: list[str] | None = None
) -> DataFrame:
    """Columns ``carry`` (all if None) with ``decoded``, the text of the ids (null for null)."""
    spelled = rows.sparkSession.sparkContext.broadcast(pieces.spelled)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [i if i is None else decode_ids(i, spelled.value) for i in batch["ids"].to_pylist()]
            yield pa.record_batch({"row": batch["row"], "decoded": pa.array(found, pa.string())})

    carry = rows.columns if carry is None else carry
    plain = packed(rows, carry, ids=F.col(ids))
    kind = plain.schema["row"].dataType.simpleString()
    return unpacked(
        plain.mapInArrow(of, f"row {kind}, decoded string"), carry, decoded=F.col("decoded")
    )
