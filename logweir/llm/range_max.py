r"""Ranked lexical search: best-first document intervals bounded by range maxima.

Documents are put in blocks, in which similar ones are neighbours. Every posting
list of a block has a sparse table that gives its largest impact between any two
places in constant time. A query starts with the whole block as one interval. The sum of
its terms' range maxima bounds every document of an interval; the intervals with the
highest bounds are split, each at the document that holds the largest
of those maxima, which is scored. An interval whose bound cannot
enter the best ``k`` is never opened. A table of the smallest ids settles ties:
an interval of equal bound and larger ids is closed as well.

The best rows so far go along from block to block of a task, so that later blocks
open fewer intervals. A task gives at most ``k`` rows per item, and these are ranked.

Two passes: one reads the texts and keeps each document's length and its counts of asked
terms; statistics come from that table, and the second pass searches it. Items are
searched in groups of a bounded number of terms (``ASKED_TERMS``), each of which
reads the texts once; what is sent to tasks has that bound.

Score of a document, all in integers but for the weights:

    w = floor(1000 ln((2N + 2) / (2 df + 1))),  m = 75 + (25 n N) div L,
    score = sum over the item's terms of w ((10^9 tf) div (1000 tf + 12 m)).

Defined results: a null text has no terms; rows of one document id are documents
each; a null document id comes after all others; of the rows of one item id the one with
the smallest text counts, a null item id none; items without terms or without a document
of a positive score give no row.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.llm.rows import map_batches, quoted, texts_as_bytes, written
from logweir.session import spread, top_k_per_group

#: Different terms of one group of items, about 100 bytes each where they are looked up.
ASKED_TERMS = 500_000
#: Documents and postings of a block; a posting has up to 14 table entries of 4 bytes.
BLOCK_DOCUMENTS = 16_384
BLOCK_POSTINGS = 1_000_000
#: Intervals opened together, from the best bounds down.
OPENED = 2_048
#: Stands for a null id where ids are compared.
LAST = 2**63 - 1

#: The bytes of [0-9A-Za-z] and of all characters beyond ASCII stay, A-Z in lower case.
_TERM_BYTES = bytes(b if chr(b).isalnum() or b >= 0x80 else 0x20 for b in range(256)).lower()


def terms(text: bytes | None) -> list[bytes]:
    return text.translate(_TERM_BYTES).split() if text else []


class Asked:
    """The items of one group: their ids and, for each, its terms as numbers with how often they are asked."""

    def __init__(self, items: list[tuple[int, bytes]]) -> None:
        self.number: dict[bytes, int] = {}
        self.items: list[tuple[int, np.ndarray, np.ndarray]] = []
        for item, text in items:
            counts = Counter(terms(text))
            at = [self.number.setdefault(t, len(self.number)) for t in counts]
            self.items.append((item, np.array(at, np.int64), np.array([*counts.values()], np.int64)))


def counted(docs: DataFrame, row_id: str, text: str, asked) -> DataFrame:
    """``(id, n, term, tf)``: length of every document that has terms, and its asked terms with counts."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        number = asked.value.number
        ids, sizes, ends, found, often = [], [], [0], [], []
        for key, body in zip(batch["id"].to_pylist(), texts_as_bytes(batch["text"]), strict=True):
            words = terms(body)
            if not words:
                continue
            own = sorted((number[w], n) for w, n in Counter(words).items() if w in number)
            ids.append(key)
            sizes.append(len(words))
            found += [t for t, _ in own]
            often += [n for _, n in own]
            ends.append(len(found))
        places = pa.array(ends, pa.int32())
        return pa.record_batch(
            {
                "id": pa.array(ids, pa.int64()),
                "n": pa.array(sizes, pa.int64()),
                "term": pa.ListArray.from_arrays(places, pa.array(found, pa.int32())),
                "tf": pa.ListArray.from_arrays(places, pa.array(often, pa.int64())),
            }
        )

    key = F.coalesce(F.col(quoted(row_id)).cast("long"), F.lit(LAST)).alias("id")
    plain = docs.select(key, F.col(quoted(text)).cast("string").alias("text"))
    return map_batches(plain, step, "id long, n long, term array<int>, tf array<long>")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _norms(sizes: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """m of every document, exact also where 25 n N has more than 64 bits."""
    if int(sizes.max(initial=0)) * 25 * n_docs < 2**63:
        return 75 + sizes * (25 * n_docs) // total
    return np.array([75 + 25 * int(n) * n_docs // total for n in sizes], np.int64)


def impacts(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """(10^9 tf) div (1000 tf + 12 m), below 10^6."""
    if int(tf.max(initial=0)) < 2**33:
        return 1_000_000_000 * tf // (1000 * tf + 12 * norm)
    pairs = zip(tf.tolist(), norm.tolist(), strict=True)
    return np.array([1_000_000_000 * t // (1000 * t + 12 * m) for t, m in pairs], np.int64)


def _levels(values: np.ndarray, starts: np.ndarray, better) -> np.ndarray:
    """Sparse tables of all lists laid end to end: level j has the best of 2^j values from each place.

    An entry that would reach beyond its list is never asked for.
    """
    longest = int(np.diff(starts).max(initial=0))
    tables = [values]
    while 2 << (len(tables) - 1) <= longest:
        last, step = tables[-1], 1 << (len(tables) - 1)
        table = last.copy()
        table[:-step] = better(last[:-step], last[step:])
        tables.append(table)
    return np.stack(tables)


class Block:
    """Posting lists of some documents, by term and place, with their sparse tables."""

    def __init__(self, ids, norms, lengths, term, tf) -> None:
        # Neighbours: documents with the same most frequent asked term, then of like length.
        doc = np.repeat(np.arange(len(ids)), lengths)
        main = np.full(len(ids), -1)
        top = np.lexsort((term, -tf, doc))
        firsts = top[np.flatnonzero(np.diff(doc[top], prepend=-1))]
        main[doc[firsts]] = term[firsts]
        order = np.lexsort((ids, norms, main))
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        self.ids = ids[order]
        at = place[doc]
        by_term = np.lexsort((at, term))
        self.place = at[by_term]
        self.names, firsts = np.unique(term[by_term], return_index=True)
        self.starts = np.append(firsts, len(by_term))
        self.impact = impacts(tf, norms[doc])[by_term].astype(np.int32)
        # Tables of the places of maxima: the value and the document to split at in one.
        self.best = _levels(
            np.arange(len(by_term), dtype=np.int32),
            self.starts,
            lambda a, b: np.where(self.impact[a] >= self.impact[b], a, b),
        )
        self.least = _levels(self.ids, np.array([0, len(ids)]), np.minimum)
        self.levels = np.concatenate([[0], np.floor(np.log2(np.arange(1, len(ids) + 1))).astype(np.int64)])

    def least_id(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        level = self.levels[high - low]
        return np.minimum(self.least[level, low], self.least[level, high - (1 << level)])


class Search:
    """One item on one block."""

    def __init__(self, block: Block, numbers: np.ndarray, weights: np.ndarray) -> None:
        at = np.searchsorted(block.names, numbers)
        at_most = np.minimum(at, max(0, len(block.names) - 1))
        here = (block.names[at_most] == numbers) & (weights > 0) if len(block.names) else np.zeros(len(at), bool)
        self.block, self.weights, lists = block, weights[here][:, None], at[here]
        self.first = block.starts[lists][:, None]
        # rank[t, d]: postings of term t before place d
        self.rank = np.zeros((len(lists), len(block.ids) + 1), np.int32)
        for row, one in zip(self.rank, lists, strict=True):
            row[block.place[block.starts[one] : block.starts[one + 1]] + 1] = 1
        np.cumsum(self.rank, axis=1, out=self.rank)

    def bounds(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum of the range maxima of [low, high), and the place of the largest of them."""
        block, a, b = self.block, self.rank[:, low], self.rank[:, high]
        n = b - a
        level = block.levels[n]
        a, b = np.where(n > 0, self.first + a, 0), np.where(n > 0, self.first + b - (1 << level), 0)
        left, right = block.best[level, a], block.best[level, b]
        x, y = block.impact[left], block.impact[right]
        most = np.where(n > 0, np.maximum(x, y), 0) * self.weights
        strongest = most.argmax(axis=0)
        column = np.arange(len(low))
        split = np.where(x >= y, left, right)[strongest, column]
        return most.sum(axis=0), block.place[split]

    def scores(self, at: np.ndarray) -> np.ndarray:
        a = self.rank[:, at]
        present = self.rank[:, at + 1] > a
        impact = self.block.impact[np.where(present, self.first + a, 0)]
        return (np.where(present, impact, 0) * self.weights).sum(axis=0)

    def run(self, best: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
        """``best`` (scores, ids in order) after the documents of this block."""
        block = self.block
        if not len(self.weights):
            return best
        low, high = np.zeros(1, np.int64), np.full(1, len(block.ids))
        bound, split = self.bounds(low, high)
        opened = 16
        while True:
            scores, ids = best
            if len(scores) < k:
                worth = bound > 0
            else:
                # A bound that only equals the last score must have a smaller id.
                worth = bound > scores[-1]
                equal = np.flatnonzero(bound == scores[-1])
                worth[equal] = (bound[equal] > 0) & (block.least_id(low[equal], high[equal]) < ids[-1])
            low, high, bound, split = (x[worth] for x in (low, high, bound, split))
            if not len(low):
                return best
            if len(low) > opened:
                order = np.argpartition(-bound, opened)
                now, later = order[:opened], order[opened:]
            else:
                now, later = np.arange(len(low)), np.zeros(0, np.int64)
            opened = min(OPENED, 2 * opened)
            at = split[now]
            new = self.scores(at)
            scores, ids = np.concatenate([scores, new]), np.concatenate([ids, block.ids[at]])
            order = np.lexsort((ids, -scores))
            order = order[scores[order] > 0][:k]
            best = scores[order], ids[order]
            left, right = np.concatenate([low[now], at + 1]), np.concatenate([at, high[now]])
            some = right > left
            left, right = left[some], right[some]
            parts = [self.bounds(left[i : i + OPENED], right[i : i + OPENED]) for i in range(0, len(left), OPENED)]
            low, high = np.concatenate([low[later], left]), np.concatenate([high[later], right])
            bound = np.concatenate([bound[later], *[p[0] for p in parts]])
            split = np.concatenate([split[later], *[p[1] for p in parts]])


def _blocks(batches: Iterator[pa.RecordBatch], n_docs: int, total: int) -> Iterator[Block]:
    held: list[tuple] = []
    documents = postings = 0

    def block() -> Block:
        ids, sizes, lengths, term, tf = (np.concatenate(x) for x in zip(*held, strict=True))
        return Block(ids, _norms(sizes, n_docs, total), lengths, term, tf)

    for whole in batches:
        for start in range(0, whole.num_rows, 512):
            batch = whole.slice(start, 512)
            lengths = np.diff(batch["term"].offsets.to_numpy())
            numbers = [batch[c].to_numpy() for c in ("id", "n")]
            lists = [batch[c].flatten().to_numpy() for c in ("term", "tf")]
            held.append((*numbers, lengths, lists[0].astype(np.int64), lists[1]))
            documents, postings = documents + len(lengths), postings + len(lists[0])
            if documents >= BLOCK_DOCUMENTS or postings >= BLOCK_POSTINGS:
                yield block()
                held.clear()
                documents = postings = 0
    if held:
        yield block()


def _search(docs: DataFrame, items: DataFrame, row_id: str, text: str, k: int) -> DataFrame:
    """``(item, id, score)`` of one group of items: at most ``k`` rows per item and task."""
    context = docs.sparkSession.sparkContext
    asked = Asked([(r.item, (r.text or "").encode()) for r in items.collect()])
    shipped = context.broadcast(asked)
    index = written(counted(docs, row_id, text, shipped))
    size = index.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
    # One row per asked term.
    dfs = index.select(F.explode("term").alias("term")).groupBy("term").count().collect()
    weights = np.zeros(max(1, len(asked.number)), np.int64)
    for r in dfs:
        weights[r.term] = weight(size.docs, r["count"])
    n_docs, total = size.docs, size.terms
    sent = context.broadcast((asked.items, weights))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = sent.value
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(items)
        for block in _blocks(batches, n_docs, total):
            for i, (_, numbers, often) in enumerate(items):
                best[i] = Search(block, numbers, weights[numbers] * often).run(best[i], k)
        for (item, _, _), (scores, ids) in zip(items, best, strict=True):
            yield pa.record_batch(
                {"item": pa.array([item] * len(ids), pa.int64()), "id": pa.array(ids), "score": pa.array(scores)}
            )

    return spread(index).mapInArrow(search, "item long, id long, score long")


def rank(
    docs: DataFrame,
    items: DataFrame,
    row_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    k: int = 20,
) -> DataFrame:
    """``(item_id, rank, id, score)``: the ``k`` best documents of every item, ties to smaller ids."""
    plain = items.select(F.col(quoted(item_id)).cast("long").alias("item"), F.col(quoted(item_text)).alias("text"))
    plain = plain.where("item IS NOT NULL").groupBy("item").agg(F.min("text").alias("text"))
    # A term has at least one byte and a separator.
    most = plain.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) / 2 + 1)).first()[0] or 0
    groups = math.ceil(most / ASKED_TERMS) or 1
    if groups > 1:
        plain = written(plain)
    found = None
    for g in range(groups):
        part = plain if groups == 1 else plain.where(F.pmod(F.xxhash64("item"), F.lit(groups)) == g)
        some = _search(docs, part, row_id, text, k)
        found = some if found is None else found.unionByName(some)
    ranked = top_k_per_group(found, ["item"], [F.desc("score"), F.col("id")], k, spread="id")
    own = F.when(F.col("id") != LAST, F.col("id")).alias("id")
    return ranked.select(F.col("item").alias("item_id"), "rank", own, "score")
