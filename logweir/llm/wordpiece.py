"""Token counts: greedy longest-match word pieces, counted in one pass over each word.

A trie holds the pieces that may begin a word and, below a second root, those
that continue one. Where no edge leads on, the failure link of a node goes to the
node that spells what remains after the longest pieces are cut off, and the number
of pieces cut is stored with the link. A count is then a walk: no step is taken
back and no piece is built.

Defined results: a null or empty text has no words; a word that cannot be cut
into pieces counts as one unknown token; the length of a word is not bounded.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.llm.rows import map_batches, packed, unpacked

BLANKS = " \t\n\x0b\x0c\r"


class Automaton:
    """Trie edges, failure links and popped-piece counts of a vocabulary."""

    def __init__(self, starts: Iterable[str], inner: Iterable[str]):
        self.edges: list[dict[str, int]] = [{}, {}]  # 0 begins a word, 1 continues one
        piece_at = {0: False, 1: False}
        for root, pieces in ((0, starts), (1, inner)):
            for piece in pieces:
                node = root
                for char in piece:
                    node = self._child(node, char)
                if node > 1:
                    piece_at[node] = True
        count = len(self.edges)
        #: Where to go on after the longest pieces, -1: nowhere; and how many pieces those are.
        self.link = [-1] * count
        self.popped = [0] * count
        queue = deque([(0, c, n) for c, n in self.edges[0].items()])
        queue.extend((1, c, n) for c, n in self.edges[1].items())
        while queue:
            parent, char, node = queue.popleft()
            if piece_at.get(node):
                self.link[node], self.popped[node] = 1, 1
            else:
                at, cut = self.link[parent], self.popped[parent]
                while at >= 0 and char not in self.edges[at]:
                    cut += self.popped[at]
                    at = self.link[at]
                if at >= 0:
                    self.link[node], self.popped[node] = self.edges[at][char], cut
            queue.extend((node, c, n) for c, n in self.edges[node].items())

    def _child(self, node: int, char: str) -> int:
        child = self.edges[node].get(char)
        if child is None:
            child = self.edges[node][char] = len(self.edges)
            self.edges.append({})
        return child

    def count(self, word: str) -> int:
        """Number of pieces of a word, 0 if there is no way to cut it."""
        edges, link, popped = self.edges, self.link, self.popped
        node = total = 0
        for char in word:
            while (after := edges[node].get(char)) is None:
                total += popped[node]
                node = link[node]
                if node < 0:
                    return 0
            node = after
        while node != 1:
            total += popped[node]
            node = link[node]
            if node < 0:
                return 0
        return total


def piece_sets(path: str) -> tuple[list[str], list[str]]:
    """Pieces that begin a word and pieces inside one, of a SentencePiece model file."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    plain = [
        model.id_to_piece(i)
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
    ]
    starts = [p[1:] for p in plain if p.startswith("▁") and p.strip("▁")]
    return [p for p in starts if "▁" not in p], [p for p in plain if "▁" not in p]


def token_counts(
    docs: DataFrame,
    vocabulary: tuple[list[str], list[str]],
    text: str = "text",
    carry: list[str] | None = None,
) -> DataFrame:
    """Columns ``carry`` (all if None) of every row with ``n_words``, ``n_tokens``, ``n_unknown``.

    ``vocabulary`` holds the pieces that begin a word and those that continue one.
    Each distinct word of a batch is walked once.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary)
    built: list[Automaton] = []  # one per Python worker and query

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not built:
            built.append(Automaton(*shipped.value))
        texts = batch["text"].fill_null("")
        lists = pc.split_pattern_regex(texts, f"[{BLANKS}]+")
        words = lists.flatten().dictionary_encode()
        each = np.array([built[0].count(w) for w in words.dictionary.to_pylist()], np.int64)
        full = np.array([w != "" for w in words.dictionary.to_pylist()], bool)
        place = words.indices.to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())

        def sums(values: np.ndarray) -> pa.Array:
            by_word = values[place] if len(place) else np.zeros(0, np.int64)
            return pa.array(np.bincount(row, by_word, len(texts)).astype(np.int64))

        unknown = full & (each == 0)
        return pa.record_batch(
            {
                "row": batch["row"],
                "n_words": sums(full.astype(np.int64)),
                "n_tokens": sums(each + unknown),
                "n_unknown": sums(unknown.astype(np.int64)),
            }
        )

    carry = docs.columns if carry is None else carry
    whole = packed(docs, carry, text=F.col(text))
    kind = whole.schema["row"].dataType.simpleString()
    counted = map_batches(
        whole, of, f"row {kind}, n_words long, n_tokens long, n_unknown long"
    )
    names = ("n_words", "n_tokens", "n_unknown")
    return unpacked(counted, carry, **{n: F.col(n) for n in names})
