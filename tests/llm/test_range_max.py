import math
import random
import re
from collections import Counter

import numpy as np

from logweir.llm import range_max
from logweir.llm.range_max import Block, Search, _blocks, impacts, rank

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute(docs, items, k=20):
    words = [(i, Counter(terms(t))) for i, t in docs]
    words = [(i, w) for i, w in words if w]
    n_docs, total = len(words), sum(w.total() for _, w in words)
    out = []
    for item in sorted({i for i, _ in items if i is not None}):
        text = min((t for i, t in items if i == item and t is not None), default=None)
        scored = []
        for i, w in words:
            score = 0
            for t, often in Counter(terms(text)).items():
                if t in w:
                    df = sum(t in x for _, x in words)
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
                    m = 100 - 25 + 25 * w.total() * n_docs // total
                    score += often * weight * (1000000000 * w[t] // (1000 * w[t] + 12 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0))
        best = sorted(scored)[:k]
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(best)]
    return out


def found(docs, items, k=20):
    return sorted((tuple(r) for r in rank(docs, items, k=k).collect()), key=lambda r: r[:2])


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(range_max, "BLOCK_DOCUMENTS", 40)
    monkeypatch.setattr(range_max, "OPENED", 32)
    random.seed(11)
    vocabulary = [f"w{i}" for i in range(60)] + ["Über", "ÜBER", "漢字", "İx", "a", "A"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    text = lambda n: random.choice([" ", ", ", "\n"]).join(random.choices(vocabulary, weights, k=n))
    docs = [(i, text(random.choice([1, 3, 20, 60]))) for i in range(400)]
    docs += [(1000 + i, docs[7][1]) for i in range(70)] + [(500 + i, docs[8][1]) for i in range(70)]
    docs += [(7, docs[7][1]), (None, docs[8][1]), (600, None), (601, ""), (602, " .,;"), (603, "w1 " * 30000)]
    random.shuffle(docs)
    items = [(i, text(12)) for i in range(25)] + [(25, docs[0][1]), (26, None), (27, "!"), (28, "unheard of")]
    items += [(3, "w5 w5 w9"), (None, "w1"), (29, "w1 w1 W1 w2"), (30, "w1")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items, 7)
    assert found(frame, asked, 7) == want
    monkeypatch.setattr(range_max, "ASKED_TERMS", 100)
    assert found(frame, asked, 7) == want


def test_fewer_documents_than_asked_and_empty_tables(spark, odd, empty):
    docs = spark.createDataFrame([(1, "one two"), (2, "two three three")], "doc_id long, text string")
    items = spark.createDataFrame([(5, "two two one")], "item_id long, text string")
    assert found(docs, items) == brute([(1, "one two"), (2, "two three three")], [(5, "two two one")])
    assert found(docs.limit(0), items) == [] and found(docs, items.limit(0)) == []
    assert found(empty, items) == []
    asked = odd.selectExpr("doc_id AS item_id", "text", "key AS id", "size AS score")
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert found(odd, asked) == brute(rows, rows)


def _block(n, n_terms, seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(0, n_terms, n)
    term = np.concatenate([rng.choice(n_terms, size, replace=False) for size in lengths])
    tf = rng.integers(1, 9, len(term))
    norms = 75 + rng.integers(0, 60, n)
    return Block(np.arange(n), norms, lengths, term.astype(np.int64), tf), lengths, term, tf, norms


def test_bounds_hold_and_are_the_sums_of_range_maxima():
    block, lengths, term, tf, norms = _block(300, 12, 1)
    weights = np.arange(1, 13) * 100
    search = Search(block, np.arange(12), weights)
    dense = np.zeros((12, 300), np.int64)
    dense[term, np.repeat(np.arange(300), lengths)] = impacts(tf, np.repeat(norms, lengths))
    dense = dense[:, block.ids] * weights[:, None]
    assert (search.scores(np.arange(300)) == dense.sum(axis=0)).all()
    low, high = np.triu_indices(301, 1)
    bound, split = search.bounds(low, high)
    for a, b, most, at in list(zip(low, high, bound, split))[::37]:
        assert most == dense[:, a:b].max(axis=1).sum()
        assert not most or (a <= at < b and dense[:, at].max() == dense[:, a:b].max())


def test_intervals_are_left_closed():
    block, *_ = _block(5000, 40, 3)
    search, opened = Search(block, np.arange(3), np.array([9000, 10, 10])), []
    plain = search.scores
    search.scores = lambda at: opened.extend(at.tolist()) or plain(at)
    scores, ids = search.run((np.zeros(0, np.int64), np.zeros(0, np.int64)), 10)
    every = plain(np.arange(5000))
    order = np.lexsort((block.ids, -every))[:10]
    assert (every[order] == scores).all() and (block.ids[order] == ids).all()
    assert len(set(opened)) == len(opened) < 2500


def test_numbers_beyond_64_bits():
    sizes = np.array([1, 10**12])
    assert range_max._norms(sizes, 10**11, 3 * 10**14).tolist() == [75, 75 + 25 * 10**23 // (3 * 10**14)]
    assert impacts(np.array([2**40]), np.array([100])).tolist() == [10**9 * 2**40 // (1000 * 2**40 + 1200)]
    assert list(_blocks(iter(()), 1, 1)) == []
