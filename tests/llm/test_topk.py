import math
import random

import numpy as np
import pytest

from logweir.llm import impact_topk
from logweir.llm.impact_topk import block_top, index_rows, top_k


def brute(rows, k, is_query):
    sound = [
        (i, [math.floor(64 * x) for x in v])
        for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out, done = [], set()
    for q, a in sorted(sound):
        if is_query(q) and q not in done:
            done.add(q)
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in sound if i != q)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_nulls_ties_ragged_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(impact_topk, "INDEX_BLOCK", 16)
    monkeypatch.setattr(impact_topk, "QUERY_BLOCK", 3)
    random.seed(2)
    rows = [(i, [random.choice([-1.0, 0.0, 0.5, 0.26]) for _ in range(6)]) for i in range(90)]
    rows += [(90, None), (91, [1.0, None]), (92, [float("nan"), 1.0]), (93, [float("inf")])]
    rows += [(None, [1.0] * 6), (94, []), (95, [2.0, 1.0]), (20, rows[20][1]), (7, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = index_rows(df, "vec_id", "embedding")
    found = top_k(index, index.where("id % 20 = 0"), 7)
    assert sorted(map(tuple, found.collect())) == brute(rows, 7, lambda q: q % 20 == 0)


def test_fewer_candidates_than_k_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    index = index_rows(df, "vec_id", "embedding")
    assert [tuple(r) for r in top_k(index, index.where("id = 0")).collect()] == [(0, 1, 1, 64 * 128)]
    assert top_k(index.where("id > 5"), index).count() == 0
    assert top_k(index, index.where("id > 5")).count() == 0


@pytest.mark.parametrize("scale", [8, 60_000, 3_000_000_000])
def test_early_stop_keeps_all_members(scale):
    rng = np.random.default_rng(scale)
    matrix = np.floor(rng.standard_normal((3000, 32)) * scale).astype(np.int64)
    if scale > 1e9:
        matrix //= 10
    queries = matrix[:20]
    ids = np.arange(3000)
    query, near, score = block_top(ids, matrix, ids[:20], queries, 10)
    for q in range(20):
        exact = [(-int(s), i) for i, s in enumerate((matrix.astype(object) @ queries[q].astype(object)))]
        want = sorted(x for x in exact if x[1] != q)[:10]
        assert [(-int(s), int(i)) for s, i in zip(score[query == q], near[query == q])] == want
