import hashlib
import math

import numpy as np
import pytest

from logweir.llm import centroids
from logweir.llm.centroids import MOST, cluster, nearest, update_dots

DIMS, K, ROUNDS = 4, 5, 3


def brute(rows, k=K, rounds=ROUNDS, dims=DIMS, scale=256):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [max(-MOST, min(MOST, math.floor(scale * x))) for x in v]))
    name = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1])
    heads = [v for _, v in sorted(kept, key=name)[:k]]

    def assign():
        out = []
        for _, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in heads]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        found = assign()
        for c in range(len(heads)):
            own = [v for (_, v), (at, _) in zip(kept, found) if at == c]
            if own:
                heads[c] = [sum(col) // len(own) for col in zip(*own)]
    found = assign()
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in heads]
    every = sum(d for _, d in found)
    fits = lambda n: n if n < 2**63 else None
    return sorted(
        (
            str((i, at, d, fits(sum(e for a, e in found if a == at)), fits(every), sha[at]))
            for (i, _), (at, d) in zip(kept, found)
        )
    )


def run(df, **more):
    out = cluster(df, k=K, rounds=ROUNDS, dims=DIMS, **more)
    names = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    return sorted(str(tuple(r)) for r in out.select(*names).collect())


SCHEMA = "vec_id long, embedding array<double>, cluster string, v string, row int"


def rows_of(vectors):
    return [(i, v, "x", "y", 3) for i, v in vectors]


def test_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, np.round(rng.standard_normal(DIMS), 1).tolist()) for i in range(120)]
    rows += [(3, rows[3][1]), (4, rows[9][1]), (None, [0.1] * DIMS), (200, None), (201, [1.0] * 3)]
    rows += [(202, [None, 0.0, 0.0, 0.0]), (203, [float("nan")] * DIMS), (204, [float("inf")] * DIMS)]
    rows += [(300 + i, [0.25, -0.5, 0.0, 1.0]) for i in range(60)]
    df = spark.createDataFrame(rows_of(rows), SCHEMA).repartition(5)
    assert run(df) == brute(rows)


def test_large_components_fewer_vectors_than_centroids_and_empty(spark):
    rows = [(1, [1e300, -1e300, 0.0, 1.0]), (2, [262144.0, 1.0, 1.0, 1.0]), (3, [0.0] * DIMS)]
    df = spark.createDataFrame(rows_of(rows), SCHEMA)
    assert run(df) == brute(rows)
    assert run(df.limit(0)) == []
    assert run(spark.createDataFrame(rows_of([(7, None)]), SCHEMA)) == []


def test_columns_that_clash(spark):
    rows = [(i, [float(i), 0.0, 0.0, 0.0]) for i in range(8)]
    out = cluster(spark.createDataFrame(rows_of(rows), SCHEMA), k=2, rounds=1, dims=DIMS)
    assert out.columns[:5] == ["vec_id", "embedding", "cluster", "v", "row"]
    assert {(r.v, r["row"]) for r in out.collect()} == {("y", 3)} and dict(out.dtypes)["cluster"] == "int"


@pytest.mark.parametrize("size", [100, MOST])
def test_kept_products_equal_new_ones(size):
    rng = np.random.default_rng(size)
    block = rng.integers(-size, size, (200, 16))
    heads = rng.integers(-size, size, (6, 16))
    dots = np.zeros((200, 6), np.int64)
    update_dots(block, dots, heads)
    for _ in range(4):
        moved = heads.copy()
        moved[rng.integers(0, 6), rng.integers(0, 16, 3)] += rng.integers(-5, 5, 3)
        update_dots(block, dots, moved - heads)
        heads = moved
        assert (dots == block @ heads.T).all()
    at, distance = nearest(block, dots, heads)
    wide = ((block[:, None, :].astype(object) - heads[None].astype(object)) ** 2).sum(axis=2)
    assert (wide.min(axis=1) == distance).all() and (wide.argmin(axis=1) == at).all()


def test_unmoved_centroids_cost_nothing(monkeypatch):
    calls = []
    monkeypatch.setattr(centroids, "_product", lambda b, c: calls.append(b.shape) or b @ c)
    block, dots = np.ones((3, 8), np.int64), np.zeros((3, 4), np.int64)
    changes = np.zeros((4, 8), np.int64)
    changes[2, 5] = 7
    update_dots(block, dots, changes)
    assert calls == [(3, 1)] and dots.tolist() == [[0, 0, 7, 0]] * 3
