import random
import re

import pytest
from pyspark.sql import functions as F

from logweir.llm.mixing import mix, rate
from tests.llm.conftest import ODD

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_targets(sizes, weights=(1, 2, 3), limit=3):
    """Targets by sharing the excess again and again."""
    names = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), set()
    while True:
        rest = total - sum(limit * sizes[s] for s in stopped)
        open_ = [s for s in names if s not in stopped]
        level = rest / sum(weight[s] for s in open_) if open_ else 0
        above = {s for s in open_ if limit * sizes[s] < level * weight[s]}
        if not above:
            return {s: limit * sizes[s] if s in stopped else level * weight[s] for s in names}
        stopped |= above


def check(df, rows, slack):
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(WORD.findall(text or ""))
    targets = brute_targets(sizes)
    out = df.collect()
    assert len(out) == len(rows)
    taken = dict.fromkeys(sizes, 0)
    for r in out:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(targets[r.source], rel=1e-9, abs=1e-9)
        assert 0 <= r.copies <= 3
        taken[r.source] += r.copies * r["size"]
    for source, words in taken.items():
        assert abs(words - targets[source]) <= slack(source, rows), source


def half_longest(source, rows):
    return 0.5 * max(len(WORD.findall(t or "")) for _, t, s in rows if s == source) + 1


def test_odd_documents(odd, empty):
    out = mix(odd, carry=["doc_id", "source", "key"])
    assert out.columns == ["doc_id", "source", "key", "size", "source_size", "target", "copies"]
    check(out, [(r[0], r[1], r[3]) for r in ODD], half_longest)
    assert mix(empty).count() == 0


def test_many_sources_near_their_targets_and_reruns_agree(spark):
    random.seed(3)
    rows = [
        (i, "w " * int(random.paretovariate(0.9) * 5 % 4000), random.choice([None, "é", "b", "B", "zz"]))
        for i in range(3000)
    ]
    rows += [(5000 + i, "same size here", "hot") for i in range(4000)]  # one size holds half of all
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mix(df, carry=["doc_id", "source"])
    check(out, rows, lambda s, r: 100)  # of 12,000 and more
    again = mix(df.repartition(7), carry=["doc_id", "source"])
    assert sorted(out.collect(), key=str) == sorted(again.collect(), key=str)


def test_single_source_and_all_empty(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (2, "c", "x")], "doc_id long, text string, source string")
    assert sorted((r.doc_id, r.copies) for r in mix(df).collect()) == [(1, 1), (2, 1)]
    none = mix(df.withColumn("text", F.lit(None).cast("string")))
    assert {(r.target, r.copies) for r in none.collect()} == {(0.0, 0)}


def test_rate_is_bounded(spark):
    df = spark.createDataFrame([(-1e3, 50.0), (0.0, 2.0), (1e3, 50.0)], "tilt double, x double")
    low, mid, high = (r[0] for r in df.select(rate(F.col("tilt"), F.col("x"), 3)).collect())
    assert 0 <= low < 1e-9 and mid == pytest.approx(1.0) and high == pytest.approx(3.0)
