import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from logweir.llm.components import components
from logweir.llm.simhash import fingerprint, keep_first, links, near_duplicates
from tests.llm.conftest import ODD

MASK = 2**64 - 1


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    width = min(3, len(words))
    shingles = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values):
    """Smallest place reachable over links of three bits or fewer, for each value."""
    label = list(range(len(values)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(values):
            for j, b in enumerate(values):
                if (a ^ b).bit_count() <= 3 and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def signed(x):
    return x - 2**64 if x >> 63 else x


def test_fingerprint_of_all_kinds_of_text():
    for _, text, *_ in ODD:
        assert fingerprint(None if text is None else text.encode(), 3, 42) == brute_fingerprint(text)


@pytest.mark.parametrize("prefix", [None, 5, 12])
def test_links_connect_what_brute_force_connects(spark, prefix):
    random.seed(4)
    values = {0, MASK}
    for _ in range(30):
        base = random.getrandbits(64)
        for _ in range(8):  # chains of one to four flipped bits, so some links are just missed
            values.add(base)
            for bit in random.sample(range(64), random.randint(1, 4)):
                base ^= 1 << bit
    values = sorted(values, key=signed)
    df = spark.createDataFrame([(signed(v),) for v in values], "fp long").repartition(4)
    tied = {r.a & MASK: r.b & MASK for r in components(links(df, prefix)).collect()}
    label = brute_components(values)
    assert {v: tied.get(v, v) for v in values} == {v: values[label[i]] for i, v in enumerate(values)}


def test_dense_ball_and_split_groups(spark, monkeypatch):
    from logweir.llm import simhash

    monkeypatch.setattr(simhash, "GROUP_VARIANTS", 8000)
    base = 0x0123456789ABCDEF
    ball = [base] + [base ^ (1 << a) ^ (1 << b) for a in range(24) for b in range(a)]
    df = spark.createDataFrame([(signed(v),) for v in ball], "fp long")
    tied = components(links(df)).collect()
    assert len(tied) == len(ball) - 1 and len({r.b for r in tied}) == 1


def test_components_of_long_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(300)]
    hub = [(1000, i) for i in range(1001, 1500)]
    edges = spark.createDataFrame(chain + hub + hub, "a long, b long")
    got = {r.a: r.b for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 301)}, **{i: 1000 for i in range(1001, 1500)}}
    assert components(edges.where("a < 0")).count() == 0


def test_odd_documents(odd, empty):
    out = near_duplicates(odd).collect()
    by_id = {r.id: (r.fp & MASK, r.component_id) for r in out}
    assert len(out) == len(ODD)
    assert by_id[1] == by_id[2] == by_id[3] == (0, 1)
    assert by_id[5][1] == by_id[10][1] == 5
    kept = keep_first(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 4, 5, 6, 7, 8, 9, None], key=str)
    assert near_duplicates(empty).count() == 0 and keep_first(empty).count() == 0


def test_query_equals_brute_force(spark, sf):
    from logweir.llm.queries import op9_simhash_near_dedup

    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").select("doc_id", "text").collect()
    values = [brute_fingerprint(d.text) for d in docs]
    label = brute_components(values)
    want = {(d.doc_id, f"{v:016x}", docs[label[i]].doc_id) for i, (d, v) in enumerate(zip(docs, values))}
    assert {tuple(r) for r in op9_simhash_near_dedup(spark, sf).collect()} == want
