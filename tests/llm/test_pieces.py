import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logweir.llm import pieces as module
from logweir.llm.pieces import Matcher, Pieces, _segment, decode, decode_ids, encode
from logweir.llm.queries import piece_file
from tests.llm.conftest import ODD


@pytest.fixture(scope="module")
def pieces():
    return Pieces.load(piece_file())


@pytest.fixture(scope="module")
def matcher(pieces):
    return Matcher(pieces)


def all_cuts(text, ids):
    if not text:
        yield ()
    for k in range(1, len(text) + 1):
        if text[:k] in ids:
            for rest in all_cuts(text[k:], ids):
                yield (ids[text[:k]], *rest)


@pytest.mark.parametrize("word", ["there", "to be", "the, of."])
def test_segmentations_come_in_proportion_to_their_weights(pieces, matcher, word):
    ids = {t: i for i, t in enumerate(pieces.texts) if t}
    cuts = list(all_cuts(" " + word, ids))
    weights = np.exp([sum(pieces.weights[i] for i in c) for c in cuts])
    n = 30_000
    keys = np.random.default_rng(1).integers(0, 2**63, n).astype(np.uint64)
    seen = Counter(tuple(i.tolist()) for i in _segment([word] * n, keys, matcher))
    assert set(seen) <= set(cuts)
    for cut, p in zip(cuts, weights / weights.sum()):
        assert abs(seen[cut] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-3


def test_random_texts_round_trip(pieces, matcher):
    random.seed(7)
    alphabet = "aeiou tnrsl  \n\t▁éßñ漢字🙂%&#\x00."
    texts = ["".join(random.choices(alphabet, k=random.randint(0, 60))) for _ in range(400)]
    cut = _segment(texts, np.arange(400, dtype=np.uint64), matcher)
    assert [decode_ids(i.tolist(), pieces.spelled) if t else "" for i, t in zip(cut, texts)] == texts


def test_cuts_depend_on_key_and_seed_only(spark, pieces, monkeypatch):
    rows = [(i, f"the quick brown fox number {i} jumps over lazy dogs") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    once = {r.doc_id: r.ids for r in encode(df, pieces).collect()}
    monkeypatch.setattr(module, "BATCH_BYTES", 300)
    monkeypatch.setattr(module, "DRAWN", 7)
    again = {r.doc_id: r.ids for r in encode(df.orderBy(F.desc("doc_id")).repartition(5), pieces).collect()}
    other = {r.doc_id: r.ids for r in encode(df, pieces, seed=1).collect()}
    assert once == again and once != other


def test_a_run_of_texts_takes_little_memory(matcher):
    random.seed(5)
    words = ["".join(random.choices("aeiounrstlmdk", k=random.randint(2, 9))) for _ in range(20_000)]
    texts = [" ".join(random.choices(words, k=500)) for _ in range(400)]
    batch = pa.record_batch({"text": pa.array(texts)})
    run = next(module._slices(batch, module.BATCH_BYTES))["text"].to_pylist()
    tracemalloc.start()
    _segment(run, np.arange(len(run), dtype=np.uint64), matcher)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 45e6


def test_odd_documents(odd, empty, pieces):
    out = encode(odd, pieces)
    assert out.columns == [*odd.columns, "ids", "n_pieces", "lossless"]
    rows = decode(out, pieces).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        assert r.decoded == r.text
        assert r.lossless is (None if r.text is None else True)
        assert r.n_pieces == (None if r.ids is None else len(r.ids))
    assert {tuple(r.ids) for r in rows if r.doc_id == 2} == {()}
    assert encode(empty, pieces).count() == 0 and decode(encode(empty, pieces), pieces).count() == 0


def test_query_is_lossless(spark, sf):
    from logweir.llm.queries import op1_sentencepiece

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    loaded = Pieces.load(piece_file())
    rows = op1_sentencepiece(spark, sf).collect()
    assert len(rows) == len(docs) and all(r.lossless for r in rows)
    assert all(decode_ids(r.ids, loaded.spelled) == docs[r.doc_id] for r in rows)
