import random
import tracemalloc
import zlib

import numpy as np

from logweir.llm import language
from logweir.llm.language import DIMENSIONS, ORDER, bundles, learn, letter_vectors, predict
from tests.llm.conftest import ODD


def brute_bundle(text):
    """The sum over all n-grams, one by one."""
    low = "".join(c if c.isalpha() else "\0" for c in f" {(text or '').lower()} ")
    while "\0\0" in low:
        low = low.replace("\0\0", "\0")
    total = np.zeros(DIMENSIONS)
    for i in range(len(low) - ORDER + 1):
        vector = np.ones(DIMENSIONS)
        for place, char in enumerate(low[i : i + ORDER]):
            vector *= np.roll(letter_vectors(np.array([ord(char)]))[0], place)
        total += vector
    return total


def test_bundles_equal_the_sum_of_bound_n_grams(monkeypatch):
    texts = ["Hello, wörld 漢字", None, "", "12 34", "a", "the quick brown fox", "ab" * 30]
    monkeypatch.setattr(language, "GRAMS", 7)
    monkeypatch.setattr(language, "LETTERS", 25)
    vectors, lettered = bundles(texts)
    assert lettered.tolist() == [True, False, False, False, True, True, True]
    for vector, text, ok in zip(vectors, texts, lettered):
        if ok:
            assert np.array_equal(vector, brute_bundle(text))


def test_many_n_grams_take_little_memory():
    random.seed(3)
    letters = "abcdefghijklmnopqrstuvwxyzäöüéè"
    texts = ["".join(random.choices(letters + "    ", k=3300)) for _ in range(256)]
    bundles(texts[:1])
    tracemalloc.start()
    bundles(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6


def test_odd_documents(odd, empty):
    profiles = learn(odd)
    assert profiles.names == ["de", "en"]
    out = predict(odd, profiles)
    assert out.columns == [*odd.columns, "lang_pred"]
    rows = {r.doc_id: r for r in out.collect()}
    assert {rows[i].lang_pred for i in (1, 2, 3, 4)} == {"und"}
    assert rows[7].lang_pred == "de" and rows[5].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in rows.values()) and len(out.collect()) == len(ODD)
    assert predict(empty, profiles).count() == 0
    nothing = learn(empty)
    assert nothing.names == []
    assert {r.lang_pred for r in predict(odd, nothing).collect()} == {"und"}


def test_held_out_accuracy(spark):
    from logweir.llm.queries import op2_language_id

    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op2_language_id(spark, sf).collect()
    assert len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r.lang_pred == lang[r.doc_id] for r in rows if r.held_out]
    assert sum(held) / len(held) >= 0.97
