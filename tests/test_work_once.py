"""Costly steps run once for a row, in tasks of bounded size."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from logweir.functions import vectors
from logweir.operators import similar
from logweir.registry import queries
from logweir.session import spread
from logweir.streaming.ingest import start_ingest


@pytest.mark.parametrize("name", ["phrase_any_token", "pca_anomaly", "scored_csv_roundtrip"])
def test_lines_are_parsed_once(spark, sf, monkeypatch, name):
    parsed = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(message):
        parsed.add(1)
        return message

    orders = queries.order_logs(spark, sf).limit(60).localCheckpoint()
    monkeypatch.setattr(queries, "order_logs", lambda *_: orders.withColumn("message", counted("message")))
    queries.QUERIES[name](spark, sf).collect()
    assert parsed.value == 60


def test_tasks_grow_in_number_not_in_length(spark, tmp_path):
    spark.range(4000).coalesce(1).write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    sizes = spread(stored, rows_per_task=200).rdd.glom().map(len).collect()
    assert len(sizes) >= 20 and max(sizes) < 400 and sum(sizes) == 4000


def test_a_batch_of_texts_is_hashed_a_few_at_a_time():
    texts = ["ab"] * 600 + ["x" * (vectors.CHARS_AT_ONCE + 1)] * 2 + [""] * 3
    few = list(vectors._few(texts))
    assert [t for part in few for t in part] == texts
    assert all(len(p) == 1 or sum(map(len, p)) <= vectors.CHARS_AT_ONCE for p in few)
    assert max(map(len, few)) <= vectors.TEXTS_AT_ONCE
    whole = vectors._cells(texts, 384)
    assert np.array_equal(np.concatenate([vectors._cells(p, 384) for p in few]), whole)
    assert list(vectors._few([])) == []


def test_vectors_of_known_logs_are_not_made_again(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.log").write_text('2025-05-05 10:15:00,123 INFO svc a=1 msg="x y"\n' * 3)
    place = {n: str(tmp_path / n) for n in ("table", "templates", "alerts")}

    def run(checkpoint, model):
        start_ingest(
            spark, str(tmp_path / "logs"), checkpoint=str(tmp_path / checkpoint), every=None, model=model, **place
        ).awaitTermination()

    run("one", None)
    run("two", lambda message: F.raise_error(F.concat(F.lit("made again: "), message)).cast("array<float>"))
    stored = spark.read.parquet(place["table"])
    assert stored.where("size(log_vector) = 384 and anomaly_score = 0").count() == 3


def test_ratio_stops_early_with_the_same_links():
    rng = random.Random(5)
    for n in range(400):
        a = "".join(rng.choices("abcdefgh ij", k=rng.randint(0, 500)))
        b = list(a)
        for _ in range(rng.randint(0, len(a) // (2 + n % 9) + 1)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 2)] = rng.choices("abcxyz", k=rng.randint(0, 2))
        b = "".join(b)
        ratio = SequenceMatcher(None, a, b).ratio()
        assert similar._ratio_from(a, b, 0.85) == (ratio if ratio >= 0.85 else 0.0)


def test_unlike_texts_of_one_language_are_told_by_their_grams(monkeypatch):
    rng = random.Random(7)
    words = ["".join(rng.choices("etaoinshrdlucmfwypvbgkjqxz", range(26, 0, -1), k=rng.randint(2, 7))) for _ in range(400)]
    texts = [" ".join(rng.choices(words, k=rng.randint(280, 320))) for _ in range(20)]
    copies = [t[:900] + rng.choice(["", " added by hand", t[:20]]) + t[rng.choice([905, 950]) :] for t in texts]
    want = [SequenceMatcher(None, a, b).ratio() for a, b in zip(texts, copies, strict=True)]
    assert [similar._ratio_from(a, b, 0.85) for a, b in zip(texts, copies, strict=True)] == [r if r >= 0.85 else 0.0 for r in want]
    assert sum(r >= 0.85 for r in want) > 5
    unlike = [(a, b) for n, a in enumerate(texts) for b in texts[:n]]
    assert max(SequenceMatcher(None, a, b).ratio() for a, b in unlike[:20]) < 0.85

    def made(*_):
        raise AssertionError("texts are matched block by block")

    monkeypatch.setattr(similar, "SequenceMatcher", made)
    assert {similar._ratio_from(a, b, 0.85) for a, b in unlike} == {0.0}


def test_matches_from_arrays_are_those_of_the_library(monkeypatch):
    rng = random.Random(8)
    for n in range(300):
        letters = rng.choice(["ab", "abcdefghij klmnop", "eeeeeeee" * 30 + "xyz 0123456789"])
        a = "".join(rng.choices(letters, k=rng.choice([1, 30, 199, 200, 450])))
        b = list(a[rng.randint(0, len(a)) :] + a[: rng.randint(0, len(a))]) or ["x"]
        for at in rng.choices(range(len(b)), k=n % 12):
            b[at] = rng.choice(letters)
        b = "".join(b)
        found = similar._matcher(a, b, similar._codes(a), similar._codes(b))
        assert isinstance(found, similar._Matches)
        library = SequenceMatcher(None, a, b)
        for _ in range(12):
            part = [*sorted(rng.choices(range(len(a) + 1), k=2)), *sorted(rng.choices(range(len(b) + 1), k=2))]
            assert found.find_longest_match(*part) == library.find_longest_match(*part), (a, b, part)
    monkeypatch.setattr(similar, "PLACES", 10)
    assert isinstance(similar._matcher(a, b, similar._codes(a), similar._codes(b)), SequenceMatcher)
