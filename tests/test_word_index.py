"""The stored word index against the search that reads all texts."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from logweir.operators import word_index
from logweir.operators.lexical_search import lexical_hits
from logweir.operators.word_index import append_index, compact_index, index_hits, index_top_k
from logweir.streaming.ingest import start_ingest

SCHEMA = (
    "log_id long, message string, trace_id string, order_number string, customer_id string, "
    "timestamp timestamp, extra string"
)
TOKENS = "query_id long, token_no int, token string"


def _rows(count):
    rng = random.Random(5)
    rows = []
    for i in range(count):
        text = " ".join(rng.choice("disk node full lost ok Ümlaut".split()) for _ in range(rng.randrange(12)))
        at = None if i % 17 == 0 else dt.datetime(2024, 1, 1 + i % 9)
        rows.append((i, None if i % 13 == 0 else text, f"t-{i % 7}", "", f"cust {i % 3}", at, "x"))
    return rows


@pytest.fixture(scope="module")
def logs(spark):
    return spark.createDataFrame(_rows(400), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def tokens(spark):
    asked = ["disk", "disk full", "full disk node", "t-3", "T-3", "ümlaut", "cust 1", "absent", "", "!"]
    rows = [(1 + n // 2, n % 2, token) for n, token in enumerate(asked)]
    return spark.createDataFrame(rows, TOKENS)


@pytest.fixture(scope="module")
def index(spark, logs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "words")
    append_index(logs.where("log_id < 150"), path, buckets=16, positions_per_file=100)
    append_index(logs.where("log_id >= 100"), path)  # fifty logs are known
    append_index(logs.limit(0), path)
    return path


def _as_dict(hits):
    rows = hits.collect()
    assert len({(r.query_id, r.log_id) for r in rows}) == len(rows)
    return {(r.query_id, r.log_id): r.score for r in rows}


def test_index_equals_search_over_texts(spark, logs, tokens, index):
    want = _as_dict(lexical_hits(logs, tokens))
    assert len(want) > 300
    assert _as_dict(index_hits(spark, index, tokens)) == pytest.approx(want, abs=1e-8)


def test_ranges(spark, logs, tokens, index):
    ranged = tokens.withColumns(
        {
            "lo": F.lit("2024-01-03").cast("timestamp"),
            "hi": F.when(F.col("query_id") == 1, F.lit("2024-01-04").cast("timestamp")),
        }
    )
    want = _as_dict(lexical_hits(logs, ranged))
    assert 0 < len(want) < len(_as_dict(lexical_hits(logs, tokens)))
    assert _as_dict(index_hits(spark, index, ranged)) == pytest.approx(want, abs=1e-8)


def test_compacted_index_gives_the_same(spark, tokens, index, tmp_path):
    target = str(tmp_path / "one")
    compact_index(spark, index, target, positions_per_file=200)
    assert len(word_index._Index(spark, target).names) == 1
    want = _as_dict(index_hits(spark, index, tokens))
    assert _as_dict(index_hits(spark, target, tokens)) == pytest.approx(want, abs=1e-8)
    top = index_top_k(spark, target, tokens, 3).where("query_id = 1").orderBy("rank").collect()
    best = sorted(((-s, i) for (q, i), s in want.items() if q == 1))[:3]
    assert [r.log_id for r in top] == [i for _, i in best]


def test_only_buckets_of_asked_words_are_read(spark, index):
    one = spark.createDataFrame([(1, 0, "disk")], TOKENS)
    found = word_index._Index(spark, index)
    read = word_index.asked_postings(found, word_index.query_words(one), one)
    files = {f for r in read.select(F.input_file_name().alias("f")).distinct().collect() for f in [r.f]}
    assert files and len({f.split("bucket=")[1].split("/")[0] for f in files}) == 1
    assert "PartitionFilters: [" in read._jdf.queryExecution().toString()
    # a hot word takes several files of its bucket
    assert len(files) > 2


def test_a_batch_without_its_last_write_does_not_count(spark, logs, tokens, index, tmp_path, monkeypatch):
    path = str(tmp_path / "words")
    append_index(logs.where("log_id < 200"), path, buckets=4)

    def stop(*_):
        raise RuntimeError("stopped")

    with monkeypatch.context() as patched:
        patched.setattr(word_index, "_commit", stop)
        with pytest.raises(RuntimeError):
            append_index(logs, path)
    part = _as_dict(lexical_hits(logs.where("log_id < 200"), tokens))
    assert _as_dict(index_hits(spark, path, tokens)) == pytest.approx(part, abs=1e-8)
    append_index(logs, path)
    want = _as_dict(lexical_hits(logs, tokens))
    assert _as_dict(index_hits(spark, path, tokens)) == pytest.approx(want, abs=1e-8)


def test_empty_index_and_missing_index(spark, logs, tokens, tmp_path):
    append_index(logs.limit(0), str(tmp_path / "empty"))
    assert index_hits(spark, str(tmp_path / "empty"), tokens).count() == 0
    with pytest.raises(ValueError):
        index_hits(spark, str(tmp_path / "none"), tokens)


def test_ingest_fills_the_index(spark, tmp_path):
    line = "2025-05-05 10:15:{:02d},123 INFO svc orderNumber=ORD{} msg=\"order {} placed\"\n"
    (tmp_path / "logs").mkdir()
    place = {n: str(tmp_path / n) for n in ("table", "templates", "alerts", "checkpoint", "index")}
    for name, ids in (("a", range(5)), ("b", range(5, 9))):
        (tmp_path / "logs" / f"{name}.log").write_text("".join(line.format(i, i, i) for i in ids))
        start_ingest(spark, str(tmp_path / "logs"), every=None, **place).awaitTermination()
    # all files once more under a new checkpoint
    again = place | {"checkpoint": str(tmp_path / "other")}
    start_ingest(spark, str(tmp_path / "logs"), every=None, **again).awaitTermination()
    asked = spark.createDataFrame([(1, 0, "placed"), (2, 0, "ORD7")], TOKENS)
    table = spark.read.parquet(place["table"])
    want = _as_dict(lexical_hits(table, asked))
    assert len(want) == 10
    assert _as_dict(index_hits(spark, place["index"], asked)) == pytest.approx(want, abs=1e-8)


def test_words_meet_inside_a_row(spark, tmp_path, monkeypatch):
    """Only repeated ids have their words grouped over rows, whatever their texts are."""
    taken = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(message):
        taken.add(1)
        return message

    grouped = []
    flatten = F.flatten
    monkeypatch.setattr(word_index.F, "flatten", lambda c: grouped.append(c) or flatten(c))
    rows = [(1, "a b a"), (2, ""), (3, None), (4, "b " * 3000 + "a"), (None, "a")]
    docs = spark.createDataFrame(rows, "log_id long, message string").withColumn("message", counted("message"))
    append_index(docs, str(tmp_path / "once"))
    assert taken.value == len(rows) and not grouped
    found = {(r.word, r.log_id): (r.length, r.positions) for r in spark.read.parquet(str(tmp_path / "once" / "postings")).collect()}
    assert found == {
        ("a", 1): (3, [0, 2]),
        ("b", 1): (3, [1]),
        ("a", 4): (3001, [3000]),
        ("b", 4): (3001, [*range(3000)]),
        ("a", None): (1, [0]),
    }
    (size,) = spark.read.parquet(str(tmp_path / "once" / "sizes")).collect()
    assert (size.docs, size.length) == (4, 3005)

    twice = spark.createDataFrame([*rows, (1, "c a a"), (1, "a"), (None, "b")], "log_id long, message string")
    append_index(twice, str(tmp_path / "twice"))
    assert grouped
    found = {(r.word, r.log_id, r.length): r.positions for r in spark.read.parquet(str(tmp_path / "twice" / "postings")).collect()}
    assert found[("a", 1, 3)] == [0, 1, 2, 2] and found[("c", 1, 3)] == [0] and found[("a", 1, 1)] == [0]
    assert found[("a", None, 1)] == [0] and found[("b", None, 1)] == [0] and len(found) == 8
