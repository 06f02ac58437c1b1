"""Searches, merging and answers on small tables, checked by hand or brute force."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from logweir.functions.vectors import embed, hash_embedding
from logweir.operators import vector_search
from logweir.operators.lexical_search import lexical_hits, lexical_top_k
from logweir.operators.reports import bucket_means, flag_buckets
from logweir.plans import answers, retrieval


def test_hash_embedding(spark):
    texts = ["", "a", "ab" * 300, "é😀x"]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    got = [r.v for r in df.select(hash_embedding(F.col("t"), 384).alias("v")).collect()]
    for text, vector in zip([*texts, ""], got, strict=True):
        want = np.zeros(384)
        for i, ch in enumerate(text):
            want[i % 384] += ord(ch) / 255.0
        size = np.linalg.norm(want)
        assert np.allclose(vector, want / size if size else want)


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=8)], dt.datetime(2024, 1, 1 + i % 20)) for i in range(200)]
    rows += [(300, [0.0] * 8, dt.datetime(2024, 1, 3)), (301, rows[5][1], rows[5][2])]
    logs = spark.createDataFrame(rows, "log_id long, log_vector array<float>, timestamp timestamp")
    asked = [(q, [float(x) for x in rng.normal(size=8)]) for q in range(5)] + [(9, [0.0] * 8)]
    queries = spark.createDataFrame(asked, "query_id long, query_vector array<float>")
    return rows, logs.repartition(4), asked, queries


def _brute(rows, vector, k, lo=None, hi=None):
    vector = np.array(vector, dtype=np.float32).astype(float)
    scored = []
    for log_id, v, ts in rows:
        v = np.array(v, dtype=np.float32).astype(float)
        if v.any() and vector.any() and (lo is None or lo <= ts <= hi):
            cos = v @ vector / np.linalg.norm(v) / np.linalg.norm(vector)
            scored.append((-round(cos + 1, 9), log_id))
    return [i for _, i in sorted(scored)[:k]]


@pytest.mark.parametrize("block", [1024, 2])
def test_vector_top_k(vectors, monkeypatch, block):
    monkeypatch.setattr(vector_search, "QUERIES_PER_BLOCK", block)
    rows, logs, asked, queries = vectors
    got = vector_search.vector_top_k(logs, queries, 7).orderBy("query_id", "rank").collect()
    for query_id, vector in asked:
        assert [r.log_id for r in got if r.query_id == query_id] == _brute(rows, vector, 7)


def test_vector_top_k_in_range(vectors):
    rows, logs, asked, queries = vectors
    lo, hi = dt.datetime(2024, 1, 3), dt.datetime(2024, 1, 9)
    ranged = queries.withColumn("lo", F.lit(lo)).withColumn("hi", F.lit(hi))
    got = vector_search.vector_top_k(logs, ranged, 4).orderBy("query_id", "rank").collect()
    for query_id, vector in asked:
        assert [r.log_id for r in got if r.query_id == query_id] == _brute(rows, vector, 4, lo, hi)


LOGS = [
    (1, "disk disk failure on node", "t-1", "ORD1", "CUST-1", dt.datetime(2024, 1, 1)),
    (2, "failure of the disk", "t-2", "ORD2", "CUST-2", dt.datetime(2024, 1, 2)),
    (3, "all quiet", "a44a1431-6001-4933-a6c3-e22b8a32dd51", None, None, dt.datetime(2024, 1, 3)),
    (4, None, None, None, "disk", dt.datetime(2024, 1, 4)),
]


@pytest.fixture(scope="module")
def logs(spark):
    return spark.createDataFrame(
        LOGS,
        "log_id long, message string, trace_id string, order_number string, customer_id string, "
        "timestamp timestamp",
    )


@pytest.mark.parametrize(
    "token,found",
    [
        ("disk", {1, 2, 4}),
        ("DISK failure", {1}),
        ("failure disk", set()),
        ("disk disk failure", {1}),
        ("cust 1", {1}),
        ("t-1", {1}),
        ("T-1", set()),
        ("ORD2", {2}),
        ("a44a1431-6001-4933-a6c3-e22b8a32dd51", {3}),
        ("absent", set()),
    ],
)
def test_phrases(spark, logs, token, found):
    tokens = spark.createDataFrame([(1, 0, token)], "query_id long, token_no int, token string")
    assert {r.log_id for r in lexical_hits(logs, tokens).collect()} == found


def test_bm25_by_hand(spark, logs):
    tokens = spark.createDataFrame([(1, 0, "disk")], "query_id long, token_no int, token string")
    top = lexical_top_k(logs, tokens, 10).orderBy("rank").collect()
    idf = np.log(1 + (3 - 2 + 0.5) / (2 + 0.5))
    mean = (5 + 4 + 2) / 3
    want = {
        1: idf * 2 / (2 + 1.2 * (0.25 + 0.75 * 5 / mean)),
        2: idf * 1 / (1 + 1.2 * (0.25 + 0.75 * 4 / mean)),
        4: np.log(1 + (3 - 1 + 0.5) / (1 + 0.5)) / (1 + 1.2 * (0.25 + 0.75 * 1 / (5 / 3))),
    }
    assert {r.log_id: r.score for r in top} == pytest.approx(want, abs=1e-8)


def test_time_range_bounds_hits_not_statistics(spark, logs):
    row = (1, 0, "disk", dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 2))
    schema = "query_id long, token_no int, token string"
    ranged = spark.createDataFrame([row], schema + ", lo timestamp, hi timestamp")
    free = spark.createDataFrame([row[:3]], schema)
    inside = {r.log_id: r.score for r in lexical_hits(logs, ranged).collect()}
    everywhere = {r.log_id: r.score for r in lexical_hits(logs, free).collect()}
    assert inside == {2: everywhere[2]}


def test_query_tokens_and_dates(spark):
    rows = [
        ("trace a44a1431-6001-4933-a6c3-e22b8a32dd51 ord12 system", None),
        ("on 20250507 or 2025-05-07", None),
        ("ignored words", ["own", "2024-01-02"]),
    ]
    df = spark.createDataFrame(rows, "query string, tokens array<string>")
    got = retrieval.understand(df).select("tokens", "lo", "hi").collect()
    assert got[0].tokens == ["a44a1431-6001-4933-a6c3-e22b8a32dd51", "ord12", "system"]
    assert got[1].tokens == ["20250507"] and got[1].lo == dt.datetime(2025, 5, 7)
    assert got[2].tokens == ["own", "2024-01-02"] and got[2].hi == dt.datetime(2024, 1, 2)


def test_parse_plans(spark):
    rows = [
        ("NO_SEARCH_NEEDED",),
        ('"NO_SEARCH_NEEDED"',),
        ('{"NO_SEARCH_NEEDED": false, "search_query": "q", "tokens": "bad"}',),
        ('{"search_query": "q", "tokens": ["a"], "date_range": {"from": "soon", "to": "2024-01-01"}}',),
        ("[1, 2]",),
    ]
    got = retrieval.parse_plans(spark.createDataFrame(rows, "response string")).collect()
    assert [(r.no_search, r.search_query, r.tokens, r.lo) for r in got] == [
        (True, None, [], None),
        (False, '"NO_SEARCH_NEEDED"', [], None),
        (False, "q", [], None),
        (False, "q", ["a"], None),
        (False, "[1, 2]", [], None),
    ]


def test_union_keeps_first_place_and_last_score(spark):
    schema = "query_id long, log_id long, score double, pos int"
    first = spark.createDataFrame([(1, 10, 5.0, 1), (1, 11, 4.0, 2)], schema)
    second = spark.createDataFrame([(1, 11, 1.9, 1), (1, 12, 1.8, 2)], schema)
    got = retrieval.union_hits(first, second, 100).orderBy("pos").collect()
    assert [(r.log_id, r.score, r.pos) for r in got] == [(10, 5.0, 1), (11, 1.9, 2), (12, 1.8, 102)]


def test_cut_comes_before_content_dedupe(spark):
    rows = [(i, "same text here", dt.datetime(2024, 1, 1)) for i in range(6)]
    rows.append((6, "other text here", dt.datetime(2024, 1, 1)))
    logs = spark.createDataFrame(rows, "log_id long, message string, timestamp timestamp")
    logs = logs.withColumn("log_vector", embed(F.col("message")))
    queries = spark.createDataFrame([(1, "same text here")], "query_id long, query string")
    top = retrieval.hybrid_top(logs, queries, size=3).collect()
    assert [(r.log_id, r.pos) for r in top] == [(0, 1)]
    union = retrieval.hybrid_union(logs, queries, k=100).orderBy("pos").collect()
    assert [(r.log_id, r.pos) for r in union] == [(0, 1), (6, 2)]


def test_texts_of_no_hits(spark):
    queries = spark.createDataFrame([(1,)], "query_id long")
    empty = spark.createDataFrame(
        [], "query_id long, pos int, level string, message string, source string, timestamp timestamp"
    )
    assert answers.answer_text(empty, queries).first().text == "No matching logs found."
    logs = spark.createDataFrame(
        [], "log_id long, level string, message string, source string, timestamp timestamp, anomaly_score double"
    )
    assert answers.anomaly_report(logs).first().report == "No anomalies detected."


def test_transcript_adds_the_current_message_once(spark):
    turns = spark.createDataFrame(
        [(1, 0, "user", "hi"), (1, 1, "assistant", "yes?"), (2, 0, "user", "now")],
        "conv_id long, turn long, role string, text string",
    )
    current = spark.createDataFrame([(1, "now"), (2, "now"), (3, "now")], "conv_id long, message string")
    got = {r.conv_id: r.transcript for r in answers.transcripts(turns, current).collect()}
    assert got == {1: "User: hi\nAssistant: yes?\nUser: now\n", 2: "User: now\n", 3: "User: now\n"}


def test_long_conversation_is_one_text_and_one_prompt(spark):
    turns = spark.range(10_050).select(
        F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text")
    )
    talks = answers.transcripts(turns)
    assert [r.transcript for r in talks.collect()] == ["".join(f"User: {i}\n" for i in range(10_050))]
    plans = spark.createDataFrame([(1, "m", True, "")], "query_id long, message string, no_search boolean, search_query string")
    contexts = spark.createDataFrame([], "query_id long, context string")
    assert answers.prompt_rows(plans, contexts, talks.withColumnRenamed("conv_id", "query_id")).count() == 1


def test_queries_without_hits_get_an_empty_text(spark):
    hits = spark.createDataFrame(
        [(1, 5, 1, None, "INFO", "m", 0.5, 1.5)],
        "query_id long, log_id long, pos int, timestamp timestamp, level string, message string, anomaly_score double, score double",
    )
    queries = spark.createDataFrame([(1,), (2,)], "query_id long")
    assert {r.query_id: r.text == "" for r in answers.hits_as_text(hits, queries).collect()} == {1: False, 2: True}
    assert {r.query_id: r.context == "" for r in answers.context_text(hits, queries).collect()} == {1: False, 2: True}


def test_vector_search_and_logs_without_a_time(spark):
    rows = [(1, None, [1.0, 0.0]), (2, dt.datetime(2024, 1, 1), [1.0, 0.1]), (3, dt.datetime(2025, 1, 1), [1.0, 0.2])]
    logs = spark.createDataFrame(rows, "log_id long, timestamp timestamp, log_vector array<double>")
    asked = [(1, [1.0, 0.0], None, None), (2, [1.0, 0.0], None, dt.datetime(2024, 6, 1)), (3, [1.0, 0.0], dt.datetime(2024, 6, 1), None)]
    queries = spark.createDataFrame(asked, "query_id long, query_vector array<double>, lo timestamp, hi timestamp")
    for some in (queries, queries.where("query_id > 1"), queries.where("query_id = 1")):
        found = {}
        for r in vector_search.vector_top_k(logs, some, 9).collect():
            found.setdefault(r.query_id, set()).add(r.log_id)
        want = {1: {1, 2, 3}, 2: {2}, 3: {3}}
        assert found == {r.query_id: want[r.query_id] for r in some.collect()}


def test_bucket_flags(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(minutes=5 * i), 1.0 + (i % 2) * 0.1) for i in range(20)]
    rows.append((start + dt.timedelta(minutes=100), 9.0))
    logs = spark.createDataFrame(rows, "timestamp timestamp, score double")
    flagged = flag_buckets(bucket_means(logs, "score")).where("anomalous").collect()
    assert [r.bucket for r in flagged] == [start + dt.timedelta(minutes=100)]


def test_ranges_are_blocks_of_days_and_prune_dates(spark, tmp_path):
    start = dt.datetime(1969, 12, 25, 13)
    logs = [(i, start + dt.timedelta(hours=31 * i)) for i in range(400)] + [(900, None)]
    table = spark.createDataFrame(logs, "log_id long, timestamp timestamp").withColumn(
        "log_date", F.to_date("timestamp")
    )
    table.write.partitionBy("log_date").parquet(f"{tmp_path}/logs")
    stored = spark.read.schema(table.schema).parquet(f"{tmp_path}/logs")
    day = lambda *d: dt.datetime(*d)
    ranges = [
        (1, day(1950, 1, 1), day(1980, 1, 1)),
        (2, day(1970, 1, 1), day(1970, 1, 1, 23)),
        (3, day(1969, 12, 31, 20), day(1970, 1, 2, 1)),
        (4, day(1970, 3, 1), day(1970, 2, 1)),
        (5, day(1970, 1, 8), day(1970, 1, 8, 0, 0, 1)),
        (6, logs[7][1], logs[7][1]),
        (7, day(1970, 2, 1), day(1970, 5, 20)),
    ]
    asked = spark.createDataFrame(ranges, "query_id long, lo timestamp, hi timestamp")
    got = {(r.query_id, r.log_id) for r in retrieval._in_ranges(stored, asked).collect()}
    assert got == {(q, i) for q, lo, hi in ranges for i, at in logs if at and lo <= at <= hi}
    few = retrieval._in_ranges(stored, asked.where("query_id = 2"))
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "log_date" in plan[plan.index("PartitionFilters") :].split("]")[0]
    assert retrieval._in_ranges(stored, asked.where("query_id = 4")).isEmpty()
