"""Files, log ids, the log table, keyed tables, CSV."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from logweir.operators.lookup import first_stored, lookup_or_compute, report_lookup
from logweir.operators.parse import parse_logs, to_log_schema
from logweir.schema import LOG_SCHEMA
from logweir.sources import files, store


@pytest.mark.parametrize(
    "name,kept",
    [
        ("a.log", True),
        ("B.TXT", True),
        ("syslog.1", True),
        ("noext", True),
        ("catalog.csv", True),
        (".hidden", True),
        ("data.csv", False),
        ("x.gz", False),
    ],
)
def test_log_file_names(spark, name, kept):
    df = spark.createDataFrame([(name,)], "n string")
    assert df.select(files.is_log_file(F.col("n")).alias("k")).first().k is kept


@pytest.fixture
def log_dir(tmp_path):
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "a.log").write_text("x=1\n\n   \nx=1\nuser=bob status=OK\n")
    (tmp_path / "deep" / "er" / "noext").write_text("plain\r\nline\n")
    (tmp_path / "data.csv").write_text("not,a,log\n")
    return tmp_path


def test_scan_log_dir(spark, log_dir):
    rows = files.scan_log_dir(spark, str(log_dir)).select("file_name", "line").collect()
    assert sorted(map(tuple, rows)) == [
        ("a.log", "user=bob status=OK"),
        ("a.log", "x=1"),
        ("a.log", "x=1"),
        ("noext", "line"),
        ("noext", "plain"),
    ]


def test_log_ids_number_copies(spark, log_dir, monkeypatch):
    lines = files.scan_log_dir(spark, str(log_dir))
    once = {(r.line, r.log_id) for r in files.with_log_ids(lines).collect()}
    assert len(once) == 5
    again = {(r.line, r.log_id) for r in files.with_log_ids(lines.repartition(5)).collect()}
    assert once == again


def test_log_ids_of_a_hot_line(spark, monkeypatch):
    monkeypatch.setattr(files, "COPIES_PER_STEP", 7)
    lines = spark.range(100).select(
        F.lit("p").alias("file_path"),
        F.lit("f").alias("file_name"),
        F.lit(dt.datetime(2024, 1, 1)).alias("file_time"),
        F.when(F.col("id") < 93, "hot").otherwise(F.concat(F.lit("l"), "id")).alias("line"),
    )
    out = files.with_log_ids(lines)
    assert out.count() == 100
    assert out.select("log_id").distinct().count() == 100
    assert out.where("line = 'hot'").count() == 93


def test_good_logs_and_raw_messages(spark, tmp_path):
    path = tmp_path / "good.log"
    path.write_text('{"raw": "only raw"}\n\n plain \n2025-05-05 10:15:23,1 WARN svc msg="m"\n')
    rows = files.good_logs(spark, str(path)).select("message", "source", "level").collect()
    assert sorted(map(tuple, rows)) == [
        (" plain ", "application", "INFO"),
        ("m", "svc", "WARN"),
        ("only raw", "application", "INFO"),
    ]
    raw = [r.message for r in files.raw_messages(spark, str(path)).collect()]
    assert "plain" in raw and len(raw) == 3


def _records(spark, ids, day="2024-01-01"):
    rows = [(i, f"f-{i}.log", f'{day} 10:00:00,1 INFO svc msg="m{i}"') for i in ids]
    return parse_logs(spark.createDataFrame(rows, "log_id string, file_name string, line string"))


def test_append_logs_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "table")
    assert store.read_logs(spark, path) is None
    store.append_logs(_records(spark, "ab"), path)
    store.append_logs(_records(spark, "abc"), path)
    store.append_logs(_records(spark, "d", "2024-02-02"), path)
    table = store.read_logs(spark, path)
    assert [f.name for f in table.schema][:-1] == LOG_SCHEMA.names
    assert sorted(r.log_id for r in table.collect()) == ["a", "b", "c", "d"]
    assert table.select("log_date").distinct().count() == 2


def test_log_schema_is_enforced(spark):
    assert to_log_schema(spark.range(1)).schema.simpleString() == LOG_SCHEMA.simpleString()


def test_keyed_store(spark, tmp_path):
    path = str(tmp_path / "keyed")
    schema = "message string, template string, timestamp timestamp"
    now, later = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
    store.append_keyed(spark.createDataFrame([("a", "t1", now)], schema), path, "message")
    more = spark.createDataFrame([("a", "t2", later), ("b", "t3", later)], schema)
    store.append_keyed(more, path, "message")
    assert {tuple(r)[:2] for r in spark.read.parquet(path).collect()} == {("a", "t1"), ("b", "t3")}
    store.append_keyed(more, path, "message", new_keys_only=False)
    stored = spark.read.parquet(path)
    latest = {tuple(r)[:2] for r in store.latest_per_key(stored, "message").collect()}
    first = {tuple(r) for r in first_stored(stored, "message").collect()}
    assert latest == {("a", "t2"), ("b", "t3")}
    assert first == {("a", "t1"), ("b", "t3")}


def test_lookup_computes_missing_only(spark):
    logs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, None)], "log_id int, message string")
    stored = spark.createDataFrame([("a", "old"), ("z", "unused")], "message string, value string")
    seen = []

    def compute(missing):
        seen.extend(r.message for r in missing.collect())
        return missing.withColumn("value", F.upper("message"))

    named, fresh = lookup_or_compute(logs, stored, compute, "value")
    assert {(r.log_id, r.value) for r in named.collect()} == {(1, "old"), (2, "B"), (3, "B"), (4, None)}
    assert seen == ["b"] and [tuple(r) for r in fresh.collect()] == [("b", "B")]


def test_report_lookup_takes_the_latest(spark):
    logs = spark.createDataFrame([(1, "a"), (2, "b")], "log_id int, message string")
    reports = spark.createDataFrame(
        [("a", "r1", dt.datetime(2024, 1, 1)), ("a", "r2", dt.datetime(2024, 1, 2))],
        "message string, llm_report string, timestamp timestamp",
    )
    got = {(r.log_id, r.llm_report) for r in report_lookup(logs, reports).collect()}
    assert got == {(1, "r2"), (2, None)}


def test_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", you', [1.0, 2.0])], "id int, message string, v array<double>")
    store.write_csv(df, str(tmp_path / "csv"))
    row = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).first()
    assert tuple(row) == ("1", 'say "hi", you', "[1.0,2.0]")
