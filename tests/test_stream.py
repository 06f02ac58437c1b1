"""Streams give what a batch over the same files gives."""

import datetime as dt
import pathlib
import shutil

from pyspark.sql import functions as F

from logweir.operators.anomaly import fit_detector
from logweir.operators.reports import bucket_means
from logweir.session import settle, shared_folder
from logweir.sources.files import good_logs
from logweir.streaming.ingest import start_ingest, stream_bucket_means

LINE = '2025-05-05 10:15:{:02d},123 INFO svc orderNumber=ORD{} msg="order {} of user {} placed"'


def _write(path, ids):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(LINE.format(i % 60, i, i, i % 5) for i in ids) + "\n")


def test_ingest(spark, tmp_path):
    logs = tmp_path / "logs"
    _write(logs / "a.log", range(40))
    _write(logs / "sub" / "b.txt", [40, 40, 41])
    (logs / "c.csv").write_text("skip me\n")
    (logs / "odd.log").write_text('{"message": 5}\n')
    detector = fit_detector(good_logs(spark, str(logs / "a.log")))
    place = {n: str(tmp_path / n) for n in ("table", "templates", "alerts", "checkpoint")}

    def run(**more):
        start_ingest(
            spark, str(logs), every=None, detector=detector, **(place | more)
        ).awaitTermination()

    run()
    table = spark.read.parquet(place["table"])
    assert table.count() == 44
    assert table.select("log_id").distinct().count() == 44
    good = table.where("level = 'INFO'")
    assert good.where("size(log_vector) = 384 and anomaly_score is not null").count() == 43
    assert {r.semantic_template for r in good.select("semantic_template").collect()} == {
        "order <*> of user <*> placed"
    }
    failed = table.where("level = 'ERROR'").first()
    assert failed.message == failed.semantic_template == '{"message": 5}'
    assert failed.anomaly_score == 0 and not any(failed.log_vector)
    assert spark.read.parquet(place["alerts"]).count() == table.where("anomaly_score >= 0.8").count()

    _write(logs / "d.log", [50])
    run()  # only the new file
    assert spark.read.parquet(place["table"]).count() == 45
    run(checkpoint=str(tmp_path / "other"))  # all files again, nothing new
    assert spark.read.parquet(place["table"]).count() == 45


def test_archive(spark, tmp_path):
    logs, archive = tmp_path / "logs", tmp_path / "archive"
    place = {n: str(tmp_path / n) for n in ("table", "templates", "alerts", "checkpoint")}
    for name, ids in (("one.log", [1]), ("two.log", [2])):
        _write(tmp_path / name, ids)
        logs.mkdir(exist_ok=True)
        shutil.move(str(tmp_path / name), str(logs / name))
        start_ingest(
            spark, str(logs), every=None, archive=str(archive), **place
        ).awaitTermination()
    assert spark.read.parquet(place["table"]).count() == 2
    # the files of a run are moved during the next one
    assert [p.name for p in archive.rglob("*.log")] == ["one.log"]
    assert [p.name for p in logs.rglob("*.log")] == ["two.log"]


def test_bucket_means_stream_equals_batch_on_closed_buckets(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(minutes=i), float(i % 11)) for i in range(200)]
    spark.createDataFrame(rows, "timestamp timestamp, score double").write.parquet(
        str(tmp_path / "in")
    )
    stored = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(stored.schema).parquet(str(tmp_path / "in"))
    (
        stream_bucket_means(stream, "score")
        .writeStream.outputMode("append")
        .option("checkpointLocation", str(tmp_path / "ck"))
        .format("parquet")
        .option("path", str(tmp_path / "out"))
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    got = spark.read.parquet(str(tmp_path / "out"))
    want = bucket_means(stored, "score").where(
        F.col("bucket") < F.lit(start + dt.timedelta(minutes=180))
    )
    missing = want.exceptAll(got.select(*want.columns))
    extra = got.select(*want.columns).exceptAll(bucket_means(stored, "score"))
    assert missing.count() == 0 and extra.count() == 0


def test_a_batch_leaves_only_its_tables(spark, tmp_path):
    logs = tmp_path / "logs"
    _write(logs / "a.log", range(40))
    place = {n: str(tmp_path / n) for n in ("table", "templates", "alerts", "index", "checkpoint")}
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    settled = pathlib.Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    shared = pathlib.Path(shared_folder(spark).removeprefix("file:"))

    def stored():
        files = manager.getAllFiles()
        shuffles = {files.apply(i).getName() for i in range(files.size())}
        shuffles = {n for n in shuffles if n.startswith("shuffle_") and n.endswith(".data")}
        return shuffles | {str(p) for folder in (settled, shared) for p in folder.rglob("*") if p.is_file()}

    for run in range(2):
        before = stored()
        place["checkpoint"] = str(tmp_path / f"run{run}")
        start_ingest(spark, str(logs), every=None, **place).awaitTermination()
        assert stored() - before == set()
    assert spark.read.parquet(place["table"]).count() == 40
    kept = settle(spark.range(3))
    assert kept.count() == 3
