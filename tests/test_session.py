"""The two-step and salted forms give the same rows as the plain ones."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from logweir.session import is_small, join_on_hot_keys, top_k_per_group


@pytest.fixture(scope="module")
def skewed(spark):
    return spark.range(3000).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).cast("int").alias("key"),
        (F.col("id") * 7919 % 101).alias("value"),
    )


def test_top_k_per_group(skewed):
    order = [F.col("value").desc(), F.col("id").asc()]
    got = top_k_per_group(skewed, ["key"], order, 5, spread="id")
    rank = F.row_number().over(Window.partitionBy("key").orderBy(*order))
    want = skewed.withColumn("rank", rank).where("rank <= 5")
    assert sorted(got.select(*want.columns).collect()) == sorted(want.collect())


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join(spark, skewed, how):
    small = spark.createDataFrame([(0, "a"), (1, "b"), (1, "c")], "key int, name string")
    salted = join_on_hot_keys(skewed, small, ["key"], "id", how, small_known=False)
    plain = skewed.join(small, "key", how)
    assert salted.columns == plain.columns
    key = lambda r: (r.id, r.name or "")
    assert sorted(salted.collect(), key=key) == sorted(plain.collect(), key=key)


@pytest.mark.parametrize("salts", [1, 16])
def test_a_side_found_too_large_is_not_broadcast_by_estimate(spark, skewed, salts, capsys):
    wide = spark.createDataFrame([(i, "x") for i in range(50)], "key int, name string").withColumn(
        "vector", F.array_repeat(F.lit(1.0), 384)
    )
    joined = join_on_hot_keys(skewed, wide, ["key"], "id", "left", salts=salts, small_known=False)
    joined.explain()
    plan = capsys.readouterr().out
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
    assert joined.count() == 3000 and set(joined.columns) == {*skewed.columns, "name", "vector"}


def test_is_small_counts_rows_and_bytes(spark):
    df = spark.range(10).withColumn("t", F.repeat(F.lit("x"), 1000))
    assert is_small(df, rows=10)
    assert not is_small(df, rows=9)
    assert not is_small(df, rows=10, size=5000)


def test_a_cluster_without_a_shared_folder_is_an_error(monkeypatch):
    from types import SimpleNamespace

    from logweir.session import shared_folder

    def session(master, folder=None):
        context = SimpleNamespace(getCheckpointDir=lambda: None, master=master)
        return SimpleNamespace(conf={"spark.checkpoint.dir": folder}, sparkContext=context)

    with pytest.raises(ValueError):
        shared_folder(session("spark://host:7077"))
    assert shared_folder(session("spark://host:7077", "hdfs:///x")) == "hdfs:///x"
    assert "logweir-" in shared_folder(session("local[4]"))
