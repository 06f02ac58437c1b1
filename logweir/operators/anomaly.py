"""Anomaly scores: subspace error, isolation forest, unexpected next events."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweir.functions.vectors import let, magnitude
from logweir.operators.features import HELPER_COLUMNS, MAX_TERMS, fit_tfidf, terms_of, tfidf
from logweir.session import join_on_hot_keys, settle, shuffle_parts, top_k_per_group

# Least training rows, contamination, trees, sample, seed, components.
MIN_ROWS = 20
CONTAMINATION = 0.1
FOREST_CONTAMINATION = 0.05
TREES = 100
SAMPLE = 256
SEED = 42
COMPONENTS = 32


def contamination_cut(scored: DataFrame, share: float, score: str = "anomaly_score") -> float:
    """The ``1 - share`` quantile of the scores, from a bounded sketch."""
    cut = scored.agg(F.percentile_approx(score, F.lit(1.0 - share), F.lit(1_000_000)).alias("c"))
    return cut.first().c


@dataclass
class Detector:
    """Features, scaling and principal directions of the good rows, and the label cut."""

    model: PipelineModel | None
    threshold: float | None
    features: str = "features"

    def score(self, df: DataFrame) -> DataFrame:
        """Add ``anomaly_score`` and ``anomaly_label``; zeros when there is no model."""
        if self.model is None:
            return df.withColumn("anomaly_score", F.lit(0.0)).withColumn(
                "anomaly_label", F.lit(0)
            )
        added = [*HELPER_COLUMNS, "tfidf", "_scaled", "_projected"]
        scored = self.model.transform(df).withColumn(
            "anomaly_score", _residual(F.col("_scaled"), F.col("_projected"))
        )
        label = (F.col("anomaly_score") > F.lit(self.threshold)).cast("int")
        return scored.drop(*[c for c in added if c not in df.columns]).withColumn(
            "anomaly_label", label
        )

    def save(self, spark: SparkSession, path: str) -> None:
        if self.model is not None:
            self.model.write().overwrite().save(f"{path}/pipeline")
            cut = spark.createDataFrame([(self.threshold,)], "threshold double")
            cut.write.mode("overwrite").parquet(f"{path}/threshold")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Detector:
        cut = spark.read.parquet(f"{path}/threshold").first().threshold
        return cls(PipelineModel.load(f"{path}/pipeline"), cut)


def _residual(scaled: Column, projected: Column) -> Column:
    """Length of what the principal directions leave out."""
    square = lambda v: let(magnitude(vector_to_array(v)), lambda m: m * m)
    return F.sqrt(F.greatest(square(scaled) - square(projected), F.lit(0.0)))


def _fit_subspace(vectors: DataFrame, column: str, components: int) -> list:
    scaler = StandardScaler(inputCol=column, outputCol="_scaled", withMean=True, withStd=True)
    scaling = scaler.fit(vectors)
    scaled = scaling.transform(vectors)
    pca = PCA(k=min(components, len(scaling.mean)), inputCol="_scaled", outputCol="_projected")
    return [scaling, pca.fit(scaled)]


def fit_vector_detector(
    good: DataFrame,
    vector: str,
    contamination: float = CONTAMINATION,
    components: int = COMPONENTS,
) -> Detector:
    """Detector on a column of MLlib vectors."""
    if good.limit(MIN_ROWS).count() < MIN_ROWS:
        return Detector(None, None)
    detector = Detector(PipelineModel(_fit_subspace(good, vector, components)), 0.0)
    detector.threshold = contamination_cut(detector.score(good), contamination)
    return detector


def fit_detector(
    good: DataFrame,
    text: str = "message",
    contamination: float = CONTAMINATION,
    components: int = COMPONENTS,
    share: float = COMPONENTS / MAX_TERMS,
) -> Detector:
    """Detector on TF-IDF features of a text column, fitted on good logs.

    A linear autoencoder spans the principal subspace of its input (Baldi and
    Hornik 1989), so the reconstruction error is the part outside of it. The
    subspace has at most ``components`` directions and at most ``share`` of the
    vocabulary's, or with few terms nothing would be left out.
    """
    if good.limit(MIN_ROWS).count() < MIN_ROWS:
        return Detector(None, None)
    words = fit_tfidf(good, text)
    directions = max(1, min(components, int(share * len(terms_of(words)) + 1e-9)))
    # Scaling, directions and the cut read the sparse vectors, not the texts again.
    vectors = settle(tfidf(words, good).select("tfidf"))
    subspace = _fit_subspace(vectors, "tfidf", directions)
    scored = Detector(PipelineModel(subspace), 0.0).score(vectors)
    return Detector(PipelineModel(words.stages + subspace), contamination_cut(scored, contamination))


# -- isolation forest (Liu, Ting and Zhou 2008) ------------------------------


def _mean_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among ``n`` points."""
    n = np.asarray(n, dtype=np.float64)
    big = np.maximum(n, 3.0)
    long = 2.0 * (np.log(big - 1.0) + np.euler_gamma) - 2.0 * (big - 1.0) / big
    return np.where(n > 2, long, np.where(n == 2, 1.0, 0.0))


def _grow_tree(sample: pd.DataFrame) -> pd.DataFrame:
    """One tree over at most ``SAMPLE`` rows, as node lists."""
    tree = int(sample["tree"].iloc[0])
    rng = np.random.default_rng([int(sample["seed"].iloc[0]), tree])
    points = np.stack(sample.sort_values("place")["features"].to_numpy())
    limit = int(np.ceil(np.log2(max(len(points), 2))))
    nodes: list[list] = []
    open_nodes = [(np.arange(len(points)), 0, -1, 0)]
    while open_nodes:
        rows, depth, parent, side = open_nodes.pop()
        here = len(nodes)
        if parent >= 0:
            nodes[parent][2 + side] = here
        spread = np.ptp(points[rows], axis=0) if len(rows) else np.zeros(points.shape[1])
        choices = np.flatnonzero(spread > 0)
        if depth >= limit or len(rows) <= 1 or not len(choices):
            nodes.append([-1, 0.0, here, here, depth + float(_mean_path(len(rows)))])
            continue
        feature = int(rng.choice(choices))
        low = points[rows, feature].min()
        split = float(low + rng.random() * spread[feature])
        left = points[rows, feature] < split
        nodes.append([feature, split, here, here, 0.0])
        open_nodes.append((rows[~left], depth + 1, here, 1))
        open_nodes.append((rows[left], depth + 1, here, 0))
    feature, split, left, right, path = map(list, zip(*nodes, strict=True))
    return pd.DataFrame(
        {
            "tree": [tree],
            "feature": [feature],
            "split": [split],
            "left": [left],
            "right": [right],
            "path": [path],
            "rows": [len(points)],
        }
    )


def fit_forest(
    df: DataFrame,
    features: str = "features",
    row_id: str = "log_id",
    trees: int = TREES,
    sample: int = SAMPLE,
    seed: int = SEED,
) -> list:
    """Trees as rows of node lists; at most ``trees * 2 * sample`` nodes come to the driver.

    Each tree takes the ``sample`` rows of the table whose hash with the tree is
    smallest. A row is offered only to trees where its hash is below twice the
    share that will be taken, so few rows travel; fewer than ``sample`` of them
    has a chance far below that of a lost machine.
    """
    draw = df.select(
        F.col(row_id).alias("row_id"), F.col(features).cast("array<double>").alias("features")
    )
    steps = 2**40
    offered = int(min(1.0, 2 * sample / max(1, draw.count())) * steps)

    def place(tree: Column) -> Column:
        return F.pmod(F.xxhash64(F.col("row_id"), tree, F.lit(seed)), F.lit(steps))

    taken = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda tree: place(tree) < offered)
    per_tree = draw.select("row_id", "features", F.explode(taken).alias("tree"))
    order = [place(F.col("tree")), F.col("row_id")]
    drawn = top_k_per_group(per_tree, ["tree"], order, sample, spread="row_id", rank="place")
    samples = drawn.withColumn("seed", F.lit(seed))
    schema = (
        "tree int, feature array<int>, split array<double>, left array<int>, "
        "right array<int>, path array<double>, rows int"
    )
    return samples.groupBy("tree").applyInPandas(_grow_tree, schema).orderBy("tree").collect()


def forest_score(df: DataFrame, forest: list, features: str = "features") -> DataFrame:
    """Add ``anomaly_score``: ``2 ** (-mean path / expected path)``, for all rows."""
    trees = [
        {k: np.array(t[k]) for k in ("feature", "split", "left", "right", "path")} for t in forest
    ]
    expected = float(np.mean([_mean_path(t["rows"]) for t in forest])) if forest else 1.0

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            if batch.empty:
                yield pd.Series([], dtype="float64")
                continue
            points = np.stack(batch.to_numpy())
            every = np.arange(len(points))
            total = np.zeros(len(points))
            for tree in trees:
                node = np.zeros(len(points), dtype=np.int64)
                while True:
                    feature = tree["feature"][node]
                    inner = feature >= 0
                    if not inner.any():
                        break
                    left = points[every, np.maximum(feature, 0)] < tree["split"][node]
                    node = np.where(left, tree["left"][node], tree["right"][node])
                total += tree["path"][node]
            yield pd.Series(2.0 ** (-total / max(len(trees), 1) / max(expected, 1e-12)))

    return df.withColumn("anomaly_score", score(F.col(features).cast("array<double>")))


def isolation_forest(
    df: DataFrame,
    features: str = "features",
    row_id: str = "log_id",
    train: DataFrame | None = None,
    contamination: float = FOREST_CONTAMINATION,
    trees: int = TREES,
    seed: int = SEED,
) -> DataFrame:
    """Add score and label; zeros when the training rows are too few."""
    good = df if train is None else train
    if good.limit(MIN_ROWS).count() < MIN_ROWS:
        return df.withColumn("anomaly_score", F.lit(0.0)).withColumn("anomaly_label", F.lit(0))
    forest = fit_forest(good, features, row_id, trees=trees, seed=seed)
    cut = contamination_cut(forest_score(good, forest, features), contamination)
    scored = forest_score(df, forest, features)
    return scored.withColumn(
        "anomaly_label", (F.col("anomaly_score") > F.lit(cut)).cast("int")
    )


# -- unexpected next events --------------------------------------------------


def split_train_test(df: DataFrame, row_id: str, parts: int = 5) -> tuple[DataFrame, DataFrame]:
    """Repeatable split: one of ``parts`` classes of the id's digest is the test set."""
    digest = F.substring(F.md5(F.col(row_id).cast("string")), 1, 8)
    test = F.conv(digest, 16, 10).cast("long") % parts == 0
    return df.where(~test), df.where(test)


#: Events of one run of a history, about; a key with more has several runs.
RUN_ROWS = 1_000_000


def with_history(
    events: DataFrame,
    key: str,
    ts: str,
    row_id: str,
    event: str,
    h: int = 2,
    run_rows: int = RUN_ROWS,
) -> DataFrame:
    """Add ``history``: the ``h`` events before each one of the same key, oldest first.

    Events are partitioned by ranges of (key, time, id), and a key's events in one
    partition are a run. The window stays inside a run, so a key with a third of all rows
    takes many tasks even where all have one time. What a run needs from before it, at most
    ``h`` events, comes from the last events of the runs before. The runs are written once,
    as ranges come from a sample and must not be drawn again.
    """
    parts = max(shuffle_parts(events.sparkSession), -(-events.count() // run_rows))
    spans = settle(
        events.repartitionByRange(parts, key, ts, row_id).withColumn(
            "_span", F.spark_partition_id()
        )
    )
    inside = Window.partitionBy(key, "_span").orderBy(ts, row_id)
    local = spans.withColumn(
        "_before", F.collect_list(event).over(inside.rowsBetween(-h, -1))
    )
    last = top_k_per_group(
        spans.select(key, "_span", ts, row_id, event),
        [key, "_span"],
        [F.col(ts).desc(), F.col(row_id).desc()],
        h,
        spread=row_id,
    )
    tails = last.groupBy(key, "_span").agg(
        F.sort_array(F.collect_list(F.struct(ts, row_id, event))).alias("_tail")
    )
    previous = Window.partitionBy(key).orderBy("_span").rowsBetween(-h, -1)
    carried = tails.select(
        key,
        "_span",
        F.flatten(F.collect_list(F.transform("_tail", lambda e: e[event])).over(previous)).alias(
            "_carried"
        ),
    )
    history = F.concat(F.coalesce("_carried", F.array()), F.col("_before"))
    newest = F.when(F.size(history) > h, F.slice(history, -h, h)).otherwise(history)
    return (
        local.join(carried, [key, "_span"], "left")
        .withColumn("history", newest)
        .drop("_span", "_before", "_carried")
    )


def next_event_model(histories: DataFrame, event: str, top: int, h: int = 2) -> DataFrame:
    """The ``top`` most frequent next events of each full history."""
    counts = (
        histories.where(F.size("history") == h)
        .groupBy("history", event)
        .agg(F.count(F.lit(1)).alias("count"))
    )
    return top_k_per_group(
        counts, ["history"], [F.col("count").desc(), F.col(event).asc()], top, spread=event
    )


def sequence_anomalies(
    events: DataFrame,
    key: str,
    ts: str,
    row_id: str,
    event: str,
    h: int = 2,
    top: int = 3,
    parts: int = 5,
) -> DataFrame:
    """Test events with ``anomalous``: not among the expected next events of their history.

    Histories are taken over all events; counts come from the training part,
    the verdict is given for the test part.
    """
    histories = with_history(events, key, ts, row_id, event, h)
    train, test = split_train_test(histories, row_id, parts)
    expected = next_event_model(train, event, top, h).select(
        "history", event, F.lit(False).alias("_unexpected")
    )
    full = test.where(F.size("history") == h)
    judged = join_on_hot_keys(full, settle(expected), ["history", event], spread=row_id, how="left")
    return judged.withColumn(
        "anomalous", F.coalesce(F.col("_unexpected"), F.lit(True))
    ).drop("_unexpected")
