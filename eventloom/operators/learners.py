"""Tabular models: logistic regression, random forest and perceptron from MLlib, and an isolation forest."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Default settings of the tabular models.
SEED = 42
MAX_ITER = 2000
TREES = 300
SAMPLE_ROWS = 256
EULER_GAMMA = 0.5772156649015329

#: Depth of a tree: the largest that is supported.
DEPTH = 30


def class_weights(df: DataFrame, y: str = "y") -> DataFrame:
    """Add ``weight`` = n / (2 * rows of the class); class sizes are a two-row table."""
    sizes = df.groupBy(y).agg(F.count(F.lit(1)).alias("_n"))
    weighted = sizes.select(y, (F.sum("_n").over(Window.partitionBy()) / (2 * F.col("_n"))).alias("weight"))
    return df.join(F.broadcast(weighted), y)


def logistic_regression(columns: Sequence[str], rows: int, max_iter: int = MAX_ITER) -> Pipeline:
    """Scaling without centring and balanced L2 logistic regression; weights sum to ``rows``."""
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=list(columns), outputCol="raw"),
            StandardScaler(withMean=False, withStd=True, inputCol="raw", outputCol="features"),
            LogisticRegression(
                labelCol="y", weightCol="weight", maxIter=max_iter, regParam=1.0 / rows, standardization=False
            ),
        ]
    )


def random_forest(columns: Sequence[str], trees: int = TREES, seed: int = SEED, depth: int = DEPTH) -> Pipeline:
    """Random forest on class-weighted rows; ``depth`` is the deepest that the library grows."""
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=list(columns), outputCol="features"),
            RandomForestClassifier(
                labelCol="y", weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed, subsamplingRate=1.0
            ),
        ]
    )


def build_models(enabled: dict[str, bool], columns: Sequence[str], rows: int, trees: int = TREES) -> dict[str, Pipeline]:
    """The enabled supervised models by name; unknown names are an error, as is enabling none."""
    makers = {
        "logistic_regression": lambda: logistic_regression(columns, rows),
        "random_forest": lambda: random_forest(columns, trees),
    }
    unknown = sorted(set(enabled) - set(makers) - {"isolation_forest"})
    if unknown:
        raise ValueError(f"unknown models: {', '.join(unknown)}")
    if not any(enabled.values()):
        raise ValueError("no model is enabled")
    return {name: makers[name]() for name, on in enabled.items() if on and name in makers}


def fit_weighted(pipeline: Pipeline, train: DataFrame) -> PipelineModel:
    return pipeline.fit(class_weights(train))


def positive_probability(model: PipelineModel, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Probability of the anomalous class as ``score``."""
    return model.transform(df).select(*keep, vector_to_array("probability")[1].alias("score"))


def importance(model: PipelineModel, columns: Sequence[str]) -> list[tuple[str, float, float]]:
    """(feature, value, absolute value), strongest first: coefficients or impurity importances.

    One entry per feature column, so its size is fixed by the table's width.
    """
    last = model.stages[-1]
    values = last.coefficients.toArray() if hasattr(last, "coefficients") else last.featureImportances.toArray()
    rows = [(name, float(v), abs(float(v))) for name, v in zip(columns, values, strict=True)]
    return sorted(rows, key=lambda r: (-r[2], r[0]))


def importance_table(model: PipelineModel, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    rows = importance(model, columns)
    table = df.sparkSession.createDataFrame(rows, "feature STRING, value DOUBLE, strength DOUBLE")
    return table.orderBy(F.desc("strength"), "feature")


def window_perceptron(
    windows: DataFrame, vocab_size: int, window: int, hidden: int = 32, max_iter: int = 50, seed: int = SEED
) -> tuple[PipelineModel, DataFrame]:
    """Next-event classifier on one-hot window positions: (model, encoded windows). One-step windows."""
    encoded = encode_windows(windows, vocab_size)
    network = MultilayerPerceptronClassifier(
        featuresCol="features", labelCol="label", layers=[window * vocab_size, hidden, vocab_size], maxIter=max_iter, seed=seed
    )
    return Pipeline(stages=[network]).fit(encoded), encoded


def encode_windows(windows: DataFrame, vocab_size: int) -> DataFrame:
    one_hot = F.flatten(
        F.transform(
            "window",
            lambda e: F.transform(F.sequence(F.lit(0), F.lit(vocab_size - 1)), lambda v: (v == e).cast("double")),
        )
    )
    return windows.select("*", array_to_vector(one_hot).alias("features"), F.col("target").cast("double").alias("label"))


def perceptron_log_probs(model: PipelineModel, encoded: DataFrame) -> DataFrame:
    """Add ``log_probs`` per event, usable wherever logits are."""
    probabilities = vector_to_array("probability")
    logs = F.transform(probabilities, lambda p: F.log(F.greatest(p, F.lit(1e-300))))
    return model.transform(encoded).withColumn("log_probs", logs).drop("features", "rawPrediction", "probability")


# --- isolation forest -------------------------------------------------------------------------------


@dataclass(frozen=True)
class IsolationForest:
    """Trees as flat node arrays: at most 2 * 256 nodes each, whatever the size of the data."""

    columns: tuple[str, ...]
    trees: list[tuple[np.ndarray, ...]]
    sample_rows: int


def _expected_path(n: np.ndarray | float) -> np.ndarray:
    n = np.asarray(n, dtype=float)
    many = 2.0 * (np.log(np.maximum(n - 1, 1.0)) + EULER_GAMMA) - 2.0 * (n - 1) / np.maximum(n, 1.0)
    return np.where(n > 2, many, np.where(n == 2, 1.0, 0.0))


def _grow(points: np.ndarray, rng: np.random.Generator) -> list[tuple[int, float, int, int, float]]:
    """Nodes (feature, cut, left, right, path length at a leaf) of one random tree."""
    limit = math.ceil(math.log2(max(len(points), 2)))
    nodes: list[list] = []
    todo = [(points, 0, -1, False)]
    while todo:
        rows, depth, parent, is_right = todo.pop()
        me = len(nodes)
        nodes.append([-1, 0.0, -1, -1, depth + float(_expected_path(len(rows)))])
        if parent >= 0:
            nodes[parent][3 if is_right else 2] = me
        low, high = rows.min(axis=0), rows.max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(rows) < 2 or len(usable) == 0:
            continue
        feature = int(rng.choice(usable))
        cut = float(rng.uniform(low[feature], high[feature]))
        left = rows[:, feature] <= cut
        nodes[me][0], nodes[me][1] = feature, cut
        todo += [(rows[left], depth + 1, me, False), (rows[~left], depth + 1, me, True)]
    return [tuple(n) for n in nodes]


def fit_isolation_forest(
    train: DataFrame, columns: Sequence[str], id_col: str, trees: int = TREES, sample_rows: int = SAMPLE_ROWS, seed: int = SEED
) -> IsolationForest:
    """Fit on (normal) rows. Every tree grows in its own task from ``sample_rows`` hashed rows.

    Each row draws as many trees as needed to fill them, so the shuffle carries about
    ``trees * sample_rows`` rows however large the table is.
    """
    columns = list(columns)
    total = train.count()
    if total == 0:
        raise ValueError("no rows to fit the isolation forest on")
    wanted = min(sample_rows, total)
    need = 1.3 * trees * sample_rows
    copies = max(1, math.ceil(need / total))
    keep = min(1.0, need / total)
    seeded = F.xxhash64(F.lit(seed), F.col(id_col))
    thinned = train.filter(F.pmod(seeded, F.lit(1_000_003)) < F.lit(math.ceil(keep * 1_000_003)))
    drawn = thinned.select(id_col, *columns, F.explode(F.sequence(F.lit(1), F.lit(copies))).alias("_copy"))
    drawn = drawn.withColumn("tree", F.pmod(F.xxhash64(F.lit(seed + 1), F.col(id_col), F.col("_copy")), F.lit(trees)))
    drawn = drawn.dropDuplicates(["tree", id_col])
    place = F.row_number().over(Window.partitionBy("tree").orderBy(F.xxhash64(F.col(id_col), F.col("tree")), id_col))
    sample = drawn.withColumn("_place", place).filter(F.col("_place") <= wanted)

    def grow(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        nodes = _grow(rows.sort_values("_place")[columns].to_numpy(float), np.random.default_rng([seed, int(key[0])]))
        out = pd.DataFrame(nodes, columns=["feature", "cut", "left", "right", "path"])
        out.insert(0, "node", range(len(out)))
        out.insert(0, "tree", int(key[0]))
        return out

    ddl = "tree BIGINT, node INT, feature INT, cut DOUBLE, left INT, right INT, path DOUBLE"
    # bounded: trees * 2 * sample_rows node rows
    nodes = sample.groupBy("tree").applyInPandas(grow, ddl).toPandas()
    grown = [
        tuple(t[c].to_numpy() for c in ("feature", "cut", "left", "right", "path"))
        for _, t in nodes.sort_values(["tree", "node"]).groupby("tree")
    ]
    return IsolationForest(tuple(columns), grown, wanted)


def isolation_scores(forest: IsolationForest, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Add ``score`` = 2 ** (-mean path / expected path); larger is more anomalous."""
    shared = df.sparkSession.sparkContext.broadcast(forest)
    columns = list(forest.columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        expected = max(float(_expected_path(model.sample_rows)), 1e-12)
        for batch in batches:
            points = batch[columns].to_numpy(float)
            rows, total = np.arange(len(points)), np.zeros(len(points))
            for feature, cut, left, right, path in model.trees:
                at = np.zeros(len(points), dtype=int)
                inner = feature[at] >= 0
                while inner.any():
                    goes_left = points[rows, np.maximum(feature[at], 0)] <= cut[at]
                    at = np.where(inner, np.where(goes_left, left[at], right[at]), at)
                    inner = feature[at] >= 0
                total += path[at]
            out = batch[list(keep)].copy()
            out["score"] = 2.0 ** (-total / (len(model.trees) * expected))
            yield out

    kinds = dict(df.dtypes)
    ddl = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", score DOUBLE"
    return df.select(*dict.fromkeys([*keep, *columns])).mapInPandas(run, ddl)
