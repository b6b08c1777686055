"""Classical classifiers on feature vectors (trial_id, y, features array), fitted by Spark, and kept with their scale."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, OneVsRest, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import scratch, write
from . import forest, kernel
from .evaluate import confusion, metrics
from .forest import Deep
from .kernel import Kernel

NAMES = ("lda", "svm", "svm_cheap", "svm_rbf", "random_forest")


@dataclass
class Fitted:
    """A fitted model; called with rows that have `features`, it gives the same rows with `yhat`."""

    name: str
    mean: list[float]  # of each feature in the training rows
    std: list[float]  # population spread; 1 where there is none
    model: Model | None = None  # Spark's, if it is one
    numbers: dict[str, list[float]] = field(default_factory=dict)  # all else that it needs
    kernel: Kernel | None = None
    deep: Deep | None = None  # below a forest's leaves

    def scaled(self) -> Column:
        """(features - mean) / std; the arrays stay in the plan once."""
        pair = F.arrays_zip(F.col("features").alias("x"), F.lit(self.mean).alias("m"), F.lit(self.std).alias("s"))
        return F.transform(pair, lambda p: (p["x"] - p["m"]) / p["s"])

    def forest(self) -> Model:
        """Spark's forest, set to give nothing but the leaf that a row reaches in each tree."""
        return self.model.stages[-1].setLeafCol("_leaf").setPredictionCol("").setRawPredictionCol("").setProbabilityCol("")

    def __call__(self, data: DataFrame) -> DataFrame:
        x = data.withColumn("_scaled", self.scaled())
        if self.name == "lda":
            d, labels = len(self.mean), self.numbers["labels"]
            weights, offsets = np.reshape(self.numbers["weights"], (len(labels), d)), self.numbers["offsets"]
            score = lambda w: F.aggregate(F.zip_with("_scaled", F.lit([float(v) for v in w]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
            best = F.array_max(F.array(*[F.struct((score(w) + F.lit(o)).alias("s"), F.lit(-int(y)).alias("y")) for y, w, o in zip(labels, weights, offsets, strict=True)]))
            return x.withColumn("yhat", -best["y"]).drop("_scaled")
        if self.kernel is not None:
            return x.withColumn("yhat", self.kernel.predicted("_scaled")).drop("_scaled")
        given = x.withColumn("v", array_to_vector("_scaled"))
        if self.deep is not None:
            kept = write(data.withColumn("_row", F.monotonically_increasing_id()), scratch(data.sparkSession, "rows"))
            given = kept.select("_row", self.scaled().alias("x")).withColumn("v", array_to_vector("x"))
            leaf = F.transform(vector_to_array("_leaf"), lambda v: v.cast("int"))
            reached = write(self.forest().transform(given).select("_row", "x", leaf.alias("leaf")), scratch(data.sparkSession, "reached"))
            return kept.join(self.deep.said(reached), "_row").select(*data.columns, "yhat")
        given = given if "y" in data.columns else given.withColumn("y", F.lit(0))
        return self.model.transform(given.withColumn("label", F.col("y").cast("double"))).select(*data.columns, F.col("prediction").cast("int").alias("yhat"))


def scale(train: DataFrame) -> tuple[list[float], list[float]]:
    """Mean and population spread of each feature, in one pass."""
    v = train.select(array_to_vector("features").alias("v"))
    row = v.agg(Summarizer.metrics("mean", "variance", "count").summary(F.col("v")).alias("s")).select(vector_to_array("s.mean").alias("mean"), vector_to_array("s.variance").alias("var"), F.col("s.count").alias("n")).first()
    std = [float(np.sqrt(v * max(row.n - 1, 0) / row.n)) for v in row["var"]]
    return list(row["mean"]), [s if s > 0 else 1.0 for s in std]


def gram(rows: DataFrame, d: int) -> DataFrame:
    """y, i, n, v: by class, row i of the sum of x x', and for i = -1 the sum of x; n counts the rows.

    A task makes one matrix product for each class and batch, and sends d + 1
    vectors for each class; these are added up by (class, i), in d places at once.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}
        for b in batches:
            for y, part in b.groupby("y"):
                x = np.stack(part["x"])
                n, s, q = held.get(y, (0, np.zeros(d), np.zeros((d, d))))
                held[y] = (n + len(x), s + x.sum(axis=0), q + x.T @ x)
        for y, (n, s, q) in held.items():
            for at in range(-1, d, 256):  # some hundred vectors at a time
                some = range(at, min(at + 256, d))
                yield pd.DataFrame({"y": y, "i": list(some), "n": n, "v": [s if i < 0 else q[i] for i in some]})

    parts = rows.mapInPandas(run, "y int, i int, n long, v array<double>").withColumn("v", array_to_vector("v"))
    return parts.groupBy("y", "i").agg(F.sum("n").alias("n"), vector_to_array(Summarizer.sum(F.col("v"))).alias("v"))


def lda(train: DataFrame, d: int, ridge: float = 1e-6) -> dict[str, list[float]]:
    """Linear discriminant on scaled features: class means and the pooled covariance from one pass, a small solve."""
    sums = gram(train.select(F.col("y").cast("int").alias("y"), F.col("_scaled").alias("x")), d).toPandas()
    labels = sorted(set(sums.y))
    n = {y: int(sums[(sums.y == y) & (sums.i == -1)].n.iloc[0]) for y in labels}
    means = np.array([np.asarray(sums[(sums.y == y) & (sums.i == -1)].v.iloc[0]) / n[y] for y in labels])
    total = sum(n.values())
    pooled = np.zeros((d, d))
    for y, m in zip(labels, means, strict=True):
        pooled += np.stack(sums[(sums.y == y) & (sums.i >= 0)].sort_values("i").v) - n[y] * np.outer(m, m)
    pooled /= total
    weights = np.linalg.solve(pooled + ridge * max(np.trace(pooled) / d, 1e-12) * np.eye(d), means.T).T
    offsets = [float(-0.5 * w @ m + np.log(n[y] / total)) for y, w, m in zip(labels, weights, means, strict=True)]
    return {"labels": [float(y) for y in labels], "weights": weights.ravel().tolist(), "offsets": offsets}


def class_sums(rows: DataFrame, labels: list[int], runs: int, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows(ys array of labels, one for each run; x): the sum of x x', the sums of x by run and class, and the rows of each.

    x x' doesn't depend on labels: it is made once for all runs. A task sends d vectors and one for each run and class.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        square, sums, n = np.zeros((d, d)), np.zeros((len(labels), runs, d)), np.zeros((len(labels), runs), np.int64)
        for b in batches:
            if not len(b):
                continue
            x, ys = np.stack(b["x"]), np.stack(b["ys"])
            square += x.T @ x
            for c, label in enumerate(labels):
                own = (ys == label).astype(np.float64)
                sums[c] += own.T @ x
                n[c] += own.sum(axis=0).astype(np.int64)
        for at in range(0, d, 256):
            yield pd.DataFrame({"c": -1, "i": range(at, min(at + 256, d)), "n": 0, "v": list(square[at : at + 256])})
        for c in range(len(labels)):
            yield pd.DataFrame({"c": c, "i": range(runs), "n": n[c], "v": list(sums[c])})

    parts = rows.mapInPandas(run, "c int, i int, n long, v array<double>").withColumn("v", array_to_vector("v"))
    found = parts.groupBy("c", "i").agg(F.sum("n").alias("n"), vector_to_array(Summarizer.sum(F.col("v"))).alias("v")).toPandas().sort_values(["c", "i"])
    of = lambda c: found[found.c == c]
    return np.stack(of(-1).v), np.stack([np.stack(of(c).v) for c in range(len(labels))]), np.stack([of(c).n for c in range(len(labels))])


def discriminants(square: np.ndarray, sums: np.ndarray, n: np.ndarray, ridge: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Weights (run, class, d) and offsets (run, class) of a linear discriminant for each run.

    A run's pooled covariance is that of all rows about zero less a few class means' products,
    so one decomposition serves all runs, and each solves a system as small as its classes are many.
    """
    d, total = len(square), int(n[:, 0].sum())
    level, turn = np.linalg.eigh(square / total)
    weights, offsets = [], []
    for r in range(n.shape[1]):
        some = n[:, r] > 0
        means = np.where(some[:, None], sums[:, r] / np.maximum(n[:, r], 1)[:, None], 0)
        share = n[:, r] / total
        lift = (turn.T @ means.T) * np.sqrt(share)  # in the turned frame: what is taken off is lift lift'
        trace = level.sum() - np.square(lift).sum()
        inverse = 1 / (level + ridge * max(trace / d, 1e-12))
        thin = lift * inverse[:, None]
        right = turn.T @ means.T
        w = inverse[:, None] * right + thin @ np.linalg.solve(np.eye(len(means)) - lift.T @ thin, thin.T @ right)
        w = (turn @ w).T
        weights.append(w)
        offsets.append(np.where(some, -0.5 * (w * means).sum(axis=1) + np.log(np.maximum(share, 1e-300)), -np.inf))
    return np.stack(weights), np.stack(offsets)


def lda_hits(rows: DataFrame, weights: np.ndarray, offsets: np.ndarray, labels: list[int]) -> DataFrame:
    """perm, accuracy of each run's discriminant on rows(y, x); ties go to the least label. The weights, runs by classes by features, go to every task."""
    runs, classes, d = weights.shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hits, n = np.zeros(runs, np.int64), 0
        for b in batches:
            if len(b):
                score = (np.stack(b["x"]) @ weights.reshape(-1, d).T).reshape(len(b), runs, classes) + offsets
                hits += (np.asarray(labels)[score.argmax(axis=2)] == b["y"].to_numpy()[:, None]).sum(axis=0)
                n += len(b)
        yield pd.DataFrame({"perm": range(runs), "hits": hits, "n": n})

    found = rows.mapInPandas(run, "perm int, hits long, n long").groupBy("perm")
    return found.agg((F.sum("hits") / F.sum("n")).alias("accuracy"))


def estimator(name: str, seed: int = 42, classes: int = 2, depth: int = 8) -> Estimator:
    """The Spark estimator of a name; svm is linear, svm_cheap its short form for shuffled runs. Trees grow to the depth, as the driver holds them, and fit() grows their mixed leaves on."""
    if name in ("svm", "svm_cheap"):
        svc = LinearSVC(featuresCol="v", maxIter=300, tol=1e-2) if name == "svm_cheap" else LinearSVC(featuresCol="v", maxIter=100)
        return svc if classes == 2 else OneVsRest(classifier=svc, featuresCol="v")
    if name == "random_forest":
        return RandomForestClassifier(featuresCol="v", numTrees=200, featureSubsetStrategy="sqrt", maxDepth=depth, seed=seed)
    raise ValueError(f"unknown model {name!r}; there are {', '.join(NAMES)}")


def fit(name: str, train: DataFrame, seed: int = 42) -> Fitted:
    """A model of the name on train(y, features), which is scaled first."""
    if name not in NAMES:
        raise ValueError(f"unknown model {name!r}; there are {', '.join(NAMES)}")
    fitted = Fitted(name, *scale(train))
    d = len(fitted.mean)
    x = train.withColumn("_scaled", fitted.scaled())
    if name == "lda":
        fitted.numbers = lda(x, d)
        return fitted
    if name == "svm_rbf":  # gamma is 1 over features and their variance, which is 1 after scaling
        fitted.kernel = kernel.fit(x.select("y", F.col("_scaled").alias("x")), 1.0 / d)
        return fitted
    rows = x.withColumn("v", array_to_vector("_scaled")).withColumn("label", F.col("y").cast("double"))
    depth = forest.depth_for(train.count()) if name == "random_forest" else 0
    fitted.model = Pipeline(stages=[estimator(name, seed, train.select("y").distinct().count(), depth)]).fit(rows)
    if name == "random_forest":
        key = [c for c in ("trial_id",) if c in train.columns]
        reached = fitted.forest().transform(rows).select(*key, F.col("y").cast("int").alias("y"), F.col("_scaled").alias("x"), F.col("_leaf").alias("leaf"))
        fitted.deep = forest.finish(reached, seed, bagged=True)
    return fitted


def save_model(fitted: Fitted, path: str) -> None:
    """The scale and all numbers as a table; beside it Spark's model, or a kernel machine's support vectors with their coefficients."""
    spark = SparkSession.getActiveSession()
    rows = [("mean", fitted.mean), ("std", fitted.std), *fitted.numbers.items()]
    spark.createDataFrame([(fitted.name, k, [float(x) for x in v]) for k, v in rows], "model string, part string, numbers array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/numbers")
    if fitted.kernel is not None:
        k = fitted.kernel
        rows = [("offsets", None, [float(v) for v in k.offsets]), ("labels", None, [float(v) for v in k.labels]), ("gamma", None, [k.gamma])]
        rows += [("support", x.tolist(), b.tolist()) for x, b in zip(k.landmarks, k.betas.T, strict=True)]
        spark.createDataFrame(rows, "part string, x array<double>, numbers array<double>").write.mode("overwrite").parquet(f"{path}/kernel")
    if fitted.deep is not None:
        fitted.deep.save(spark, f"{path}/deep")
    if fitted.model is not None:
        fitted.model.write().overwrite().save(f"{path}/spark")


def load_model(spark: SparkSession, path: str) -> Fitted:
    """A saved model with its scale; an error of Spark's if there is none at path."""
    rows = spark.read.parquet(f"{path}/numbers").collect()
    numbers = {r.part: list(r.numbers) for r in rows}
    name = rows[0].model
    fitted = Fitted(name, numbers.pop("mean"), numbers.pop("std"), None, numbers)
    if name == "svm_rbf":
        parts = spark.read.parquet(f"{path}/kernel").toPandas()
        of = lambda part: np.array(parts[parts.part == part].numbers.iloc[0])
        support = parts[parts.part == "support"]
        fitted.kernel = Kernel(float(of("gamma")[0]), np.stack(support.x), [int(v) for v in of("labels")], np.stack(support.numbers).T, of("offsets"))
    elif name != "lda":
        fitted.model = PipelineModel.load(f"{path}/spark")
    if name == "random_forest":
        fitted.deep = Deep.load(spark, f"{path}/deep")
    return fitted


def evaluate(name: str, train: DataFrame, val: DataFrame, average: str = "binary", seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Fit on train, predict val: the metrics row with the model's name, and the confusion matrix."""
    said = fit(name, train, seed)(val)
    return metrics(said, average).withColumn("model", F.lit(name)), confusion(said)


def importances(fitted: Fitted, spark: SparkSession) -> DataFrame:
    """position, value of a fitted forest's feature importances: each tree's lessened impurity by feature, above and below Spark's leaves, as shares; the trees' mean."""
    below, total = fitted.deep.gains(), np.zeros(len(fitted.mean))
    for i, tree in enumerate(fitted.model.stages[-1].trees):
        own = tree.featureImportances.toArray() * fitted.deep.lessened[i]
        for feature, gain in below.get(i, {}).items():
            own[feature] += gain
        total += own / own.sum() if own.sum() > 0 else 0
    values = total / total.sum() if total.sum() > 0 else total
    return spark.createDataFrame(list(enumerate(values.tolist())), "position int, value double")
