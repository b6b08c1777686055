"""Metrics of predictions (y, yhat), as SQL over counts: one shuffle of class pairs whatever the size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import scratch, write


def confusion(predictions: DataFrame) -> DataFrame:
    """y, yhat, n over all pairs of labels seen on either side, zeros included."""
    counts = predictions.groupBy("y", "yhat").agg(F.count(F.lit(1)).alias("n"))
    labels = counts.select(F.explode(F.array("y", "yhat")).alias("label")).distinct()
    grid = labels.select(F.col("label").alias("y")).crossJoin(labels.select(F.col("label").alias("yhat")))  # classes by classes
    return grid.join(counts, ["y", "yhat"], "left").select("y", "yhat", F.coalesce("n", F.lit(0)).alias("n"))


def per_class(matrix: DataFrame) -> DataFrame:
    """label, support, precision, recall, f1; 0 over 0 is 0."""
    one = F.explode(
        F.array(
            F.struct(F.col("y").alias("label"), F.when(F.col("y") == F.col("yhat"), F.col("n")).otherwise(0).alias("hit"), F.col("n").alias("true"), F.lit(0).cast("long").alias("said")),
            F.struct(F.col("yhat").alias("label"), F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("true"), F.col("n").alias("said")),
        )
    )
    by = matrix.select(one.alias("c")).select("c.*").groupBy("label").agg(F.sum("hit").alias("hit"), F.sum("true").alias("support"), F.sum("said").alias("said"))
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    precision, recall = safe(F.col("hit"), F.col("said")), safe(F.col("hit"), F.col("support"))
    x = by.withColumn("precision", precision).withColumn("recall", recall)
    return x.select("label", "support", "precision", "recall", safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"))


def metrics(predictions: DataFrame, average: str = "binary", positive: int = 1) -> DataFrame:
    """accuracy, precision, recall, f1 in one row: of the positive class, or the plain mean over classes (macro)."""
    matrix = confusion(predictions)
    classes = per_class(matrix)
    if average == "binary":
        chosen = classes.agg(*[F.coalesce(F.max(F.when(F.col("label") == positive, F.col(c))), F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1")])
    elif average == "macro":
        chosen = classes.agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")])
    else:
        raise ValueError(f"unknown average {average!r}")
    accuracy = matrix.agg((F.sum(F.when(F.col("y") == F.col("yhat"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    return accuracy.crossJoin(chosen)  # one row by one row


def confused_pairs(matrix: DataFrame, k: int = 5) -> DataFrame:
    """The k largest counts off the diagonal."""
    return matrix.where("y <> yhat AND n > 0").orderBy(F.desc("n"), "y", "yhat").limit(k)


def majority(predictions: DataFrame) -> DataFrame:
    """Predictions of the most frequent label, the least of them in a tie."""
    top = predictions.groupBy("y").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "y").limit(1).select(F.col("y").alias("yhat"))
    return predictions.drop("yhat").crossJoin(F.broadcast(top))  # one row


def roc_auc(scored: DataFrame) -> DataFrame:
    """Rank-sum form over (y in 0 or 1, score); ties share their mean rank.

    Equal scores are counted together first. Ranks are running counts within
    stretches of the score range plus the counts of lower stretches, so no task
    sees all scores.
    """
    by = scored.groupBy("score").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    n = max(int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    laid = write(by.repartitionByRange(n, "score").withColumn("_part", F.spark_partition_id()), scratch(scored.sparkSession, "ranks"))
    starts = laid.groupBy("_part").agg(F.sum("neg").alias("_neg")).withColumn("_before", F.coalesce(F.sum("_neg").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    lower = F.coalesce(F.sum("neg").over(Window.partitionBy("_part").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = laid.withColumn("_lower", lower).join(starts.select("_part", "_before"), "_part")
    wins = F.sum(F.col("pos") * (F.col("_before") + F.col("_lower") + F.col("neg") / 2))
    return x.agg(F.try_divide(wins, F.sum("pos").cast("double") * F.sum("neg")).alias("auc"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))


def val_test_gap(results: DataFrame) -> DataFrame:
    """results(variant_tag, stage, model, split, metric, value): val, test and val - test of each."""
    keys = ["variant_tag", "stage", "model", "metric"]
    val = results.where("split = 'val'").select(*keys, F.col("value").alias("val"))
    test = results.where("split = 'test'").select(*keys, F.col("value").alias("test"))
    return val.join(test, keys).withColumn("gap", F.col("val") - F.col("test"))


def ablation(predictions: DataFrame, trial_flags: DataFrame, average: str = "binary") -> DataFrame:
    """Metrics with all trials, and without those of concern."""
    clean = predictions.join(trial_flags.where("trial_concern").select("trial_id"), "trial_id", "left_anti")
    return metrics(predictions, average).withColumn("condition", F.lit("all")).unionByName(metrics(clean, average).withColumn("condition", F.lit("clean")))


def best_model(results: DataFrame) -> DataFrame:
    """Of each variant and stage the model of highest val accuracy, the first by name in a tie."""
    x = results.where("metric = 'accuracy' AND split = 'val'")
    place = F.row_number().over(Window.partitionBy("variant_tag", "stage").orderBy(F.desc("value"), "model"))
    return x.withColumn("_r", place).where("_r = 1").select("variant_tag", "stage", "model", F.col("value").alias("accuracy"))


def session_breakdown(predictions: DataFrame) -> DataFrame:
    """predictions(sessionnum, y, yhat, trial_concern): accuracy and concern rate by session."""
    return predictions.groupBy("sessionnum").agg(F.count(F.lit(1)).alias("n_trials"), F.avg((F.col("y") == F.col("yhat")).cast("double")).alias("accuracy"), F.avg(F.col("trial_concern").cast("double")).alias("concern_rate"))


def permutation_summary(runs: DataFrame) -> DataFrame:
    """runs(perm, accuracy), perm 0 with the real labels: real, shuffled mean and population spread, gap, gap in spreads (null over 0)."""
    shuffled = F.when(F.col("perm") > 0, F.col("accuracy"))
    x = runs.agg(F.max(F.when(F.col("perm") == 0, F.col("accuracy"))).alias("real"), F.avg(shuffled).alias("shuffled_mean"), F.stddev_pop(shuffled).alias("shuffled_std"))
    gap = F.col("real") - F.col("shuffled_mean")
    return x.select("*", gap.alias("gap"), F.when(F.col("shuffled_std") > 0, gap / F.col("shuffled_std")).alias("gap_in_stds"))


def importance_by(importances: DataFrame, n_features: int, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """importances(position, value) of concatenated channels: sums by feature type and by channel."""
    at = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("position") % n_features + 1).cast("int"))
    by_type = importances.groupBy(at.alias("feature")).agg(F.sum("value").alias("importance"))
    by_channel = importances.groupBy(F.floor(F.col("position") / n_features).cast("int").alias("channel")).agg(F.sum("value").alias("importance"))
    return by_type, by_channel


def target_counts(variants: DataFrame) -> DataFrame:
    """variants(name, total, fraction): floor(total * fraction); null (no cap) for a fraction of 1 or more."""
    return variants.withColumn("target", F.when(F.col("fraction") < 1, F.floor(F.col("total") * F.col("fraction"))))
