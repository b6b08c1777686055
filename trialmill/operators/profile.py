"""Counts and checks of raw rows and of stored pools."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import not_finite, rounded
from ..functions.ranks import with_previous
from ..sources.wide import role_of


def label_distribution(rows: DataFrame, label: str = "label") -> DataFrame:
    n = F.count(F.lit(1))
    return rows.groupBy(label).agg(n.alias("n")).withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 2))


def distinct_counts(rows: DataFrame, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.count_distinct
    return rows.agg(count(F.col("label")).alias("n_labels"), count(F.col("sessionnum")).alias("n_sessions"), count(F.struct("sessionnum", "block")).alias("n_blocks"))


def counts_by(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_trials"))


def pool_validation(trials: DataFrame, classes: list[int]) -> DataFrame:
    """A row for each class, empty ones included, beside the totals and the binary balance."""
    all_classes = trials.sparkSession.createDataFrame([(c,) for c in classes], "label_digit int")
    by = trials.groupBy("label_digit").agg(F.count(F.lit(1)).alias("n"))
    totals = trials.agg(F.count(F.lit(1)).alias("n_total"), F.count_if(F.col("label_binary") == 0).alias("n_blank"), F.count_if(F.col("label_binary") == 1).alias("n_digit"))
    return all_classes.join(by, "label_digit", "left").select("label_digit", F.coalesce("n", F.lit(0)).alias("n")).crossJoin(F.broadcast(totals))


def nan_audit(signals: DataFrame) -> DataFrame:
    bad = signals.select("channel", F.size("signal").alias("_size"), not_finite(F.col("signal")).alias("_b"))
    return bad.groupBy("channel").agg(F.sum("_size").alias("n_values"), F.sum("_b.n_nan").alias("n_nan"), F.sum("_b.n_inf").alias("n_inf"))


def head_sample(rows: DataFrame, n: int) -> DataFrame:
    """The first n rows in source order; each task sends n at most."""
    return rows.orderBy("seq").limit(n)


def order_audit(rows: DataFrame) -> DataFrame:
    """Of each block, how many rows have an earlier time than the row before them."""
    x = with_previous(rows.select("sessionnum", "block", "seq", "ts"), ["sessionnum", "block"], ["seq"], {"_before": "ts"})
    return x.withColumn("_back", F.col("ts") < F.col("_before")).groupBy("sessionnum", "block").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("_back").alias("n_inversions"))


def column_roles(unpivoted: DataFrame, columns: list[str]) -> DataFrame:
    """How many columns and values each role has; roles follow from names alone."""
    roles = unpivoted.sparkSession.createDataFrame([(c, role_of(c)) for c in columns], "column string, role string")
    counts = unpivoted.groupBy("column").agg(F.count("value").alias("n"))
    return roles.join(counts, "column").groupBy("role").agg(F.count(F.lit(1)).alias("n_columns"), F.sum("n").alias("n_values"))


def shape_check(signals: DataFrame) -> DataFrame:
    """Whether all channels have as many samples, and how many values a trial has."""
    by = signals.groupBy("channel").agg(F.min(F.size("signal")).alias("lo"), F.max(F.size("signal")).alias("hi"))
    return by.agg(F.count(F.lit(1)).alias("n_channels"), F.min("lo").alias("min_samples"), F.max("hi").alias("max_samples"), F.sum("hi").alias("values_per_trial"), (F.min("lo") == F.max("hi")).alias("is_regular"))


def range_stats(params: DataFrame) -> DataFrame:
    return params.agg(rounded(F.min("center")).alias("min_center"), rounded(F.max("center")).alias("max_center"), rounded(F.min("scale")).alias("min_scale"), rounded(F.max("scale")).alias("max_scale"))
