"""Features of each channel and of each trial."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import moments, zero_crossings
from .spectral import BANDS, FS, SEGMENT, band_columns, frequency_columns

STATISTICS = ("mean", "variance", "skewness", "kurtosis", "zero_crossing_rate")
FREQUENCIES = ("dominant_freq", "total_power")


def feature_names(bands=BANDS) -> list[str]:
    return [b[0] for b in bands] + list(STATISTICS) + list(FREQUENCIES)


def statistic_columns() -> list[Column]:
    """Of a column _m of moments() and `signal`; skewness and kurtosis are 0 where the variance is below 1e-12."""
    some = F.col("_m.m2") >= 1e-12
    return [
        F.col("_m.mean").alias("mean"),
        F.col("_m.m2").alias("variance"),
        F.when(some, F.col("_m.m3") / F.pow("_m.m2", F.lit(1.5))).otherwise(0.0).alias("skewness"),
        F.when(some, F.col("_m.m4") / (F.col("_m.m2") * F.col("_m.m2")) - 3).otherwise(0.0).alias("kurtosis"),
        zero_crossings(F.col("signal")).alias("zero_crossing_rate"),
    ]


def statistics(signals: DataFrame) -> DataFrame:
    x = signals.select("trial_id", "channel", "signal", moments(F.col("signal")).alias("_m"))
    return x.select("trial_id", "channel", *statistic_columns())


def channel_features(signals: DataFrame, bands=BANDS, nperseg: int = SEGMENT, fs: float = FS) -> DataFrame:
    """trial_id, channel and a column for each feature: one spectrum serves bands and frequencies; nothing is shuffled."""
    from ..functions.batches import map_signals
    from .spectral import welch

    x = map_signals(signals.withColumn("_s", F.col("signal")), lambda s: welch(s, fs, nperseg), "psd", ["trial_id", "channel", "_s"]).withColumnRenamed("_s", "signal")
    x = x.withColumn("_m", moments(F.col("signal")))
    return x.select("trial_id", "channel", *band_columns(bands, nperseg, fs), *statistic_columns(), *frequency_columns(nperseg, fs))


def long_features(wide: DataFrame, bands=BANDS) -> DataFrame:
    """trial_id, channel, ord, feature, value."""
    names = feature_names(bands)
    parts = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(n).alias("feature"), F.col(n).alias("value")) for i, n in enumerate(names)])
    return wide.select("trial_id", "channel", F.explode(parts).alias("f")).select("trial_id", "channel", "f.*")


def trial_vectors(wide: DataFrame, bands=BANDS) -> DataFrame:
    """trial_id, features array: channels in order, each with its features in order."""
    one = F.struct("channel", F.array(*feature_names(bands)).alias("values"))
    return wide.groupBy("trial_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(one)), lambda s: s["values"])).alias("features"))


def with_vector(vectors: DataFrame) -> DataFrame:
    return vectors.withColumn("vector", array_to_vector("features"))


def flattened(signals: DataFrame) -> DataFrame:
    """trial_id, values: the trial's samples, channel after channel."""
    return signals.groupBy("trial_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("channel", "signal"))), lambda s: s["signal"])).alias("values"))


def jumps_long(signals: DataFrame) -> DataFrame:
    """trial_id, channel, i, jump: each sample less the one before it."""
    d = F.zip_with(F.slice("signal", 2, F.size("signal") - 1), F.slice("signal", 1, F.size("signal") - 1), lambda a, b: a - b)
    return signals.select("trial_id", "channel", F.posexplode(d).alias("_i", "jump")).select("trial_id", "channel", (F.col("_i") + 1).alias("i"), "jump")


def scale_fit(features: DataFrame) -> DataFrame:
    """channel, feature, mean, std: population spread; 1 where there is none."""
    by = features.groupBy("channel", "feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return by.withColumn("std", F.when(F.col("std") > 0, F.col("std")).otherwise(1.0))


def scale_apply(features: DataFrame, fitted: DataFrame) -> DataFrame:
    x = features.join(fitted, ["channel", "feature"])
    return x.withColumn("value", (F.col("value") - F.col("mean")) / F.col("std")).drop("mean", "std")


def stage_view(trials: DataFrame, stage: str) -> DataFrame:
    """stage1: every trial with its binary label; stage2: digit trials with their digit. A view of the same data."""
    if stage == "stage1":
        return trials.withColumn("y", F.col("label_binary"))
    if stage == "stage2":
        return trials.where("label_digit <> -1").withColumn("y", F.col("label_digit"))
    raise ValueError(f"unknown stage {stage!r}")


def with_flags(features: DataFrame, trial_flags: DataFrame) -> DataFrame:
    """Features beside their trial's flags, joined by id; raises if a trial lacks flags."""
    missing = features.select("trial_id").join(trial_flags.select("trial_id"), "trial_id", "left_anti").take(1)
    if missing:
        raise ValueError(f"trial {missing[0].trial_id} has features but no flags")
    return features.join(trial_flags, "trial_id")

