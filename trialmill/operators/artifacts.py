"""Artifact diagnostics, thresholds learned from training data, flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import abs_max, jumps, moments
from ..functions.radix import of_columns, quantiles

CRITERIA = ("amplitude", "jump", "kurtosis", "flatline")
CONCERN = 3


def metrics(signals: DataFrame) -> DataFrame:
    """trial_id, channel, amplitude, jump, std, kurtosis: no shuffle. Kurtosis is excess and biased, null where undefined."""
    m = moments(F.col("signal"))
    x = signals.select("trial_id", "channel", "signal", m.alias("_m"))
    return x.select(
        "trial_id",
        "channel",
        abs_max(F.col("signal")).alias("amplitude"),
        abs_max(jumps(F.col("signal"))).alias("jump"),
        F.sqrt("_m.m2").alias("std"),
        F.when(F.col("_m.m2") > 0, F.col("_m.m4") / (F.col("_m.m2") * F.col("_m.m2")) - 3).alias("kurtosis"),
    )


def thresholds(measured: DataFrame, high: float = 0.995, low: float = 0.005) -> DataFrame:
    """One row: exact quantiles over all trials and channels of the training data, counted in passes over the four columns at once; undefined kurtosis doesn't count. Null without any."""
    of = {"amplitude": ("amplitude", "high"), "jump": ("jump", "high"), "kurtosis": ("kurtosis", "high"), "flatline": ("std", "low")}
    columns = [c for c, _ in of.values()]
    found = quantiles(measured.select(*columns), of_columns(columns), {"high": high, "low": low})
    row = [found.get(c, {}).get(end) for c, end in of.values()]
    return measured.sparkSession.createDataFrame([tuple(row)], ", ".join(f"{n} double" for n in of))


def flags(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """trial_id, channel, a flag for each criterion, is_any. Above a limit, or at or below the flatline one; undefined never flags."""
    t = limits.select(*[F.col(c).alias(f"_{c}") for c in CRITERIA])
    no = lambda c: F.coalesce(c, F.lit(False))
    x = measured.crossJoin(F.broadcast(t))  # one row
    x = x.select("trial_id", "channel", *[no(F.col(c) > F.col(f"_{c}")).alias(f"is_{c}") for c in CRITERIA[:3]], no(F.col("std") <= F.col("_flatline")).alias("is_flatline"))
    return x.withColumn("is_any", F.col("is_amplitude") | F.col("is_jump") | F.col("is_kurtosis") | F.col("is_flatline"))


def concern(flagged: DataFrame, least: int = CONCERN) -> DataFrame:
    """trial_id, n_flagged, trial_concern."""
    n = F.count_if("is_any")
    return flagged.groupBy("trial_id").agg(n.alias("n_flagged"), (n >= least).alias("trial_concern"))


def rates(flagged: DataFrame, trials: DataFrame, least: int = CONCERN) -> DataFrame:
    """Of each split: trials hit by each criterion, and the shares with any flag and of concern."""
    by = flagged.groupBy("trial_id").agg(*[F.bool_or(f"is_{c}").alias(c) for c in CRITERIA], F.count_if("is_any").alias("n_flagged"))
    x = by.join(trials.select("trial_id", "split"), "trial_id")
    return x.groupBy("split").agg(
        *[F.count_if(c).alias(f"n_{c}") for c in CRITERIA],
        F.round(F.avg((F.col("n_flagged") > 0).cast("double")), 6).alias("any_rate"),
        F.round(F.avg((F.col("n_flagged") >= least).cast("double")), 6).alias("concern_rate"),
    )


def clean(trials: DataFrame, trial_flags: DataFrame) -> DataFrame:
    """trials without those of concern."""
    return trials.join(trial_flags.where("trial_concern").select("trial_id"), "trial_id", "left_anti")
