"""Robust scale of each channel, bad channels, normalization."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.radix import of_arrays, quantiles

FLOOR, BAD = 1e-8, 1e-7


def fit(signals: DataFrame) -> DataFrame:
    """channel, center, scale: median over trials and samples, and 1.4826 times the median deviation from it, FLOOR at least.

    Both medians are exact at any size, and are found by counting inside the
    arrays: no sample is shuffled or written. NaN samples don't count. A few
    numbers for each channel come to the driver; a channel that is null is left out.
    """
    rows = signals.where("channel IS NOT NULL").select("channel", "signal")
    inside = of_arrays()
    center = {k: v["center"] for k, v in quantiles(rows, inside, {"center": 0.5}).items()}
    away = lambda b: ((k, np.abs(x - center[k])) for k, x in inside(b) if k in center)
    spread = quantiles(rows, away, {"mad": 0.5})
    kind = signals.schema["channel"].dataType
    made = [(k, center[k], max(1.4826 * v["mad"], FLOOR)) for k, v in spread.items()]
    return signals.sparkSession.createDataFrame(made, "channel string, center double, scale double").withColumn("channel", F.col("channel").cast(kind))


def bad_channels(params: DataFrame, limit: float = BAD) -> DataFrame:
    return params.where(F.col("scale") <= limit).select("channel")


def exclude(signals: DataFrame, bad: DataFrame) -> DataFrame:
    """signals without the bad channels; the others keep their numbers."""
    return signals.join(bad, "channel", "left_anti")


def good_channels(bad: DataFrame, nominal: int) -> DataFrame:
    return bad.sparkSession.range(nominal).select(F.col("id").cast("int").alias("channel")).exceptAll(bad.select(F.col("channel").cast("int").alias("channel")))


def normalize(signals: DataFrame, params: DataFrame) -> DataFrame:
    """Signals on the fitted scale; channels without parameters drop out."""
    joined = signals.join(params, "channel")
    return joined.withColumn("signal", F.transform("signal", lambda x: (x - F.col("center")) / F.col("scale"))).drop("center", "scale")
