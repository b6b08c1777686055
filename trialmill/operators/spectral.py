"""Power spectra, band powers, class differences, zero-phase filters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import not_finite
from ..functions.batches import map_signals
from ..functions.design import Recursion, butterworth_bandpass, notch as notch_sections

FS, SEGMENT = 250.0, 128
#: Name and inclusive edges in Hz, in the order of the features.
BANDS = (("delta", 1.0, 4.0), ("theta", 4.0, 8.0), ("alpha", 8.0, 13.0), ("beta", 13.0, 30.0), ("gamma", 30.0, 40.0), ("high_gamma", 40.0, 80.0))


def welch(x: np.ndarray, fs: float, nperseg: int) -> np.ndarray:
    """One-sided densities of the rows: periodic Hann segments that overlap by half, each without its mean."""
    n = min(x.shape[1], nperseg)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    starts = range(0, x.shape[1] - n + 1, n - n // 2)
    power = np.zeros((len(x), n // 2 + 1))
    for s in starts:
        part = x[:, s : s + n]
        power += np.abs(np.fft.rfft((part - part.mean(axis=1, keepdims=True)) * window)) ** 2
    power *= 1 / (len(starts) * fs * (window**2).sum())
    power[:, 1 : (n + 1) // 2] *= 2
    return power


def psd(signals: DataFrame, fs: float = FS, nperseg: int = SEGMENT) -> DataFrame:
    """trial_id, channel, psd array: the power at each bin."""
    return map_signals(signals, lambda x: welch(x, fs, nperseg), "psd", ["trial_id", "channel"])


def bins(spectra: DataFrame, nperseg: int, fs: float = FS) -> DataFrame:
    """trial_id, channel, k, freq, power."""
    return spectra.select("trial_id", "channel", F.posexplode("psd").alias("k", "power")).withColumn("freq", F.col("k") * F.lit(fs / nperseg))


def trapezoid(power: Column, first: int, last: int, width: float) -> Column:
    """The integral over bins first to last; 0 over less than two."""
    if last <= first:
        return F.lit(0.0)
    part = F.slice(power, first + 1, last - first + 1)
    return (F.aggregate(part, F.lit(0.0), lambda a, v: a + v) - (part[0] + part[last - first]) / 2) * F.lit(width)


def band_bins(lo: float, hi: float, nperseg: int, fs: float) -> tuple[int, int]:
    """The first and last bin with lo <= freq <= hi."""
    at = [k for k in range(nperseg // 2 + 1) if lo <= k * fs / nperseg <= hi]
    return (at[0], at[-1]) if at else (0, -1)


def band_columns(bands=BANDS, nperseg: int = SEGMENT, fs: float = FS) -> list[Column]:
    return [trapezoid(F.col("psd"), *band_bins(lo, hi, nperseg, fs), fs / nperseg).alias(name) for name, lo, hi in bands]


def frequency_columns(nperseg: int = SEGMENT, fs: float = FS) -> list[Column]:
    """dominant_freq, at the first largest bin, and total_power."""
    dominant = (F.array_position("psd", F.array_max("psd")) - 1) * F.lit(fs / nperseg)
    return [dominant.alias("dominant_freq"), trapezoid(F.col("psd"), 0, nperseg // 2, fs / nperseg).alias("total_power")]


def class_difference(spectra: DataFrame, trials: DataFrame, nperseg: int, fs: float = FS) -> DataFrame:
    """channel, k, freq, digit_power, blank_power, log_diff: log10 of the class means' ratio, each mean 1e-12 higher."""
    x = bins(spectra, nperseg, fs).join(trials.select("trial_id", "label_binary"), "trial_id")
    mean = x.groupBy("channel", "k", "freq").agg(F.avg(F.when(F.col("label_binary") == 1, F.col("power"))).alias("digit_power"), F.avg(F.when(F.col("label_binary") == 0, F.col("power"))).alias("blank_power"))
    return mean.withColumn("log_diff", F.log10(F.col("digit_power") + 1e-12) - F.log10(F.col("blank_power") + 1e-12))


def cutoff_audit(difference: DataFrame, cutoff: float) -> DataFrame:
    """Mean absolute divergence up to and above the cutoff, their ratio (NaN over 0), channels with more above than below."""
    d = F.abs("log_diff")
    below, above = F.avg(F.when(F.col("freq") <= cutoff, d)), F.avg(F.when(F.col("freq") > cutoff, d))
    by = difference.groupBy("channel").agg((above > below).alias("more_above"))
    flagged = by.agg(F.count_if("more_above").alias("n_channels_above"))
    total = difference.agg(below.alias("mean_below"), above.alias("mean_above"))
    ratio = F.when(F.col("mean_below") > 0, F.col("mean_above") / F.col("mean_below")).otherwise(F.lit(float("nan")))
    return total.crossJoin(flagged).select("mean_below", "mean_above", ratio.alias("ratio"), "n_channels_above")  # one row by one row


def _filtered(signals: DataFrame, sections: np.ndarray, pad: int) -> DataFrame:
    made: list[Recursion] = []  # a worker's own, made once

    def apply(x: np.ndarray) -> np.ndarray:
        if not made:
            made.append(Recursion(sections))
        return made[0].zero_phase(x, pad)

    keep = [c for c in signals.columns if c != "signal"]
    return map_signals(signals, apply, "signal", keep)


def bandpass(signals: DataFrame, low: float = 1.0, high: float = 40.0, order: int = 4, fs: float = FS) -> DataFrame:
    """Zero-phase band-pass of every signal, of any length: a few matrix products for each batch. Raises on signals of 27 samples or fewer."""
    return _filtered(signals, butterworth_bandpass(order, low, high, fs), 27)


def notch(signals: DataFrame, freq: float = 60.0, quality: float = 30.0, fs: float = FS) -> DataFrame:
    """Zero-phase notch, meant for signals that the band-pass has gone over."""
    return _filtered(signals, notch_sections(freq, quality, fs), 9)


def filter_finite(filtered: DataFrame) -> DataFrame:
    """Filtered signals and how many of their values aren't finite."""
    x = filtered.select(not_finite(F.col("signal")).alias("b"))
    return x.agg(F.count(F.lit(1)).alias("n_signals"), F.coalesce(F.sum(F.col("b.n_nan") + F.col("b.n_inf")), F.lit(0)).alias("n_bad"))


def edge_mask(signals: DataFrame, edge: int = 27) -> DataFrame:
    """Signals with the samples that filtering disturbs (the first and last `edge`) as null, and how many are left."""
    n = F.size("signal")
    inside = F.transform("signal", lambda x, i: F.when((i >= edge) & (i < n - edge), x))
    return signals.withColumn("signal", inside).withColumn("n_inside", F.greatest(n - 2 * edge, F.lit(0)))
