"""The phases of a run, each a function of DataFrames; Parquet stands between them.

A phase whose table was made from the same inputs and parameters is skipped, unless `force` is given. Data
and fitted parameters lie under the tag of variant and fraction, models and
results under that, stage and model.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import acquire, artifacts, features, models, permute, robust, spectral, split
from ..operators.evaluate import confusion, metrics, permutation_summary, val_test_gap
from ..sources import order, store, wide
from .manifest import Manifest, source_version

SHUFFLES, SHUFFLED_ROWS = 10, 5000  # of the shuffled-label test of classical models


def of_split(rows: DataFrame, trials: DataFrame, name: str) -> DataFrame:
    return rows.join(trials.where(F.col("split") == name).select("trial_id"), "trial_id", "left_semi")


def preprocess(spark: SparkSession, trials: DataFrame, signals: DataFrame, path: str, apply_notch: bool = False) -> DataFrame:
    """Fits on the train split and applies to every split; parameters are left under path.

    Filter, robust fit, bad channels, exclusion, normalization, diagnostics,
    thresholds, flags. The robust fit is by channel, so a fit before exclusion
    serves after it. Result: trial_id, split, n_flagged, trial_concern.
    """
    filtered = spectral.bandpass(signals)
    filtered = store.write(spectral.notch(filtered) if apply_notch else filtered, f"{path}/filtered", mode="overwrite")
    params = store.write(robust.fit(of_split(filtered, trials, "train")), f"{path}/norm_params", mode="overwrite")
    bad = store.write(robust.bad_channels(params), f"{path}/bad_channels", mode="overwrite")
    measured = store.write(artifacts.metrics(robust.normalize(robust.exclude(filtered, bad), params)), f"{path}/artifact_metrics", mode="overwrite")
    limits = store.write(artifacts.thresholds(of_split(measured, trials, "train")), f"{path}/thresholds", mode="overwrite")
    flagged = artifacts.concern(artifacts.flags(measured, limits))
    return flagged.join(trials.select("trial_id", "split"), "trial_id")


def fitted_bad_channels(spark: SparkSession, path: str) -> DataFrame:
    return store.params(spark, f"{path}/bad_channels")


def apply_fitted(spark: SparkSession, signals: DataFrame, path: str, apply_notch: bool = False) -> DataFrame:
    """Flags of new trials by the parameters under path, which are never fitted anew; an error if they are missing."""
    params, bad, limits = (store.params(spark, f"{path}/{name}") for name in ("norm_params", "bad_channels", "thresholds"))
    filtered = spectral.bandpass(signals)
    normal = robust.normalize(robust.exclude(spectral.notch(filtered) if apply_notch else filtered, bad), params)
    return artifacts.concern(artifacts.flags(artifacts.metrics(normal), limits))


def normalized(spark: SparkSession, trials: DataFrame, trial_flags: DataFrame, path: str) -> DataFrame:
    """The filtered and normalized signals of the good channels, each beside its trial's labels and flags: the other lane's input."""
    params, bad = store.params(spark, f"{path}/norm_params"), fitted_bad_channels(spark, path)
    x = robust.normalize(robust.exclude(spark.read.parquet(f"{path}/filtered"), bad), params)
    return x.join(trials.select("trial_id", "label_binary", "label_digit", "split"), "trial_id").join(trial_flags.select("trial_id", "n_flagged", "trial_concern"), "trial_id")


def raw_features(spark: SparkSession, signals: DataFrame, path: str, bands=spectral.BANDS, nperseg: int = spectral.SEGMENT) -> DataFrame:
    """trial_id, features: of the raw signals of the channels that the fit under path found good."""
    return features.trial_vectors(features.channel_features(robust.exclude(signals, fitted_bad_channels(spark, path)), bands, nperseg), bands)


def stage_data(trials: DataFrame, vectors: DataFrame, stage: str, trial_flags: DataFrame | None = None) -> DataFrame:
    """trial_id, split, sessionnum, y, features of a stage, without trials of concern where flags are given."""
    x = features.stage_view(trials, stage).join(vectors, "trial_id")
    return artifacts.clean(x, trial_flags) if trial_flags is not None else x


def average_of(stage: str) -> str:
    return "binary" if stage == "stage1" else "macro"


def result_rows(row: DataFrame, variant_tag: str, stage: str, model: str, split_name: str) -> DataFrame:
    names = [c for c, t in row.dtypes if t == "double"]
    parts = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in names]))
    return row.select(F.lit(variant_tag).alias("variant_tag"), F.lit(stage).alias("stage"), F.lit(model).alias("model"), F.lit(split_name).alias("split"), parts.alias("p")).select("variant_tag", "stage", "model", "split", "p.*")


def save_results(rows: DataFrame, path: str) -> None:
    store.replace_partitions(rows, f"{path}/results", ("variant_tag", "stage", "model", "split"))


def shuffled_label_test(data: DataFrame, name: str, seed: int = 42, permutations: int = SHUFFLES, rows: int | None = SHUFFLED_ROWS) -> DataFrame:
    """One row: accuracy with real and with shuffled labels, each fitted on at most `rows` training rows; svm by its cheap form."""
    quick = "svm_cheap" if name.startswith("svm") else name
    some = data.select("trial_id", "split", "y", "features")
    train, val = some.where("split = 'train'").drop("split"), some.where("split = 'val'").drop("split")
    train = train if rows is None else permute.subsample(train, rows, seed)
    runs = permute.lda_runs(train, val, permutations, seed) if name == "lda" else permute.model_runs(lambda t: models.fit(quick, t, seed), train, val, permutations, seed)
    return permutation_summary(runs)


def run_model(data: DataFrame, name: str, stage: str, path: str, variant_tag: str, seed: int = 42, permutations: int = SHUFFLES) -> DataFrame:
    """Fits on train, saves the model with its scale, scores val, runs the shuffled-label test (unless permutations is 0); the result rows written.

    The confusion matrix is written beside the results.
    """
    spark = data.sparkSession
    fitted = models.fit(name, data.where("split = 'train'"), seed)
    models.save_model(fitted, f"{path}/models/{variant_tag}/{stage}/{name}")
    said = store.write(fitted(data.where("split = 'val'")).select("trial_id", "y", "yhat"), store.scratch(spark, "said"))
    store.write(confusion(said), f"{path}/confusion/{variant_tag}/{stage}/{name}", mode="overwrite")
    save_results(result_rows(metrics(said, average_of(stage)), variant_tag, stage, name, "val"), path)
    if permutations:
        save_results(result_rows(shuffled_label_test(data, name, seed, permutations), variant_tag, stage, name, "shuffled"), path)
    return run_results(spark, path, variant_tag, stage, name)


def run_results(spark: SparkSession, path: str, variant_tag: str, stage: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{path}/results")
    return rows.where((F.col("variant_tag") == variant_tag) & (F.col("stage") == stage) & (F.col("model") == name)).select("variant_tag", "stage", "model", "split", "metric", "value")


def evaluate_test(test: DataFrame, name: str, stage: str, path: str, variant_tag: str) -> DataFrame:
    """Scores the held-out test set with the saved model, which is never fitted anew, and compares with the val results.

    test(y, features) of the stage. An error of Spark's if no model was saved.
    """
    spark = test.sparkSession
    said = models.load_model(spark, f"{path}/models/{variant_tag}/{stage}/{name}")(test)
    save_results(result_rows(metrics(said, average_of(stage)), variant_tag, stage, name, "test"), path)
    return val_test_gap(run_results(spark, path, variant_tag, stage, name))


def cap_of(per_class: int | None, fraction: float) -> int | None:
    """Pairs of each class to acquire: all of them, or the fraction of what the whole source has of each."""
    if fraction >= 1:
        return None
    if per_class is None:
        raise ValueError("a fraction needs the number of pairs that each class has in the whole source")
    return int(per_class * fraction)


def ordered(spark: SparkSession, source: DataFrame | str) -> DataFrame:
    """Raw rows with a dense `seq`: those of Parquet files under a path in order of the files, or a table that has one."""
    rows = order.in_file_order(spark, source) if isinstance(source, str) else source
    return rows.withColumn("label", F.col("label").cast("int"))


def pool_trials(raw: DataFrame, cap: int | None, multiplier: int = 5) -> DataFrame:
    """The balanced pool of raw rows: trial_id in writing order, seq, labels and recording position."""
    x = acquire.acquire(raw.select("seq", "label"), cap, multiplier, guard=cap is not None)
    place = raw.select("seq", *[F.col(c).cast("long").alias(c) for c in ("sessionnum", "blocknum", "blockpos")])
    return x.join(place, "seq").select(F.col("position").alias("trial_id"), "seq", "label_digit", "label_binary", "sessionnum", "blocknum", "blockpos")


def pool_signals(raw: DataFrame, pool: DataFrame) -> DataFrame:
    """trial_id, channel, signal of the pool's rows."""
    rows = raw.drop("trial_id").join(pool.select("seq", "trial_id"), "seq")
    return wide.to_signals(rows).select("trial_id", "channel", "signal")


def run(
    spark: SparkSession,
    source: DataFrame | str,
    path: str,
    model: str = "random_forest",
    stage: str = "stage1",
    bands=spectral.BANDS,
    nperseg: int = spectral.SEGMENT,
    *,
    test_source: DataFrame | str | None = None,
    per_class: int | None = None,
    test_per_class: int | None = None,
    multiplier: int = 5,
    variant: str = "all",
    fraction: float = 1.0,
    seed: int = 42,
    permutations: int = SHUFFLES,
    force: bool = False,
) -> DataFrame:
    """From raw wide rows to results: acquisition of the pool and of the test set, and all that main() does. The result rows of the run.

    A source is a path of Parquet files, whose rows are taken in order of the files, or a table with a dense seq; either has
    label, sessionnum, blocknum, blockpos and a column `{channel}_{i}` for each sample. per_class and test_per_class:
    pairs that each class has in the whole source; with a fraction below 1 the pool is capped at that share of them.
    """
    base = f"{path}/{store.variant_tag(variant, fraction)}"
    pools = {}
    for name, src, whole in (("", source, per_class), ("test_", test_source, test_per_class)):
        if src is None:
            continue
        raw, cap = ordered(spark, src), cap_of(whole, fraction)
        m = Manifest(spark, base, {"raw": source_version(spark.read.parquet(src) if isinstance(src, str) else src)}, force)
        pool = m.phase(f"{name}pool_trials", lambda: pool_trials(raw, cap, multiplier), ["raw"], cap=cap, multiplier=multiplier)  # noqa: B023
        signals = m.phase(f"{name}pool_signals", lambda: pool_signals(raw, pool), ["raw", f"{name}pool_trials"])  # noqa: B023
        pools[name] = (pool, signals)
    return main(spark, *pools[""], path, model, stage, bands, nperseg, test=pools.get("test_"), variant=variant, fraction=fraction, seed=seed, permutations=permutations, force=force)


def main(
    spark: SparkSession,
    trials: DataFrame,
    signals: DataFrame,
    path: str,
    model: str = "random_forest",
    stage: str = "stage1",
    bands=spectral.BANDS,
    nperseg: int = spectral.SEGMENT,
    *,
    test: tuple[DataFrame, DataFrame] | None = None,
    variant: str = "all",
    fraction: float = 1.0,
    seed: int = 42,
    permutations: int = SHUFFLES,
    force: bool = False,
) -> DataFrame:
    """Split, preprocess, features, model, and the test set (its trials and signals) if one is given: the result rows of one run.

    A phase is skipped if its table was made from the same tables with the same parameters (Manifest).
    """
    tag = store.variant_tag(variant, fraction)
    base = f"{path}/{tag}"
    sources = {"given_trials": source_version(trials), "given_signals": source_version(signals)}
    sources |= {"test_trials": source_version(test[0]), "test_signals": source_version(test[1])} if test else {}
    m = Manifest(spark, base, sources, force)
    parted = m.phase("trials", lambda: split.split_pool(trials, test[0] if test else None, seed=seed), ["given_trials", *(["test_trials"] if test else [])], seed=seed)
    flagged = m.phase("trial_flags", lambda: preprocess(spark, parted, signals, base), ["trials", "given_signals"])
    bins = {"bands": [list(b) for b in bands], "nperseg": nperseg}
    vectors = m.phase("features", lambda: raw_features(spark, signals, base, bands, nperseg), ["trial_flags", "given_signals"], **bins)
    done = f"runs/{stage}/{model}"
    m.phase(done, lambda: run_model(stage_data(parted, vectors, stage, flagged), model, stage, path, tag, seed, permutations), ["trials", "trial_flags", "features"], seed=seed, permutations=permutations)
    if test:
        own_flags = m.phase("test_flags", lambda: apply_fitted(spark, test[1], base), ["trial_flags", "test_signals"])
        own = m.phase("test_features", lambda: raw_features(spark, test[1], base, bands, nperseg), ["trial_flags", "test_signals"], **bins)
        m.phase(f"tests/{stage}/{model}", lambda: evaluate_test(stage_data(test[0], own, stage, own_flags), model, stage, path, tag), [done, "test_trials", "test_flags", "test_features"])
    return run_results(spark, path, tag, stage, model)
