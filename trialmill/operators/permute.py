"""Subsamples, shuffled labels and the shuffled-label test."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import order
from ..functions.ranks import places
from ..sources.store import scratch, write
from . import models


#: Centres that are sent to every task at once.
MOST_CENTRES = 10_000


def subsample(rows: DataFrame, n: int, seed: int = 42, key: str = "trial_id") -> DataFrame:
    """n rows without replacement; each task sends n at most."""
    return rows.withColumn("_o", order(seed, key)).orderBy("_o", key).limit(n).drop("_o")


def permuted(labels: DataFrame, permutations: int, seed: int = 42) -> DataFrame:
    """labels(trial_id, y): perm, trial_id, y; perm 0 keeps the labels, 1 to `permutations` shuffle them.

    Trials in order of id take the labels of trials in hashed order; both
    orders are found by range, so a permutation of any size fits.
    """
    perms = F.explode(F.sequence(F.lit(1), F.lit(permutations))).alias("perm")
    by_id = places(labels.select("trial_id"), [], ["trial_id"])  # the same for every permutation
    each = labels.select(perms, "trial_id", "y").withColumn("_o", order(seed, "perm", "trial_id"))
    by_hash = places(each, ["perm"], ["_o", "trial_id"]).select("perm", "place", "y")
    shuffled = by_hash.join(by_id, "place").select("perm", "trial_id", "y")
    return labels.select(F.lit(0).alias("perm"), "trial_id", "y").unionByName(shuffled)


def centroids(rows: DataFrame) -> DataFrame:
    """perm, yhat, centroid: class means of rows(perm, y, x array); sums by permutation, class and place are added up before they are shuffled."""
    cells = rows.select("perm", "y", F.posexplode("x").alias("i", "v")).groupBy("perm", "y", "i").agg(F.avg("v").alias("m"))
    return cells.groupBy("perm", "y").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid")).withColumnRenamed("y", "yhat")


def nearest(tested: DataFrame, centres: DataFrame) -> DataFrame:
    """perm, trial_id, y, yhat: each row of tested(trial_id, y, x) with the nearest centre of each permutation; ties go to the least label.

    A row meets all centres as one array, and finds its nearest within itself: no row is
    shuffled. Centres, one for each permutation and class, are counted first; beyond MOST_CENTRES
    they go in as many arrays as that takes.
    """
    spark = tested.sparkSession
    by = centres.groupBy("perm").agg(F.array_sort(F.collect_list(F.struct("yhat", "centroid"))).alias("each"))
    by = write(by, scratch(spark, "centroids"))
    parts = -(-by.agg(F.coalesce(F.sum(F.size("each")), F.lit(0))).first()[0] // MOST_CENTRES)
    far = lambda c: F.aggregate(F.zip_with("x", c["centroid"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    best = lambda p: F.struct(p["perm"].alias("perm"), F.array_min(F.transform(p["each"], lambda c: F.struct(F.round(far(c), 9).alias("d"), c["yhat"].alias("yhat"))))["yhat"].alias("yhat"))
    out = None
    for i in range(parts):
        some = by.where(F.pmod("perm", F.lit(parts)) == i).agg(F.collect_list(F.struct("perm", "each")).alias("_all"))
        near = tested.crossJoin(F.broadcast(some)).select("trial_id", "y", F.explode(F.transform("_all", best)).alias("b")).select("b.perm", "trial_id", "y", "b.yhat")  # one row of bounded size
        out = near if out is None else out.unionAll(near)
    return out if out is not None else tested.select(F.lit(0).alias("perm"), "trial_id", "y", F.col("y").alias("yhat")).limit(0)


def centroid_runs(features: DataFrame, train: DataFrame, val: DataFrame, permutations: int, seed: int = 42) -> DataFrame:
    """perm, accuracy of a nearest-centroid classifier, for all permutations in one plan.

    features(trial_id, x array); train and val(trial_id, y).
    """
    centres = centroids(permuted(train, permutations, seed).join(features, "trial_id"))
    said = nearest(val.join(features, "trial_id"), centres)
    return said.groupBy("perm").agg(F.avg((F.col("yhat") == F.col("y")).cast("double")).alias("accuracy"))


def lda_runs(train: DataFrame, val: DataFrame, permutations: int, seed: int = 42) -> DataFrame:
    """perm, accuracy of a linear discriminant, for all permutations in one plan: the same as model_runs() gives by fitting them one after the other.

    train and val(trial_id, y, features). The scale and the sum of x x' don't depend on labels;
    a permutation needs its class sums and a solve as small as there are classes.
    """
    spark = train.sparkSession
    train = write(train.select("trial_id", F.col("y").cast("int").alias("y"), "features"), scratch(spark, "train"))
    scale = models.Fitted("lda", *models.scale(train))
    each = permuted(train.select("trial_id", "y"), permutations, seed).groupBy("trial_id").agg(F.array_sort(F.collect_list(F.struct("perm", "y"))).alias("_ys"))
    rows = train.join(each, "trial_id").select(F.transform("_ys", lambda s: s["y"]).alias("ys"), scale.scaled().alias("x"))
    labels = sorted(r.y for r in train.select("y").distinct().collect())  # classes are few
    weights, offsets = models.discriminants(*models.class_sums(rows, labels, permutations + 1, len(scale.mean)))
    return models.lda_hits(val.select(F.col("y").cast("int").alias("y"), scale.scaled().alias("x")), weights, offsets, labels)


def model_runs(fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]], train: DataFrame, val: DataFrame, permutations: int, seed: int = 42) -> DataFrame:
    """perm, accuracy for any fit and predict: fit(train) gives a function from val to (y, yhat) rows. Fits follow each other."""
    spark = train.sparkSession
    train, val = write(train, scratch(spark, "train")), write(val, scratch(spark, "val"))
    labels = write(permuted(train.select("trial_id", "y"), permutations, seed), scratch(spark, "labels"))
    out = []
    for p in range(permutations + 1):
        data = train.drop("y").join(labels.where(F.col("perm") == p).select("trial_id", "y"), "trial_id")
        hit = fit(data)(val).agg(F.avg((F.col("y") == F.col("yhat")).cast("double"))).first()[0]
        out.append((p, hit))
    return spark.createDataFrame(out, "perm int, accuracy double")
