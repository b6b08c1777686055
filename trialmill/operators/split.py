"""Splits without leakage: a block, or a session, is wholly in one split."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import unit
from ..functions.ranks import places

BLOCK = ("sessionnum", "blocknum")


def blocks_of(trials: DataFrame) -> DataFrame:
    return trials.select(*BLOCK).distinct()


def assign_blocks(trials: DataFrame, val_share: float = 0.2, seed: int = 42) -> DataFrame:
    """sessionnum, blocknum, split: a function of the seed and the block alone."""
    return blocks_of(trials).withColumn("split", F.when(unit(seed, *BLOCK) < val_share, "val").otherwise("train"))


def assign_sessions(trials: DataFrame, val_share: float = 0.2, seed: int = 42) -> DataFrame:
    sessions = trials.select("sessionnum").distinct()
    return sessions.withColumn("split", F.when(unit(seed, "sessionnum") < val_share, "val").otherwise("train"))


def assign_chronological(trials: DataFrame, val_share: float = 0.2, time: str = "trial_id") -> DataFrame:
    """The last share of blocks by start goes to val; places are found by range, so no task sees all blocks."""
    start = places(trials.groupBy(*BLOCK).agg(F.min(time).alias("starts")), [], ["starts", *BLOCK])
    last = F.greatest(F.max("place"), F.lit(1)).alias("_last")
    x = start.crossJoin(F.broadcast(start.agg(last)))  # one row
    return x.select(*BLOCK, F.when(F.col("place") / F.col("_last") >= 1 - val_share, "val").otherwise("train").alias("split"))


def with_split(trials: DataFrame, assignment: DataFrame) -> DataFrame:
    """Spark picks the join: a broadcast only below its own size threshold."""
    return trials.join(assignment, [c for c in BLOCK if c in assignment.columns])


def balance(trials: DataFrame, label: str = "label_binary") -> DataFrame:
    by = trials.groupBy("split", label).agg(F.count(F.lit(1)).alias("n"))
    return by.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy("split")), 2))


def balance_rollup(trials: DataFrame, label: str = "label_binary") -> DataFrame:
    return trials.rollup("split", label).agg(F.count(F.lit(1)).alias("n"))


def validation(trials: DataFrame) -> DataFrame:
    """Blocks in more than one split, and trials of each."""
    by = trials.groupBy(*BLOCK).agg(F.count_distinct("split").alias("splits"), F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "val").alias("val"))
    return by.agg(F.count_if(F.col("splits") > 1).alias("n_overlap"), F.sum("train").alias("n_train"), F.sum("val").alias("n_val"))


def overlap(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))


def require_disjoint(a: DataFrame, b: DataFrame, *keys: str) -> None:
    """Raises if a key is in both; stops at the first ones found."""
    common = overlap(a, b, *keys).take(5)
    if common:
        raise ValueError(f"{', '.join(keys)} in both tables, such as {[tuple(r) for r in common]}")


def split_pool(trials: DataFrame, test: DataFrame | None = None, val_share: float = 0.2, seed: int = 42) -> DataFrame:
    """The whole phase: sessions apart from the test set's, blocks assigned, no block in both."""
    if test is not None:
        require_disjoint(trials, test, "sessionnum")
    out = with_split(trials, assign_blocks(trials, val_share, seed))
    if validation(out).first().n_overlap:
        raise ValueError("a block is in both splits")
    return out
