"""Balanced acquisition from an ordered stream of labelled rows: seq, label (-1 is a blank), and what else they carry.

"The row before" is that in order of seq, which may have gaps; rows are dealt by range
to find it, as a window over the whole stream would need one task. sources/order.py numbers
rows of files that carry no order of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import places, with_previous


def scan_guard(rows: DataFrame, target_per_class: int | None, multiplier: int = 5) -> DataFrame:
    """The rows that a scan may read at most; the condition reaches the source."""
    most = target_per_class * 10 * multiplier if target_per_class else 50_000_000
    return rows.where(F.col("seq") < most)


def preceded(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """rows with the label and seq of the row before, in label_before and seq_before: over the whole stream, or within the keys `by`."""
    return with_previous(rows, list(by), ["seq"], {"label_before": "label", "seq_before": "seq"})


def paired(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Each digit row that comes right after a blank, with that blank's seq in blank_seq. Any digit row uses up the blank before it.

    All columns are written once on the way: give those that are needed. Rows
    that share a seq come in order of a hash.
    """
    return preceded(rows, by).where("label <> -1 AND label_before = -1").drop("label_before").withColumnRenamed("seq_before", "blank_seq")


def unpaired(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Digit rows that have no blank right before them."""
    return preceded(rows, by).where("label <> -1 AND coalesce(label_before, 0) <> -1").drop("label_before", "seq_before")


def capped(pairs: DataFrame, cap: int | None) -> DataFrame:
    """The first `cap` pairs of each class in order of seq, numbered in `taken`; None: all of them.

    Ranks are limited before they are shuffled: a task sends at most cap rows of
    a class. Without a cap places are found by range.
    """
    if cap is None:
        return places(pairs, ["label"], ["seq"], "_n").withColumn("taken", F.col("_n") + 1).drop("_n")
    ranked = pairs.withColumn("taken", F.row_number().over(Window.partitionBy("label").orderBy("seq")))
    return ranked.where(F.col("taken") <= cap)


def class_fill(pairs: DataFrame, classes: list[int], cap: int) -> DataFrame:
    """Accepted pairs of each class against the target, classes without any included."""
    all_classes = pairs.sparkSession.createDataFrame([(c,) for c in classes], "label int")
    counts = pairs.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    accepted = F.coalesce("n", F.lit(0))
    return all_classes.join(counts, "label", "left").select("label", accepted.alias("accepted"), F.lit(cap).alias("target"), (accepted >= cap).alias("is_full"))


def stop_position(pairs: DataFrame, classes: list[int], cap: int) -> DataFrame:
    """The seq at which every class is full; null if one never fills. Nothing after it is accepted."""
    last = pairs.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last"))
    return last.agg(F.when((F.count_if(F.col("n") >= cap) == len(classes)), F.max("last")).alias("stop_seq"))


def pool_order(pairs: DataFrame) -> DataFrame:
    """Rows of the pool in writing order: the kth pair's digit at 2k, its blank at 2k + 1."""
    k = places(pairs.select("seq", "label", "blank_seq"), [], ["seq"], "_k")
    both = F.explode(F.array(F.struct((2 * F.col("_k")).alias("position"), F.col("seq").alias("seq"), F.col("label").alias("label")), F.struct((2 * F.col("_k") + 1).alias("position"), F.col("blank_seq").alias("seq"), F.lit(-1).alias("label"))))
    return k.select(both.alias("r")).select("r.*")


def previous_label(rows: DataFrame) -> DataFrame:
    """Each row with the label before it in its session; null for the first."""
    return with_previous(rows.select("seq", "sessionnum", "label"), ["sessionnum"], ["seq"], {"prev_label": "label"}).select("seq", "sessionnum", "label", "prev_label")


def alternation(rows: DataFrame) -> DataFrame:
    """How often a session's rows change between blank and digit, and how often not."""
    x = previous_label(rows).where("prev_label IS NOT NULL")
    change = (F.col("label") == -1) != (F.col("prev_label") == -1)
    return x.agg(F.count_if(change).alias("n_changes"), F.count_if(~change).alias("n_same"))


def with_binary(rows: DataFrame) -> DataFrame:
    """label_digit, and label_binary: 0 for a blank, else 1; the rest is carried."""
    return rows.withColumnRenamed("label", "label_digit").withColumn("label_binary", F.when(F.col("label_digit") == -1, 0).otherwise(1))


def acquire(rows: DataFrame, cap: int | None, multiplier: int = 5, guard: bool = False) -> DataFrame:
    """The whole phase: scan, pair, cap, put in writing order, label."""
    rows = scan_guard(rows, cap, multiplier) if guard else rows
    return with_binary(pool_order(capped(paired(rows.select("seq", "label")), cap)))
