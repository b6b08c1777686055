"""Stand-ins for trial tables, built from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The acquisition stream's label of each event type: -1 is a blank.
LABELS = {"view": -1, "click": 0, "signup": 1, "purchase": 2, "error": 3}
#: Channel names of the wide table, in source order; lexicographic order differs.
WIDE = ("T9", "T10", "AF3", "Pz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trials(embeddings: DataFrame) -> DataFrame:
    """One row for each trial: labels and recording position."""
    digit = F.when(F.col("label") == 0, -1).otherwise(F.col("label")).cast("int")
    return embeddings.select(
        F.col("vec_id").alias("trial_id"),
        digit.alias("label_digit"),
        F.when(digit == -1, 0).otherwise(1).alias("label_binary"),
        F.floor(F.col("vec_id") / 50).cast("long").alias("sessionnum"),
        F.floor(F.col("vec_id") / 10).cast("long").alias("blocknum"),
        (F.col("vec_id") % 10).alias("blockpos"),
    )


def _signal(start: Column | int, length: int) -> Column:
    return F.transform(F.slice("embedding", start, length), lambda x: x.cast("double"))


def signals(embeddings: DataFrame, channels: int = 4, samples: int = 16) -> DataFrame:
    """trial_id, channel, signal: `channels` stretches of each embedding."""
    channel = F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), _signal(c * samples + 1, samples).alias("signal")) for c in range(channels)]))
    return embeddings.select(F.col("vec_id").alias("trial_id"), channel.alias("s")).select("trial_id", "s.channel", "s.signal")


def long_signals(embeddings: DataFrame) -> DataFrame:
    """trial_id, channel 0, signal: the whole embedding as one channel."""
    return embeddings.select(F.col("vec_id").alias("trial_id"), F.lit(0).alias("channel"), _signal(1, 64).alias("signal"))


def with_dead_channel(signals: DataFrame, samples: int = 16) -> DataFrame:
    """signals and a channel 4 of zeros for each trial."""
    dead = signals.where("channel = 0").select("trial_id", F.lit(4).alias("channel"), F.array_repeat(F.lit(0.0), samples).alias("signal"))
    return signals.unionByName(dead)


def wide(embeddings: DataFrame) -> DataFrame:
    """A raw row for each trial: `{channel}_{i}` columns, label columns and metadata."""
    columns = [F.col("embedding")[c * 16 + i].cast("double").alias(f"{name}_{i}") for c, name in enumerate(WIDE) for i in range(16)]
    pixels = [((F.col("vec_id") + i) % 256).cast("double").alias(f"label_imgpix_{i}") for i in range(4)]
    t = trials(embeddings)
    return embeddings.select(F.col("vec_id").alias("_id"), *columns, *pixels).join(t.select(F.col("trial_id").alias("_id"), F.col("label_digit").cast("double").alias("label"), *[F.col(c).cast("double").alias(c) for c in ("sessionnum", "blocknum", "blockpos")]), "_id").withColumnRenamed("_id", "trial_id")


def stream_rows(events: DataFrame) -> DataFrame:
    """The acquisition stream: seq, label, sessionnum, block, ts, value."""
    label = F.lit(None).cast("int")
    for name, value in LABELS.items():
        label = F.when(F.col("event_type") == name, value).otherwise(label)
    return events.select(F.col("event_id").alias("seq"), label.alias("label"), F.col("user_id").alias("sessionnum"), F.to_date("ts").alias("block"), F.col("ts").cast("timestamp").alias("ts"), "value")
