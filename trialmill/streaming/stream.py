"""Acquisition and flagging of streams of files."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import artifacts, robust
from ..operators.acquire import capped
from ..sources.store import exists, scratch

def read_rows(spark: SparkSession, path: str, schema: str, files_at_once: int | None = None) -> DataFrame:
    """A stream of the Parquet files under a path or glob, so many to a batch: all that there are, or files_at_once."""
    reader = spark.readStream.schema(schema)
    return (reader if files_at_once is None else reader.option("maxFilesPerTrigger", files_at_once)).parquet(path)


def drain(stream: DataFrame, name: str, at: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Runs a stream over what there is, into Parquet, and reads the result.

    at: a folder; a later call with the same one goes on from there, with what has come since. by: columns that part the result.
    """
    spark = stream.sparkSession
    out = at or scratch(spark, name)
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").partitionBy(*by).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


class _Full(Exception):
    """All classes are full: the batch at hand isn't wanted."""


def drain_capped(stream: DataFrame, cap: int, name: str = "capped", classes: Collection[int] | None = None, at: str | None = None) -> DataFrame:
    """Pairs of a stream, the first `cap` of each class: each batch's pairs compete with those stored before.

    The cap holds over all sessions. A batch is written under its own number, so
    a batch that is run again after a failure replaces itself. With `classes`, the query ends with the
    batch in which the last of them fills: later files aren't read, as of the first one's batch nothing is committed. at: as in drain().
    """
    spark = stream.sparkSession
    out = at or scratch(spark, name)
    columns = stream.columns
    ended: list[int] = []

    def stored(below: int | None = None) -> DataFrame:
        if not exists(spark, out):
            return spark.createDataFrame([], "label int, _had long")
        before = spark.read.parquet(out)
        before = before if below is None else before.where(F.col("batch") < below)
        return before.groupBy("label").agg(F.count(F.lit(1)).alias("_had"))  # a row for each class

    def full(below: int | None = None) -> bool:
        return classes is not None and stored(below).where(F.col("label").isin(list(classes)) & (F.col("_had") >= cap)).count() == len(set(classes))

    def store(batch: DataFrame, number: int) -> None:
        if full(number):
            ended.append(number)
            raise _Full(f"all classes have {cap} pairs before batch {number}")
        new = capped(batch, cap).join(F.broadcast(stored(number)), "label", "left")
        kept = new.where(F.col("taken") + F.coalesce("_had", F.lit(0)) <= cap).select(*columns)
        kept.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.foreachBatch(store).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except StreamingQueryException:
        if not ended:
            raise
    return spark.read.parquet(out).select(*columns)


def flags(signals: DataFrame, params: DataFrame, bad: DataFrame, limits: DataFrame) -> DataFrame:
    """Flags of arriving signals by fitted parameters: stateless joins of the stream with small tables."""
    return artifacts.flags(artifacts.metrics(robust.normalize(robust.exclude(signals, bad), params)), limits)
