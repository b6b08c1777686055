"""A dense order number for the rows of any table: two passes, and no task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import scratch, write

#: So many files' starts are sent to every task; of more, rows meet their file by a shuffle join.
FEW_FILES = 10_000


def in_file_order(spark: SparkSession, path: str, name: str = "seq") -> DataFrame:
    """The rows of the Parquet files under path, numbered from 0 without gaps, by the files' paths and each row's place in its file.

    The first pass counts each file's rows, the second adds the counts of the
    files before it to a row's place; rows aren't shuffled. One row for each
    file is sorted in one task. Files must not change between the passes. A column called `name` gives way.
    """
    rows = spark.read.parquet(path)
    placed = rows.select(*[F.col(f"`{c}`") for c in rows.columns if c != name], F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    sizes = placed.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = write(sizes.select(F.col("_file").alias("_f"), F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_start")), scratch(spark, "files"))
    starts = F.broadcast(starts) if starts.count() <= FEW_FILES else starts
    return placed.join(starts, F.col("_file") == F.col("_f")).withColumn(name, F.col("_start") + F.col("_at")).drop("_file", "_at", "_f", "_start")


def in_given_order(df: DataFrame, name: str = "seq") -> DataFrame:
    """df with its rows numbered from 0 without gaps, in the order of its partitions and of the rows in them: written once, so that both passes see the same."""
    spark = df.sparkSession
    laid = write(df.withColumn("_id", F.monotonically_increasing_id()), scratch(spark, "laid"))
    part = F.shiftright("_id", 33)
    ahead = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = laid.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    starts = write(sizes.select("_p", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_start")), scratch(spark, "partitions"))
    starts = F.broadcast(starts) if starts.count() <= FEW_FILES else starts
    at = F.col("_id") - F.shiftleft("_p", 33)  # a partition's own numbers have no gaps
    return laid.join(starts, part == F.col("_p")).withColumn(name, F.col("_start") + at).drop("_id", "_p", "_start")
