"""Places in a global order, found without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import scratch, write


def places(df: DataFrame, keys: list[str], order: list[str], name: str = "place") -> DataFrame:
    """df with each row's place, from 0, in its key's order: rows are dealt by range, and a range starts after those before it."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    laid = write(df.repartitionByRange(n, *keys, *order).withColumn("_part", F.spark_partition_id()), scratch(df.sparkSession, "ranges"))
    counts = laid.groupBy("_part", *keys).agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", *keys, F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_start"))
    here = F.row_number().over(Window.partitionBy("_part", *keys).orderBy(*order))
    renamed = starts.select(F.col("_part").alias("_p"), *[F.col(k).alias(f"_s{i}") for i, k in enumerate(keys)], "_start")
    on = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_s{i}"))
    return laid.withColumn("_here", here).join(renamed, on).withColumn(name, F.col("_start") + F.col("_here") - 1).drop("_part", "_here", "_p", "_start", *[f"_s{i}" for i in range(len(keys))])


def with_previous(df: DataFrame, keys: list[str], order: list[str], columns: dict[str, str]) -> DataFrame:
    """df with further columns {name: column}: `column` of the row before it in its key's order, null for the first.

    Rows are dealt by range, and each looks within its own; the first of a range
    looks at the last row of the range before, of which there is one for each range. A key of any size is shared
    out, and order may have gaps. Rows that tie come in order of a hash of all their columns.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    by = [*keys, *order, "_tie"]
    laid = write(df.withColumn("_tie", F.xxhash64(*df.columns)).repartitionByRange(n, *by).withColumn("_part", F.spark_partition_id()), scratch(spark, "ranges"))
    last = laid.groupBy("_part").agg(F.max(F.struct(*by, *[F.col(c).alias(f"_v{i}") for i, c in enumerate(columns.values())])).alias("_last"))
    edges = last.select(F.col("_part").alias("_p"), F.lag("_last").over(Window.orderBy("_part")).alias("_last"))  # a row for each range
    here = Window.partitionBy("_part", *keys).orderBy(*order, "_tie")
    same: Column = F.col("_last").isNotNull()
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_last.{k}"))
    found = laid.select("*", F.row_number().over(here).alias("_n"), *[F.lag(c).over(here).alias(f"_w{i}") for i, c in enumerate(columns.values())]).join(F.broadcast(edges), F.col("_part") == F.col("_p"))
    value = lambda i: F.when(F.col("_n") > 1, F.col(f"_w{i}")).when(same, F.col(f"_last._v{i}"))
    return found.select(*df.columns, *[value(i).alias(name) for i, name in enumerate(columns)])
