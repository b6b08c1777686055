"""Exact quantiles of groups of any size, ties or not.

`percentile` holds every distinct value of a group in one task. Here a sketch
brackets each quantile's rank by two values; what lies between is counted by
value, so that equal values are one row, and running counts over ranges of
those rows find the values at the ranks. Four jobs, whatever the data; where no
group has more values than a task may hold, a count and one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import scratch, write

#: A sketch's rank is off by n / ACCURACY at most; brackets reach three times as far.
ACCURACY = 10_000


def between(rank: Column) -> Column:
    """The value at a rank, from 0, of rows (v, c, upto): values, how often each is there, and running counts. A fraction is interpolated."""
    at = lambda r: F.max(F.when((r < F.col("upto")) & (r >= F.col("upto") - F.col("c")), F.col("v")))
    low, high = at(F.floor(rank)), at(F.ceil(rank))
    return low + (high - low) * F.max(rank - F.floor(rank))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], at_once: int = 200_000) -> DataFrame:
    """keys and a column for each of probs {name: p}: linear interpolation between the two nearest ranks.

    Null and NaN values don't count; a group without values gives no row.
    at_once: values of a group that one task may hold.
    """
    spark = df.sparkSession
    own = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], F.col(value).cast("double").alias("_x"))
    rows = rows.where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    if (rows.groupBy(*own).count().agg(F.max("count")).first()[0] or 0) <= at_once:
        upto = F.sum("c").over(Window.partitionBy(*own).orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        x = rows.groupBy(*own, F.col("_x").alias("v")).agg(F.count(F.lit(1)).alias("c")).select("*", upto.alias("upto"), F.sum("c").over(Window.partitionBy(*own)).alias("n"))
        picked = x.groupBy(*own).agg(*[between(F.lit(float(p)) * (F.col("n") - 1)).alias(n) for n, p in probs.items()])
        return picked.select(*[F.col(o).alias(k) for o, k in zip(own, keys, strict=True)], *probs)
    rows = write(rows, scratch(spark, "values"))

    reach, names = 3 / ACCURACY, list(probs)
    edges = lambda sign: F.percentile_approx("_x", F.array(*[F.lit(min(max(p + sign * reach, 0.0), 1.0)) for p in probs.values()]), ACCURACY)
    groups = rows.groupBy(*own).agg(F.count(F.lit(1)).alias("n"), F.min("_x").alias("lo"), F.max("_x").alias("hi"), edges(-1).alias("los"), edges(1).alias("his"))
    whole = F.col("n") <= at_once
    bracket = lambda i, n: F.struct(F.lit(n).alias("name"), (F.lit(float(probs[n])) * (F.col("n") - 1)).alias("rank"), F.when(whole, F.col("lo")).otherwise(F.col("los")[i]).alias("lo"), F.when(whole, F.col("hi")).otherwise(F.col("his")[i]).alias("hi"))
    state = groups.select(*[F.col(o).alias(f"{o}_") for o in own], F.explode(F.array(*[bracket(i, n) for i, n in enumerate(names)])).alias("q")).select(*[f"{o}_" for o in own], "q.*")
    state = write(state, scratch(spark, "brackets"))  # small, and Spark knows its size: it picks the join

    on = F.col("_x") <= F.col("hi")
    for o in own:
        on = on & F.col(o).eqNullSafe(F.col(f"{o}_"))
    by = [*own, "name", "rank"]
    inside = F.when(F.col("_x") >= F.col("lo"), F.col("_x")).alias("v")  # null: all that is below the bracket
    counts = rows.join(state, on).groupBy(*by, inside).agg(F.count(F.lit(1)).alias("c"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    laid = write(counts.repartitionByRange(parts, *own, "name", F.col("v").asc_nulls_first()).withColumn("_part", F.spark_partition_id()), scratch(spark, "counts"))

    ahead = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = laid.groupBy("_part", *by).agg(F.sum("c").alias("s")).select(F.col("_part").alias("_p"), *[F.col(o).alias(f"{o}_") for o in own], F.col("name").alias("_n"), F.coalesce(F.sum("s").over(ahead), F.lit(0)).alias("start"))
    here = Window.partitionBy("_part", *by).orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    on = (F.col("_part") == F.col("_p")) & (F.col("name") == F.col("_n"))
    for o in own:
        on = on & F.col(o).eqNullSafe(F.col(f"{o}_"))
    run = laid.withColumn("upto", F.sum("c").over(here)).join(starts, on).withColumn("upto", F.col("upto") + F.col("start"))
    found = run.groupBy(*by).agg(between(F.col("rank")).alias("_q"))
    out = found.groupBy(*own).agg(*[F.max(F.when(F.col("name") == n, F.col("_q"))).alias(n) for n in probs])
    return out.select(*[F.col(o).alias(k) for o, k in zip(own, keys, strict=True)], *probs)
