"""Sinks and fitted-parameter tables: Parquet partitioned by variant, stage, model or split."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, our own in a local session, and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for a table that stands between steps, in the shared folder, under the application's id."""
    return f"{shared_dir(spark)}/trialmill-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}/{name}"


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def clear_scratch(spark: SparkSession) -> None:
    """Deletes all scratch tables of this application. Results that aren't written elsewhere read them: call it when these are done with."""
    delete(spark, f"{shared_dir(spark)}/trialmill-{spark.sparkContext.applicationId}")


def write(df: DataFrame, path: str, by: tuple[str, ...] = (), mode: str = "append") -> DataFrame:
    """Writes whole batches and reads them back; with `by`, readers prune partitions."""
    df.write.mode(mode).partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path) if not by else df.sparkSession.read.parquet(path)


def replace_partitions(df: DataFrame, path: str, by: tuple[str, ...]) -> None:
    """Overwrites only the partitions that df has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def once(spark: SparkSession, path: str, make: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The table at path; made only if it isn't there or `force` is given."""
    if force or not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def params(spark: SparkSession, path: str) -> DataFrame:
    """Fitted parameters; an error if they were never fitted, so that nothing is fitted anew on test data."""
    if not exists(spark, path):
        raise FileNotFoundError(f"no fitted parameters at {path}")
    return spark.read.parquet(path)


def variant_tag(variant: str, fraction: float) -> str:
    """The scope of data and fitted parameters."""
    return variant if fraction >= 1 else f"{variant}_{fraction:g}"


def run_tag(variant: str, fraction: float, stage: str, model: str) -> str:
    """The scope of models and results."""
    return f"{variant_tag(variant, fraction)}/{stage}/{model}"
