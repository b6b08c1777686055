"""Phases that are run again only if what they were made from has changed."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import store


def source_version(df: DataFrame) -> str:
    """A digest of what a table stands for: of its files' names, sizes and times and of what the plan makes of them, or, where it reads no files, of its rows in any order."""
    spark, files = df.sparkSession, sorted(df.inputFiles())
    if files:
        conf, seen = spark._jsc.hadoopConfiguration(), []
        for f in files:
            p = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(f))
            status = p.getFileSystem(conf).getFileStatus(p)
            seen.append((f, status.getLen(), status.getModificationTime()))
        return digest([seen, df._jdf.queryExecution().analyzed().canonicalized().toString()])
    rows = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)")).alias("h")).first()
    return digest([df.schema.simpleString(), rows.n, str(rows.h)])


def digest(what: Any) -> str:
    return hashlib.sha256(json.dumps(what, sort_keys=True, default=str).encode()).hexdigest()


class Manifest:
    """The phases of a run under a path, and what each was made from.

    A phase's version is a digest of its name, parameters and the versions of
    what it reads: sources, or phases before it. It is made if its table isn't there, or its recorded
    version is another. The record goes before the table is made and comes back after it, so a run that
    broke off is never taken for a whole one. A change therefore runs what depends on it again, and nothing else.
    """

    def __init__(self, spark: SparkSession, path: str, sources: dict[str, str] | None = None, force: bool = False) -> None:
        self.spark, self.path, self.force = spark, path, force
        self.versions: dict[str, str] = dict(sources or {})
        self.made: list[str] = []

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def recorded(self, name: str) -> str | None:
        at = f"{self.path}/manifest/{name}"
        return self.spark.read.parquet(at).first().version if store.exists(self.spark, f"{at}/_SUCCESS") else None

    def phase(self, name: str, make: Callable[[], DataFrame], reads: Sequence[str] = (), **parameters: Any) -> DataFrame:
        """The table of a phase; `make` gives it from what stands in `reads`, names of sources and of phases before this one."""
        inputs = {r: self.versions[r] for r in reads}
        version = self.versions[name] = digest([name, parameters, inputs])
        if self.force or self.recorded(name) != version or not store.exists(self.spark, f"{self.path}/{name}/_SUCCESS"):
            store.delete(self.spark, f"{self.path}/manifest/{name}")
            make().write.mode("overwrite").parquet(f"{self.path}/{name}")
            record = [(name, version, json.dumps(parameters, sort_keys=True, default=str), json.dumps(inputs, sort_keys=True))]
            self.spark.createDataFrame(record, "phase string, version string, parameters string, inputs string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/{name}")
            self.made.append(name)
        return self.table(name)
