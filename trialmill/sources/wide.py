"""Wide rows to signals: column roles, channel names and long form."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METADATA = {"trial_id", "sessionnum", "blocknum", "blockpos", "timestamp"}
SIGNAL = re.compile(r"^(.+)_(\d+)$")


def role_of(column: str) -> str:
    """image for pixels, label, metadata, signal for `{channel}_{i}`; anything else is metadata."""
    if column.startswith("label_imgpix"):
        return "image"
    if column.startswith("label"):
        return "label"
    return "metadata" if column in METADATA or not SIGNAL.match(column) else "signal"


def channel_names(columns: Sequence[str]) -> list[str]:
    """Distinct channel names in lexicographic order."""
    return sorted({SIGNAL.match(c)[1] for c in columns if role_of(c) == "signal"})


def by_channel(columns: Sequence[str]) -> dict[str, list[str]]:
    """The signal columns of each channel, in sample order."""
    return {name: sorted((c for c in columns if role_of(c) == "signal" and SIGNAL.match(c)[1] == name), key=lambda c: int(SIGNAL.match(c)[2])) for name in channel_names(columns)}


def to_signals(wide: DataFrame) -> DataFrame:
    """trial_id, channel (place in lexicographic order), name, signal: each row makes its own arrays, nothing is shuffled."""
    parts = [F.struct(F.lit(i).alias("channel"), F.lit(name).alias("name"), F.array(*[F.col(f"`{c}`").cast("double") for c in columns]).alias("signal")) for i, (name, columns) in enumerate(by_channel(wide.columns).items())]
    return wide.select("trial_id", F.explode(F.array(*parts)).alias("s")).select("trial_id", "s.*")


def unpivoted(wide: DataFrame) -> DataFrame:
    """trial_id, column, value of every column that isn't the id."""
    columns = [c for c in wide.columns if c != "trial_id"]
    return wide.unpivot("trial_id", [F.col(f"`{c}`") for c in columns], "column", "value")


def text_signals(spark: SparkSession, path: str, channels: Sequence[str] | None = None, sep: str = ",") -> DataFrame:
    """A delimited file with a header and tens of thousands of columns, as trial rows of arrays.

    The header alone is parsed on the driver; a row stays one array until its channels' stretches
    are cut out, so the plan has as many columns as there are roles, not values.
    """
    lines = spark.read.text(path)
    header = lines.first()[0].split(sep)
    places = {name: [header.index(c) for c in columns] for name, columns in by_channel(header).items() if channels is None or name in channels}
    cells = F.split("value", re.escape(sep))
    rows = lines.where(F.col("value") != sep.join(header)).withColumn("cells", cells)
    other = [F.element_at("cells", i + 1).alias(c) for i, c in enumerate(header) if role_of(c) in ("label", "metadata")]

    def stretch(at: list[int]):
        if at == list(range(at[0], at[0] + len(at))):
            return F.transform(F.slice("cells", at[0] + 1, len(at)), lambda x: x.cast("double"))
        return F.transform(F.array(*[F.lit(i + 1) for i in at]), lambda i: F.element_at(F.col("cells"), i).cast("double"))

    parts = [F.struct(F.lit(i).alias("channel"), F.lit(name).alias("name"), stretch(at).alias("signal")) for i, (name, at) in enumerate(sorted(places.items()))]
    return rows.select(*other, F.explode(F.array(*parts)).alias("s")).select(*[c for c in header if role_of(c) in ("label", "metadata")], "s.*")
