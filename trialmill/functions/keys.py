"""Random choices as hashes of keys: the same for any partitioning and any engine with md5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unit(seed: int, *keys: Column | str) -> Column:
    """A number in [0, 1) for the seed and keys."""
    text = F.concat_ws("|", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def order(seed: int, *keys: Column | str) -> Column:
    """A string to sort by in random order."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]))
