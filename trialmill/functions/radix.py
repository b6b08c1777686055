"""Exact quantiles of samples that lie in arrays or columns, without a row for each sample.

A double's bits, read as a whole number of the same order, are fixed from the
highest down: each pass counts, inside the arrays, how many samples of a group share the
bits fixed so far and go on with which next ones, and the counts tell in which
bucket a rank lies. Some thousand counters of a group and rank are what a task sends. Once a bucket holds
few samples, the next pass counts its values themselves. Five passes at most, three as a rule; ties, of whatever size, are one
counter. NaN and null samples don't count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from math import ceil, floor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits that a pass fixes: a thirteenth power of two counters of a bucket at most. The first has the sign and the exponent.
FIRST, NEXT = 12, 13
#: Samples of a bucket whose values a task may count one by one.
FEW = 100_000
Samples = Callable[[pa.RecordBatch], Iterable[tuple[str, np.ndarray]]]


def ordered(x: np.ndarray) -> np.ndarray:
    """Doubles as unsigned numbers of the same order; both zeros are one."""
    u = (x + 0.0).view("u8")
    return np.where(u >> np.uint64(63) == 1, ~u, u | np.uint64(1 << 63))


def value_of(u: int) -> float:
    bits = u & ((1 << 63) - 1) if u >> 63 else ~u & ((1 << 64) - 1)
    return float(np.array([bits], "u8").view("f8")[0])


@dataclass
class Target:
    """A rank of a group: the bits fixed so far, and its place among the samples that share them."""

    group: str
    rank: int
    bits: int = 0
    fixed: int = 0
    place: int = 0
    inside: int = 0  # samples that share the bits

    @property
    def width(self) -> int:
        left = 64 - self.fixed
        return left if self.inside <= FEW else min(NEXT, left)


def counted(df: DataFrame, samples: Samples, wanted: dict[str, list[tuple[int, int, int]]] | None) -> DataFrame:
    """(grp, bits, fixed, bucket, n): samples of each group and bucket; wanted: (bits, fixed, width) of each group, None for the first pass over all groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        dense: dict[tuple, np.ndarray] = {}
        loose: dict[tuple, list[np.ndarray]] = {}
        for b in batches:
            for group, x in samples(b):
                x = x[~np.isnan(x)]
                if not len(x):
                    continue
                u = ordered(x)
                for bits, fixed, width in [(0, 0, FIRST)] if wanted is None else wanted.get(group, []):
                    some = u if fixed == 0 else u[(u >> np.uint64(64 - fixed)) == bits]
                    if not len(some):
                        continue
                    at = (some >> np.uint64(64 - fixed - width)) & np.uint64((1 << width) - 1)
                    key = (group, bits, fixed)
                    if width <= NEXT:
                        n = np.bincount(at.astype(np.int64), minlength=1 << width)
                        dense[key] = dense[key] + n if key in dense else n
                    else:
                        loose.setdefault(key, []).append(at.astype(np.int64))
        rows = lambda key, bucket, n: pd.DataFrame({"grp": key[0], "bits": np.full(len(n), key[1]).astype("u8").view("i8"), "fixed": key[2], "bucket": bucket, "n": n})
        for key, n in dense.items():
            some = np.flatnonzero(n)
            yield rows(key, some, n[some])
        for key, parts in loose.items():
            yield rows(key, *np.unique(np.concatenate(parts), return_counts=True))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("grp", pa.string()), ("bits", pa.int64()), ("fixed", pa.int32()), ("bucket", pa.int64()), ("n", pa.int64())])
        for rows in run(batches):
            yield pa.RecordBatch.from_pandas(rows, kinds, preserve_index=False)

    return df.mapInArrow(packed, "grp string, bits long, fixed int, bucket long, n long").groupBy("grp", "bits", "fixed", "bucket").agg(F.sum("n").alias("n"))


def located(counts: DataFrame, ranks: DataFrame | None, probs: list[float]) -> list:
    """The buckets in which ranks lie, with the samples before each and in it, and of the whole group: a few rows for each group."""
    by = ["grp", "bits", "fixed"]
    own = Window.partitionBy(*by)
    x = counts.select("*", (F.sum("n").over(own.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"), F.sum("n").over(own).alias("all"))
    inside = lambda rank: (F.col("before") <= rank) & (rank < F.col("before") + F.col("n"))
    if ranks is None:
        hit: Column = F.lit(False)
        for p in probs:
            at = F.lit(float(p)) * (F.col("all") - 1)
            hit = hit | inside(F.floor(at)) | inside(F.ceil(at))
        return x.where(hit).select("grp", "bucket", "n", "before", "all").collect()
    return x.join(F.broadcast(ranks), by).where(inside(F.col("place"))).select(*by, "place", "bucket", "n", "before").distinct().collect()


def quantiles(df: DataFrame, samples: Samples, probs: dict[str, float]) -> dict[str, dict[str, float]]:
    """Of each group, each of probs {name: p}: linear interpolation between the two nearest ranks; groups without samples are left out.

    samples gives (group, doubles) of an Arrow batch of df, as often as it likes.
    Groups are few: some rows for each come to the driver.
    """
    spark = df.sparkSession
    sizes: dict[str, int] = {}
    first: dict[str, list] = {}
    for r in located(counted(df, samples, None), None, list(probs.values())):
        sizes[r.grp] = r["all"]
        first.setdefault(r.grp, []).append(r)
    targets: dict[tuple[str, int], Target] = {}
    for group, n in sizes.items():
        for p in probs.values():
            for rank in (floor(p * (n - 1)), ceil(p * (n - 1))):
                r = next(r for r in first[group] if r.before <= rank < r.before + r.n)
                targets[group, rank] = Target(group, rank, r.bucket, FIRST, rank - r.before, r.n)
    while left := [t for t in targets.values() if t.fixed < 64]:
        wanted: dict[str, set[tuple[int, int, int]]] = {}
        for t in left:
            wanted.setdefault(t.group, set()).add((t.bits, t.fixed, t.width))
        signed = lambda u: u - (1 << 64) if u >> 63 else u
        ranks = spark.createDataFrame(sorted({(t.group, signed(t.bits), t.fixed, t.place) for t in left}), "grp string, bits long, fixed int, place long")
        found = {(r.grp, r.bits, r.fixed, r.place): r for r in located(counted(df, samples, {g: sorted(w) for g, w in wanted.items()}), ranks, [])}
        for t in left:
            r, width = found[t.group, signed(t.bits), t.fixed, t.place], t.width
            t.bits, t.fixed, t.place, t.inside = t.bits << width | r.bucket, t.fixed + width, t.place - r.before, r.n
    out: dict[str, dict[str, float]] = {}
    for group, n in sizes.items():
        at = lambda rank: value_of(targets[group, rank].bits)  # noqa: B023, E731
        for name, p in probs.items():
            low, high = at(floor(p * (n - 1))), at(ceil(p * (n - 1)))
            share = p * (n - 1) - floor(p * (n - 1))
            out.setdefault(group, {})[name] = low + (high - low) * share if share else low
    return out


def of_arrays(group: str = "channel", column: str = "signal") -> Samples:
    """Samples of rows (group, array of doubles)."""

    def samples(b: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
        import pyarrow.compute as pc

        keys = b.column(b.schema.get_field_index(group))
        arrays = b.column(b.schema.get_field_index(column))
        for key in pc.unique(keys):
            some = arrays.filter(pc.equal(keys, key)) if key.is_valid else arrays.filter(pc.is_null(keys))
            yield str(key.as_py()), some.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)

    return samples


def of_columns(columns: list[str]) -> Samples:
    """Samples of several columns of doubles, each a group of its own."""

    def samples(b: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
        for c in columns:
            yield c, b.column(b.schema.get_field_index(c)).cast(pa.float64()).to_numpy(zero_copy_only=False)

    return samples
