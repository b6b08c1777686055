"""Arrow batches of signals: one matrix for each length in a batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType


def map_signals(df: DataFrame, fn: Callable[[np.ndarray], np.ndarray], out: str, keep: Sequence[str], column: str = "signal") -> DataFrame:
    """The columns `keep`, and `out` array<double>: fn of the signals of equal length, one row each. Null and empty signals give null."""
    schema = StructType([*df.select(*keep).schema.fields, StructField(out, ArrayType(DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            signals = b.column(len(keep))
            lengths = np.array([0 if n is None else n for n in pa.compute.list_value_length(signals).to_pylist()])
            made: list[np.ndarray | None] = [None] * len(signals)
            for n in set(lengths.tolist()) - {0}:
                rows = np.flatnonzero(lengths == n)
                x = signals.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), n)
                for i, y in zip(rows, fn(x), strict=True):
                    made[i] = y
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(made, pa.list_(pa.float64()))], names=schema.names)

    import pyarrow.compute  # noqa: F401

    return df.select(*keep, column).mapInArrow(run, schema)
