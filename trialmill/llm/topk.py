"""Exact top-k inner products with vector-approximation files.

The approximation file holds, for blocks of rows, a cell number of one byte for
each component, and a block's cell edges. A scan of a block by a block of
queries gives each row's highest and lowest possible score; only rows whose
highest isn't below the block's kth lowest stay candidates. Over all blocks, a
query's candidates are then cut at its kth highest lower bound. Exact vectors
are read of these alone, in the order of their bounds: first the `k` best, and
then those whose bound isn't below the kth exact score found. Queries and rows meet in blocks of
bounded size, and what crosses the network for them are cells, not vectors.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, save

#: Products of integers below this, summed over 4096 components, are exact in doubles.
SAFE = 1 << 20
#: Squared length of an integer vector, from which products may leave 63 bits.
LONGEST = 9e18
#: Bounds that a task holds at once.
BOUNDS = 1 << 21


def finite(vec_col: str) -> Column:
    """Whether a vector holds neither nulls nor NaN nor infinite components."""
    return F.forall(vec_col, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))


def integers(vec_col: str, scale: int) -> Column:
    """floor(scale * x) of each component, as long."""
    return F.transform(vec_col, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256, more: Sequence[str] = ()) -> DataFrame:
    """(vec_id, v array<long>, d): floor(scale * x) of each component; and the columns `more` of df.

    Without: null vectors, null ids, vectors that hold null or non-finite
    components, and vectors whose integers' squares sum to LONGEST or more. The inner product of
    two that stay is below 2**63, and so is every partial sum, so scores are exact. Rows that share an id all stay.
    """
    short = F.aggregate(vec_col, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) * F.lit(float(scale) ** 2) < F.lit(LONGEST)
    rows = df.where(F.col(vec_col).isNotNull() & F.col(id_col).isNotNull() & finite(vec_col)).where(short)
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), integers(vec_col, scale).alias("v"), *more).withColumn("d", F.size("v"))


def distinct_enough(ids: np.ndarray, v: np.ndarray, k: int) -> np.ndarray:
    """Places of the rows that can be among the k best of any query: of rows with equal vectors those of the k + 1 least ids, k of each id."""
    same = np.unique(np.ascontiguousarray(v).view(f"V{v.itemsize * v.shape[1]}").ravel(), return_inverse=True)[1].ravel() if v.shape[1] else np.zeros(len(v), int)
    order = np.lexsort((ids, same))
    same, ids = same[order], ids[order]
    at = np.arange(len(order))
    group = np.diff(same, prepend=-1) != 0
    first = group | (np.diff(ids, prepend=ids[:1]) != 0)
    number = np.cumsum(first)  # of the id, over all groups
    start = np.maximum.accumulate(np.where(group, number, 0))
    row = at - np.maximum.accumulate(np.where(first, at, 0))
    return order[(number - start <= k) & (row < k)]


def approximated(vectors: DataFrame, k: int, bits: int, block_rows: int) -> DataFrame:
    """(block, d, low, width, rows, ids, cells): the approximation file of vectors(row, vec_id, v, d), without a shuffle.

    A block holds rows of one task and dimension, without those whose equals in it
    go before them in any ranking. low and width (64-bit) are of
    each component, rows and ids (64-bit) and cells (one byte, row-major) of each row.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[pd.DataFrame]] = {}

        def block(d: int) -> pd.DataFrame:
            b = pd.concat(held.pop(d))
            v = np.stack(b.v).astype(np.int64).reshape(len(b), d)
            some = distinct_enough(b.vec_id.to_numpy(np.int64), v, k)
            b, v = b.iloc[some], v[some]
            low = v.min(axis=0)
            width = -(-(v.max(axis=0) - low + 1) // (1 << bits))
            cells = ((v - low) // width).astype(np.uint8)
            return pd.DataFrame([(int(b.row.iloc[0]), d, *[x.tobytes() for x in (low, width, b.row.to_numpy(np.int64), b.vec_id.to_numpy(np.int64), cells)])], columns=["block", "d", "low", "width", "rows", "ids", "cells"])

        for batch in batches:
            for d, b in batch.groupby("d"):
                held.setdefault(d, []).append(b)
                if sum(map(len, held[d])) >= block_rows:
                    yield block(d)
        for d in list(held):
            yield block(d)

    return vectors.mapInPandas(run, "block long, d int, low binary, width binary, rows binary, ids binary, cells binary")


def within(x: np.ndarray) -> np.ndarray:
    """Whole doubles as 64-bit integers, those beyond as the outermost; no score lies there."""
    return np.clip(x, -(2.0**63), 2.0**63 - 1024).astype(np.int64)


def candidates(queries: np.ndarray, qid: np.ndarray, low: np.ndarray, width: np.ndarray, ids: np.ndarray, cells: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(query, rows, highest, lowest possible scores) of one block: every row that can be among the query's k best of the block, its own id left out.

    With values beyond SAFE, bounds are wider by what doubles may be off.
    """
    exact = max(np.abs(queries).max(initial=0), np.abs(low).max(initial=0), np.abs(low + width * 256.0).max(initial=0)) < SAFE
    q = queries.astype(np.float64)
    edges = cells.astype(np.float64) * width + low
    rise = q * (width - 1.0)
    above, below = np.maximum(rise, 0).sum(axis=1), np.minimum(rise, 0).sum(axis=1)
    if not exact:
        off = 1 + 1e-13 * (np.abs(q) @ (np.abs(low) + 512.0 * width))
        above, below = above + off, below - off
    step = max(1, BOUNDS // max(len(ids), 1))
    for at in range(0, len(qid), step):
        base = q[at : at + step] @ edges.T
        own = ids[None, :] == qid[at : at + step, None]
        for i in range(len(base)):
            rows = np.flatnonzero(~own[i])
            score = base[i, rows]
            if len(rows) > k:
                kth = np.partition(score, len(rows) - k)[len(rows) - k]
                few = score + above[at + i] >= kth + below[at + i]
                rows, score = rows[few], score[few]
            yield at + i, rows, within(score + above[at + i]), within(score + below[at + i])


def bounded(vectors: DataFrame, queries: DataFrame, k: int, bits: int, block_rows: int, query_rows: int) -> DataFrame:
    """(qrow, query_id, row, upper): the rows that can be among each query's k best; vectors and queries have a number for each row in `row`."""
    file = save(approximated(vectors, k, bits, block_rows), "cells")
    q_blocks = max(1, -(-queries.count() // query_rows))
    blocks = file.select(F.col("block").alias("b"), F.col("d").alias("_d"))  # two numbers for each block_rows rows
    blocks = F.broadcast(blocks) if blocks.count() <= 1_000_000 else blocks
    asked = queries.withColumn("qb", F.pmod(F.xxhash64("row"), F.lit(q_blocks)).cast("int"))
    left = asked.join(blocks, F.col("d") == F.col("_d"))  # each query meets each block of its dimension: the work that is asked for
    right = file.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))

    def scan(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            d, file = int(a.d.iloc[0]), b.iloc[0]
            whole = lambda x: np.frombuffer(x, np.int64)
            rows, ids = whole(file.rows), whole(file.ids)
            found = candidates(np.stack(a.v).astype(np.int64).reshape(len(a), d), a.vec_id.to_numpy(), whole(file.low), whole(file.width), ids, np.frombuffer(file.cells, np.uint8).reshape(len(ids), d), k)
            for i, at, upper, lower in found:
                out.append(pd.DataFrame({"qrow": a.row.iloc[i], "query_id": a.vec_id.iloc[i], "row": rows[at], "upper": upper, "lower": lower}))
        return pd.concat(out) if out else pd.DataFrame({c: pd.Series([], dtype="int64") for c in ("qrow", "query_id", "row", "upper", "lower")})

    met = left.groupBy("b", "qb").cogroup(right.groupBy("block", "qb")).applyInPandas(scan, "qrow long, query_id long, row long, upper long, lower long")
    met = save(met, "bounds")
    # the kth highest lower bound over all blocks; each block has sent those of its k best
    place = F.row_number().over(Window.partitionBy("qrow").orderBy(F.desc("lower")))
    least = met.select("qrow", "lower", place.alias("_n")).where(F.col("_n") <= k).groupBy("qrow").agg(F.min("lower").alias("_least"), F.count(F.lit(1)).alias("_have")).withColumnRenamed("qrow", "_q")
    cut = met.join(least, F.col("qrow") == F.col("_q")).where((F.col("_have") < k) | (F.col("upper") >= F.col("_least")))
    out = save(cut.select("qrow", "query_id", "row", "upper"), "candidates")
    for x in (file, met):
        forget(x)
    return out


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, bits: int = 6, block_rows: int = 8192, query_rows: int = 2048) -> tuple[DataFrame, DataFrame]:
    """(query_id, rank, vec_id, score) as top_k(), and (query_id, qrow, row, score) of every exact vector read."""
    numbered = lambda df, name: save(df.withColumn("row", F.monotonically_increasing_id()), name)
    vectors, queries = numbered(vectors, "vectors"), numbered(queries, "queries")
    near = bounded(vectors, queries, k, bits, block_rows, query_rows)
    exact = vectors.select(F.col("row").alias("_row"), "vec_id", "v")
    asked = queries.select(F.col("row").alias("_qrow"), F.col("v").alias("q"))
    dot = F.aggregate(F.zip_with("q", "v", lambda a, b: a * b), F.lit(0).cast("long"), lambda s, x: s + x)

    def read(some: DataFrame) -> DataFrame:
        return some.join(exact, F.col("row") == F.col("_row")).join(asked, F.col("qrow") == F.col("_qrow")).select("query_id", "qrow", "row", "vec_id", dot.alias("score"))

    order = Window.partitionBy("qrow").orderBy(F.desc("upper"), "row")
    near = save(near.withColumn("_n", F.row_number().over(order)), "ordered")
    first = save(read(near.where(F.col("_n") <= k)), "first")
    kth = first.groupBy("qrow").agg(F.min("score").alias("_kth")).withColumnRenamed("qrow", "_q")
    rest = near.where(F.col("_n") > k).join(kth, F.col("qrow") == F.col("_q")).where(F.col("upper") >= F.col("_kth"))
    scored = save(first.unionAll(read(rest)), "scored")
    forget(near)
    forget(first)
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), scored.select("query_id", "qrow", "row", "score")


def top_k(vectors: DataFrame, queries: DataFrame, **options: int) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest inner products among rows of other ids, ties to the smaller id.

    Both inputs as integer_vectors() gives them; only vectors of as many
    components are compared. Fewer than k rows: all of them. Rows that repeat
    an id are rows like others; queries that do share one ranking. Empty: no rows.
    """
    return search(vectors, queries, **options)[0]
