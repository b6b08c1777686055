"""Embedding whitening with MLlib's block matrices.

Vectors become integers, and each distinct one counts once. The centred rows
are indexed into a BlockMatrix; its transpose times itself is the scatter,
whose partial products are spread over tasks by the inner dimension and added up.
The scatter comes to the driver (as many numbers as the square of a vector's
length), is decomposed there, and a BlockMatrix product with the whitening
matrix projects all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.order import in_given_order
from .common import forget, save
from .topk import finite, integers

#: Rows and columns of a block.
ROWS, COLUMNS = 1024, 1024
#: Rows to one matrix: MLlib numbers a matrix's rows by 32-bit integers on the way out. More rows are several matrices.
CHUNK = 1 << 30
#: A component of less than this share of the variance is noise of the arithmetic: it can't be scaled to one.
LEAST_SHARE = 1e-12
FIELDS = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


@dataclass
class Whitening:
    """What the fit list gives: its size, sums, and components by falling variance, columns of `vectors`; each one's largest entry is positive."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    identity_error: float | None = None

    @property
    def mean(self) -> list[float]:
        return [s / self.n for s in self.sums]

    def matrix(self, k: int) -> np.ndarray:
        """The whitening matrix of the first k components; a component without variance is only turned, not scaled."""
        return self.vectors[:, :k] / np.sqrt(np.where(self.sound(k), self.values[:k], 1.0))

    def sound(self, k: int) -> np.ndarray:
        return self.values[:k] > LEAST_SHARE * max(self.values.sum(), 0)

    def explained(self, k: int) -> list[float | None]:
        total = float(self.values.sum())
        return [float(max(e, 0.0)) / total if total > 0 else None for e in self.values[:k]]


def centred(rows: DataFrame, sums: list[int], n: int) -> DataFrame:
    """(number, x): the vectors v less sums / n."""
    mean = F.lit([s / n for s in sums])
    return rows.select("number", F.zip_with("v", mean, lambda a, m: a - m).alias("x"))


def matrices(rows: DataFrame, n: int, d: int, chunk: int = CHUNK) -> list[BlockMatrix]:
    """rows(number, x), numbered densely below n, as block matrices of `chunk` rows at most."""
    out = []
    for low in range(0, n, chunk):
        some = rows.where((F.col("number") >= low) & (F.col("number") < low + chunk)) if n > chunk else rows
        indexed = MLUtils.convertVectorColumnsFromML(some.select((F.col("number") - low).alias("index"), array_to_vector("x").alias("vector")), "vector")
        out.append(IndexedRowMatrix(indexed, min(chunk, n - low), d).toBlockMatrix(ROWS, min(COLUMNS, d)))
    return out


def product(a: BlockMatrix, b: BlockMatrix, splits: int) -> BlockMatrix:
    """a times b, partial products dealt over so many parts of the inner dimension: PySpark's own multiply() has no such argument."""
    return BlockMatrix(a._java_matrix_wrapper.call("multiply", b._java_matrix_wrapper._java_model, splits), a.rowsPerBlock, b.colsPerBlock)


def scatter(parts: list[BlockMatrix], d: int) -> np.ndarray:
    """The sum over rows of x x': a small matrix, on the driver."""
    out = np.zeros((d, d))
    for m in parts:
        out += product(m.transpose(), m, max(1, -(-m.numRows() // ROWS))).toLocalMatrix().toArray()
    return (out + out.T) / 2


def small_matrix(spark: SparkSession, m: np.ndarray) -> BlockMatrix:
    """A matrix of the driver's, its rows blocked as columns of the large ones are."""
    rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], "index long, x array<double>")
    indexed = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector("x").alias("vector")), "vector")
    return IndexedRowMatrix(indexed, *m.shape).toBlockMatrix(min(COLUMNS, m.shape[0]), m.shape[1])


def sums_of(vectors: DataFrame, d: int) -> list[int]:
    """The exact sum of each component, of whatever size."""
    at = vectors.select(F.posexplode("v").alias("i", "c")).groupBy("i").agg(F.sum(F.col("c").cast("decimal(38,0)")).alias("s")).collect()
    found = {r.i: int(r.s) for r in at}
    return [found[i] for i in range(d)]


def fit(vectors: DataFrame, d: int, k: int = 4, chunk: int = CHUNK) -> Whitening | None:
    """The whitening of vectors(v array<long>) of d components each, every distinct vector counted once; None without vectors.

    identity_error: the largest absolute entry of the covariance of the first k
    whitened components over the fit list, less the identity; components without variance don't count.
    """
    spark = vectors.sparkSession
    kept = save(vectors.select("v").distinct(), "distinct")
    listed = in_given_order(kept, "number")
    n = kept.count()
    if not n or not d:
        return None
    sums = sums_of(kept, d)
    parts = matrices(centred(listed, sums, n), n, d, chunk)
    values, turned = np.linalg.eigh(scatter(parts, d) / n)
    values, turned = values[::-1], turned[:, ::-1]
    turned = turned * np.sign(turned[np.abs(turned).argmax(axis=0), np.arange(d)])
    out = Whitening(n, sums, values, turned)
    k = min(k, d)
    good = out.sound(k)
    if good.any():
        white = small_matrix(spark, out.matrix(k)[:, good])
        again = sum(scatter([product(m, white, 1)], int(good.sum())) for m in parts) / n
        out.identity_error = float(np.abs(again - np.eye(int(good.sum()))).max())
    forget(kept)
    return out


def projected(rows: DataFrame, model: Whitening, count: int, k: int, chunk: int = CHUNK) -> DataFrame:
    """(number, y): the first k whitened components of rows(number, v), numbered densely below count."""
    spark = rows.sparkSession
    d = len(model.sums)
    white, out = small_matrix(spark, model.matrix(k)), None
    for i, m in enumerate(matrices(centred(rows, model.sums, model.n), count, d, chunk)):
        back = callMLlibFunc("getIndexedRows", product(m, white, 1)._java_matrix_wrapper.call("toIndexedRowMatrix"))
        part = back.select((F.col("index") + i * chunk).alias("_number"), vector_to_array("vector").alias("y"))
        out = part if out is None else out.unionAll(part)
    return out


def deviation(v: str, model: Whitening) -> Column:
    """Sum over components of (n * x - S)**2, exact: decimal(38,0), null beyond that."""
    wide = "decimal(38,0)"
    most = (2**63 - 1 - max(abs(s) for s in model.sums)) // model.n
    if most <= 0:
        return F.lit(None).cast(wide)
    far = F.zip_with(v, F.lit(model.sums), lambda x, s: x * F.lit(model.n).cast("long") - s.cast("long"))
    safe = F.forall(v, lambda x: F.abs(x) <= F.lit(most))  # else even the difference leaves a long
    square = lambda x: F.try_multiply(x.cast(wide), x.cast(wide))
    total = F.aggregate(F.transform(far, square), F.lit(0).cast(wide), lambda a, b: F.try_add(a, b).cast(wide))
    return F.when(safe, total)


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256, k: int = 4, chunk: int = CHUNK) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each row of df that takes part, and for each of its first k components.

    Left out: null vectors, vectors with null or non-finite components, or
    with one that no long holds when scaled; empty vectors have no component and give no row. Rows without an id stay,
    and rows that repeat an id or a vector give as many rows. Vectors of
    each length are whitened apart, one length after the other; n is that length's. A component without variance has
    `whitened` null (one vector alone has no other kind: explained is null too).
    Further columns of df don't matter. An empty table gives no rows.
    """
    spark = df.sparkSession
    ok = finite(vec_col) & F.forall(vec_col, lambda x: F.abs(x.cast("double") * scale) < F.lit(2.0**62))
    rows = df.where(F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & ok).select(F.col(id_col).cast("long").alias("vec_id"), integers(vec_col, scale).alias("v"))
    listed = save(in_given_order(rows, "number"), "rows")
    lengths = sorted(r.d for r in listed.groupBy(F.size("v").alias("d")).count().collect())
    out = spark.createDataFrame([], FIELDS)
    for d in lengths:
        own = listed if len(lengths) == 1 else in_given_order(listed.where(F.size("v") == d).drop("number"), "number")
        model, few = fit(own, d, k, chunk), min(k, d)
        found = projected(own, model, own.count(), few, chunk)
        good, share = model.sound(few).tolist(), model.explained(few)
        parts = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("component"), (F.col("y")[i] if good[i] else F.lit(None).cast("double")).alias("whitened"), F.lit(share[i]).cast("double").alias("explained")) for i in range(few)]))
        joined = own.withColumn("deviation", deviation("v", model)).select("number", "vec_id", "deviation").join(found, F.col("number") == F.col("_number"))
        each = joined.select("vec_id", "deviation", parts.alias("p"))
        each = each.select("vec_id", "p.component", F.lit(model.n).cast("long").alias("n"), "deviation", "p.whitened", "p.explained", F.lit(model.identity_error).cast("double").alias("identity_error"))
        out = out.unionAll(each) if len(lengths) > 1 else each
    return out
