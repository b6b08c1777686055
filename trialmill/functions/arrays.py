"""Expressions on a signal array; all stay in the JVM and move no rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def abs_max(x: Column) -> Column:
    return F.array_max(F.transform(x, F.abs))


def jumps(x: Column) -> Column:
    """Differences of neighbours."""
    n = F.size(x) - 1
    return F.zip_with(F.slice(x, 2, F.greatest(n, F.lit(0))), F.slice(x, 1, F.greatest(n, F.lit(0))), lambda a, b: a - b)


def moments(x: Column) -> Column:
    """struct(n, mean, m2, m3, m4): population moments about the mean, in two folds."""
    n = F.size(x).cast("double")
    start = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("c"))

    def about(mean: Column) -> Column:
        def step(s: Column, v: Column) -> Column:
            d = v - mean
            return F.struct((s["a"] + d * d).alias("a"), (s["b"] + d * d * d).alias("b"), (s["c"] + d * d * d * d).alias("c"))

        done = lambda s: F.struct(n.alias("n"), mean.alias("mean"), (s["a"] / n).alias("m2"), (s["b"] / n).alias("m3"), (s["c"] / n).alias("m4"))
        return F.aggregate(x, start, step, done)

    # the mean is bound once, as the element of an array of one
    return F.transform(F.array(total(x) / n), about)[0]


def zero_crossings(x: Column) -> Column:
    """Share of steps at which the sign changes; a visit to exactly 0 counts as changes."""
    signs = F.transform(x, F.signum)
    changes = F.filter(jumps(signs), lambda d: d != 0)
    return F.size(changes) / (F.size(x) - 1)


def not_finite(x: Column) -> Column:
    """How many values are NaN, and how many infinite."""
    nan = F.size(F.filter(x, F.isnan))
    inf = F.size(F.filter(x, lambda v: F.abs(v) == F.lit(float("inf"))))
    return F.struct(nan.alias("n_nan"), inf.alias("n_inf"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)


def rounded(x: Column, places: int = 6) -> Column:
    """To so many places, without a negative zero."""
    return F.round(x, places) + F.lit(0.0)
