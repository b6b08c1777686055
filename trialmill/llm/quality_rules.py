"""Robust multivariate outliers among document statistics.

Each document becomes a vector of transformed statistics. For each language
and source the minimum-covariance-determinant estimate is found by C-steps
over all rows: distances to the current centre, then mean and covariance of
the nearest `keep_share` of the rows, until the determinants settle. Rows enter
a C-step as sums for each group, start and distance cell, so a group of any size
costs a few hundred rows of shuffle; of the cell that holds the last of the
nearest rows, the fraction that is needed counts.

Every language and source has an estimate of its own, whatever its size. It is
shrunk towards that of its language, and that towards the estimate over all
rows, with the weight that `borrow` rows would have: next to nothing in a group
of thousands, most of it in a group of ten.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORDS, forget, map_text, save

SYMBOLS = "#*$%&|<>"
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_marks", "n_lines", "n_same_next"]
FEATURES = ["f_word_length", "f_symbols", "f_dup_lines", "f_repeats", "f_upper", "f_marks", "f_same_next"]
#: Spread below which a feature's deviations are taken as noise of short texts.
FLOORS = [0.06, 0.05, 0.05, 0.06, 0.05, 0.05, 0.05]
CELL = 16  # distance cells to a factor of two
FEW = 16  # rows, about, of a random start


def kind_of(char: str) -> int:
    """1 upper-case letter, 2 other letter, 3 digit, 0 anything else."""
    return 1 if char.isupper() else 2 if char.isalpha() else 3 if char.isalnum() else 0


#: Kinds of the code points below 65536; the others are looked up as they come.
KINDS = np.array([kind_of(chr(i)) for i in range(1 << 16)], np.int8)


def kind_counts(text: str) -> tuple[int, int, int]:
    """How many code points are upper-case letters, other letters, digits."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    high = points > 0xFFFF
    counts = np.bincount(KINDS[points[~high]], minlength=4)
    if high.any():
        for point, n in zip(*np.unique(points[high], return_counts=True), strict=True):
            counts[kind_of(chr(point))] += n
    return int(counts[1]), int(counts[2]), int(counts[3])


def text_stats(text: str | None) -> tuple[int, ...]:
    """STATS of a whole text; null counts as empty.

    A line is repeated if an equal line with a word stands before it. A word is
    repeated if it is in a five-word window that the text holds twice or more.
    """
    text = text or ""
    words = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        often, end = Counter(windows), 0
        for i, w in enumerate(windows):
            if often[w] > 1:
                repeated += i + 5 - max(end, i)
                end = i + 5
    upper, lower, digits = kind_counts(text)
    chars = sum(map(len, words))
    same = sum(map(str.__eq__, words, words[1:]))
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated, upper, upper + lower, chars - upper - lower - digits, len(lines), same


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and STATS, a row for each row of docs."""

    return map_text(docs, ["doc_id", "lang", "source"], lambda texts: list(zip(*map(text_stats, texts), strict=True)) or [[]] * len(STATS), ", ".join(f"{s} long" for s in STATS))


def transformed() -> list[Column]:
    """FEATURES of STATS: shares, shrunk towards their usual value in short texts, on a root or log scale."""
    n = F.col("n_words").cast("double")
    share = lambda c, of=n, usual=0.0, weight=20.0: (F.col(c) + F.lit(usual * weight)) / (of + F.lit(weight))
    root = lambda x: F.sqrt(F.greatest(x, F.lit(0.0)))
    columns = [
        F.log((F.col("word_chars") + F.lit(100.0)) / (n + F.lit(20.0))),
        root(share("n_symbols")),
        share("n_dup_lines", F.col("n_lines").cast("double"), 0.0, 4.0),
        share("n_repeat_words"),
        root(share("n_upper", F.col("n_letters").cast("double"), 0.03, 100.0)),
        root(share("n_marks", usual=0.2)),
        share("n_same_next"),
    ]
    return [c.alias(name) for c, name in zip(columns, FEATURES, strict=True)]


def chi2_cdf(x: float, k: int) -> float:
    """Wilson and Hilferty's approximation."""
    z = ((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
    return 0.5 * math.erfc(-z / math.sqrt(2))


def chi2_quantile(p: float, k: int) -> float:
    lo, hi = 0.0, 1e4
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, k) < p else (lo, mid)
    return lo


def _estimate(sums: np.ndarray, h: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Mean, covariance and its log determinant from the nearest h rows of cells (in order; count, sums, sums of products).

    The squares of FLOORS are added to the covariance: none is singular.
    """
    d = len(FEATURES)
    upto = np.cumsum(sums[:, 0])
    part = np.clip((h - (upto - sums[:, 0])) / sums[:, 0], 0, 1)  # of each cell, the fraction among the nearest
    near = part @ sums
    mean = near[1 : 1 + d] / near[0]
    cov = np.zeros((d, d))
    cov[np.triu_indices(d)] = near[1 + d :] / near[0]
    cov = cov + cov.T - np.diag(np.diag(cov)) - np.outer(mean, mean) + np.diag(np.square(FLOORS))
    return mean, cov, float(np.linalg.slogdet(cov)[1])


def _root(cov: np.ndarray) -> np.ndarray:
    """Inverse Cholesky root: root times deviation has unit spread."""
    return np.linalg.inv(np.linalg.cholesky(cov))


def _shrunk(rows: float, own: tuple[np.ndarray, np.ndarray], wider: tuple[np.ndarray, np.ndarray], borrow: float) -> tuple[np.ndarray, np.ndarray]:
    """Centre and covariance of rows and of `borrow` rows of the wider group."""
    w = rows / (rows + borrow)
    return w * own[0] + (1 - w) * wider[0], w * own[1] + (1 - w) * wider[1]


def mcd(stats: DataFrame, keys: tuple[str, str] = ("lang", "source"), keep_share: float = 0.75, borrow: float = 50, starts: int = 3, most_steps: int = 20, settled: float = 0.01, seed: int = 42) -> DataFrame:
    """keys, rows, centre array<double>, root array<double> (row-major; root times deviation has unit spread): one row for each group.

    Estimates are made over all rows, for each first key and for each pair of
    keys. Starts: the whole group's mean and covariance, its medians with FLOORS as
    spreads, and `starts` means and covariances of about FEW rows chosen by a hash. After two
    C-steps the two of least determinant go on, until no determinant changes by more
    than a factor of 1 + settled, or for most_steps. Of these the least wins. A pair's
    estimate is then shrunk towards its first key's, and that towards the common one, by `borrow` rows.
    """
    d = len(FEATURES)
    rows = stats.select(*[F.col(k).cast("string").alias(f"_g{i}") for i, k in enumerate(keys)], *transformed())
    level = F.explode(F.array(*[F.struct(F.lit(i).alias("_level"), *[(F.col(f"_g{k}") if k < i else F.lit(None).cast("string")).alias(f"_k{k}") for k in (0, 1)]) for i in range(3)])).alias("g")
    rows = save(rows.select("*", F.xxhash64("_g0", "_g1", *FEATURES).alias("_h")), "vectors")
    leveled = rows.select(level, "_h", *FEATURES).select("g.*", "_h", *FEATURES)
    groups = ["_level", "_k0", "_k1"]
    moments = F.array(F.count(F.lit(1)).cast("double"), *[F.sum(f) for f in FEATURES], *[F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])) for i in range(d) for j in range(i, d)])
    fitted = "_level int, _k0 string, _k1 string, start int, rows long, logdet double, centre array<double>, cov array<double>, root array<double>"

    def fit(cells: DataFrame, share: float) -> DataFrame:
        """One row for each group and start, from its few hundred cells."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = []
                for cells in b.cells:
                    sums = np.array([c["sums"] for c in cells])[np.argsort([c["cell"] for c in cells])]
                    n = sums[:, 0].sum()
                    mean, cov, logdet = _estimate(sums, share * n)
                    out.append((int(n), logdet, mean, cov.ravel(), _root(cov).ravel()))
                yield pd.concat([b.drop(columns="cells"), pd.DataFrame(out, columns=["rows", "logdet", "centre", "cov", "root"])], axis=1)

        return cells.groupBy(*groups, "start").agg(F.collect_list(F.struct("cell", "sums")).alias("cells")).mapInPandas(run, fitted)

    def step(now: DataFrame) -> DataFrame:
        cell = F.floor(F.log2(F.greatest(_distance2(), F.lit(1e-9))) * CELL / 2).cast("int")
        cells = _with(leveled, now, groups).withColumn("cell", cell).groupBy(*groups, "start", "cell").agg(moments.alias("sums"))
        return save(fit(cells, keep_share), "step")

    first = fit(leveled.groupBy(*groups).agg(moments.alias("sums")).withColumns({"cell": F.lit(0), "start": F.lit(0)}), 1.0)
    unit = F.array(*[F.lit(1.0 / FLOORS[i] if i == j else 0.0) for i in range(d) for j in range(d)])
    medians = leveled.groupBy(*groups).agg(F.count(F.lit(1)).alias("rows"), *[F.percentile_approx(f, 0.5, 100).alias(f) for f in FEATURES])
    second = medians.select(*groups, F.lit(1).alias("start"), "rows", F.lit(0.0).alias("logdet"), F.array(*FEATURES).alias("centre"), unit.alias("cov"), unit.alias("root"))
    now = save(first.unionByName(second), "starts")
    sizes = now.where("start = 0").select(*[F.col(g).alias(f"_s{i}") for i, g in enumerate(groups)], "rows")
    chance = [F.pmod(F.xxhash64("_h", F.lit(seed + s)), F.lit(1 << 40)) / F.lit(float(1 << 40)) * F.col("rows") < FEW for s in range(starts)]
    drawn = leveled.join(F.broadcast(sizes) if sizes.count() <= 20_000 else sizes, _same(groups, "_s"))
    drawn = drawn.withColumn("start", F.explode(F.filter(F.array(*[F.when(c, F.lit(s + 2)) for s, c in enumerate(chance)]), lambda x: x.isNotNull())))
    random = fit(drawn.groupBy(*groups, "start").agg(moments.alias("sums")).withColumn("cell", F.lit(0)), 1.0)
    before, now = now, save(now.unionByName(random), "starts")
    forget(before)
    least = Window.partitionBy(*groups).orderBy("logdet", "start")
    for i in range(most_steps):
        before, now = now, step(now)
        if i == 1:
            both, now = now, save(now.withColumn("_r", F.row_number().over(least)).where("_r <= 2").drop("_r"), "best")
            forget(both)
        elif i > 1:
            was = before.select(*[F.col(g).alias(f"_s{i}") for i, g in enumerate(groups)], F.col("start").alias("_start"), F.col("logdet").alias("_was"))
            change = now.join(was, _same(groups, "_s") & (F.col("start") == F.col("_start"))).agg(F.max(F.abs(F.col("logdet") - F.col("_was")))).first()[0]
        forget(before)
        if i > 1 and (change is None or change <= math.log1p(settled)):
            break
    best = now.withColumn("_r", F.row_number().over(least)).where("_r = 1").select(*groups, "rows", "centre", "cov")
    estimate = F.struct("rows", "centre", "cov")
    common = best.where("_level = 0").select(estimate.alias("c0"))
    wide = best.where("_level = 1").select(F.col("_k0").alias("_w"), estimate.alias("c1"))
    own = best.where("_level = 2").select("_k0", "_k1", estimate.alias("c2")).join(wide, F.col("_k0").eqNullSafe(F.col("_w"))).crossJoin(F.broadcast(common))  # one row

    def shrink(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for levels in zip(b.c0, b.c1, b.c2, strict=True):
                centre, cov = None, None
                for c in levels:
                    mine = np.asarray(c["centre"]), np.asarray(c["cov"]).reshape(d, d)
                    centre, cov = mine if centre is None else _shrunk(c["rows"], mine, (centre, cov), borrow)
                out.append((levels[2]["rows"], centre, _root(cov).ravel()))
            yield pd.concat([b[["_k0", "_k1"]], pd.DataFrame(out, columns=["rows", "centre", "root"])], axis=1)

    out = save(own.mapInPandas(shrink, "_k0 string, _k1 string, rows long, centre array<double>, root array<double>"), "mcd")
    for x in (rows, now):
        forget(x)
    return out.select(F.col("_k0").alias(keys[0]), F.col("_k1").alias(keys[1]), "rows", "centre", "root")


def _same(keys: list[str], prefix: str) -> Column:
    """Each key equals the column of that prefix and its number, nulls alike."""
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"{prefix}{i}"))
    return on


def _with(rows: DataFrame, params: DataFrame, keys: list[str]) -> DataFrame:
    """Rows beside their group's parameters; a broadcast only of a counted, small table."""
    params = params.select(*[F.col(k).alias(f"_s{i}") for i, k in enumerate(keys)], "start", "centre", "root")
    return rows.join(F.broadcast(params) if params.count() <= 20_000 else params, _same(keys, "_s"))


def _distance2() -> Column:
    """The squared Mahalanobis distance: the sum of squares of root times deviation."""
    d, total = len(FEATURES), F.lit(0.0)
    for i in range(d):
        part = F.lit(0.0)
        for j in range(i + 1):  # root is lower triangular
            part = part + F.col("root")[i * d + j] * (F.col(FEATURES[j]) - F.col("centre")[j])
        total = total + part * part
    return total


def judge(docs: DataFrame, keep_share: float = 0.75, tail: float = 1e-4, stretch: float = 1.6, min_words: int = 10, max_repeat: int = 20) -> DataFrame:
    """doc_id, STATS, base_failed, distance, kept: a row for each row of docs(doc_id, text, lang, source).

    base_failed: fewer than min_words words, or more than max_repeat percent of
    them in repeated five-word windows. kept: not base_failed, and a robust
    distance of at most stretch times the root of the chi-squared quantile at
    1 - tail, after the usual correction for the share that the estimate keeps.
    Null text counts as empty (base_failed); null languages and sources form
    groups of their own; repeated rows get equal verdicts; no rows, no rows.
    """
    stats = save(statistics(docs), "stats")
    d = len(FEATURES)
    params = mcd(stats.where("n_words > 0"), keep_share=keep_share)
    shrunk = keep_share / chi2_cdf(chi2_quantile(keep_share, d), d + 2)  # covariances of the nearest share are too small by this
    limit = stretch**2 * chi2_quantile(1 - tail, d) * shrunk
    x = stats.select("*", *transformed())
    params = params.select(F.col("lang").alias("_s0"), F.col("source").alias("_s1"), "centre", "root")
    x = x.join(F.broadcast(params) if params.count() <= 20_000 else params, _same(["lang", "source"], "_s"), "left")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    return x.withColumn("distance", F.sqrt(_distance2())).select("doc_id", *STATS, failed.alias("base_failed"), "distance", (~failed & F.coalesce(F.col("distance") <= F.lit(math.sqrt(limit)), F.lit(False))).alias("kept"))
