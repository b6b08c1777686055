"""Forests grown to purity: the tops of trees are Spark's, and what lies below their leaves is grown in parallel tasks.

Spark's trees are held by the driver, so they end at a depth that leaves no more than some hundred leaves each. Rows that
reach a mixed leaf meet in a task, with those of some other leaves, and the task grows all of these
until their rows are of one class or alike. What is grown stays a table: it is as large as the rows, and predictions meet it
by leaf. A leaf of more rows than a task may hold is first parted: a small tree,
grown on some of its rows, deals all of them to parts, and parts that are still too large are parted again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import scratch, write

#: Rows of a leaf, or of a part of one, that a task grows; rows on which a larger one is parted; parts to a parting.
MOST, SOME, PARTS = 50_000, 5000, 64
#: Rows that a task grows at once on average, of one leaf or of many; rows to predict that meet what was grown on them.
AT_ONCE, MEET = 30_000, 200_000
#: Rows that a leaf of Spark's has on average, and the least and the greatest depth of its trees.
TO_A_LEAF, DEPTHS = 3000, (4, 8)
MIXED = -(1 << 31)
NODES = "tree int, leaf int, part long, feature array<int>, threshold array<double>, low array<int>, high array<int>, value array<long>, gain array<double>"
ARRAYS = ("feature", "threshold", "low", "high", "value", "gain")
KEY = ["tree", "leaf", "part"]
Key = tuple[int, int, int]


@dataclass
class Nodes:
    """Trees as arrays; feature -1 ends one, and value is then a class, or the next part. gain: by how much a split lessens the rows' impurity."""

    feature: np.ndarray
    threshold: np.ndarray
    low: np.ndarray
    high: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    def ends(self, x: np.ndarray, root: np.ndarray | int = 0) -> np.ndarray:
        at = np.zeros(len(x), np.int64) + root
        while True:
            on = np.flatnonzero(self.feature[at] >= 0)
            if not len(on):
                return self.value[at]
            here = at[on]
            at[on] = np.where(x[on, self.feature[here]] <= self.threshold[here], self.low[here], self.high[here])


def depth_for(rows: int) -> int:
    """The depth at which Spark's trees end."""
    return int(np.clip(np.ceil(np.log2(max(rows, 1) / TO_A_LEAF)), *DEPTHS))


def impurity(counts: np.ndarray) -> np.ndarray:
    """Gini's, times the rows: of rows of counts by class."""
    n = counts.sum(axis=-1)
    return n - np.square(counts).sum(axis=-1) / n


def best_splits(ranks: np.ndarray, one: np.ndarray, at: np.ndarray, drawn: np.ndarray, counts: np.ndarray, first: int) -> tuple[np.ndarray, ...]:
    """Of each node, from rows(ranks, one: weight by class, at: node): impurity, feature (-1: none varies), and the rows on both sides of the cut.

    A node looks at the first features that are drawn for it, and at all the others if none of them varies.
    """
    n, nodes, d = len(at), len(counts), drawn.shape[1]
    best, feature, below, above = np.full(nodes, np.inf), np.full(nodes, -1), np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
    rows, span = np.arange(n), int(ranks.max()) + 1
    for t in range(d):
        if t == first:
            lacking = feature < 0
        if t >= first:
            rows = np.flatnonzero(lacking[at])
            if not len(rows):
                break
        of = at[rows]
        rank = ranks[rows, drawn[of, t]]
        order = np.argsort(of * span + rank)
        rows_in, of, rank = rows[order], of[order], rank[order]
        sums = np.cumsum(one[rows_in], axis=0)
        starts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        before = np.zeros((nodes, one.shape[1]))
        before[of[starts[1:]]] = sums[starts[1:] - 1]
        cuts = np.flatnonzero((of[1:] == of[:-1]) & (rank[1:] > rank[:-1]))
        if not len(cuts):
            continue
        of = of[cuts]
        low = sums[cuts] - before[of]
        impure = impurity(low) + impurity(counts[of] - low)
        starts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        least = np.minimum.reduceat(impure, starts)
        hits = np.flatnonzero(impure == np.repeat(least, np.diff(np.append(starts, len(of)))))
        hits = hits[np.append(True, of[hits][1:] != of[hits][:-1])]  # the first of each node
        better = least < best[of[starts]]
        hits, least = hits[better], least[better]
        node, cut = of[hits], cuts[hits]
        best[node], feature[node], below[node], above[node] = least, drawn[node, t], rows_in[cut], rows_in[cut + 1]
    return best, feature, below, above


def grow_all(x: np.ndarray, y: np.ndarray, weight: np.ndarray, root: np.ndarray, seed: int, most_ends: int | None = None) -> tuple[Nodes, np.ndarray]:
    """Nodes and each one's root, of trees for rows of many roots (numbers from 0), level by level: rows are split until those of each end are of one class or alike.

    A root of the number of features is drawn for each node. most_ends, of a single root: it has so many ends at most.
    """
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    classes, c = np.unique(y, return_inverse=True)
    ranks = np.stack([np.unique(x[:, f], return_inverse=True)[1] for f in range(d)], axis=1)
    roots = int(root.max()) + 1
    made: list[list[np.ndarray]] = []
    rows, at, owner, count, ends = np.arange(len(y)), root.astype(np.int64), np.arange(roots), roots, 1
    while len(owner):
        nodes, k = len(owner), len(classes)
        counts = np.bincount(at * k + c[rows], weights=weight[rows], minlength=nodes * k).reshape(nodes, k)
        feature, threshold, gain = np.full(nodes, -1), np.zeros(nodes), np.zeros(nodes)
        low, high, value = np.zeros(nodes, np.int64), np.zeros(nodes, np.int64), classes[counts.argmax(axis=1)]
        made.append([feature, threshold, low, high, value, gain, owner])
        mixed = (counts > 0).sum(axis=1) > 1
        if not mixed.any() or (most_ends and ends >= most_ends):
            break
        on = np.flatnonzero(mixed)
        keep = mixed[at]
        rows, at = rows[keep], (np.cumsum(mixed) - 1)[at[keep]]
        one = np.zeros((len(rows), k))
        one[np.arange(len(rows)), c[rows]] = weight[rows]
        drawn = rng.random((len(on), d)).argsort(axis=1)
        impure, f, below, above = best_splits(ranks[rows], one, at, drawn, counts[on], max(1, int(np.sqrt(d))))
        split = np.flatnonzero(f >= 0)[: most_ends - ends if most_ends else None]
        ends += len(split)
        a, b = x[rows[below[split]], f[split]], x[rows[above[split]], f[split]]
        middle = a + (b - a) / 2
        node = on[split]
        feature[node], threshold[node], gain[node] = f[split], np.where(middle < b, middle, a), impurity(counts[node]) - impure[split]
        low[node] = count + 2 * np.arange(len(split))
        high[node] = low[node] + 1
        place = np.full(len(on), -1)
        place[split] = np.arange(len(split))
        keep = place[at] >= 0
        rows, at = rows[keep], at[keep]
        is_high = x[rows, f[at]] > threshold[on[at]]
        at = 2 * place[at] + is_high
        owner = np.repeat(owner[node], 2)
        count += len(owner)
    feature, threshold, low, high, value, gain, owner = (np.concatenate(a) for a in zip(*made, strict=True))
    return Nodes(feature, threshold, low, high, value.astype(np.int64), gain), owner


def grow(x: np.ndarray, y: np.ndarray, seed: int, most_ends: int | None = None) -> Nodes:
    """One tree."""
    return grow_all(x, y, np.ones(len(y)), np.zeros(len(y), np.int64), seed, most_ends)[0]


def by_root(nodes: Nodes, owner: np.ndarray) -> list[Nodes]:
    """Each root's own tree, with the root first."""
    order = np.argsort(owner, kind="stable")
    starts = np.searchsorted(owner[order], np.arange(int(owner.max()) + 1))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order)) - starts[owner[order]]
    own = [nodes.feature, nodes.threshold, place[nodes.low], place[nodes.high], nodes.value, nodes.gain]
    return [Nodes(*a) for a in zip(*[np.split(v[order], starts[1:]) for v in own], strict=True)]


def joined(trees: list[Nodes]) -> tuple[Nodes, np.ndarray]:
    """The trees in one, and where each begins."""
    starts = np.cumsum([0, *[len(t.feature) for t in trees[:-1]]])
    of = lambda c, by=0: np.concatenate([getattr(t, c) + s * by for t, s in zip(trees, starts, strict=True)])
    return Nodes(of("feature"), of("threshold"), of("low", 1), of("high", 1), of("value"), of("gain")), starts


def nodes_of(row) -> Nodes:
    return Nodes(np.array(row.feature, np.int64), np.array(row.threshold, float), np.array(row.low, np.int64), np.array(row.high, np.int64), np.array(row.value, np.int64), np.array(row.gain, float))


def trees_of(nodes: DataFrame) -> dict[Key, Nodes]:
    return {(r.tree, r.leaf, r.part): nodes_of(r) for r in nodes.collect()}


def as_rows(trees: dict[Key, Nodes]) -> list[tuple]:
    return [(*k, *[getattr(n, c).tolist() for c in ARRAYS]) for k, n in trees.items()]


def dealt(rows: DataFrame, parting: dict[Key, Nodes]) -> DataFrame:
    """rows(tree, leaf, part, x) with the part that each comes to in the end."""
    if not parting:
        return rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.reset_index(drop=True)
            open_rows = b
            while len(open_rows):
                moved = []
                for key, own in open_rows.groupby(KEY):
                    if key in parting:
                        b.loc[own.index, "part"] = parting[key].ends(np.stack(own.x))
                        moved.append(own.index)
                open_rows = b.loc[np.concatenate(moved)] if moved else b.iloc[:0]
            yield b

    return rows.mapInPandas(run, rows.schema)


def bucket(n: int) -> Column:
    return F.pmod(F.xxhash64(*KEY), F.lit(n))


@dataclass
class Deep:
    """What lies below Spark's leaves: each leaf's class, MIXED where grown trees tell; how leaves are parted; and the grown trees, as a table."""

    leaves: dict[int, np.ndarray]
    lessened: dict[int, float] = field(default_factory=dict)  # by how much each of Spark's trees lessens the rows' impurity
    parting: dict[Key, Nodes] = field(default_factory=dict)
    nodes: DataFrame | None = None
    buckets: int = 1

    @cached_property
    def grown(self) -> dict[Key, Nodes]:
        """All trees, here: of a small forest."""
        return self.parting | (trees_of(self.nodes) if self.nodes is not None else {})

    def end_of(self, tree: int, leaf: int, x: np.ndarray) -> np.ndarray:
        """The class of each row that is in a mixed leaf, of a small forest."""
        out = np.zeros(len(x), np.int64)
        waiting = [(0, np.arange(len(x)))]
        while waiting:
            part, rows = waiting.pop()
            found = self.grown[tree, leaf, part].ends(x[rows])
            told = found >= MIXED  # parts are numbered below that
            out[rows[told]] = found[told]
            waiting += [(int(p), rows[found == p]) for p in np.unique(found[~told])]
        return out

    def labels(self, spark: SparkSession) -> DataFrame:
        """tree, leaf, label: a row for each of Spark's leaves."""
        each = [pd.DataFrame({"tree": t, "leaf": np.arange(len(a)), "label": a}) for t, a in self.leaves.items()]
        return spark.createDataFrame(pd.concat(each), "tree int, leaf int, label long")

    def said(self, reached: DataFrame) -> DataFrame:
        """_row, yhat: the class that most trees tell, ties to the least, of rows(_row, x, leaf array: of each tree).

        Rows meet the trees that were grown below their leaves in a task, which holds those of one bucket.
        """
        spark = reached.sparkSession
        each = reached.select("_row", "x", F.posexplode("leaf").alias("tree", "leaf")).join(F.broadcast(self.labels(spark)), ["tree", "leaf"])
        votes = each.where(F.col("label") != MIXED).select("_row", F.col("label").cast("int").alias("yhat"))
        if self.nodes is not None:
            shares = -(-reached.count() * len(self.leaves) // (self.buckets * MEET))
            rows = dealt(each.where(F.col("label") == MIXED).select("tree", "leaf", F.lit(0).cast("long").alias("part"), "_row", "x"), self.parting)
            rows = rows.withColumn("share", F.pmod(F.xxhash64("_row"), F.lit(shares)))
            nodes = self.nodes.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))))
            both = nodes.unionByName(rows, allowMissingColumns=True).withColumn("bucket", bucket(self.buckets))
            votes = votes.unionByName(both.repartition("bucket", "share").sortWithinPartitions("bucket", "share", F.col("_row").isNotNull()).mapInPandas(ends_met, "_row long, yhat int"))
        counted = votes.groupBy("_row", "yhat").agg(F.count(F.lit(1)).alias("n"))
        return counted.groupBy("_row").agg((-F.max(F.struct("n", (-F.col("yhat")).alias("y")))["y"]).alias("yhat"))

    def gains(self) -> dict[int, dict[int, float]]:
        """By tree and feature, by how much splits below Spark's leaves lessen the rows' impurity."""
        out: dict[int, dict[int, float]] = {}

        def add(tree: int, feature: int, gain: float) -> None:
            own = out.setdefault(tree, {})
            own[feature] = own.get(feature, 0.0) + gain

        for (tree, _, _), t in self.parting.items():
            for f in np.unique(t.feature[t.feature >= 0]):
                add(tree, int(f), float(t.gain[t.feature == f].sum()))
        if self.nodes is not None:
            each = self.nodes.select("tree", F.explode(F.arrays_zip("feature", "gain")).alias("s")).where("s.feature >= 0")
            for r in each.groupBy("tree", F.col("s.feature").alias("feature")).agg(F.sum("s.gain").alias("gain")).collect():
                add(r.tree, r.feature, r.gain)
        return out

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(t, [int(v) for v in a], float(self.lessened.get(t, 0.0)), self.buckets) for t, a in self.leaves.items()]
        spark.createDataFrame(rows, "tree int, labels array<long>, lessened double, buckets long").write.mode("overwrite").parquet(f"{path}/leaves")
        spark.createDataFrame(as_rows(self.parting), NODES).write.mode("overwrite").parquet(f"{path}/parting")
        (self.nodes if self.nodes is not None else spark.createDataFrame([], NODES)).write.mode("overwrite").parquet(f"{path}/grown")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Deep:
        rows = spark.read.parquet(f"{path}/leaves").collect()
        return cls({r.tree: np.array(r.labels, np.int64) for r in rows}, {r.tree: r.lessened for r in rows}, trees_of(spark.read.parquet(f"{path}/parting")), spark.read.parquet(f"{path}/grown"), rows[0].buckets)


def ends_met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """_row, yhat from trees and rows in order of bucket and share, in each the trees first."""
    now, keys, trees, field_ = None, [], [], None
    for b in batches:
        change = (b[["bucket", "share"]] != b[["bucket", "share"]].shift()).any(axis=1).cumsum()
        for _, own in b.groupby(change):
            if (at := (own.bucket.iloc[0], own.share.iloc[0])) != now:
                now, keys, trees, field_ = at, [], [], None
            is_tree = own._row.isna()
            for r in own[is_tree].itertuples():
                keys.append((r.tree, r.leaf, r.part))
                trees.append(nodes_of(r))
            rows = own[~is_tree]
            if len(rows):
                if field_ is None:
                    field_ = (pd.MultiIndex.from_tuples(keys), *joined(trees))
                index, nodes, starts = field_
                root = starts[index.get_indexer(pd.MultiIndex.from_frame(rows[KEY]))]
                yield pd.DataFrame({"_row": rows._row.astype("int64"), "yhat": nodes.ends(np.stack(rows.x), root).astype("int32")})


def grown_by(rows: DataFrame, seed: int, buckets: int) -> DataFrame:
    """NODES of each (tree, leaf, part) of rows(tree, leaf, part, x, y, w: weight); a task grows all of a bucket at once."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([*KEY, "h", "y", "w"])  # the same order in any run
        root = rows.groupby(KEY).ngroup().to_numpy()
        nodes, owner = grow_all(np.stack(rows.x), rows.y.to_numpy(np.int64), rows.w.to_numpy(float), root, hash((seed, int(key[0]))) & 0x7FFFFFFF)
        keys = rows[KEY].drop_duplicates().itertuples(index=False)
        return pd.DataFrame(as_rows({tuple(int(v) for v in k): t for k, t in zip(keys, by_root(nodes, owner), strict=True)}), columns=[f.split()[0] for f in NODES.split(", ")])

    return rows.withColumn("h", F.xxhash64("x")).groupBy(bucket(buckets).alias("bucket")).applyInPandas(run, NODES)


def parted_by(rows: DataFrame, seed: int) -> dict[Key, Nodes]:
    """A parting of each (tree, leaf, part) of drawn rows(tree, leaf, part, x, y, n: rows that there are). Ends are parts: numbers below MIXED, unlike for each."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        tree, leaf, part = (int(k) for k in key)
        rows = rows.sort_values(["h", "y"])
        t = grow(np.stack(rows.x), rows.y.to_numpy(np.int64), hash((seed, tree, leaf, part)) & 0x7FFFFFFF, PARTS)
        ends = np.flatnonzero(t.feature < 0)
        t.value[ends] = MIXED - 1 - (-min(part, 0) * PARTS + np.arange(len(ends)))
        t.gain *= rows.n.iloc[0] / len(rows)
        return pd.DataFrame(as_rows({(tree, leaf, part): t}), columns=[f.split()[0] for f in NODES.split(", ")])

    return trees_of(rows.withColumn("h", F.xxhash64("x")).groupBy(*KEY).applyInPandas(run, NODES))


def drawn_often(row: Column, seed: int) -> Column:
    """How often a bootstrap sample of as many rows takes a row (Poisson of mean 1), by a hash."""
    u = F.pmod(F.xxhash64(row, "tree", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    shares = np.cumsum(np.exp(-1) / np.cumprod([1, *range(1, 12)]))
    return sum((u >= F.lit(float(s))).cast("int") for s in shares)


def finish(leaves: DataFrame, seed: int = 42, most: int = MOST, some: int = SOME, bagged: bool = False) -> Deep:
    """The trees below a forest's leaves, from training rows(y int, x array, leaf vector: of each tree).

    bagged: each tree draws its own bootstrap sample, by a hash of all that a row holds. Rows alike in all features but not in class take the class of most of them.
    """
    spark = leaves.sparkSession
    row = F.xxhash64(*[c for c in leaves.columns if c != "leaf"])
    leaf = F.transform(vector_to_array("leaf"), lambda v: v.cast("int"))
    reached = write(leaves.select("y", "x", row.alias("row"), leaf.alias("leaf")), scratch(spark, "leaves"))
    each = reached.select("y", "x", "row", F.posexplode("leaf").alias("tree", "leaf"))
    each = each.withColumn("w", drawn_often(F.col("row"), seed) if bagged else F.lit(1)).drop("row")
    counts = each.groupBy("tree", "leaf", "y").agg(F.sum("w").alias("w"), F.count_if(F.col("w") > 0).alias("n"), F.count(F.lit(1)).alias("all")).toPandas()  # a row for each class of each of Spark's leaves
    out, mixed_keys, pairs = Deep({}), [], 0
    for tree, own in counts.groupby("tree"):
        table = lambda c, own=own: own.pivot_table(index="leaf", columns="y", values=c, aggfunc="sum", fill_value=0)
        weight, present, n = table("w"), table("all"), table("n").sum(axis=1)
        of = weight.where(weight.sum(axis=1) > 0, present)  # a leaf that the sample misses is told by all its rows
        mixed = (of > 0).sum(axis=1).to_numpy() > 1
        mixed &= weight.sum(axis=1).to_numpy() > 0
        labels = np.full(int(own.leaf.max()) + 1, MIXED, np.int64)
        labels[of.index] = np.where(mixed, MIXED, of.columns.to_numpy()[of.to_numpy().argmax(axis=1)])
        out.leaves[int(tree)] = labels
        seen = weight.to_numpy(float)[weight.sum(axis=1).to_numpy() > 0]
        out.lessened[int(tree)] = max(float(impurity(seen.sum(axis=0)) - impurity(seen).sum()), 0.0) if len(seen) else 0.0
        pairs += int(n[mixed].sum())
        mixed_keys += [(int(tree), int(k), int(v)) for k, v in n[mixed].items()]
    if not mixed_keys:
        return out
    mixed = spark.createDataFrame(pd.DataFrame(mixed_keys, columns=["tree", "leaf", "n"]), "tree int, leaf int, n long")
    rows = each.where("w > 0").join(F.broadcast(mixed.select("tree", "leaf")), ["tree", "leaf"]).select("tree", "leaf", F.lit(0).cast("long").alias("part"), "x", "y", "w")
    large = mixed.where(F.col("n") > most).select("tree", "leaf", F.lit(0).cast("long").alias("part"), "n")
    plain: list[tuple[int, int, int, int]] = []
    while (many := [tuple(r) for r in large.collect()]):
        large = spark.createDataFrame(many, "tree int, leaf int, part long, n long")
        own = dealt(rows.join(F.broadcast(large.select("tree", "leaf").distinct()), ["tree", "leaf"]).select(*rows.columns), out.parting).join(F.broadcast(large), KEY)
        share = F.pmod(F.xxhash64("x", "y", F.lit(seed)), F.lit(1 << 40)) < F.lit(float(some)) / F.col("n") * F.lit(float(1 << 40))
        # a sample that happens to be alike or of one class parts nothing, and its leaf is grown as it is; each has over `most` rows: they are few
        made = {k: t for k, t in parted_by(own.where(share).select(*KEY, "x", "y", "n"), seed).items() if len(t.feature) > 1}
        # of rows that are alike, or of one class, the class of most is all that there is to tell
        alike = own.groupBy(*KEY).agg(F.min(F.xxhash64("x")).alias("lo"), F.max(F.xxhash64("x")).alias("hi"), F.min("y").alias("a"), F.max("y").alias("b")).where("lo = hi OR a = b")
        told = own.join(F.broadcast(alike.select(*KEY)), KEY).groupBy(*KEY, "y").agg(F.sum("w").alias("w")).groupBy(*KEY).agg(F.max(F.struct("w", (-F.col("y")).alias("m"))).alias("b"))
        plain += [(r.tree, r.leaf, r.part, -r.b.m) for r in told.collect()]
        made = {k: t for k, t in made.items() if k not in {p[:3] for p in plain}}
        if not made:
            break
        out.parting |= made
        keys = spark.createDataFrame([k for k in made], "tree int, leaf int, part long")
        sizes = dealt(own.drop("n").join(F.broadcast(keys), KEY).select(*rows.columns), out.parting).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
        large = sizes.where(F.col("n") > most)
    rows = dealt(rows, out.parting)
    if plain:
        rows = rows.join(F.broadcast(spark.createDataFrame(plain, "tree int, leaf int, part long, y int").select(*KEY)), KEY, "left_anti")
    out.buckets = -(-pairs // AT_ONCE)
    nodes = grown_by(rows, seed, out.buckets)
    if plain:
        nodes = nodes.unionByName(spark.createDataFrame([(*p[:3], [-1], [0.0], [0], [0], [p[3]], [0.0]) for p in plain], NODES))
    out.nodes = write(nodes, scratch(spark, "grown"))
    return out
