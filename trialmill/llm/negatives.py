"""Hard negatives by an inverted multi-index, exactly.

Vectors are cut in half, and each half has a codebook of its own; a pair of
codes is a cell. The index is a table of blocks of rows, each block's rows in
order of their cells, with the largest distance of a row's half from its code's centre. Over a
block, a query's half-scores plus what these radii can add bound every cell's
scores. Cells are visited in falling order of the sum of their halves' bounds,
by the multi-sequence heap, and the visit ends where no cell left can change what was found: the
nearest rows of the same label first, then, for each of these, the first rows of another
label within its window of scores. Blocks' findings are cut to the best over all blocks.

Anchors meet each block of rows once in either round; what a block sends for an
anchor is a few rows, whatever it holds.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, sampled, save

#: Rows whose scores are taken at once, about: so many at first, and twice as many each time up to the most.
AT_FIRST, AT_MOST = 256, 4096
INDEX = "block long, d int, ids binary, labels binary, vectors binary, cells binary, radii binary"
Window_ = tuple[int, int]


@dataclass
class Codebooks:
    """Centres of the two halves of vectors of one length."""

    left: np.ndarray
    right: np.ndarray

    @classmethod
    def fit(cls, vectors: np.ndarray, codes: int, rounds: int = 8, seed: int = 42) -> Codebooks:
        half = vectors.shape[1] // 2
        return cls(centres(vectors[:, :half], codes, rounds, seed), centres(vectors[:, half:], codes, rounds, seed + 1))


def nearest(x: np.ndarray, middle: np.ndarray) -> np.ndarray:
    return ((middle**2).sum(axis=1) - 2 * (x @ middle.T)).argmin(axis=1)


def centres(x: np.ndarray, codes: int, rounds: int, seed: int) -> np.ndarray:
    """Lloyd's means from rows drawn at random; a mean without rows stays where it was."""
    x = x.astype(np.float64)
    middle = x[np.random.default_rng(seed).permutation(len(x))[:codes]].copy()
    for _ in range(rounds):
        at = nearest(x, middle)
        n = np.bincount(at, minlength=len(middle))
        sums = np.zeros_like(middle)
        np.add.at(sums, at, x)
        middle[n > 0] = sums[n > 0] / n[n > 0, None]
    return middle


def fitted(vectors: DataFrame, codes: int, sample_rows: int) -> dict[int, Codebooks]:
    """Codebooks for each length of vectors, from about sample_rows rows chosen by a hash of the id. A length that the sample missed has one code at the origin."""
    some = sampled(vectors.select("vec_id", "v", "d"), "vec_id", sample_rows).limit(2 * sample_rows).toPandas()
    return {int(d): Codebooks.fit(np.stack(x.v).reshape(len(x), d), codes) for d, x in some.groupby("d")}


@dataclass
class Block:
    """The rows of one block of the index, in order of their cells."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    starts: np.ndarray  # of each cell, and the end
    radii: np.ndarray  # of each code of the left half, and of the right; -1 where the block has no row of it
    books: Codebooks

    def __post_init__(self) -> None:
        self.largest = float(np.abs(self.vectors).max(initial=0))
        self.as_floats: dict[type, np.ndarray] = {}

    def scores(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Exact: as floats while no partial sum leaves their whole numbers, else as integers."""
        most = float(np.abs(q).sum()) * self.largest
        if most >= 2.0**53:
            return self.vectors[rows] @ q
        kind = np.float32 if most < 2.0**24 else np.float64
        if kind not in self.as_floats:
            self.as_floats[kind] = self.vectors.astype(kind)
        return (self.as_floats[kind][rows] @ q.astype(kind)).astype(np.int64)

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The highest half-score that a row of each code can have with q; -inf for codes without rows. Wider by what doubles may be off."""
        half = self.books.left.shape[1]
        out = []
        for part, middle, radius in ((q[:half], self.books.left, self.radii[: len(self.books.left)]), (q[half:], self.books.right, self.radii[len(self.books.left) :])):
            size = np.sqrt(part @ part)
            top = middle @ part + size * radius + 1e-9 * size * (np.sqrt((middle**2).sum(axis=1)) + radius) + 1e-6
            out.append(np.where(radius < 0, -np.inf, top))
        return out[0], out[1]


def built(d: int, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, books: Codebooks) -> tuple[bytes, ...]:
    """A row of the index, after its block and d."""
    half = d // 2
    x = v.astype(np.float64)
    left, right = nearest(x[:, :half], books.left), nearest(x[:, half:], books.right)
    order = np.lexsort((ids, left * len(books.right) + right))
    cell = (left * len(books.right) + right)[order]
    radii = np.full(len(books.left) + len(books.right), -1.0)
    for at, code, part, middle in ((0, left, x[:, :half], books.left), (len(books.left), right, x[:, half:], books.right)):
        np.maximum.at(radii, at + code, np.sqrt(((part - middle[code]) ** 2).sum(axis=1)))
    starts = np.searchsorted(cell, np.arange(len(books.left) * len(books.right) + 1)).astype(np.int32)
    return ids[order].tobytes(), labels[order].tobytes(), np.ascontiguousarray(v[order]).tobytes(), starts.tobytes(), radii.tobytes()


def indexed(vectors: DataFrame, books: dict[int, Codebooks], block_rows: int) -> DataFrame:
    """The index of vectors(row, vec_id, label, v, d): every row is in one block, of rows of one task and length; nothing is shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[pd.DataFrame]] = {}

        def block(d: int) -> pd.DataFrame:
            b = pd.concat(held.pop(d))
            v = np.stack(b.v).astype(np.int64).reshape(len(b), d)
            made = built(d, b.vec_id.to_numpy(np.int64), b.label.to_numpy(np.int64), v, of_length(books, d))
            return pd.DataFrame([(int(b.row.iloc[0]), d, *made)], columns=[x.split()[0] for x in INDEX.split(", ")])

        for batch in batches:
            for d, b in batch.groupby("d"):
                held.setdefault(d, []).append(b)
                if sum(map(len, held[d])) >= block_rows:
                    yield block(d)
        for d in list(held):
            yield block(d)

    return vectors.mapInPandas(run, INDEX)


def of_length(books: dict[int, Codebooks], d: int) -> Codebooks:
    return books.get(d) or Codebooks(np.zeros((1, d // 2)), np.zeros((1, d - d // 2)))


def opened(row: pd.Series, books: dict[int, Codebooks]) -> Block:
    whole = lambda x: np.frombuffer(x, np.int64)
    ids = whole(row.ids)
    return Block(ids, whole(row.labels), whole(row.vectors).reshape(len(ids), row.d), np.frombuffer(row.cells, np.int32), np.frombuffer(row.radii), of_length(books, int(row.d)))


def visit(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """(bound, left code, right code) of every cell of codes that have rows, in falling order of left + right: the multi-sequence algorithm.

    A cell waits in the heap once the cells before it in either sequence are out.
    """
    a, b = np.argsort(-left, kind="stable"), np.argsort(-right, kind="stable")
    a, b = a[left[a] > -np.inf], b[right[b] > -np.inf]
    if not len(a) or not len(b):
        return
    u, w = left[a].tolist(), right[b].tolist()
    a, b = a.tolist(), b.tolist()
    out = [0] * (len(a) + 1)  # of each left code, how many cells are out
    heap = [(-u[0] - w[0], 0, 0)]
    while heap:
        bound, i, j = heapq.heappop(heap)
        yield -bound, a[i], b[j]
        out[i] = j + 1
        if i + 1 < len(a) and out[i + 1] == j:
            heapq.heappush(heap, (-u[i + 1] - w[j], i + 1, j))
        if j + 1 < len(b) and (i == 0 or out[i - 1] > j + 1):
            heapq.heappush(heap, (-u[i] - w[j + 1], i, j + 1))


def scanned(block: Block, q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(places, scores, bound of all rows left) of a block's rows, by some hundred of whole cells in the order of visit()."""
    codes = len(block.books.right)
    held: list[np.ndarray] = []
    size, enough = 0, AT_FIRST
    for bound, i, j in visit(*block.bounds(q.astype(np.float64))):
        if size >= enough:
            rows = np.concatenate(held)
            yield rows, block.scores(rows, q), bound
            held, size, enough = [], 0, min(2 * enough, AT_MOST)
        start, end = block.starts[i * codes + j], block.starts[i * codes + j + 1]
        if end > start:
            held.append(np.arange(start, end))
            size += end - start
    if size:
        rows = np.concatenate(held)
        yield rows, block.scores(rows, q), -np.inf


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id, in order."""
    if len(scores) > 4 * k + 64:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def first_of(block: Block, q: np.ndarray, anchor: int, label: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(ids, scores, rows read): the block's k highest scores among rows of the label and of other ids than the anchor's."""
    ids, scores, read = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    for rows, found, bound in scanned(block, q):
        read += len(rows)
        own = (block.labels[rows] == label) & (block.ids[rows] != anchor)
        ids, scores = np.concatenate([ids, block.ids[rows[own]]]), np.concatenate([scores, found[own]])
        top = best(ids, scores, k)
        ids, scores = ids[top], scores[top]
        if len(scores) == k and scores[-1] > bound:  # a row left may tie with a bound that it reaches
            break
    return ids, scores, read


def windows_of(block: Block, q: np.ndarray, label: int, windows: list[Window_], k: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """For each window (lowest, highest score): (ids, scores) of the block's k highest scores in it among rows of other labels; and how many rows were read."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in windows]
    is_open = [low <= high for low, high in windows]
    read = 0
    if not any(is_open):
        return found, read
    for rows, scores, bound in scanned(block, q):
        read += len(rows)
        other = block.labels[rows] != label
        ids, scores = block.ids[rows[other]], scores[other]
        for i, (low, high) in enumerate(windows):
            if not is_open[i]:
                continue
            inside = (scores >= low) & (scores <= high)
            if inside.any():
                a, s = np.concatenate([found[i][0], ids[inside]]), np.concatenate([found[i][1], scores[inside]])
                top = best(a, s, k)
                found[i] = a[top], s[top]
            is_open[i] = not (bound < low or (len(found[i][1]) == k and found[i][1][-1] > bound))
        if not any(is_open):
            break
    return found, read


def over_blocks(index: DataFrame, asked: DataFrame, books: dict[int, Codebooks], find: Callable[[Block, pd.Series], Iterator[tuple]], fields: str, query_rows: int) -> DataFrame:
    """What `find` gives of each block and each row of asked(row, d, v, ...) of its length. Blocks and anchors, query_rows of them, meet in one task; both are of bounded size."""
    parts = max(1, -(-asked.count() // query_rows))
    blocks = index.select(F.col("block").alias("b"), F.col("d").alias("_d"))  # two numbers for each block
    blocks = F.broadcast(blocks) if blocks.count() <= 1_000_000 else blocks
    left = asked.withColumn("qb", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")).join(blocks, F.col("d") == F.col("_d"))
    right = index.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    names = [f.split()[0] for f in fields.split(", ")]

    def scan(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            block = opened(b.iloc[0], books)
            for row in a.itertuples():
                out += find(block, row)
        return pd.DataFrame(out, columns=names)

    return left.groupBy("b", "qb").cogroup(right.groupBy("block", "qb")).applyInPandas(scan, fields)


def mine(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, low: tuple[int, int] = (1, 2), high: tuple[int, int] = (19, 20), codes: int = 12, block_rows: int = 16384, query_rows: int = 2048, sample_rows: int = 20_000, reads: str | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors(vec_id, label, v, d) and anchors, rows of the same kind, as
    topk.integer_vectors(more=["label"]) gives them: scores are exact 64-bit integers. An anchor's positives are the first
    `positives` rows of its label; for each, the first `negatives` rows of other labels whose score is at least `low` and at most `high`
    (fractions) of the positive's. Higher scores come first, ties by smaller id; fewer, where there are no more. Rows of the anchor's own id
    are none of its partners. Rows without a label take no part. Rows that repeat an id are rows like others; anchors that do are
    each mined, over rows in common. Vectors are compared with those of as many components. Empty: no rows.

    codes: of each half; sample_rows: that the codebooks are fitted on. reads: a path to which the rows read by each visit are written.
    """
    spark = vectors.sparkSession
    numbered = lambda df, name: save(df.where("label is not null").withColumn("label", F.col("label").cast("long")).withColumn("row", F.monotonically_increasing_id()), name)
    rows, asked = numbered(vectors, "vectors"), numbered(anchors, "anchors")
    books = fitted(rows, codes, sample_rows)
    index = save(indexed(rows, books, block_rows), "index")
    forget(rows)

    def same(block: Block, a: pd.Series) -> Iterator[tuple]:
        ids, scores, read = first_of(block, np.asarray(a.v, np.int64), a.vec_id, a.label, positives)
        return [(a.row, int(i), int(s), read) for i, s in zip(ids, scores, strict=True)] or [(a.row, None, None, read)]

    near = save(over_blocks(index, asked, books, same, "row long, positive_id long, positive_score long, read long", query_rows), "near")
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("positive_score"), "positive_id"))
    first = near.where("positive_id is not null").withColumn("place", place).where(F.col("place") <= positives)
    listed = first.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("windows"))
    windowed = save(asked.join(listed.withColumnRenamed("row", "_row"), F.col("row") == F.col("_row")).drop("_row"), "windows")

    def others(block: Block, a: pd.Series) -> Iterator[tuple]:
        windows = [window(int(w["positive_score"]), low, high) for w in a.windows]
        found, read = windows_of(block, np.asarray(a.v, np.int64), a.label, windows, negatives)
        out = [(a.row, a.vec_id, int(w["place"]), int(w["positive_id"]), int(w["positive_score"]), int(i), int(s), read) for w, (ids, scores) in zip(a.windows, found, strict=True) for i, s in zip(ids, scores, strict=True)]
        return out or [(a.row, a.vec_id, 0, None, None, None, None, read)]

    hard = save(over_blocks(index, windowed, books, others, "row long, anchor_id long, place int, positive_id long, positive_score long, negative_id long, negative_score long, read long", query_rows), "hard")
    if reads:
        near.select("row", F.lit("positives").alias("of"), "read").unionAll(hard.select("row", F.lit("negatives").alias("of"), "read")).write.parquet(reads)
    rank = F.row_number().over(Window.partitionBy("row", "place").orderBy(F.desc("negative_score"), "negative_id"))
    out = hard.where("negative_id is not null").withColumn("rank", rank).where(F.col("rank") <= negatives)
    for x in (index, near, windowed, asked):
        forget(x)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def window(score: int, low: tuple[int, int], high: tuple[int, int]) -> Window_:
    """The lowest and highest score between two fractions of a positive's; none if the lowest is above the highest."""
    return -(-score * low[0] // low[1]), score * high[0] // high[1]

