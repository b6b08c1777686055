"""Lempel-Ziv phrase fingerprints: texts that would compress each other well have like signatures.

A text's UTF-8 bytes are parsed into dictionary phrases: each is the longest
known phrase and one byte more, and is known from then on. The set of phrases is
hashed, and the least hash in each of BINS parts of the hash space is kept, as
a byte: the signature. The share of parts in which two signatures agree,
less what bytes agree by chance, tells the likeness (Jaccard) of the phrase sets.

The dictionary starts anew every `reset` bytes, so that a text of any length is
parsed whole in bounded memory; the phrases of all its stretches are one set.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import AT_ONCE, map_text, save

BINS = 256
#: Bytes after which the dictionary starts anew.
RESET = 1 << 20
#: Texts that are hashed together, at most.
TEXTS = 2000
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
BYTE = np.uint64(255)
LIKENESS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def grow(data: bytes, phrases: dict[int, int], node: int) -> int:
    """Parses on from a known phrase (0: none begun) and gives the one that data ends in.

    Phrases are known by their number, from 1 on, times 256. phrases: that of a phrase, and the byte that follows, to that of the longer phrase.
    """
    n = 256 * len(phrases) + 256
    put = phrases.setdefault
    for c in data:
        node = put(node + c, n)
        if node == n:
            n += 256
            node = 0
    return node


class Forest:
    """Phrases of many texts, to be hashed together; `owner` is a number of the caller's."""

    def __init__(self) -> None:
        self.parents: list[np.ndarray] = []
        self.bytes: list[np.ndarray] = []
        self.owners: list[np.ndarray] = []
        self.size = 0

    def add(self, keys: Sequence[int], owner: int, known: int = 0, at: int = 0) -> int:
        """Phrases in the order of their numbers; the first `known` numbers are those of phrases added before, from place `at`. Gives their place."""
        k = np.fromiter(keys, np.int64, len(keys))
        number = k >> 8
        self.parents.append(np.where(number == 0, -1, np.where(number <= known, at + number - 1, self.size + number - known - 1)))
        self.bytes.append(k & 255)
        self.owners.append(np.full(len(k), owner))
        self.size += len(k)
        return self.size - len(k)

    def minima(self, owners: int) -> np.ndarray:
        """The least phrase hash of each owner and part, NONE where there is none."""
        out = np.full(owners * BINS, NONE)
        if self.size:
            parent, byte, owner = (np.concatenate(x) for x in (self.parents, self.bytes, self.owners))
            # hash = hash of what comes before * factor + byte: twice as much of each chain in every round
            hashes = np.concatenate([byte.astype("u8") + np.uint64(1), np.zeros(1, "u8")])
            factor = np.full(self.size + 1, np.uint64(0x9E3779B97F4A7C15))
            factor[-1] = 1
            parent = np.concatenate([np.where(parent < 0, self.size, parent), [self.size]])
            while (parent != self.size).any():
                hashes = hashes + factor * hashes[parent]
                factor = factor * factor[parent]
                parent = parent[parent]
            h = hashes[:-1]
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h ^= h >> np.uint64(31)
            np.minimum.at(out, owner * BINS + (h >> np.uint64(56)).astype(np.int64), h)
        return out.reshape(owners, BINS)


def stretch(data: bytes, forest: Forest, owner: int, reset: int) -> tuple[dict[int, int], int, int]:
    """Parses data by stretches into the forest, but for the last one: its phrases, the phrase begun, and how many bytes it has."""
    whole = len(data) - len(data) % reset
    for at in range(0, whole, reset):
        phrases: dict[int, int] = {}
        grow(data[at : at + reset], phrases, 0)
        forest.add(phrases, owner)
    phrases = {}
    return phrases, grow(data[whole:], phrases, 0), len(data) - whole


def minima(texts: Sequence[str | None], reset: int = RESET) -> np.ndarray:
    """The least hashes of each text."""
    forest = Forest()
    for i, text in enumerate(texts):
        phrases, _, _ = stretch((text or "").encode("utf-8", "surrogatepass"), forest, i, reset)
        forest.add(phrases, i)
    return forest.minima(len(texts))


def minima_of_both(begins: Sequence[str], tails: Sequence[str], others: Sequence[str], reset: int = RESET) -> tuple[np.ndarray, np.ndarray]:
    """The least hashes of begin + tail and of begin + other of each place: what both begin with is parsed once."""
    forest = Forest()
    for i, begin in enumerate(begins):
        phrases, node, used = stretch(begin.encode("utf-8", "surrogatepass"), forest, 3 * i, reset)
        known = len(phrases)
        at = forest.add(phrases, 3 * i)
        for j, end in ((1, tails[i]), (2, others[i])):
            data = end.encode("utf-8", "surrogatepass")
            grow(data[: reset - used], phrases, node)
            added = list(phrases)[known:]
            forest.add(added, 3 * i + j, known, at)
            for k in added:
                del phrases[k]
            rest, _, _ = stretch(data[reset - used :], forest, 3 * i + j, reset)
            forest.add(rest, 3 * i + j)
    both = forest.minima(3 * len(begins)).reshape(-1, 3, BINS)
    return np.minimum(both[:, 0], both[:, 1]), np.minimum(both[:, 0], both[:, 2])


def signatures(least: np.ndarray) -> np.ndarray:
    """A byte for each part, 0 where it is empty."""
    return np.where(least == NONE, 0, 1 + least % BYTE).astype(np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows of signatures: the likeness of the phrase sets behind them, 0 to 1. Equal ones are alike, two empty ones too."""
    some, full = ((a | b) > 0).sum(axis=-1), ((a > 0) & (b > 0)).sum(axis=-1)
    agree = ((a == b) & (a > 0)).sum(axis=-1)
    found = (agree - full / 255) * (255 / 254) / np.maximum(some, 1)
    return np.where(agree == some, 1.0, np.clip(found, 0.0, 1.0))


def hexed(rows: np.ndarray) -> list[str]:
    return [r.tobytes().hex() for r in rows]


def fingerprints(docs: DataFrame, reset: int = RESET) -> DataFrame:
    """doc_id, fingerprint (hexadecimal, two digits for each part): a row for each row of docs(doc_id, text). A null text counts as empty; further columns don't matter."""

    def of(texts: list[str | None]) -> list[list[str]]:
        return [[x for at in range(0, len(texts), TEXTS) for x in hexed(signatures(minima(texts[at : at + TEXTS], reset)))]]

    return map_text(docs, ["doc_id"], of, "fingerprint string")


def compared(pairs: DataFrame, left: str = "fingerprint", right: str = "other_fingerprint", name: str = "near") -> DataFrame:
    """pairs, with the likeness of two columns of fingerprints in `name`; null where one of them is."""

    @F.pandas_udf("double")
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        out = pd.Series(np.nan, index=a.index, dtype="float64").astype("Float64")
        some = a.notna() & b.notna()
        if some.any():
            bytes_of = lambda s: np.frombuffer(bytes.fromhex("".join(s[some])), np.uint8).reshape(-1, BINS)
            out[some] = likeness(bytes_of(a), bytes_of(b))
        return out.where(some, pd.NA)

    return pairs.withColumn(name, near(left, right))


def judged(ids: Sequence[int | None], texts: Sequence[str], following: Sequence[str], reset: int) -> tuple[list[tuple], np.ndarray]:
    """Of texts and those that follow them: LIKENESS but for near_next, and the texts' own signatures."""
    cuts = [len(t) - len(t) // 3 for t in texts]
    others = [f[: len(t) - c] for t, f, c in zip(texts, following, cuts, strict=True)]
    own, edited = (signatures(m) for m in minima_of_both([t[:c] for t, c in zip(texts, cuts, strict=True)], [t[c:] for t, c in zip(texts, cuts, strict=True)], others, reset))
    digests = [hashlib.sha256((t[:c] + o).encode("utf-8", "surrogatepass")).hexdigest() for t, c, o in zip(texts, cuts, others, strict=True)]
    return list(zip(ids, map(len, texts), digests, hexed(own), hexed(edited), likeness(own, edited).tolist(), strict=True)), own


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def by_next(docs: DataFrame, reset: int = RESET) -> DataFrame:
    """The columns of LIKENESS: each text, what an edit makes of it, and the next text in order of falling doc_id (after the last: the first).

    A row for each row of docs(doc_id, text). The edit puts the first code
    points of the next text in place of the last third. Null texts count as empty; an empty text's fingerprint
    is all zeros. Rows without a doc_id come last; rows that share one come in order of their texts' hashes. A single
    row follows itself. Further columns don't matter; a text of any length is one value of one task.

    Texts are dealt by range and shuffled once; a task goes over its range in order. Where
    ranges meet, the first and last texts, two for each task, are written and meet by a join.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    salt = F.xxhash64(F.monotonically_increasing_id())  # rows that are alike may lie in several ranges: any order of them is the same
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"), salt.alias("s"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("h"), F.col("s")]
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    laid = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = [f.split()[0] for f in LIKENESS.split(", ")]
    arrow = pa.schema([pa.field("part", pa.int32()), pa.field("kind", pa.string()), *[pa.field(a, k) for a, k in zip(names, kinds, strict=True)], pa.field("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        edge = lambda kind, doc_id, text: (part, kind, doc_id, None, None, None, None, None, None, text)
        held: list[tuple[int | None, str]] = []
        wait: list[tuple] = []  # the last row judged and its signature, until the next one's is known
        begun = False

        def done(last: bool) -> Iterator[pa.RecordBatch]:
            """Judges the rows held but the last, of which there is no next yet; at the end its own signature is made as well."""
            some = held if last else held[:-1]
            ids, texts = [r[0] for r in some], [r[1] for r in some]
            found, own = judged(ids, texts, [r[1] for r in held[1:]] + [""] * last, reset)
            before = [wait[0][1]] if wait else []
            chain = np.stack([*before, *own])
            known = [wait[0][0]] if wait else []
            next_to = likeness(chain[:-1], chain[1:]).tolist()
            rows = [(part, "done", *r, x, None) for r, x in zip([*known, *found], next_to, strict=False)]
            wait[:] = [(found[-1], own[-1])]
            held[:] = [] if last else held[-1:]
            if rows:
                yield batch_of(rows, arrow)

        for b in batches:
            size = 0
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not begun:
                    begun = True
                    yield batch_of([edge("first", None, text)], arrow)
                held.append((doc_id, text))
                size += len(text)
                if len(held) > 1 and (size >= AT_ONCE or len(held) > TEXTS):
                    yield from done(False)
                    size = 0
        if begun:
            final = held[-1]
            yield from done(True)
            yield batch_of([edge("last", *final)], arrow)

    found = save(laid.mapInArrow(run, f"part int, kind string, {LIKENESS}, text string"), "ranges")
    whole = Window.orderBy("part")
    firsts = found.where("kind = 'first'").select("part", F.col("text").alias("following"))
    after = firsts.select("part", F.coalesce(F.lead("part").over(whole), F.min("part").over(whole.rowsBetween(Window.unboundedPreceding, 0))).alias("_next"))
    meet = found.where("kind = 'last'").select("part", "doc_id", "text").join(after, "part").join(firsts.withColumnRenamed("part", "_next"), "_next")

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc_id, text, following in zip(*[c.to_pylist() for c in b.columns], strict=True):
                rows, own = judged([doc_id], [text], [following], reset)
                yield batch_of([(*rows[0], float(likeness(own, signatures(minima([following], reset)))[0]))], pa.schema(list(arrow)[2:-1]))

    return found.where("kind = 'done'").select(*names).unionAll(meet.select("doc_id", "text", "following").mapInArrow(stitch, LIKENESS))
