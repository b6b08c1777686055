"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most four bits apart have a common variant at most two
bits from each. Every fingerprint therefore emits its 2081 variants within two
bits, variants are shuffled, and fingerprints that meet at a variant are
compared and linked. Whoever shares a variant is within four bits by the triangle
inequality, so a chain through a variant's fingerprints loses no link between groups,
and no group is expanded into pairs. A variant has 2081 fingerprints at most,
as each is there once.

Variants are dealt by their first `key_bits` bits. A fingerprint has variants
under 1 + b + b(b-1)/2 keys of b bits (79 of 12), and a row for each key stands
for all of its variants under it: the receiving task lists them again. The
variants themselves never cross the network. The more fingerprints there are,
the longer the keys, so that a key has about PER_KEY of them at any size. A task
lists AT_ONCE variants at a time; a key with more is dealt again, by its next bits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, WORDS, apart, forget, give_back, map_text, save

RADIUS = 4
#: Variants that a task lists at once, at some 60 bytes each. Workers that other stages have left large list them too.
AT_ONCE = 1_000_000
#: Bits by which a key with more variants is dealt again.
MORE_BITS = 4
#: Fingerprints under a key, on average, at most.
PER_KEY = 8000


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """A bit is set if it is set in over half of the XXH64 (seed 42) hashes of the word shingles; no words: zero."""
    words = WORDS.findall((text or "").translate(LOWER))
    if not words:
        return 0
    line = " ".join(words).encode("utf-8", "surrogatepass")
    starts = np.cumsum([0, *[len(w) + 1 for w in (words if line.isascii() else [w.encode("utf-8", "surrogatepass") for w in words])]]).tolist()
    size = min(shingle, len(words))
    hash64 = xxhash.xxh64_intdigest
    hashes = np.array([hash64(line[a : b - 1], 42) for a, b in zip(starts, starts[size:], strict=False)], "<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):  # bits of a bounded part at a time
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, text_hash, fp long (the 64 bits as a signed number), a row for each row of docs(doc_id, text)."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    return map_text(rows, ["doc_id", "text_hash"], lambda texts: [np.array([fingerprint(t, shingle) for t in texts], "u8").view("i8")], "fp long")


@lru_cache(maxsize=256)
def masks(bits: range, most: int) -> np.ndarray:
    """All words with at most `most` of the given bits set."""
    return np.array([sum(1 << b for b in x) for n in range(most + 1) for x in combinations(bits, n)], "u8")


def keyed(fps: DataFrame, key_bits: int, half: int) -> DataFrame:
    """(key, fp): a row for each key under which a fingerprint has variants."""
    flips = masks(range(64 - key_bits, 64), half).view("i8").tolist()
    key = F.shiftrightunsigned(F.col("fp").bitwiseXOR(F.col("flip")), 64 - key_bits).cast("long")
    return fps.withColumn("flip", F.explode(F.array(*[F.lit(x) for x in flips]))).select(key.alias("key"), "fp")


def meet(key: np.ndarray, fp: np.ndarray, key_bits: int, half: int) -> np.ndarray:
    """Links (first, other) among fingerprints that share a variant under the same key and differ in 2 * half bits at most; one for each fingerprint and key at most.

    The rows must hold all fingerprints of their keys.
    """
    low = np.uint64((1 << (64 - key_bits)) - 1)
    top = key.astype("u8") << np.uint64(64 - key_bits)
    spent = np.bitwise_count((fp ^ top) & ~low)
    variants, owners = [], []
    for n in range(half + 1):
        flips, mine = masks(range(64 - key_bits), half - n), np.flatnonzero(spent == n)
        variants.append(((fp[mine] & low | top[mine])[:, None] ^ flips).ravel())
        owners.append(np.repeat(mine.astype(np.int32), len(flips)))
    v, o = np.concatenate(variants), np.concatenate(owners)
    order = np.argsort(v)
    v, o = v[order], o[order]
    same = v[1:] == v[:-1]
    a, b = o[:-1][same], o[1:][same]  # neighbours chain the fingerprints of each variant
    if not len(a):
        return np.zeros((0, 2), "u8")
    pairs = np.unique(np.minimum(a, b).astype(np.int64) * len(fp) + np.maximum(a, b))
    a, b = pairs // len(fp), pairs % len(fp)
    near = np.bitwise_count(fp[a] ^ fp[b]) <= 2 * half
    a, b = a[near], b[near]
    label = np.arange(len(fp))
    while True:  # the least row of each chain, chains of chains included
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if np.array_equal(label, before):
            break
    linked = np.flatnonzero(label != np.arange(len(fp)))
    return np.unique(np.stack([fp[label[linked]], fp[linked]], axis=1), axis=0)


def spent_on(key: np.ndarray, fp: np.ndarray, key_bits: int) -> np.ndarray:
    """Bits in which each fingerprint's first key_bits differ from its key."""
    return np.bitwise_count((fp >> np.uint64(64 - key_bits)) ^ key.astype("u8"))


def meet_bounded(key: np.ndarray, fp: np.ndarray, key_bits: int, half: int, most: int) -> Iterator[np.ndarray]:
    """The links of meet(), in parts, for rows in order of their keys: as many keys at once as have `most` variants; of a key that has more, as many parts."""
    spent = spent_on(key, fp, key_bits)
    total = np.cumsum(np.array([len(masks(range(64 - key_bits), half - n)) for n in range(half + 1)])[spent])
    ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))
    start, n = 0, 0
    while start < len(key):
        fit = int(np.searchsorted(total[ends - 1], (total[start - 1] if start else 0) + most, side="right"))
        alone = fit <= n and key_bits < 64
        n = max(fit, n + 1)
        rows = slice(start, int(ends[n - 1]))
        start = rows.stop
        if not alone:
            yield meet(key[rows], fp[rows], key_bits, half)
            continue
        bits = min(key_bits + MORE_BITS, 64)
        low = np.uint64((1 << (64 - key_bits)) - 1)
        top = key[rows].astype("u8") << np.uint64(64 - key_bits)
        longer, owners = [], []
        for k in range(half + 1):
            flips, mine = masks(range(64 - bits, 64 - key_bits), half - k), np.flatnonzero(spent[rows] == k)
            longer.append(((fp[rows][mine] & low | top[mine])[:, None] ^ flips).ravel() >> np.uint64(64 - bits))
            owners.append(np.repeat(fp[rows][mine], len(flips)))
        keys, fps = np.concatenate(longer), np.concatenate(owners)
        order = np.argsort(keys)
        yield from meet_bounded(keys[order], fps[order], bits, half, most)


def meet_all(batches: Iterable[tuple[np.ndarray, np.ndarray]], key_bits: int, half: int, most: int | None = None) -> Iterator[np.ndarray]:
    """The links of meet(), in parts, for batches of (key, fp) in order of the keys, that hold all fingerprints of their keys."""
    most = AT_ONCE if most is None else most
    each = np.array([len(masks(range(64 - key_bits), half - n)) for n in range(half + 1)])
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for key, fp in batches:
        held.append((key, fp))
        size += int(each[spent_on(key, fp, key_bits)].sum())
        if size < most:
            continue
        key, fp = (np.concatenate(x) for x in zip(*held, strict=True))
        end = int(np.searchsorted(key, key[-1]))  # the last key may go on
        if end:
            yield from meet_bounded(key[:end], fp[:end], key_bits, half, most)
        held, size = [(key[end:], fp[end:])], int(each[spent_on(key[end:], fp[end:], key_bits)].sum())
    if held:
        yield from meet_bounded(*(np.concatenate(x) for x in zip(*held, strict=True)), key_bits, half, most)


def bits_for(fingerprints: int, half: int = RADIUS // 2, per_key: int = PER_KEY) -> int:
    """Key bits with which so many fingerprints come to per_key under a key, on average."""
    return next(b for b in range(12, 41) if b == 40 or fingerprints * len(masks(range(b), half)) <= per_key << b)


def links(fps: DataFrame, radius: int = RADIUS, key_bits: int | None = None) -> DataFrame:
    """(a, b): links among distinct fingerprints whose components are those of all pairs within the radius.

    Every link joins fingerprints of one component; fps(fp) holds each
    fingerprint once. Tasks take whole keys, AT_ONCE variants at a time. The radius
    is even: two balls of half an odd one don't meet for every pair.
    """
    if radius < 0 or radius % 2:
        raise ValueError(f"the radius must be even, not {radius}")
    key_bits = bits_for(fps.count(), radius // 2) if key_bits is None else key_bits
    half = radius // 2

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for found in meet_all(((b.key.to_numpy(), b.fp.to_numpy().view("u8")) for b in batches), key_bits, half):
            yield pd.DataFrame({"a": found[:, 0].view("i8"), "b": found[:, 1].view("i8")})
        give_back()

    n = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = keyed(fps, key_bits, half).repartition(n, "key").sortWithinPartitions("key")
    return rows.mapInPandas(run, "a long, b long")


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node, root): the least node reachable from each node that has a link.

    Alternates large and small stars until no link changes; each round's links
    are written to the shared folder. Nodes with many links are joined on keys
    whose large partitions Spark may split, and minima are partial sums.
    """
    now = save(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct(), "links")
    print_of = lambda df: tuple(df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")), F.lit(0))).first())
    seen = print_of(now)
    for _ in range(most_rounds):
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        # written first: a join of an exchange and an aggregate can't be split where one node has most links
        least = save(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m")), "least")
        large = both.where("v > u").join(least, F.col("u") == F.col("_u")).select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = save(large, "large")
        low = save(large.groupBy("hi").agg(F.min("lo").alias("m")).select(F.col("hi").alias("_h"), "m"), "low")
        small = large.join(low, F.col("hi") == F.col("_h")).select(F.explode(F.array(F.struct(F.col("hi"), F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e")).select("e.*").where("hi <> lo").distinct()
        after = save(small, "links")
        for x in (now, least, large, low):
            forget(x)
        now, was, seen = after, seen, print_of(after)
        if was == seen:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = RADIUS, key_bits: int | None = None) -> DataFrame:
    """doc_id, fp, root (of its class of fingerprints), fingerprint (16 hex digits), component_id: a row for each row of docs(doc_id, text).

    component_id is the smallest doc_id among the documents reachable by links,
    the document itself included. Null and empty texts, and texts of white
    space, have fingerprint zero and are linked like any other. Rows that
    repeat a doc_id stay and share its component; rows without a doc_id are
    fingerprinted, link others, and never name a component.
    """
    marked = save(fingerprints(docs, shingle), "fingerprints")
    classes = save(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = components(links(classes.select("fp"), radius, key_bits))
    placed = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    placed = save(placed, "placed")
    named = save(placed.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "_r"), "named")
    of_fp = placed.join(named, F.col("root") == F.col("_r")).select(F.col("fp").alias("_fp"), "root", "component_id")
    out = marked.join(of_fp, F.col("fp") == F.col("_fp"))
    return out.select(*[c for c in marked.columns if c != "fp"], "fp", "root", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, **options: int) -> DataFrame:
    """docs without the near copies: of each component one row stays, that of the smallest doc_id.

    Rows of different components that share a doc_id all stay; of rows of one
    component that share the smallest, the text of the least hash stays, once.
    Rows without a doc_id all stay: nothing tells which of them to keep.
    Texts aren't compared or shuffled to find this out, but meet the list of
    what goes; only rows that are there twice over meet each other.
    """
    docs, back = apart(docs, ["doc_id", "text"])
    key = ["doc_id", "text_hash"]
    rows = near_duplicates(docs, **options).where("doc_id is not null").groupBy(*key, "root").agg(F.count(F.lit(1)).alias("_n"))
    rows = save(rows, "rows")
    first = save(rows.groupBy("root").agg(F.min(F.struct(*key)).alias("_first")).withColumnRenamed("root", "_root"), "first")
    told = rows.join(first, F.col("root") == F.col("_root")).withColumn("_stays", F.struct(*key) == F.col("_first"))
    told = save(told.where((~F.col("_stays")) | (F.col("_n") > 1)).select(F.col("doc_id").alias("_i"), F.col("text_hash").alias("_h"), "_stays"), "told")
    small = told.count() <= 1_000_000
    hashed = docs.withColumn("_th", F.xxhash64(F.col("text").cast("string")))
    on = lambda t: (F.col("doc_id") == F.col("_i")) & (F.col("_th") == F.col("_h"))
    met = F.broadcast(told) if small else told  # 17 bytes a row
    kept = hashed.join(met, on(told), "left_anti").select(*docs.columns)
    twice = told.where("_stays")
    again = hashed.join(F.broadcast(twice) if small else twice, on(twice), "left_semi").dropDuplicates(["doc_id", "_th"]).select(*docs.columns)
    for x in (rows, first):
        forget(x)
    return back(kept.unionByName(again))
