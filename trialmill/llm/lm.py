"""Language-model scores by deleted interpolation.

Trigram, bigram, unigram and uniform estimates are mixed; the weights depend on
buckets of the contexts' frequencies (their binary logarithms): one of the last
word's for the lower three, and one of the last two words' for the trigram
against these. They are learned by
expectation-maximisation on a part of the training documents that is left
out of the counts meanwhile. Its rounds go over the left-out tokens' own
counts, in Spark; a start is found on rounded ones first.

Documents are tokenised once into blocks of some hundred thousand tokens, all
of one role (held out, counted, or left out for the weights). A block's n-grams are counted
before anything is shuffled, and travel as sorted arrays of 64-bit hashes with
their counts, cut into key ranges; the totals come back in the same order, so
their keys don't travel twice. Trigrams follow when the others are through. A word that makes up most of the corpus is one
entry for each block. Hashes take the place of n-grams: among 10**9 distinct
ones, a chance of about 3 % for one wrong count.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, release, save, small_batches

HELD, COUNTED, TUNING = 0, 1, 2
BLOCK = 400_000
#: Tokens of the corpus to a key range: bounds what a task holds of it.
RANGE = 1_000_000
BLOCK_FIELDS = "block long, role int, doc_ids array<long>, n_tokens array<int>, tokens binary, words binary"
#: Stand for the end of a text and for its start as a context; no word holds white space.
END, START = xxhash.xxh64_intdigest(b" "), xxhash.xxh64_intdigest(b"\n")


def pack(x: np.ndarray) -> bytes:
    """Compressed by byte planes: the high bytes of small numbers are nearly all zero."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def pack_sorted(x: np.ndarray) -> bytes:
    """Rising 64-bit numbers, as differences."""
    return pack(np.diff(x, prepend=x.dtype.type(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, "<u8"), dtype="u8")


def role_of(doc_id: int | None) -> int:
    rest = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    return HELD if rest % 5 == 1 else TUNING if rest % 5 == 0 else COUNTED


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, A-Z in lower case, and how many each text has. Arrow's ASCII white space is the six of WORD."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = lists.flatten()
    full = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0  # white space at an end gives an empty one
    before = np.concatenate([[0], np.cumsum(full)])
    offsets = lists.offsets.to_numpy()
    return (words if full.all() else words.filter(pa.array(full))), before[offsets[1:]] - before[offsets[:-1]]


def tokenised(docs: DataFrame, block_tokens: int = BLOCK) -> DataFrame:
    """Blocks of documents of one role: their token numbers, and the hash of each number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        held: dict[int, tuple[list, list, list]] = {}  # of each role: ids, token counts, words
        size: dict[int, int] = {}

        def block(role: int) -> pa.RecordBatch:
            nonlocal made
            ids, counts, words = held.pop(role)
            counts, coded = np.concatenate(counts), pc.dictionary_encode(pa.concat_arrays(words))
            hashes = np.array([END, *map(xxhash.xxh64_intdigest, coded.dictionary.cast(pa.binary()).to_pylist())], "u8")
            order = np.argsort(hashes)  # words are numbered in order of their hash, which packs well
            number = np.empty(len(hashes), np.int32)
            number[order] = np.arange(len(hashes), dtype=np.int32)
            tokens, is_word = np.full(counts.sum(), number[0]), np.ones(counts.sum(), bool)
            is_word[np.cumsum(counts) - 1] = False  # the ends
            tokens[is_word] = number[coded.indices.to_numpy() + 1]
            made += 1
            row = {"block": [(part << 32) | made], "role": [role], "doc_ids": [np.concatenate(ids).tolist()], "n_tokens": [counts.tolist()], "tokens": [pack(tokens)], "words": [pack_sorted(hashes[order])]}
            kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row.values(), kinds, strict=True)], names=list(row))

        for b in batches:
            ids = np.array(b.column(0).to_pylist(), dtype=object)
            roles = np.array([role_of(i) for i in ids], np.int8)
            words, n = split(b.column(1))
            for role in np.unique(roles).tolist():
                mine = roles == role
                own, counts, own_ids = words.filter(pa.array(np.repeat(mine, n))), n[mine] + 1, ids[mine]
                ends = np.concatenate([[0], np.cumsum(counts)])
                at = 0
                while at < len(counts):  # a block takes texts until it is full
                    parts = held.setdefault(role, ([], [], []))
                    room = block_tokens - size.get(role, 0)
                    to = min(int(np.searchsorted(ends, ends[at] + room)), len(counts))
                    for x, more in zip(parts, (own_ids[at:to], counts[at:to], own.slice(ends[at] - at, ends[to] - ends[at] - (to - at))), strict=True):
                        x.append(more)
                    size[role] = size.get(role, 0) + int(ends[to] - ends[at])
                    at = to
                    if size[role] >= block_tokens:
                        size[role] = 0
                        yield block(role)
        for role in list(held):
            yield block(role)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, BLOCK_FIELDS)


@dataclass
class Grams:
    """The n-grams of one block: where each token's are, and their keys in the order that travels."""

    tokens: np.ndarray
    pair_of: np.ndarray  # of each token, its bigram's number
    context_of: np.ndarray  # of each bigram, its context's number; -1 at the start of a text
    hashes: np.ndarray  # of each bigram
    keys: np.ndarray  # sorted
    order: np.ndarray  # of each sorted key: the unigram's number, or the bigram's number behind all of those
    size: int  # unigrams

    @classmethod
    def of(cls, tokens: np.ndarray, n_tokens: np.ndarray, words: np.ndarray) -> Grams:
        before = np.concatenate([[-1], tokens[:-1]]).astype(np.int64)
        before[firsts(n_tokens)] = -1
        size = len(words)
        pair_of, pairs = pd.factorize((before + 1) * size + tokens)
        pair_of = pair_of.astype(np.int32)
        context, word = pairs // size - 1, pairs % size
        hashes = together(np.where(context < 0, np.uint64(START), words[context]), words[word])
        one = np.uint64(1)  # the last bit tells bigrams from unigrams
        keys = np.concatenate([words & ~one, hashes | one])
        order = np.argsort(keys)
        return cls(tokens, pair_of, context, hashes, keys[order], order, size)

    def counts(self) -> np.ndarray:
        own = np.concatenate([np.bincount(self.tokens, minlength=self.size), np.bincount(self.pair_of, minlength=len(self.context_of))])
        return own[self.order].astype(np.int32)


def firsts(n_tokens: np.ndarray) -> np.ndarray:
    """Where the texts of a block start."""
    return np.concatenate([[0], np.cumsum(n_tokens)[:-1]]).astype(np.int64)


def together(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """One hash of two."""
    mixed = (left * np.uint64(0x9E3779B97F4A7C15) ^ (right + (left >> np.uint64(29)))) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    return mixed * np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Triples:
    """The trigrams of one block, as Grams has the shorter ones; the first token of a text has none."""

    triple_of: np.ndarray  # of each token; -1 for none
    context_of: np.ndarray  # of each trigram, its first two tokens' bigram
    keys: np.ndarray
    order: np.ndarray

    @classmethod
    def of(cls, g: Grams, n_tokens: np.ndarray, words: np.ndarray) -> Triples:
        before = np.concatenate([[-1], g.pair_of[:-1]]).astype(np.int64)
        before[firsts(n_tokens)] = -1
        some = before >= 0
        found, triples = pd.factorize(before[some] * g.size + g.tokens[some])
        triple_of = np.full(len(before), -1, np.int64)
        triple_of[some] = found
        context, word = triples // g.size, triples % g.size
        keys = together(g.hashes[context], words[word]) | np.uint64(1)
        order = np.argsort(keys)
        return cls(triple_of, context, keys[order], order)

    def counts(self) -> np.ndarray:
        return np.bincount(self.triple_of[self.triple_of >= 0], minlength=len(self.context_of))[self.order].astype(np.int32)


def read_block(row) -> tuple[Grams, np.ndarray, np.ndarray]:
    """The grams of a block, its texts' sizes and its words."""
    sizes, words = np.asarray(row.n_tokens), unpack_sorted(row.words)
    return Grams.of(unpack(row.tokens, "<i4"), sizes, words), sizes, words


def sent(blocks: DataFrame, ranges: int, longest: int) -> DataFrame:
    """(range, block, role, keys, counts): each block's n-grams, of one and two tokens or (longest = 3) of three, cut by key range."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples():
                g, sizes, words = read_block(row)
                g = Triples.of(g, sizes, words) if longest == 3 else g
                counts = g.counts()
                where = (g.keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
                cuts = np.searchsorted(where, np.arange(ranges + 1, dtype="u8"))
                yield pd.DataFrame(
                    [(i, row.block, row.role, pack_sorted(g.keys[a:z]), pack(counts[a:z])) for i, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)) if z > a],
                    columns=["range", "block", "role", "keys", "counts"],
                )

    return blocks.mapInPandas(run, "range int, block long, role int, keys binary, counts binary")


def totalled(parts: DataFrame, ranges: int) -> DataFrame:
    """(block, range, counted, all): totals over the counted (for blocks that are left out of them) and over all training documents, in the order in which a block sent its keys.

    A further row for each range, of block -1, has the number of distinct training tokens in `known`.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        keys = [unpack_sorted(k) for k in rows["keys"]]
        cuts = np.cumsum([0, *map(len, keys)])
        at, distinct = pd.factorize(np.concatenate(keys))
        totals = np.zeros((2, len(distinct)), np.int64)
        for role, a, z, counts in zip(rows.role, cuts, cuts[1:], rows["counts"], strict=False):
            if role != HELD:
                n = unpack(counts, "<i4")
                totals[1, at[a:z]] += n  # keys of a block are distinct
                if role == COUNTED:
                    totals[0, at[a:z]] += n
        known = int(((totals[1] > 0) & (distinct % 2 == 0)).sum())
        out = [(-1, rows.range.iloc[0], b"", b"", known)]
        own = lambda i, a, z: pack(totals[i, at[a:z]])
        out += [(block, rows.range.iloc[0], own(0, a, z) if role == TUNING else b"", own(1, a, z), 0) for block, role, a, z in zip(rows.block, rows.role, cuts, cuts[1:], strict=False)]
        return pd.DataFrame(out, columns=["block", "range", "counted", "all", "known"])

    # a partition for each range: a task's share doesn't grow with the corpus
    n = max(ranges, int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return parts.repartition(n, "range").groupBy("range").applyInPandas(run, "block long, range int, counted binary, all binary, known long")


def beside(blocks: DataFrame, totals: DataFrame, triples: DataFrame, which: str) -> DataFrame:
    """Each block with its pieces of one kind of totals, as many as it has key ranges; those of trigrams in `more`, null where it has none."""
    pieces = lambda df, name: df.where("block >= 0").groupBy("block").agg(F.collect_list(F.struct("range", F.col(which).alias("n"))).alias(name))
    return blocks.join(pieces(totals, "pieces"), "block").join(pieces(triples, "more"), "block", "left")


def placed(pieces, order: np.ndarray) -> np.ndarray:
    """Totals in the order of the n-grams' numbers."""
    found = np.zeros(len(order), np.int64)
    if len(order):
        found[order] = np.concatenate([unpack(p["n"], "<i8") for p in sorted(pieces, key=lambda p: p["range"])])
    return found


def looked_up(row) -> tuple[Grams, Triples, np.ndarray, np.ndarray, np.ndarray]:
    """The grams of a block, and the totals of its unigrams, bigrams and trigrams."""
    g, sizes, words = read_block(row)
    t = Triples.of(g, sizes, words)
    found = placed(row.pieces, g.order)
    return g, t, found[: g.size], found[g.size :], placed(row.more, t.order)


def bucket(n: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else one more than its count's binary logarithm."""
    return np.where(n > 0, np.floor(np.log2(np.maximum(n, 1))) + 1, 0).astype(np.int64)


def tuning_cells(joined: DataFrame, start_count: int) -> DataFrame:
    """(bucket, context, pair, word, more, two, triple, n): how many left-out tokens have which counts: of their last word, bigram and unigram, and of their last two words and trigram.

    bucket and more are those of the two contexts; more is -1 where a token has no trigram.
    """
    names = ["bucket", "context", "pair", "word", "more", "two", "triple"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples():
                g, t, ones, twos, threes = looked_up(row)
                # a row for each trigram, and for each bigram that starts a text; then for each tuple of counts
                has = t.triple_of >= 0
                pair = np.zeros(len(threes), np.int64)
                pair[t.triple_of[has]] = g.pair_of[has]
                first, times = np.unique(g.pair_of[~has], return_counts=True)
                none = np.zeros(len(first), np.int64)
                at, two, triple = np.concatenate([pair, first]), np.concatenate([twos[t.context_of], none]), np.concatenate([threes, none])
                n = np.concatenate([np.bincount(t.triple_of[has], minlength=len(threes)), times])
                word = np.zeros(len(twos), np.int64)
                word[g.pair_of] = g.tokens
                context = np.where(g.context_of < 0, start_count, ones[g.context_of])[at]
                more = np.concatenate([bucket(twos[t.context_of]), none - 1])
                columns = {"bucket": bucket(context), "context": context, "pair": twos[at], "word": ones[word[at]], "more": more, "two": two, "triple": triple}
                key = np.zeros(len(at), "u8")
                for c in columns.values():
                    key = together(key, c.astype("u8"))
                of, distinct = pd.factorize(key)
                one = np.zeros(len(distinct), np.int64)
                one[of[::-1]] = np.arange(len(of))[::-1]  # the first place of each
                yield pd.DataFrame({c: x[one] for c, x in columns.items()} | {"n": np.bincount(of, weights=n).astype(np.int64)})

    cells = joined.mapInPandas(run, ", ".join(f"{c} long" for c in [*names, "n"]))
    return cells.groupBy(*names).agg(F.sum("n").alias("n"))


def rounded(cells: DataFrame, n: int, v: int) -> DataFrame:
    """(bucket, two, one, n): cells with their estimates as half powers of two of the ratio to the uniform one, -999 for none: some thousand rows."""
    power = lambda x: F.coalesce(F.round(2 * F.log2(F.when(x > 0, x * F.lit(float(v + 1))))), F.lit(-999)).cast("long")
    two, one = F.col("pair") / F.greatest("context", F.lit(1)), F.col("word") / F.lit(max(n, 1))
    return cells.groupBy("bucket", power(two).alias("two"), power(one).alias("one")).agg(F.sum("n").alias("n"))


def weight(mix: np.ndarray, bucket: str, i: int) -> Column:
    return F.get(F.lit([float(x) for x in mix[:, i]]), F.col(bucket).cast("int"))


def estimates(n: int, v: int) -> list[Column]:
    """Of a row of tuning_cells(): the bigram, unigram and uniform estimates."""
    return [F.col("pair") / F.greatest("context", F.lit(1)), F.col("word") / F.lit(max(n, 1)), F.lit(1.0 / (v + 1))]


def settled(cells: DataFrame, at: str, given: list[Column], mix: np.ndarray, close: float, rounds: int = 36) -> np.ndarray:
    """mix, of a bucket `at` and estimates `given`, after further rounds of expectation-maximisation over all cells, until none changes a weight by more than `close`.

    A round is one aggregation; a row for each bucket comes to the driver.
    Every third round starts from where the two before it lead.
    """
    seen: set[int] = set()
    path = [mix]
    some = [F.col(f"p{i}") for i in range(len(given))]
    for _ in range(rounds):
        if len(path) == 3:
            path = [leap(*path)]
        now = path[-1]
        x = cells.select(F.col(at).alias("b"), "n", *[(weight(now, at, i) * e).alias(f"p{i}") for i, e in enumerate(given)]).withColumn("each", F.col("n") / sum(some[1:], some[0]))
        sums = x.groupBy("b").agg(F.sum("n").alias("n"), *[F.sum(F.col("each") * p).alias(f"s{i}") for i, p in enumerate(some)]).collect()
        new = now.copy()
        for r in sums:
            seen.add(r.b)
            new[r.b] = mixed(np.array([r[f"s{i}"] for i in range(len(given))]), r.n, r.b)
        path.append(new)
        if np.abs(new - now).max() <= close:
            break
    mix = path[-1].copy()
    for b in range(1, len(mix)):
        if b not in seen and seen and b > min(seen):
            mix[b] = mix[b - 1]
    return mix


def leap(first: np.ndarray, second: np.ndarray, third: np.ndarray) -> np.ndarray:
    """Where three successive weights of each bucket lead, by squared extrapolation; the third itself where that leaves the simplex."""
    step = second - first
    bend = third - second - step
    size = np.linalg.norm(bend, axis=1, keepdims=True)
    far = np.maximum(np.linalg.norm(step, axis=1, keepdims=True) / np.maximum(size, 1e-15), 1)
    ahead = first + 2 * far * step + far**2 * bend
    return np.where((size > 1e-12) & (ahead >= 0).all(axis=1, keepdims=True), ahead, third)


def mixed(sums: np.ndarray, n: float, b: int) -> np.ndarray:
    """Weights from expected counts, a thousandth of a count added to each; contexts never seen give their n-grams, which are the first, no weight."""
    few = np.array([0.0 if b == 0 else 1e-3, *[1e-3] * (len(sums) - 1)])
    w = (sums + few) / (n + few.sum())
    return w / w.sum()


def weights(cells: pd.DataFrame, rounds: int = 150) -> np.ndarray:
    """A row of weights (bigram, unigram, uniform) for each of 64 buckets, by expectation-maximisation.

    A bucket without left-out tokens takes those of the next lower one that has
    some; the first, for contexts never seen, has no bigram weight.
    """
    out = np.tile([0.4, 0.4, 0.2], (64, 1))
    last = np.array([0.0, 0.8, 0.2])
    for b in range(64):
        some = cells[cells.bucket == b]
        if len(some):
            estimate = lambda x: np.where(x > -900, 2.0 ** (x / 2), 0.0)
            p = np.stack([estimate(some.two.to_numpy(dtype=float)), estimate(some.one.to_numpy(dtype=float)), np.ones(len(some))], axis=1)
            n = some.n.to_numpy(dtype=float)
            w = np.array([0.0, 0.8, 0.2]) if b == 0 else np.array([0.4, 0.4, 0.2])
            path = [w]
            for _ in range(rounds):
                if len(path) == 3:
                    path = [leap(*[x[None] for x in path])[0]]
                part = p * path[-1]
                path.append(mixed((n / part.sum(axis=1)) @ part, n.sum(), b))
            last = path[-1]
        out[b] = last
    return out


def scores(joined: DataFrame, mix: np.ndarray, more: np.ndarray, start_count: int, n: int, v: int) -> DataFrame:
    """The contract's columns, a row for each document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples():
                g, t, ones, twos, threes = looked_up(row)
                sizes = np.asarray(row.n_tokens)
                context = np.where(g.context_of < 0, start_count, ones[g.context_of])
                word = np.zeros(len(twos), np.int64)
                word[g.pair_of] = g.tokens
                w = mix[bucket(context)]
                p = (w[:, 0] * twos / np.maximum(context, 1) + w[:, 1] * ones[word] / max(n, 1) + w[:, 2] / (v + 1))[g.pair_of]
                some = np.flatnonzero(t.triple_of >= 0)
                two = twos[t.context_of]
                high, estimate = more[bucket(two), 0], threes / np.maximum(two, 1)
                at = t.triple_of[some]
                p[some] = high[at] * estimate[at] + (1 - high[at]) * p[some]
                base = np.log10((ones + 0.5) / (n + 0.5 * (v + 1)))
                add = lambda x: np.add.reduceat(x, firsts(sizes))
                yield pd.DataFrame(
                    {
                        "doc_id": pd.array(row.doc_ids, "Int64"),
                        "held_out": row.role == HELD,
                        "n_tokens": sizes.astype(np.int64),
                        "n_known": add((ones[g.tokens] > 0).astype(np.int64)),
                        "train_tokens": n,
                        "base_score": add(base[g.tokens]),
                        "score": add(np.log10(p)),
                    }
                )

    return joined.mapInPandas(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score(docs: DataFrame, block_tokens: int = BLOCK, range_tokens: int = RANGE, close: float = 1e-3) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: a row for each row of docs(doc_id, text).

    Learns from rows whose crc32(doc_id as text) mod 5 is not 1 (a null id
    counts as the empty text); of those, remainder 0 is left out of the counts
    while the weights are learned. Null texts count as empty: one end token.
    Repeated rows count as often as they stand. Without training rows both
    scores are those of the uniform estimate. Weights are learned until a round changes
    none by more than `close`. Blocks go to Python one or two at a time: the session's
    Arrow batches are lowered meanwhile.
    """
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    before = conf.get(name)
    small_batches(docs.sparkSession)
    try:
        return _score(docs, block_tokens, range_tokens, close)
    finally:
        conf.set(name, before)


def _score(docs: DataFrame, block_tokens: int, range_tokens: int, close: float) -> DataFrame:
    blocks = save(tokenised(docs, block_tokens), "blocks")
    tokens = F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)
    by_role = {r.role: r for r in blocks.select("role", tokens.alias("n"), F.size("doc_ids").alias("d")).groupBy("role").agg(F.sum("n").alias("n"), F.sum("d").alias("d")).collect()}
    n = {r: by_role[r].n if r in by_role else 0 for r in (HELD, COUNTED, TUNING)}
    d = {r: by_role[r].d if r in by_role else 0 for r in (HELD, COUNTED, TUNING)}
    ranges = max(1, -(-sum(n.values()) // range_tokens))
    spark = docs.sparkSession
    totals = save(totalled(sent(blocks, ranges, 2), ranges), "totals")
    release(spark)
    triples = save(totalled(sent(blocks, ranges, 3), ranges), "triples")
    release(spark)
    known = totals.where("block < 0").agg(F.coalesce(F.sum("known"), F.lit(0))).first()[0]
    cells = save(tuning_cells(beside(blocks.where(F.col("role") == TUNING), totals, triples, "counted"), d[COUNTED]), "cells")
    given = estimates(n[COUNTED], known)
    few = save(cells.groupBy("bucket", "context", "pair", "word").agg(F.sum("n").alias("n")), "lower")  # what the lower three depend on
    mix = settled(few, "bucket", given, weights(rounded(few, n[COUNTED], known).toPandas()), close)
    forget(few)
    lower = sum((weight(mix, "bucket", i) * e for i, e in enumerate(given)), F.lit(0.0))
    upper = cells.where("more >= 0").select("more", (F.col("triple") / F.greatest("two", F.lit(1))).alias("high"), lower.alias("low"), "n")
    upper = save(upper, "upper")
    forget(cells)
    start = np.array([[0.0, 1.0], *[[0.5, 0.5]] * 63])
    more = settled(upper, "more", [F.col("high"), F.col("low")], start, close)
    forget(upper)
    train = n[COUNTED] + n[TUNING]
    out = save(scores(beside(blocks, totals, triples, "all"), mix, more, d[COUNTED] + d[TUNING], train, known), "scores")
    for x in (blocks, totals, triples):
        forget(x)
    return out
