"""Phrase fingerprints, whitening and hard negatives against brute force on small tables."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialmill.llm import lzprint, negatives, topk, whitening

VECTORS = "vec_id long, embedding array<float>, label int"


def phrases(data):
    """Every phrase of a byte string, by a loop."""
    known, start, end = set(), 0, 1
    while end <= len(data):
        if data[start:end] not in known:
            known.add(data[start:end])
            start = end
        end += 1
    return known


# --- phrase fingerprints ---------------------------------------------------------------------------------------------


def test_parse_is_that_of_a_loop():
    rng = np.random.default_rng(3)
    for text in ["", "a", "aa", "abababab", "é" * 40, "x " * 500, *["".join(rng.choice(list("ab cd"), 300)) for _ in range(10)]]:
        data, known = text.encode(), {}
        lzprint.grow(data, known, 0)
        found = {}
        for key, number in known.items():
            found[number] = found.get(key & ~255, b"") + bytes([key & 255])
        assert set(found.values()) == phrases(data) and len(found) == len(set(found.values()))


def test_what_texts_share_is_parsed_once_with_the_same_result():
    rng = np.random.default_rng(4)
    words = "the of river stone bridge under walk light paper green".split()
    for _ in range(20):
        begin, one, other = (" ".join(rng.choice(words, int(rng.integers(0, 60)))) for _ in range(3))
        for reset in (16, 100, 1 << 20):
            a, b = lzprint.minima_of_both([begin], [one], [other], reset)
            assert (a == lzprint.minima([begin + one], reset)).all() and (b == lzprint.minima([begin + other], reset)).all()


def test_likeness_comes_near_that_of_the_phrase_sets():
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(400)]
    errors = []
    for share in (0.0, 0.3, 0.6, 0.9):
        for _ in range(5):
            one = rng.choice(words, 500)
            other = np.where(np.arange(500) < 500 * share, one, rng.choice(words, 500))
            one, other = " ".join(one), " ".join(other)
            a, b = phrases(one.encode()), phrases(other.encode())
            x, y = (lzprint.signatures(lzprint.minima([t]))[0] for t in (one, other))
            errors.append(float(lzprint.likeness(x, y)) - len(a & b) / len(a | b))
    assert abs(np.mean(errors)) < 0.03 and np.abs(errors).max() < 0.12
    zero, some = np.zeros(lzprint.BINS, np.uint8), lzprint.signatures(lzprint.minima(["some words"]))[0]
    assert lzprint.likeness(zero, zero) == 1 and lzprint.likeness(zero, some) == 0 and lzprint.likeness(some, some) == 1


def next_by_loop(rows):
    """(doc_id, text, edited, following) of each row, in order of falling doc_id."""
    out = []
    for i, (doc_id, text) in enumerate(rows):
        text, following = text or "", rows[(i + 1) % len(rows)][1] or ""
        k = len(text) // 3
        out.append((doc_id, text, text[: len(text) - k] + following[:k], following))
    return out


def test_texts_meet_the_next_ones(spark):
    rng = np.random.default_rng(6)
    texts = ["", "a", "ab", "abc", "é€😀 ü" * 7, None, "x " * 30_000, *[" ".join(rng.choice("the of river stone bridge under".split(), int(rng.integers(1, 80)))) for _ in range(60)]]
    texts += [texts[-1], texts[-1]]
    docs = spark.createDataFrame([(3 * i, t, f"n{i}", "clash") for i, t in enumerate(texts)], "doc_id long, text string, part string, kind string").repartition(5)
    rows = sorted([(3 * i, t) for i, t in enumerate(texts)], reverse=True)
    got = {r.doc_id: r for r in lzprint.by_next(docs).collect()}
    assert len(got) == len(rows)
    sign = lambda t: lzprint.signatures(lzprint.minima([t]))[0]
    for doc_id, text, edited, following in next_by_loop(rows):
        r = got[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (bytes.fromhex(r.fingerprint), bytes.fromhex(r.edited_fingerprint)) == (sign(text).tobytes(), sign(edited).tobytes())
        assert r.near_edited == float(lzprint.likeness(sign(text), sign(edited))) and r.near_next == float(lzprint.likeness(sign(text), sign(following)))
    assert got[3 * (len(texts) - 1)].fingerprint == got[3 * (len(texts) - 2)].fingerprint
    prints = {r.doc_id: r.fingerprint for r in lzprint.fingerprints(docs).collect()}
    assert prints == {i: r.fingerprint for i, r in got.items()}
    pair = lzprint.compared(spark.createDataFrame([(prints[30], prints[33]), (prints[30], None)], "fingerprint string, other_fingerprint string")).collect()
    assert pair[0].near == float(lzprint.likeness(sign(texts[10]), sign(texts[11]))) and pair[1].near is None


def test_texts_without_and_with_repeated_ids(spark):
    fields = "doc_id long, text string"
    assert lzprint.by_next(spark.createDataFrame([], fields)).count() == 0
    alone = lzprint.by_next(spark.createDataFrame([(7, "abcdef")], fields)).collect()
    assert [(r.doc_id, r.edited_sha256, r.near_next) for r in alone] == [(7, hashlib.sha256(b"abcdab").hexdigest(), 1.0)]
    rows = [(5, "the same text")] * 40 + [(None, "no id here"), (None, None), (1, "one")]
    got = lzprint.by_next(spark.createDataFrame(rows, fields).repartition(4)).collect()
    assert len(got) == len(rows) and sum(r.doc_id is None for r in got) == 2
    same = [r for r in got if r.doc_id == 5]
    assert len({r.fingerprint for r in same}) == 1 and sum(r.edited_sha256 == hashlib.sha256(b"the same the ").hexdigest() for r in same) == 39


# --- whitening -------------------------------------------------------------------------------------------------------


def whitened_by_loop(x):
    """Over integer rows: n, deviations, eigenvalues and eigenvectors of the distinct rows' covariance, the centre."""
    fit = np.unique(x, axis=0)
    n, sums = len(fit), [int(s) for s in fit.sum(axis=0)]
    centre = np.array([s / n for s in sums])
    values, vectors = np.linalg.eigh(np.cov((fit - centre).T, bias=True).reshape(x.shape[1], -1))
    return n, [sum((n * int(v) - s) ** 2 for v, s in zip(r, sums)) for r in x], values[::-1], vectors[:, ::-1], centre


@pytest.mark.parametrize("chunk", [1 << 30, 50])
def test_whitening(spark, chunk):
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (120, 6)) @ rng.normal(0, 1, (6, 6))
    x[60:70] = x[50]
    rows = [(i, [float(v) for v in r], i % 3) for i, r in enumerate(x.astype(np.float32))]
    rows += [(200, None, 1), (201, [float("nan"), *[0.0] * 5], 1), (202, [None, *[0.0] * 5], 1), (203, [float("inf"), *[0.0] * 5], 1), (204, [], 1), rows[3]]
    df = spark.createDataFrame(rows, VECTORS).withColumn("n", F.lit("clash")).withColumn("number", F.lit("clash"))
    got = whitening.whiten(df.repartition(3), chunk=chunk).toPandas()
    ints = np.floor(256 * x.astype(np.float32).astype(float)).astype(int)
    n, deviations, values, vectors, centre = whitened_by_loop(ints)
    assert n == 110 and set(got.n) == {n} and len(got) == 4 * 121 and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    assert sorted(got.vec_id[got.component == 1]) == sorted([*range(120), 3])
    for c in range(4):
        some = got[got.component == c + 1].drop_duplicates("vec_id").sort_values("vec_id")
        want = (ints - centre) @ vectors[:, c] / math.sqrt(values[c])
        found = some.whitened.to_numpy()
        assert np.allclose(found, want * np.sign(found @ want), atol=1e-9) and np.allclose(some.explained, values[c] / values.sum(), rtol=1e-9)
        assert [int(v) for v in some.deviation] == deviations


def test_whitening_of_odd_tables(spark):
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)], VECTORS)).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, None, None, None)] * 4
    flat = whitening.whiten(spark.createDataFrame([(1, [0.0, 1.0], 0), (2, [1.0, 1.0], 0), (None, [0.5, 1.0], 0)], VECTORS)).collect()
    first, second = [r for r in flat if r.component == 1], [r for r in flat if r.component == 2]
    assert len(first) == 3 and abs(max(r.whitened for r in first) - math.sqrt(1.5)) < 1e-9 and {(r.whitened, r.explained) for r in second} == {(None, 0.0)}
    mixed = whitening.whiten(spark.createDataFrame([(i, [float(i), float(i * i)][: 1 + i % 2], 0) for i in range(8)], VECTORS)).collect()
    assert len(mixed) == 4 + 8 and {r.n for r in mixed} == {4}
    huge = whitening.whiten(spark.createDataFrame([(1, [1e30], 0), (2, [1e14], 0), (3, [0.0], 0)], "vec_id long, embedding array<double>, label int")).collect()
    assert {(r.vec_id, r.deviation) for r in huge} == {(2, (256 * 10**14) ** 2), (3, (256 * 10**14) ** 2)}


# --- hard negatives --------------------------------------------------------------------------------------------------


def mined_by_loop(rows, anchors, positives=5, negatives_=3):
    ints = [(i, lab, [math.floor(256 * x) for x in v]) for i, v, lab in rows]
    out = []
    for a, label, q in ints:
        if a not in anchors:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(q, v)), i, lab) for i, lab, v in ints if i != a and len(v) == len(q)))
        for s, p, _ in [t for t in scored if t[2] == label][:positives]:
            inside = [t for t in scored if t[2] != label and 50 * -s <= 100 * -t[0] <= 95 * -s]
            out += [(a, p, r + 1, i, -s, -t) for r, (t, i, _) in enumerate(inside[:negatives_])]
    return sorted(out)


@pytest.mark.parametrize("block_rows", [10_000, 40])
def test_hard_negatives(spark, block_rows):
    rng = np.random.default_rng(9)
    middle = rng.normal(0, 1, (6, 10))
    x = np.round(middle[rng.integers(0, 6, 260)] + rng.normal(0, 0.6, (260, 10)), 2)
    x[100:130] = x[99]  # ties
    rows = [(i, [float(v) for v in r], int(rng.integers(0, 3))) for i, r in enumerate(x)]
    rows += [(300 + i, [1.0 * i, 2.0, -1.0], i % 2) for i in range(9)]  # of another length
    odd = [(400, None, 1), (401, [float("nan")] * 10, 1), (402, [1.0] * 10, None), (403, [None] * 10, 0), (None, [1.0] * 10, 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int").withColumn("row", F.lit("clash")).repartition(3)
    vectors = topk.integer_vectors(df, more=["label"])
    got = sorted(tuple(r) for r in negatives.mine(vectors, vectors.where("vec_id % 10 = 0"), block_rows=block_rows, query_rows=7, codes=5).collect())
    assert got == mined_by_loop(rows, set(range(0, 310, 10))) and len(got) > 200
    assert negatives.mine(vectors.limit(0), vectors.limit(0)).count() == 0


def test_large_scores_are_exact(spark):
    rng = np.random.default_rng(10)
    rows = [(i, [float(v) for v in np.round(rng.uniform(0.2, 1, 3) * 4e6)], i % 2) for i in range(40)] + [(50, [1e30, 0.0, 0.0], 0), (51, [1e7, 0.0, 0.0], 1)]
    vectors = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), more=["label"])
    assert {r.vec_id for r in vectors.collect()} == {*range(40), 51}
    kept = [r for r in rows if r[0] != 50]
    got = sorted(tuple(r) for r in negatives.mine(vectors, vectors.where("vec_id % 5 = 0")).collect())
    assert got == mined_by_loop(kept, set(range(0, 40, 5)))
    best = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(vectors, vectors.where("vec_id % 5 = 0"), k=2).collect()}
    for q in range(0, 40, 5):
        scored = sorted((-sum(math.floor(256 * a) * math.floor(256 * b) for a, b in zip(rows[q][1], v)), i) for i, v, _ in kept if i != q)
        assert [best[q, 1], best[q, 2]] == [(i, -s) for s, i in scored[:2]]


def test_cells_are_visited_in_falling_order_and_all():
    rng = np.random.default_rng(11)
    for _ in range(30):
        left, right = rng.normal(0, 1, int(rng.integers(1, 8))), rng.normal(0, 1, int(rng.integers(1, 8)))
        left[rng.random(len(left)) < 0.2] = -np.inf
        out = list(negatives.visit(left, right))
        assert [b for b, _, _ in out] == sorted((b for b, _, _ in out), reverse=True)
        assert {(i, j) for _, i, j in out} == {(i, j) for i in range(len(left)) for j in range(len(right)) if left[i] > -np.inf} and len(out) == len({x[1:] for x in out})


def test_few_rows_are_read(spark):
    """Where vectors lie in groups, visits end early."""
    rng = np.random.default_rng(12)
    middle = rng.normal(0, 4, (12, 8))
    at = rng.integers(0, 12, 6000)
    x = middle[at] + rng.normal(0, 0.05, (6000, 8))
    v = np.floor(256 * x).astype(np.int64)
    books = negatives.Codebooks.fit(v[:3000], 12)
    d, ids, labels = 8, np.arange(6000), at.astype(np.int64) % 5
    made = negatives.built(d, ids, labels, v, books)
    import pandas as pd

    block = negatives.opened(pd.Series(dict(zip(["d", "ids", "labels", "vectors", "cells", "radii"], [d, *made]))), {8: books})
    read = [negatives.first_of(block, v[i], i, int(labels[i]), 5)[2] for i in range(0, 6000, 100)]
    assert np.mean(read) < 2500
