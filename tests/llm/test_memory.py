"""What tasks hold at once, whatever they are given."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest

from trialmill.llm import langid, simhash
from trialmill.llm.linear import byte_grams, expanded, packed_grams, svm


@pytest.fixture
def task(spark, monkeypatch):
    """The function that links() gives to a task."""

    class Rows:
        repartition = sortWithinPartitions = lambda self, *a: self
        mapInPandas = lambda self, fn, schema: fn

    monkeypatch.setattr(simhash, "keyed", lambda *a: Rows())
    return simhash.links(spark.createDataFrame([(1,)], "fp long"), key_bits=12)


def dealt(fps, key_bits=12):
    """(key, fp), as keyed() makes them, by loop."""
    flips = simhash.masks(range(64 - key_bits, 64), 2)
    return ((fps[:, None] ^ flips).ravel() >> np.uint64(64 - key_bits)).astype("i8"), np.repeat(fps, len(flips))


def linked(task, key, fp, rows=10_000):
    """The roots that the task's links give, and the most MB that it held."""
    order = np.argsort(key, kind="stable")
    batches = [pd.DataFrame({"key": key[i], "fp": fp[i].view("i8")}) for i in np.split(order, range(rows, len(order), rows))]
    tracemalloc.start()
    links = list(task(iter(batches)))
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    root = {}

    def top(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for b in links:
        for x, y in zip(b.a.to_numpy().view("u8").tolist(), b.b.to_numpy().view("u8").tolist(), strict=True):
            x, y = sorted((top(x), top(y)))
            root[y] = x
    return {x: top(x) for x in root}, most


def test_a_task_lists_few_variants_at_once(task):
    rng = np.random.default_rng(5)
    key, fp = dealt(rng.integers(0, 1 << 63, 4000, dtype="u8"))
    _, most = linked(task, key, fp)
    assert most < 120


def test_a_key_of_many_variants_is_dealt_again(task):
    rng = np.random.default_rng(6)
    fps = np.unique(rng.integers(0, 1 << 52, 3000, dtype="u8"))
    fps = np.unique(np.concatenate([fps, fps[:900] ^ np.uint64(0b1011), fps[:300] ^ np.uint64(1 << 45 | 1)]))
    roots, most = linked(task, np.zeros(len(fps), "i8"), fps)  # one key alone
    assert most < 120
    near = np.bitwise_count(fps[:, None] ^ fps) <= 4
    for i, j in zip(*np.nonzero(near), strict=True):
        a, b = int(fps[i]), int(fps[j])
        assert roots.get(a, a) == roots.get(b, b)
    for a, b in roots.items():
        assert a == b or near[np.searchsorted(fps, a)].sum() > 1


@pytest.mark.parametrize("at_once", [400, 3000, 200_000])
def test_links_are_those_of_all_pairs(task, monkeypatch, at_once):
    monkeypatch.setattr(simhash, "AT_ONCE", at_once)
    rng = np.random.default_rng(7)
    fps = rng.integers(0, 1 << 63, 40, dtype="u8").tolist()
    for f in fps[:20]:
        for d in range(1, 8):
            fps.append(f ^ sum(1 << int(b) for b in rng.choice(64, d, replace=False)))
    fps = np.unique(np.array(fps, "u8"))
    roots, _ = linked(task, *dealt(fps), rows=500)
    near = np.bitwise_count(fps[:, None] ^ fps) <= 4
    label = np.arange(len(fps))
    while (after := np.where(near, label, len(fps)).min(axis=1)).tolist() != label.tolist():
        label = after
    assert [int(fps[i]) for i in label] == [roots.get(int(f), int(f)) for f in fps]


def test_packed_features_are_the_features():
    rng = np.random.default_rng(8)
    texts = ["", "a", "Der Fluß", "b" * 300, "é" * 40_000, "xy" * 80_000, " ".join(map(str, rng.integers(0, 9999, 700)))]
    got = expanded([packed_grams(t, 512) for t in texts], 512)
    assert got.dtype == np.float32 and got.tobytes() == b"".join(byte_grams(t, 512).tobytes() for t in texts)


def test_the_language_sample_comes_to_the_driver_small(spark, monkeypatch):
    """A few hundred kilobytes in place of a float for each row and feature; the machines are those of the floats."""
    rng = np.random.default_rng(10)
    words = {c: ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(400)] for c in ("de", "nl", "fr")}
    rows = [(i, " ".join(rng.choice(words[c], 150)), c) for i, c in enumerate(["de", "nl", "fr"] * 80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    came, kind = [], type(docs)
    whole = kind.toPandas
    monkeypatch.setattr(kind, "toPandas", lambda df: came.append(whole(df)) or came[-1])
    model = langid.fit(docs)
    assert len(came) == 1 and len(came[0]) == len(rows) and sum(map(len, came[0].x)) < len(rows) * model.dims
    x, lang = (np.stack(a) for a in zip(*sorted(((byte_grams(t, model.dims), c) for _, t, c in rows), key=lambda r: (r[1], r[0].tobytes())), strict=True))
    assert np.array_equal(model.family_weights["romance"], svm(x, np.where(lang == "fr", 1, -1)))
    assert np.array_equal(model.pair_weights["de", "nl"], svm(x[lang != "fr"], np.where(lang[lang != "fr"] == "de", 1, -1)))
