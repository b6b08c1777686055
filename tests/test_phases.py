"""Whole runs and streams on small made signals."""

import os
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialmill.operators import acquire, artifacts, evaluate, features, models
from trialmill.plans import phases
from trialmill.plans.manifest import Manifest
from trialmill.sources import store
from trialmill.streaming import pairing, stream

START = datetime(2024, 1, 1)
BANDS = (("low", 0.0, 40.0), ("high", 40.0, 125.0))


@pytest.fixture(scope="module")
def recorded(spark):
    rng = np.random.default_rng(1)
    trials = [(t, t % 2, t % 2 * 3 - (1 - t % 2), t // 30, t // 5, t % 5) for t in range(120)]
    signals = [(t, c, (rng.normal(size=64) + (t % 2) * np.sin(np.arange(64) / 2) * 3).tolist()) for t in range(120) for c in range(2)]
    a = spark.createDataFrame(trials, "trial_id long, label_binary int, label_digit int, sessionnum long, blocknum long, blockpos long")
    return a.cache(), spark.createDataFrame(signals, "trial_id long, channel int, signal array<double>").cache()


def test_a_run_writes_results_that_beat_chance(spark, recorded, tmp_path):
    trials, signals = recorded
    old, new = trials.where("sessionnum < 3"), trials.where("sessionnum = 3")
    of = lambda t: signals.join(t.select("trial_id"), "trial_id", "left_semi")
    run = lambda name, **more: phases.main(spark, old, of(old), str(tmp_path), name, "stage1", BANDS, 32, test=(new, of(new)), seed=7, permutations=2, **more)
    rows = run("svm").collect()
    value = {(r.split, r.metric): r.value for r in rows}
    assert value["val", "accuracy"] > 0.8 and value["test", "accuracy"] > 0.8
    assert value["shuffled", "real"] > value["shuffled", "shuffled_mean"] and {m for s, m in value if s == "val"} == {"accuracy", "precision", "recall", "f1"}
    matrix = spark.read.parquet(f"{tmp_path}/confusion/all/stage1/svm").collect()
    assert sum(r.n for r in matrix if r.y == r.yhat) / sum(r.n for r in matrix) == pytest.approx(value["val", "accuracy"])
    # fitted parameters serve the test data, and give the same flags for the same trials
    flags = {r.trial_id: r.n_flagged for r in spark.read.parquet(f"{tmp_path}/all/trial_flags").collect()}
    again = {r.trial_id: r.n_flagged for r in phases.apply_fitted(spark, of(old), f"{tmp_path}/all").collect()}
    assert flags == again
    # the test set is scored by the saved model
    saved = models.load_model(spark, f"{tmp_path}/models/all/stage1/svm")
    vectors = phases.raw_features(spark, of(new), f"{tmp_path}/all", BANDS, 32)
    data = phases.stage_data(new, vectors, "stage1", phases.apply_fitted(spark, of(new), f"{tmp_path}/all"))
    assert evaluate.metrics(saved(data)).first().accuracy == pytest.approx(value["test", "accuracy"])
    # a second run skips what is there; force doesn't
    stamp = lambda: [os.stat(tmp_path / "all" / n / "_SUCCESS").st_mtime_ns for n in ("trials", "trial_flags", "features", "runs/stage1/svm")]
    before = stamp()
    assert {(r.split, r.metric): r.value for r in run("svm").collect()} == value and stamp() == before
    run("svm", force=True)
    assert all(a > b for a, b in zip(stamp(), before))
    with pytest.raises(ValueError):
        features.with_flags(features.statistics(signals), artifacts.concern(spark.createDataFrame([], "trial_id long, is_any boolean")))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        phases.evaluate_test(data, "lda", "stage1", str(tmp_path), "all")


def test_a_changed_parameter_runs_what_depends_on_it(spark, tmp_path):
    """Raw rows of two files to results; then other permutations, a fraction, another source, a broken phase."""
    rng = np.random.default_rng(4)
    names = [f"{c}_{i}" for c in ("A1", "B2") for i in range(40)]
    rows = [(k % 2 * (1 + k // 2 % 3) - (1 - k % 2), k // 30, k // 6, k % 6, *rng.normal(size=80).round(3).tolist()) for k in range(180)]
    source, path = str(tmp_path / "raw"), str(tmp_path / "run")
    for part in (rows[:100], rows[100:]):
        spark.createDataFrame(part, ["label", "sessionnum", "blocknum", "blockpos", *names]).coalesce(1).write.mode("append").parquet(source)
    made = []
    watched = lambda *a: (m := Manifest(*a), made.append(m))[0]

    def run(**more):
        made.clear()
        got = phases.run(spark, source, path, "lda", bands=BANDS, nperseg=32, per_class=30, **{"permutations": 1} | more).collect()
        return {(r.split, r.metric): r.value for r in got}, [x for m in made for x in m.made]

    keep, phases.Manifest = phases.Manifest, watched
    try:
        every = ["pool_trials", "pool_signals", "trials", "trial_flags", "features", "runs/stage1/lda"]
        first, done = run()
        assert done == every and ("val", "accuracy") in first and spark.read.parquet(f"{path}/all/pool_trials").count() == 180
        assert run() == (first, [])
        assert run(permutations=2)[1] == ["runs/stage1/lda"]
        assert run(fraction=0.5)[1] == every and spark.read.parquet(f"{path}/all_0.5/pool_trials").count() == 90
        store.delete(spark, f"{path}/all_0.5/manifest/features")  # as if it had broken off
        assert run(fraction=0.5)[1] == ["features"]
        spark.createDataFrame(rows[:2], ["label", "sessionnum", "blocknum", "blockpos", *names]).coalesce(1).write.mode("append").parquet(source)
        assert run(fraction=0.5)[1] == every
        with pytest.raises(ValueError):
            phases.run(spark, source, path, "lda", fraction=0.5)
    finally:
        phases.Manifest = keep


def test_bad_channels_give_no_features(spark, recorded, tmp_path):
    trials, signals = recorded
    dead = signals.where("channel = 0").withColumns({"channel": F.lit(2), "signal": F.array_repeat(F.lit(0.0), 64)})
    both, path = signals.unionByName(dead), str(tmp_path / "run")
    phases.preprocess(spark, trials.withColumn("split", F.lit("train")), both, path).count()
    assert [r.channel for r in phases.fitted_bad_channels(spark, path).collect()] == [2]
    assert {len(r.features) for r in phases.raw_features(spark, both, path, BANDS, 32).collect()} == {2 * len(features.feature_names(BANDS))}


def write_rows(spark, path, rows):
    spark.createDataFrame(rows, "seq long, label int, sessionnum long, ts timestamp").coalesce(1).write.mode("append").parquet(path)


SCHEMA = "seq long, label int, sessionnum long, ts timestamp"


def in_order(rows):
    """(kind, seq, blank_seq) of every digit, by the loop."""
    out, pending = [], None
    for seq, label, *_ in rows:
        if label == -1:
            pending = seq
        else:
            out.append(("unpaired", seq, None) if pending is None else ("pair", seq, pending))
            pending = None
    return out


def told(df):
    return sorted(((r.kind, r.seq, r.blank_seq) for r in df.collect()), key=str)


def made_rows(n, seed, sessions=1, step=timedelta(minutes=1)):
    rng = np.random.default_rng(seed)
    return [(i, int(x), int(s), START + i * step) for i, (x, s) in enumerate(zip(rng.choice([-1, 0, 1], n), rng.integers(0, sessions, n)))]


def test_stream_equals_batch(spark, tmp_path):
    """Rows in any order, days apart, over two runs from one checkpoint."""
    rows = made_rows(60, 2, step=timedelta(days=3))
    mixed = [rows[i] for i in np.random.default_rng(3).permutation(60)]
    path, at = str(tmp_path / "in"), str(tmp_path / "out")
    read = lambda n=1: stream.read_rows(spark, path, SCHEMA, n)
    for part in (mixed[:20], mixed[20:40]):
        write_rows(spark, path, part)
    first = stream.drain(pairing.by_place(read(), places=16), "p", at).count()
    write_rows(spark, path, mixed[40:])
    all_rows = stream.drain(pairing.by_place(read(), places=16), "p", at)
    assert told(all_rows) == sorted(in_order(rows), key=str) and 0 < first < all_rows.count()
    want = sorted((r.seq, r.blank_seq) for r in acquire.paired(spark.read.parquet(path)).collect())
    assert sorted((r.seq, r.blank_seq) for r in pairing.pairs(all_rows).collect()) == want
    assert sorted(r.seq for r in pairing.unpaired(all_rows).collect()) == sorted(r.seq for r in acquire.unpaired(spark.read.parquet(path)).collect())
    by = stream.drain_capped(pairing.pairs(pairing.by_place(read(), places=16)), 4).groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()
    assert {r.label: r.n for r in by} == {x: min(4, sum(1 for s, _ in want if rows[s][1] == x)) for x in (0, 1)}


def test_sessions_keep_one_row_of_state(spark, tmp_path):
    """Gaps in seq, sessions side by side, a batch that comes too late; state is a row for each session."""
    rows = [(2 * i + i // 7, *r[1:]) for i, r in enumerate(made_rows(90, 5, 3))]
    held = [r for r in rows[:40] if r[0] % 5 == 0]
    path, at = str(tmp_path / "in"), str(tmp_path / "out")
    for part in ([r for r in rows[:50] if r not in held][::-1], rows[50:], held):
        write_rows(spark, path, part)
        got = stream.drain(pairing.by_session(stream.read_rows(spark, path, SCHEMA)), "s", at)
    want = [x for s in range(3) for x in in_order([r for r in rows if r[2] == s and r not in held])] + [("late", r[0], None) for r in held if r[1] != -1]
    assert told(got) == sorted(want, key=str) and {r.kind for r in got.select("kind").distinct().collect()} == {"pair", "unpaired", "late"}
    in_time = spark.createDataFrame([r for r in rows if r not in held], SCHEMA)
    assert sorted(r.seq for r in pairing.pairs(got).collect()) == sorted(r.seq for r in acquire.paired(in_time, ["sessionnum"]).collect())
    state = spark.read.format("statestore").option("stateVarName", "last").load(f"{at}-state")
    assert state.count() == 3


def test_a_capped_stream_ends_when_classes_are_full(spark, tmp_path):
    rows = made_rows(120, 7)
    path = str(tmp_path / "in")
    for i in range(0, 120, 20):
        write_rows(spark, path, rows[i : i + 20])
    arriving = lambda: pairing.pairs(pairing.by_place(stream.read_rows(spark, path, SCHEMA, 1)))
    pairs = acquire.paired(spark.read.parquet(path))
    for cap in (3, 6):
        at = str(tmp_path / f"out{cap}")
        got = sorted(r.seq for r in stream.drain_capped(arriving(), cap, classes=[0, 1], at=at).collect())
        want = acquire.capped(pairs, cap)
        assert got == sorted(r.seq for r in want.collect())
        stop = acquire.stop_position(want, [0, 1], cap).first().stop_seq
        read = [n for n in os.listdir(at) if n.startswith("batch=")]
        assert len(read) == stop // 20 + 1 < 6
    assert stream.drain_capped(arriving(), 1000, classes=[0, 1]).count() == pairs.count()
