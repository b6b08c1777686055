"""Operators against small loops in plain Python, and what must hold of any input."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from trialmill.functions import radix
from trialmill.functions.design import Recursion, bandpass_matrix, butterworth_bandpass, matrix, notch, zero_phase
from trialmill.functions.quantiles import exact_quantiles
from trialmill.functions.ranks import places, with_previous
from trialmill.operators import acquire, artifacts, evaluate, features, forest, kernel, models, permute, robust, spectral, split
from trialmill.plans import phases, queries
from trialmill.sources import order, store, wide

LEAVES = StructType([StructField("y", IntegerType()), StructField("x", ArrayType(DoubleType())), StructField("leaf", VectorUDT())])


def paired_by_loop(labels, cap):
    pending, out, taken = None, [], {}
    for seq, label in enumerate(labels):
        if label == -1:
            pending = seq
            continue
        if pending is not None and taken.get(label, 0) < cap:
            out.append((seq, pending))
            taken[label] = taken.get(label, 0) + 1
        pending = None
    return out


def test_pairs_equal_a_loop(spark):
    labels = np.random.default_rng(1).choice([-1, -1, 0, 1, 2], 500).tolist()
    rows = spark.createDataFrame(list(enumerate(labels)), "seq long, label int")
    got = acquire.capped(acquire.paired(rows), 20)
    assert sorted((r.seq, r.blank_seq) for r in got.collect()) == paired_by_loop(labels, 20)
    assert acquire.unpaired(rows).count() + acquire.paired(rows).count() == sum(x != -1 for x in labels)
    pool = {r.position: (r.seq, r.label) for r in acquire.pool_order(got).collect()}
    assert len(pool) == 2 * got.count() and all(pool[2 * k][0] == pool[2 * k + 1][0] + 1 for k in range(len(pool) // 2))


def test_pairs_go_by_order_over_gaps(spark):
    """Any step between rows, and few rows to a range: nothing is lost."""
    rows = spark.createDataFrame([(0, -1), (2, 7), (3, -1), (4, 8)], "seq long, label int")
    assert sorted((r.seq, r.blank_seq) for r in acquire.paired(rows).collect()) == [(2, 0), (4, 3)]
    rng = np.random.default_rng(5)
    seqs = np.cumsum(rng.integers(1, 9, 400)).tolist()
    labels = rng.choice([-1, -1, 0, 1, 2], 400).tolist()
    rows = spark.createDataFrame([(s, x, i % 5) for i, (s, x) in enumerate(zip(seqs, labels))], "seq long, label int, sessionnum int").repartition(6)
    want = [(seqs[d], seqs[b]) for d, b in paired_by_loop(labels, 1000)]
    assert sorted((r.seq, r.blank_seq) for r in acquire.paired(rows).collect()) == want
    assert {r.seq for r in acquire.unpaired(rows).collect()} == {s for s, x in zip(seqs, labels) if x != -1} - {d for d, _ in want}
    by = sorted((r.seq, r.blank_seq) for r in acquire.paired(rows, ["sessionnum"]).collect())
    assert by == sorted((seqs[5 * d + k], seqs[5 * b + k]) for k in range(5) for d, b in paired_by_loop(labels[k::5], 1000))


def test_pairs_of_rows_that_share_a_seq(spark):
    """Rows that tie come in one order, whatever it is: each digit is paired or not, and a blank serves once."""
    rng = np.random.default_rng(6)
    data = [(int(s), int(x), i) for i, (s, x) in enumerate(zip(rng.integers(0, 40, 300), rng.choice([-1, 0, 1], 300)))]
    rows = spark.createDataFrame(data, "seq long, label int, id int")
    got, rest = acquire.paired(rows.repartition(3)).collect(), acquire.unpaired(rows.repartition(7)).collect()
    assert sorted([r.id for r in got] + [r.id for r in rest]) == [i for _, x, i in data if x != -1]
    blanks = [s for s, x, _ in data if x == -1]
    for s in set(r.blank_seq for r in got):
        assert sum(r.blank_seq == s for r in got) <= blanks.count(s)


def test_rows_are_numbered_in_order_of_files(spark, tmp_path):
    path = str(tmp_path / "files")
    for n in (30, 0, 1, 77, 12):
        spark.range(n).select((F.col("id") * 3).alias("v"), F.lit("clash").alias("seq")).coalesce(1).write.mode("append").parquet(path)
    got = order.in_file_order(spark, path).collect()
    assert sorted(r.seq for r in got) == list(range(120))
    by_file = sorted((r.f, r.i, r.v) for r in spark.read.parquet(path).select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i"), "v").collect())
    assert [r.v for r in sorted(got, key=lambda r: r.seq)] == [v for _, _, v in by_file]
    again = order.in_given_order(spark.range(100).repartition(7), "n").collect()
    assert sorted(r.n for r in again) == list(range(100))
    assert order.in_given_order(spark.range(0), "n").count() == 0


def test_pairs_of_no_rows_and_full_class(spark):
    rows = spark.createDataFrame([], "seq long, label int")
    assert acquire.acquire(rows, 5).count() == 0
    rows = spark.createDataFrame([(0, -1), (1, -1), (2, 3), (3, -1), (4, 3)], "seq long, label int")
    assert [(r.seq, r.blank_seq) for r in acquire.capped(acquire.paired(rows), 1).collect()] == [(2, 1)]
    fill = {r.label: (r.accepted, r.is_full) for r in acquire.class_fill(acquire.capped(acquire.paired(rows), 1), [2, 3], 1).collect()}
    assert fill == {2: (0, False), 3: (1, True)}
    assert acquire.stop_position(acquire.paired(rows), [2, 3], 1).first().stop_seq is None


@pytest.mark.parametrize("at_once", [50, 10**6])
def test_exact_quantiles(spark, at_once):
    rng = np.random.default_rng(2)
    groups = {0: rng.normal(size=5000), 1: np.zeros(700), 2: rng.integers(0, 5, 3000).astype(float), 3: np.array([7.0])}
    rows = spark.createDataFrame([(k, float(x)) for k, v in groups.items() for x in v], "k int, x double").repartition(5)
    probs = {"a": 0.5, "b": 0.995, "c": 0.005, "d": 1.0}
    got = {r.k: [r[n] for n in probs] for r in exact_quantiles(rows, ["k"], "x", probs, at_once).collect()}
    for k, v in groups.items():
        assert np.allclose(got[k], np.percentile(v, [100 * p for p in probs.values()]), atol=1e-12)


@pytest.mark.parametrize("few", [20, 10**6])
def test_quantiles_are_counted_inside_arrays(spark, few, monkeypatch):
    """Ties, zeros of both signs, infinities, NaN, nulls, tiny and large values; whatever may be counted one by one."""
    rng = np.random.default_rng(3)
    groups = {
        "0": rng.normal(size=3000), "1": np.zeros(700), "2": rng.integers(-2, 3, 2000).astype(float), "3": np.array([7.0]), "4": np.array([-0.0, 0.0, -0.0, 1.0]),
        "5": rng.normal(size=900) * 10.0 ** rng.integers(-300, 300, 900), "6": np.concatenate([np.full(500, 1.5), [np.nan] * 40, np.full(499, 1.5 + 2**-52)]), "7": np.array([-np.inf, 1.0, np.inf, np.inf]), "8": np.array([np.nan]),
    }
    rows = [(k, v[i : i + 50].tolist() + ([None] if k == "2" else [])) for k, v in groups.items() for i in range(0, len(v), 50)] + [("0", None), ("0", []), (None, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "channel string, signal array<double>").repartition(4)
    monkeypatch.setattr(radix, "FEW", few)
    probs = {"a": 0.5, "b": 0.995, "c": 0.005, "d": 1.0, "e": 0.0}
    got = radix.quantiles(df, radix.of_arrays(), probs)
    assert set(got) == {*groups, "None"} - {"8"} and got["None"]["a"] == 1.5
    for k, v in groups.items():
        if k not in ("7", "8"):
            assert np.allclose(list(got[k].values()), np.percentile(v[~np.isnan(v)], [100 * p for p in probs.values()]), rtol=1e-12, atol=0)
    assert (got["7"]["d"], got["7"]["e"]) == (np.inf, -np.inf)
    assert radix.quantiles(df.limit(0), radix.of_arrays(), probs) == {}


def test_numbers_keep_their_order_as_bits():
    x = np.array([-np.inf, -1e300, -1.0, -1e-310, 0.0, 5e-324, 1.0, 1.0 + 2**-52, 1e300, np.inf])
    u = radix.ordered(x)
    assert (np.diff(u.astype(object)) > 0).all() and [radix.value_of(int(v)) for v in u] == x.tolist()


@pytest.mark.parametrize("sections, pad", [(butterworth_bandpass(4, 1.0, 40.0, 250.0), 27), (notch(60.0, 30.0, 250.0), 9)])
def test_filtering_by_blocks_is_the_matrix(sections, pad):
    rng = np.random.default_rng(4)
    by_blocks = Recursion(sections)
    for n in (pad + 1, 64, 127, 128, 129, 300, 1000):
        x = rng.normal(size=(3, n)).cumsum(axis=1)
        assert np.allclose(by_blocks.zero_phase(x, pad), x @ matrix(sections, n, pad).T, rtol=0, atol=1e-9)
    long = rng.normal(size=(1, 10**6))
    near = by_blocks.zero_phase(long, pad)[:, :5000]
    assert np.allclose(near[:, :2000], zero_phase(sections, long[0, :5000, None], pad)[:2000].T, atol=1e-6)
    with pytest.raises(ValueError, match="too short"):
        by_blocks.zero_phase(long[:, :pad], pad)


def test_all_permutations_of_a_discriminant_are_those_of_a_loop(spark):
    rng = np.random.default_rng(7)
    data = [(i, int(rng.integers(0, 3)) * 2 - 1) for i in range(240)]
    rows = spark.createDataFrame([(i, y, (rng.normal(size=6) * [1, 2, 3, 4, 5, 1e-3] + 0.4 * y).tolist()) for i, y in data], "trial_id long, y int, features array<double>")
    train, val = rows.where("trial_id < 160"), rows.where("trial_id >= 160")
    want = {r.perm: r.accuracy for r in permute.model_runs(lambda t: models.fit("lda", t), train, val, 6).collect()}
    got = {r.perm: r.accuracy for r in permute.lda_runs(train, val, 6).collect()}
    assert got.keys() == want.keys() and all(got[p] == pytest.approx(want[p]) for p in want) and len(set(got.values())) > 2


def test_grown_trees_tell_every_distinct_row():
    rng = np.random.default_rng(11)
    x, y = np.round(rng.normal(size=(400, 5)), 1), rng.integers(0, 3, 400)
    first = {tuple(r): i for i, r in reversed(list(enumerate(x.tolist())))}
    y = np.array([y[first[tuple(r)]] for r in x.tolist()])  # rows that are alike are of one class
    assert (forest.grow(x, y, 1).ends(x) == y).all()
    deep = np.arange(200.0)[:, None]
    t = forest.grow(deep, np.arange(200) % 2, 1)
    assert (t.ends(deep) == np.arange(200) % 2).all() and (t.feature < 0).sum() == 200
    alike = forest.grow(np.zeros((5, 2)), np.array([1, 0, 1, 1, 0]), 1)
    assert alike.ends(np.zeros((1, 2))).tolist() == [1] and len(alike.feature) == 1


@pytest.mark.parametrize("most", [50_000, 60])
def test_leaves_are_grown_to_purity(spark, most):
    """Trees that end at once leave everything to what lies below, in one piece or in many; alike rows go with most of them."""
    rng = np.random.default_rng(12)
    x, y = rng.normal(size=(500, 4)), rng.integers(-1, 2, 500)
    x[400:450], y[400:450] = x[400], [1] * 30 + [0] * 20
    leaf = np.stack([np.zeros(500), (x[:, 0] > 0.5).astype(float), np.arange(500.0)], axis=1)
    rows = spark.createDataFrame([(int(a), b.tolist(), Vectors.dense(c)) for a, b, c in zip(y, x, leaf)], LEAVES).repartition(3)
    found = forest.finish(rows, most=most, some=40)
    want = y.copy()
    want[400:450] = 1
    for tree in (0, 1):
        for one in np.unique(leaf[:, tree]).astype(int):
            mine = leaf[:, tree] == one
            assert (found.end_of(tree, one, x[mine]) == want[mine]).all()
    assert (found.leaves[2] == y).all() and len(found.grown) == (3 if most > 500 else len(found.grown)) and (most > 500 or len(found.grown) > 10)


def test_a_forest_goes_beyond_sparks_depth(spark, tmp_path):
    """Two classes in turn along one feature: a tree has to part every pair of neighbours."""
    n = 150
    data = spark.createDataFrame([(i, i % 2, [float(2.0 ** (i / 4)), 0.0]) for i in range(n)], "trial_id long, y int, features array<double>")
    fitted = models.fit("random_forest", data, 3)
    said = {r.trial_id: r.yhat for r in fitted(data).collect()}
    assert fitted.deep.grown and np.mean([said[i] == i % 2 for i in range(n)]) > 0.99
    models.save_model(fitted, str(tmp_path / "m"))
    assert {r.trial_id: r.yhat for r in models.load_model(spark, str(tmp_path / "m"))(data.drop("y")).collect()} == said


def by_pairs_of_multipliers(k, sign, cost=1.0, close=1e-6):
    """The dual, two multipliers at a time: coefficients and offset."""
    n = len(sign)
    a, slope = np.zeros(n), -np.ones(n)
    q = k * np.outer(sign, sign)
    while True:
        up, low = ((sign > 0) & (a < cost)) | ((sign < 0) & (a > 0)), ((sign > 0) & (a > 0)) | ((sign < 0) & (a < cost))
        v = -sign * slope
        i, j = np.flatnonzero(up)[v[up].argmax()], np.flatnonzero(low)[v[low].argmin()]
        if v[i] - v[j] < close:
            return a * sign, (v[i] + v[j]) / 2
        step = (v[i] - v[j]) / max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12)
        step = min(step, cost - a[i] if sign[i] > 0 else a[i], a[j] if sign[j] > 0 else cost - a[j])
        a[i] += sign[i] * step
        a[j] -= sign[j] * step
        slope += q[:, i] * sign[i] * step - q[:, j] * sign[j] * step


def test_kernel_machine_is_the_exact_one(spark):
    """Decision values and support vectors of a plain dual solver; passes over tasks give what passes here give."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 5))
    y = np.where(np.sin(2 * x[:, 0]) + x[:, 1] * x[:, 2] + 0.5 * rng.normal(size=400) > 0, 1, 0)
    beta, offset = by_pairs_of_multipliers(kernel.rbf(x, x, 0.2), np.where(y == 1, 1.0, -1.0))
    rows = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(y, x)], "y int, x array<double>").repartition(3)
    found = kernel.fit(rows, 0.2)
    new = rng.normal(size=(200, 5))
    want = kernel.rbf(new, x, 0.2) @ beta + offset
    assert np.abs(found.decide(new)[:, 0] - want).max() < 2e-3 and abs(len(found.landmarks) - (np.abs(beta) > 1e-7).sum()) <= 2
    step = lambda: kernel.Step(0.2, x[:40], np.eye(40), np.full(41, 0.1), 0.5, np.ones(41))
    signed = rows.select("x", (2 * F.col("y") - 1).cast("double").alias("sign"))
    for what in ("slope", "losses"):
        assert np.allclose(kernel.over_rows(signed)(step(), what), kernel.over_arrays(x, 2.0 * y - 1, step())(step(), what))


def test_kernel_machine_on_fewer_landmarks_and_more_classes(spark, tmp_path):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(300, 2))
    y = (x[:, 0] ** 2 + x[:, 1] ** 2 > 1.2).astype(int) + (x[:, 0] > 0.3)
    rows = spark.createDataFrame([(i, int(a), b.tolist()) for i, (a, b) in enumerate(zip(y, x))], "trial_id long, y int, features array<double>")
    few = kernel.fit(rows.where("y < 2").select("y", F.col("features").alias("x")), 0.5, landmarks=60)
    own = y < 2
    assert len(few.landmarks) <= 60 and (few.vote(x[own]) == y[own]).mean() > 0.9
    fitted = models.fit("svm_rbf", rows)
    said = {r.trial_id: r.yhat for r in fitted(rows).collect()}
    assert np.mean([said[i] == y[i] for i in range(300)]) > 0.93
    models.save_model(fitted, str(tmp_path / "m"))
    assert {r.trial_id: r.yhat for r in models.load_model(spark, str(tmp_path / "m"))(rows.drop("y")).collect()} == said


def test_nearest_centres_are_those_of_a_loop(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x, c = rng.normal(size=(30, 4)), rng.normal(size=(5, 3, 4))
    c[2, 1] = c[2, 0]  # a tie goes to the lesser label
    tested = spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(x)], "trial_id long, y int, x array<double>")
    centres = spark.createDataFrame([(p, k - 1, c[p, k].tolist()) for p in range(5) for k in range(3)], "perm int, yhat int, centroid array<double>")
    for most in (10_000, 4):
        monkeypatch.setattr(permute, "MOST_CENTRES", most)
        got = {(r.perm, r.trial_id): r.yhat for r in permute.nearest(tested, centres).collect()}
        assert got == {(p, i): int(np.argmin(np.round(((x[i] - c[p]) ** 2).sum(axis=1), 9))) - 1 for p in range(5) for i in range(30)}
    assert permute.nearest(tested, centres.limit(0)).count() == 0


def test_quantiles_of_ties_end(spark):
    """Values that meet at the rank, each far more often than a task may hold: half and half, and three heavy values."""
    rows = spark.range(3000).select((F.col("id") % 2).cast("double").alias("half"), F.element_at(F.array(F.lit(-1.0), F.lit(0.0), F.lit(0.0), F.lit(5.0)), (F.col("id") % 4 + 1).cast("int")).alias("three"), F.lit(0).alias("k"))
    for column in ("half", "three"):
        x = [r[0] for r in rows.select(column).collect()]
        got = exact_quantiles(rows, ["k"], column, {"m": 0.5, "a": 0.25, "b": 0.995}, at_once=50).first()
        assert np.allclose([got.m, got.a, got.b], np.percentile(x, [50, 25, 99.5]))
    none = rows.select(F.lit(None).cast("int").alias("k"), F.lit(float("nan")).alias("x"))
    assert exact_quantiles(none, ["k"], "x", {"m": 0.5}).count() == 0
    odd = rows.select(F.when(F.col("half") == 1, 7).alias("k"), F.col("three").alias("x"))
    assert {r.k for r in exact_quantiles(odd, ["k"], "x", {"m": 0.5}, at_once=50).collect()} == {None, 7}


def test_quantiles_behind_a_sketch(spark):
    x = np.random.default_rng(12).normal(size=60_000).round(3)
    rows = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(7).withColumn("k", F.lit("a"))
    got = exact_quantiles(rows, ["k"], "x", {"a": 0.5, "b": 0.995, "c": 0.00001, "d": 0.0, "e": 1.0}, at_once=100).first()
    assert np.allclose([got.a, got.b, got.c, got.d, got.e], np.percentile(x, [50, 99.5, 0.001, 0, 100]), atol=1e-12)


def test_places_are_ranks(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"), (F.col("id") % 3).alias("k"))
    got = places(rows, ["k"], ["v"]).collect()
    for k in range(3):
        mine = sorted((r.v, r.place) for r in got if r.k == k)
        assert [p for _, p in mine] == list(range(len(mine)))


def test_rows_before_are_those_of_a_sort(spark):
    rows = spark.range(500).select((F.col("id") * 7919 % 500).alias("v"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("k"))
    got = with_previous(rows, ["k"], ["v"], {"before": "v"}).collect()
    for k in (None, 1, 2):
        mine = sorted((r.v, r.before) for r in got if r.k == k)
        assert [b for _, b in mine] == [None, *[v for v, _ in mine[:-1]]]


def test_chronological_split_is_a_percent_rank(spark):
    trials = spark.range(330).select(F.col("id").alias("trial_id"), F.floor(F.col("id") / 40).alias("sessionnum"), F.floor(F.col("id") / 8).alias("blocknum"))
    got = sorted((r.blocknum, r.split) for r in split.assign_chronological(trials).collect())
    assert [s for _, s in got] == ["val" if i / (len(got) - 1) >= 0.8 else "train" for i in range(len(got))]
    assert [r.split for r in split.assign_chronological(trials.where("trial_id = 0")).collect()] == ["train"]


def test_split_is_a_function_of_the_block(spark):
    trials = spark.range(400).select(F.col("id").alias("trial_id"), F.floor(F.col("id") / 40).alias("sessionnum"), F.floor(F.col("id") / 8).alias("blocknum"))
    a = {tuple(r) for r in split.assign_blocks(trials).collect()}
    b = {tuple(r) for r in split.assign_blocks(trials.repartition(7).where("trial_id % 2 = 0")).collect()}
    assert a == b and split.validation(split.split_pool(trials)).first().n_overlap == 0
    with pytest.raises(ValueError):
        split.require_disjoint(trials, trials, "sessionnum")


def test_robust_fit_gives_unit_scale(spark):
    rng = np.random.default_rng(3)
    rows = [(t, c, (rng.normal(size=30) * (c + 1) + c).tolist() if c < 2 else [1.0] * 30) for t in range(20) for c in range(3)]
    signals = spark.createDataFrame(rows, "trial_id long, channel int, signal array<double>")
    params = robust.fit(signals)
    assert [r.channel for r in robust.bad_channels(params).collect()] == [2]
    good = robust.normalize(robust.exclude(signals, robust.bad_channels(params)), params)
    for r in robust.fit(good).collect():
        assert abs(r.center) < 1e-12 and abs(r.scale - 1) < 1e-12


def test_flags_grow_with_lower_limits(spark):
    rng = np.random.default_rng(4)
    signals = spark.createDataFrame([(t, c, rng.normal(size=20).tolist()) for t in range(30) for c in range(4)] + [(30, 0, [0.0] * 20)], "trial_id long, channel int, signal array<double>")
    measured = artifacts.metrics(signals)
    still = measured.where("trial_id = 30").first()
    assert still.kurtosis is None and still.std == 0
    strict, lax = artifacts.thresholds(measured, 0.8, 0.2), artifacts.thresholds(measured, 0.99, 0.01)
    n = [artifacts.flags(measured, x).where("is_any").count() for x in (strict, lax)]
    assert n[0] > n[1] > 0


def test_bandpass_matrix_is_a_zero_phase_filter():
    sections = butterworth_bandpass(4, 1.0, 40.0, 250.0)

    def gain(f):
        z = np.exp(2j * np.pi * f / 250)
        return abs(np.prod([(s[0] * z**2 + s[1] * z + s[2]) / (z**2 + s[4] * z + s[5]) for s in sections]))

    assert np.allclose([gain(1.0), gain(40.0)], 2**-0.5, atol=1e-9) and abs(gain(np.sqrt(40.0)) - 1) < 0.01
    x = np.random.default_rng(5).normal(size=256)
    assert np.allclose(bandpass_matrix(256) @ x, zero_phase(sections, x))
    with pytest.raises(ValueError):
        zero_phase(sections, np.zeros(27))


def test_features_of_256_samples(spark):
    rng = np.random.default_rng(6)
    x = np.sin(2 * np.pi * 10 * np.arange(256) / 250) + 0.1 * rng.normal(size=256)
    signals = spark.createDataFrame([(0, 0, x.tolist()), (0, 1, [0.0] * 256)], "trial_id long, channel int, signal array<double>")
    got = {r.channel: r for r in features.channel_features(signals).collect()}
    assert abs(got[0].dominant_freq - 9.765625) < 1e-9 and got[0].alpha > 10 * got[0].beta
    assert got[1].skewness == got[1].kurtosis == 0 and got[1].total_power == 0
    vector = features.trial_vectors(features.channel_features(signals)).first().features
    assert len(vector) == 26 and features.feature_names()[:2] == ["delta", "theta"]
    density = spectral.welch(x[None], 250.0, 128)[0]
    assert np.isclose(got[0].total_power, ((density[1:] + density[:-1]) / 2).sum() * 250 / 128)


def test_metrics_with_a_label_never_true(spark):
    got = evaluate.metrics(spark.createDataFrame([(0, 2), (0, 0), (1, 1)], "y int, yhat int"), "macro").first()
    assert np.allclose([got.accuracy, got.precision, got.recall], [2 / 3, 2 / 3, 0.5])
    auc = evaluate.roc_auc(spark.createDataFrame([(1, 3.0), (0, 3.0), (0, 1.0), (1, 5.0)], "y int, score double")).first()
    assert np.isclose(auc.auc, 3.5 / 4)
    flat = evaluate.permutation_summary(spark.createDataFrame([(0, 0.7), (1, 0.5), (2, 0.5)], "perm int, accuracy double")).first()
    assert flat.shuffled_std == 0 and flat.gap_in_stds is None


def test_permutation_keeps_labels(spark):
    labels = spark.range(200).select(F.col("id").alias("trial_id"), (F.col("id") % 7).cast("int").alias("y"))
    got = permute.permuted(labels, 2).collect()
    want = sorted(r.y for r in labels.collect())
    for p in range(3):
        assert sorted(r.y for r in got if r.perm == p) == want
    assert {r.trial_id: r.y for r in got if r.perm == 1} != {r.trial_id: r.y for r in got if r.perm == 2}


def test_models_learn_and_reject_unknown_names(spark, tmp_path):
    rng = np.random.default_rng(7)
    rows = [(i, i % 2, (rng.normal(size=4) + 2 * (i % 2)).tolist()) for i in range(200)]
    data = spark.createDataFrame(rows, "trial_id long, y int, features array<double>")
    for name in ("lda", "svm", "svm_rbf", "random_forest"):
        predict, path = models.fit(name, data), str(tmp_path / name)
        said = {r.trial_id: r.yhat for r in predict(data).collect()}
        assert sum(y == said[i] for i, y, _ in rows) / len(rows) > 0.9
        models.save_model(predict, path)
        again = models.load_model(spark, path)
        assert again.mean == predict.mean and {r.trial_id: r.yhat for r in again(data.drop("y")).collect()} == said
    with pytest.raises(ValueError):
        models.fit("perceptron", data)
    with pytest.raises(ValueError):
        features.stage_view(data, "stage3")


def test_lda_is_the_textbook_one(spark):
    rng = np.random.default_rng(8)
    y = rng.integers(0, 3, 300)
    x = rng.normal(size=(300, 300)) * rng.uniform(0.1, 9, 300) + y[:, None]
    data = spark.createDataFrame([(i, int(k), v.tolist()) for i, (k, v) in enumerate(zip(y, x))], "trial_id long, y int, features array<double>").repartition(3)
    fitted = models.fit("lda", data)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    assert np.allclose(fitted.mean, x.mean(axis=0)) and np.allclose(fitted.std, x.std(axis=0))
    means = np.stack([z[y == k].mean(axis=0) for k in range(3)])
    pooled = sum((z[y == k] - means[k]).T @ (z[y == k] - means[k]) for k in range(3)) / 300
    w = np.linalg.solve(pooled + 1e-6 * np.trace(pooled) / 300 * np.eye(300), means.T).T
    scores = z @ w.T + [-0.5 * w[k] @ means[k] + np.log((y == k).mean()) for k in range(3)]
    assert {r.trial_id: r.yhat for r in fitted(data).collect()} == dict(enumerate(scores.argmax(axis=1).tolist()))


def test_svm_is_held_against_ten_shuffles(spark, monkeypatch):
    rows = [(i, "val" if i % 5 == 0 else "train", i % 2, [1.0]) for i in range(20)]
    data = spark.createDataFrame(rows, "trial_id long, split string, y int, features array<double>")
    monkeypatch.setattr(queries, "model_data", lambda spark, sf: data)
    monkeypatch.setattr(queries.models, "fit", lambda name, train: lambda val: val.withColumn("yhat", F.lit(1)))
    assert sorted(r.perm for r in queries.QUERIES["perm_test_svm"](spark, "").collect()) == list(range(11))


def test_phases_are_idempotent_and_need_parameters(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for force in (False, False, True):
        assert store.once(spark, str(tmp_path / "t"), make, force).count() == 3
    assert len(made) == 2
    with pytest.raises(FileNotFoundError):
        phases.apply_fitted(spark, spark.createDataFrame([], "trial_id long, channel int, signal array<double>"), str(tmp_path / "none"))
    assert store.variant_tag("2B", 1.0) == "2B" and store.run_tag("2B", 0.2, "stage1", "svm") == "2B_0.2/stage1/svm"


def test_scratch_is_cleared(spark):
    path = store.scratch(spark, "x")
    store.write(spark.range(3), path)
    assert store.exists(spark, path)
    store.clear_scratch(spark)
    assert not store.exists(spark, path) and store.write(spark.range(3), store.scratch(spark, "x")).count() == 3


def test_wide_text_is_read_as_arrays(spark, tmp_path):
    (tmp_path / "w.csv").write_text("label,B_0,B_1,A_0,A_1,sessionnum\n3,1,2,3,4,9\n-1,5,6,7,8,9\n")
    got = sorted((r.label, r.name, list(r.signal)) for r in wide.text_signals(spark, str(tmp_path / "w.csv")).collect())
    assert got == [("-1", "A", [7, 8]), ("-1", "B", [5, 6]), ("3", "A", [3, 4]), ("3", "B", [1, 2])]
    assert wide.channel_names(["label", "T9_0", "T10_0", "label_imgpix_3", "x"]) == ["T10", "T9"]
