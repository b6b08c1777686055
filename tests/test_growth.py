"""Models and streams whose state grew with the input, against loops over small rows."""

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from trialmill.operators import forest, models


def test_a_forests_trees_stay_a_table(spark, monkeypatch):
    """Rows meet grown trees by leaf, in many buckets and shares, large leaves in parts; what is said is the vote of all trees walked here."""
    for name, n in (("MOST", 60), ("SOME", 40), ("AT_ONCE", 900), ("MEET", 800)):
        monkeypatch.setattr(forest, name, n)
    monkeypatch.setattr(forest.finish, "__defaults__", (42, 60, 40, False))
    rng = np.random.default_rng(21)
    x = np.round(rng.normal(size=(300, 4)), 1)
    y = (x[:, 0] > 0).astype(int) + (x[:, 1] > 0.3) * (rng.random(300) < 0.8)
    data = spark.createDataFrame([(i, int(a), b.tolist()) for i, (a, b) in enumerate(zip(y, x))], "trial_id long, y int, features array<double>").repartition(3)
    fitted = models.fit("random_forest", data)
    assert fitted.model.stages[-1].getMaxDepth() <= 8 and fitted.deep.nodes.count() > 200 and fitted.deep.buckets > 3 and fitted.deep.parting
    said = {r.trial_id: r.yhat for r in fitted(data).collect()}
    from pyspark.ml.functions import array_to_vector

    reached = fitted.forest().transform(data.withColumn("x", fitted.scaled()).withColumn("v", array_to_vector("x"))).select("trial_id", "x", vector_to_array("_leaf").alias("leaf")).toPandas()
    scaled, leaf = np.stack(reached.x), np.stack(reached.leaf).astype(int)
    votes = np.zeros((300, 3), int)
    for tree, labels in fitted.deep.leaves.items():
        told = labels[leaf[:, tree]]
        for one in np.unique(leaf[told == forest.MIXED, tree]):
            mine = leaf[:, tree] == one
            told[mine] = fitted.deep.end_of(tree, int(one), scaled[mine])
        votes[np.arange(300), told] += 1
    assert [said[i] for i in reached.trial_id] == votes.argmax(axis=1).tolist()
    shares = {r.position: r.value for r in models.importances(fitted, spark).collect()}
    assert abs(sum(shares.values()) - 1) < 1e-9 and min(shares[0], shares[1]) > max(shares[2], shares[3])


def test_importances_count_splits_below_sparks_leaves():
    """The impurity that all splits of a tree lessen is that of its root, as its ends are pure."""
    rng = np.random.default_rng(22)
    x, y, w, root = rng.normal(size=(500, 3)), rng.integers(0, 3, 500), rng.integers(1, 4, 500), np.repeat([0, 1], [200, 300])
    nodes, owner = forest.grow_all(x, y, w.astype(float), root, 5)
    for one, t in enumerate(forest.by_root(nodes, owner)):
        mine = root == one
        assert (t.ends(x[mine]) == y[mine]).all()
        assert np.isclose(t.gain.sum(), forest.impurity(np.bincount(y[mine], weights=w[mine])))


def test_many_sessions_share_a_state(spark, tmp_path):
    """Hundreds of sessions in few states, over three batches, the last with late rows; null sessions and labels keep their place."""
    from trialmill.streaming import pairing, stream

    schema = "seq long, label int, sessionnum long, ts timestamp"
    rng = np.random.default_rng(23)
    label, session = rng.choice([-1, 0, 1], 3000), rng.integers(-150, 150, 3000)
    rows = [(i, None if i % 50 == 7 else int(a), None if s == 3 else int(s), None) for i, (a, s) in enumerate(zip(label, session))]
    held = [r for r in rows[:1500] if r[0] % 11 == 5]
    path, at = str(tmp_path / "in"), str(tmp_path / "out")
    seen: dict = {}
    want = []
    for part in ([r for r in rows[:1500] if r not in held], rows[1500:], held):
        passed = {s: p[0] for s, p in seen.items()}
        for seq, lab, s, _ in part:
            if s in passed and seq <= passed[s]:
                want += [("late", seq, lab, None, s)] if lab != -1 else []
                continue
            before = seen.get(s)
            if lab != -1:
                want.append(("pair", seq, lab, before[0], s) if before and before[1] == -1 else ("unpaired", seq, lab, None, s))
            seen[s] = (seq, lab)
        spark.createDataFrame(part, schema).repartition(2).write.mode("append").parquet(path)
        got = stream.drain(pairing.by_session(stream.read_rows(spark, path, schema), states=7), "s", at)
    assert sorted(map(str, want)) == sorted(str((r.kind, r.seq, r.label, r.blank_seq, r.sessionnum)) for r in got.collect())
    assert spark.read.format("statestore").option("stateVarName", "last").load(f"{at}-state").count() == 7


def test_a_rows_place_is_sent_once(spark, tmp_path):
    """Only the last row of a key stands under the next key too; times and nulls come back as they were."""
    from datetime import datetime, timedelta

    from trialmill.streaming import pairing, stream

    schema = "seq long, label int, sessionnum long, ts timestamp"
    rng = np.random.default_rng(24)
    start = datetime(2024, 3, 1, 5, 6, 7, 123456)
    rows = [(i, int(a), None if i % 9 == 0 else i % 4, None if i % 13 == 0 else start + timedelta(hours=i)) for i, a in enumerate(rng.choice([-1, 0, 1], 900))]
    mixed = [rows[i] for i in rng.permutation(900)]
    path = str(tmp_path / "in")
    for i in range(0, 900, 300):
        spark.createDataFrame(mixed[i : i + 300], schema).coalesce(1).write.mode("append").parquet(path)
    at = str(tmp_path / "out")
    got = stream.drain(pairing.by_place(stream.read_rows(spark, path, schema, 1), places=64), "p", at)
    pair = lambda i: i > 0 and rows[i - 1][1] == -1
    want = [("pair" if pair(i) else "unpaired", i, a, i - 1 if pair(i) else None, s, t) for i, a, s, t in rows if a != -1]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.collect())
    assert spark.read.format("statestore").option("stateVarName", "waiting").load(f"{at}-state").count() == 1
    assert pairing.placed(spark.read.parquet(path), 64).count() == 900 + 900 // 64


def test_rows_are_not_mapped_one_by_one(spark):
    """What tasks add up over kernel values, mapped once, is what mapped rows add up to."""
    from trialmill.operators import kernel

    rng = np.random.default_rng(25)
    x, sign, onto = rng.normal(size=(90, 3)), rng.choice([-1.0, 1.0], 90), rng.normal(size=(20, 7))
    step = lambda onto: kernel.Step(0.3, x[:20], onto, rng_point, 0.7, rng_point[::-1])
    rng_point = rng.normal(size=8)
    rows = spark.createDataFrame([(v.tolist(), float(s)) for v, s in zip(x, sign)], "x array<double>, sign double").repartition(3)
    for what in ("slope", "losses"):
        assert np.allclose(kernel.over_rows(rows)(step(onto), what), kernel.over_arrays(x, sign, step(onto))(step(onto), what))
    assert step(None).mapped(x).shape == (90, 21)
