"""The pipeline's stages on a small table, each against what it must keep."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from trialmill.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    rng = np.random.default_rng(21)
    words = {"en": "the and river with light stone over".split(), "fr": "les et rivière avec été pierre sur".split()}
    rows, labels = [], []
    for i in range(120):
        c = ("en", "fr")[i % 2]
        rows.append((i, " ".join(rng.choice(words[c]) + str(rng.choice(["", "s", "er", "ing", "al"])) for _ in range(40)) + ".", c, f"s{i % 3}", 200))
        labels.append((i, 1, 0))
    for i in range(120, 140):
        rows.append((i, " ".join(w + "&&&%%%" for w in rng.choice(words["en"], 40)), "en", "s0", 200))
        labels.append((i, 0, 0))
    rows += [(150, rows[4][1], "en", "s1", 200), (151, None, "en", "s1", None), (152, "12 34", None, None, 5)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, {r[0]: r for r in rows}


def test_stages(spark, world):
    path, rows = world
    docs = spark.read.parquet(f"{path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "language", "near_dedup", "mix", "tokens"]
    kept = stages["quality"](spark, docs, path)
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == docs.columns and ids >= set(range(120)) and not ids & set(range(120, 140))
    told = stages["language"](spark, docs, path)
    ids = {r.doc_id for r in told.collect()}
    assert told.columns == docs.columns and ids >= set(range(120)) and not ids & {151, 152}
    lone = stages["near_dedup"](spark, docs, path)
    ids = {r.doc_id for r in lone.collect()}
    assert lone.columns == docs.columns and 150 not in ids and 4 in ids
    mixed = stages["mix"](spark, docs, path)
    assert mixed.columns == docs.columns and mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    encoded = stages["tokens"](spark, docs, path)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    for r in encoded.collect():
        ids = t.encode(rows[r.doc_id][1] or "", add_special_tokens=False).ids
        assert list(r.ids) == ids and r.decoded == t.decode(ids, skip_special_tokens=False)


def test_run(spark, world):
    path, rows = world
    out = corpus_pipeline.run(spark, path).collect()
    ids = {r.doc_id for r in out}
    assert ids and ids <= set(range(120)) and all(r.decoded for r in out)


def test_stages_change_no_column(spark, world):
    """Columns with the names that operators use come through as they are; rows that share an id, too."""
    path, rows = world
    docs = spark.read.parquet(f"{path}/documents.parquet")
    names = "score kept lang_pred quality_score text_odds meta_odds _key _size _n _th fp root component_id size target copies _m0 _x doc".split()
    docs = docs.withColumns({n: F.concat(F.lit(f"{n}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) for n in names})
    docs = docs.unionByName(docs.where("doc_id = 1").withColumn("text", F.reverse("text")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString(), name
        got = out.select("doc_id", *names).distinct().collect()
        assert got and all(r[n] == f"{n}:{'' if r.doc_id is None else r.doc_id}" for r in got for n in names), name
        if name == "near_dedup":
            assert out.where("doc_id = 1").count() == 2


def test_a_very_long_text_passes_every_stage(spark, world):
    path, _ = world
    long = "the and river with light stone over " * 400_000  # 14 MB
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(60)
    docs = docs.unionByName(spark.createDataFrame([(9000, long, "en", "s1", len(long))], DOCS))
    for name, stage in corpus_pipeline.STAGES:
        n = stage(spark, docs, path).where("doc_id = 9000").count()
        assert n == 1 or name not in {"near_dedup", "tokens"}, name
