"""The training-data pipeline: stages applied to documents, each to what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialmill.llm import bpe, cotrain, langid, mixing, simhash
from trialmill.llm.common import apart, new_path, small_batches, table
from trialmill.llm.queries import tokenizer_path

#: A document is rejected where its language can't be told: no letters, or a score below this.
LEAST_LANGUAGE_SCORE = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps; it learns from docs and labels."""
    small_batches(spark)
    model = cotrain.fit(docs, table(spark, sf_dir, "labels"))
    rows, back = apart(docs, ["text", *cotrain.META])
    return back(cotrain.score(rows, model, keep=rows.columns).where("kept"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told from their text; it learns from docs that carry a language."""
    small_batches(spark)
    rows, back = apart(docs, ["text"])
    found = langid.identify(rows, langid.fit(docs))
    return back(found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of the smallest doc_id."""
    return simhash.deduplicate(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: a row for each copy."""
    return mixing.mixed_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row without its text, with its token ids (`ids`) and the text that they decode to (`decoded`); columns of these names give way."""
    small_batches(spark)
    return bpe.encode(docs, tokenizer_path(), keep=[c for c in docs.columns if c != "text"])


#: (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame.
STAGES = [("quality", quality), ("language", language), ("near_dedup", near_dedup), ("mix", mix), ("tokens", tokens)]

#: The classifiers and the tokenizer can't be said in SQL; tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn; each result is written as Parquet and read again. Stages lower the session's Arrow batches; they are as before at the end."""
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = table(spark, sf_dir, "documents")
    try:
        for name, stage in STAGES:
            path = new_path(spark, name)
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", before)
    return docs
