"""Mixing sources to target weights by systematic sampling.

Targets come from a water level: each source gets its weight's share of the
budget, but no more than `cap` times its own size, and what it can't take is
shared anew by weight. Every document of a source then has the same expected
number of copies. Prefix sums of those, in order of size, plus one offset for
each source, cross a whole number once for each copy that the mix takes.

Prefix sums are in fixed point (2**-32), so they don't depend on the order of
addition. No source is gathered in one task: rows are dealt out by range of
(source, size, doc_id), and a partition starts from the sum of those before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import places
from .common import WORD, apart, save

UNIT = 1 << 32


def n_words(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def offset_units(source: Column, seed: int) -> Column:
    """The random offset of a source, in units of 2**-32; md5 lets other engines repeat it."""
    text = F.concat(F.lit(f"{seed}|"), F.coalesce(source, F.lit("\0null")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("decimal(20,0)")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], budget: float, cap: float) -> DataFrame:
    """sizes(source, source_size) to (source, source_size, target): one small row for each source.

    Sources in code-point order, null last, take the weights in turn; their places are found by range, so any number of sources will do. A target
    is min(cap * size, level * weight); the level spends the budget exactly. It is found in rounds:
    the sources that are full below a level free the rest for a higher one, until no more are full.
    """
    spark = sizes.sparkSession
    placed = places(sizes.withColumn("_none", F.col("source").isNull()), [], ["_none", "source"], "_place")
    given = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("_place", F.lit(len(weights))) + 1).cast("int"))
    x = placed.withColumn("w", given).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    x = save(x.select("source", "source_size", "w", "most", (F.col("most") / F.col("w")).alias("full_at")), "levels")
    spend = (x.agg(F.sum("source_size")).first()[0] or 0) * float(budget)
    level, full = -1.0, None
    while True:
        is_full = F.col("full_at") < F.lit(level)
        row = x.agg(F.coalesce(F.sum(F.when(is_full, F.col("most"))), F.lit(0.0)).alias("most"), F.sum(F.when(~is_full, F.col("w"))).alias("w"), F.count_if(is_full).alias("n")).first()
        if row.n == full or row.w is None:
            break
        level, full = (spend - row.most) / row.w, row.n
    level = float("inf") if row.w is None else level
    target = F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.least("most", F.lit(level) * F.col("w")))
    return x.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), budget: float = 1.5, cap: float = 2.0, seed: int = 42) -> DataFrame:
    """docs with size, source_size, target, and copies: how often the mix takes the document.

    Input: doc_id, source and either size or text; every other column is kept
    (a clashing size, source_size, target or copies is replaced, except that a
    given size is used). Null text has size 0; a null source is a source of its
    own. Documents of size 0 are copied like others and add no words. Sources
    without words get target 0 and no copies. Ties of size go by doc_id; rows
    repeated whole are interchangeable. An empty table gives an empty one.
    """
    keep = [c for c in docs.columns if c not in ("source_size", "target", "copies", "size")]
    size = F.col("size").cast("long") if "size" in docs.columns else n_words("text")
    parts = docs.select(*keep, F.coalesce(size, F.lit(0)).alias("size"))
    thin = save(parts.select("source", "size").groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    targets = save(source_targets(thin, weights, budget, cap), "targets")
    units = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * F.lit(float(UNIT)))).otherwise(F.lit(0)).cast("decimal(20,0)")
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = parts.repartitionByRange(n, F.col("source").asc_nulls_last(), "size", "doc_id")
    laid = save(ordered.withColumn("_part", F.spark_partition_id()), "ranges")
    laid = laid.join(F.broadcast(targets) if targets.count() <= 100_000 else targets, laid["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    laid = laid.withColumn("_units", units)
    sums = laid.groupBy("_part", "source").agg(F.sum("_units").cast("decimal(38,0)").alias("_sum"))
    ahead = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("_part").alias("_p"), F.col("source").alias("_s"), F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).cast("decimal(38,0)").alias("_start"))
    here = Window.partitionBy("_part", "source").orderBy("size", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = laid.withColumn("_run", F.sum("_units").over(here).cast("decimal(38,0)"))
    run = run.join(sums, (F.col("_part") == F.col("_p")) & F.col("source").eqNullSafe(F.col("_s")))
    end = (F.col("_run") + F.col("_start") + offset_units(F.col("source"), seed)).cast("decimal(38,0)")
    crossed = lambda x: F.floor(x / F.lit(UNIT).cast("decimal(11,0)"))
    copies = (crossed(end) - crossed((end - F.col("_units")).cast("decimal(38,0)"))).cast("long")
    return run.select(*keep, "size", "source_size", "target", copies.alias("copies"))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of docs(doc_id, text, source, ...) as often as it is taken, with the columns of docs.

    Copies are found on thin rows; texts are shuffled once, to meet them by
    doc_id, source and size. Rows that agree in all three
    share out their copies by a hash of the text. Other columns are carried, whatever their names.
    """
    docs, back = apart(docs, ["doc_id", "text", "source"])
    key = lambda i, s, z: F.xxhash64(i, s, z).alias("__key")
    hashed = docs.select("*", n_words("text").alias("__size"), F.xxhash64("text").alias("__hash")).select("*", key("doc_id", "source", "__size"))
    thin = save(hashed.select("doc_id", "source", F.col("__size").alias("size")), "sizes")
    taken = mix(thin, **options).where("copies > 0").groupBy("doc_id", "source", "size").agg(F.sort_array(F.collect_list(F.col("copies").cast("int")), asc=False).alias("n"))
    # joined by a hash, which the window then goes by too: texts move once; who shares a hash is told apart by the columns themselves
    taken = save(taken.groupBy(key("doc_id", "source", "size")).agg(F.collect_list(F.struct("doc_id", "source", "size", "n")).alias("__taken")), "taken")
    same = lambda e: e["doc_id"].eqNullSafe(F.col("doc_id")) & e["source"].eqNullSafe(F.col("source")) & (e["size"] == F.col("__size"))
    place = F.row_number().over(Window.partitionBy("__key", "doc_id", "source", "__size").orderBy("__hash"))
    met = hashed.join(taken, "__key").withColumn("__mine", F.get(F.filter("__taken", same), F.lit(0))["n"])
    met = met.withColumn("__times", F.coalesce(F.try_element_at("__mine", place), F.lit(0))).where("__times > 0")
    return back(met.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))))
