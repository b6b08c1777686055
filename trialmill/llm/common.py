"""What several operators share: scratch tables, the word rule, hashes, hashed samples."""

from __future__ import annotations

import gc
import re
import time
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.store import delete
from ..sources.store import scratch as new_path

#: A word is a run of code points other than these six; Java, Python and RE2 read it alike.
WORD = r"[^\x20\x09-\x0D]+"
WORDS = re.compile(WORD)

#: Upper-case A-Z to lower case, and nothing else.
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Bytes of text, about, that a task turns into Python objects at once. Spark bounds an Arrow batch by bytes already.
AT_ONCE = 4 << 20


def save(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: the lineage ends, and no executor holds the only copy."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of steps whose results are written: its cleaner waits for a collection, which a calm driver puts off."""
    for _ in range(2):  # the end of the last query is told to listeners with the query itself, a moment after it
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


def forget(df: DataFrame) -> None:
    """Deletes a table that save() wrote and that no later plan reads."""
    delete(df.sparkSession, df.saved_at.rpartition("/")[0])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def share(*keys: Column | str, seed: int = 42) -> Column:
    """A double in [0, 1) that depends on the keys and the seed alone."""
    return F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))


def crc_mod(doc_id: Column | str, m: int) -> Column:
    """crc32 of the id as text, modulo m; a null id counts as the empty text."""
    text = F.coalesce((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(m))


def sampled(df: DataFrame, key: str, rows: int, seed: int = 42) -> DataFrame:
    """About `rows` rows of df, chosen by a hash of the key: all rows, where there are no more."""
    n = df.count()
    return df if n <= rows else df.where(share(key, seed=seed) < rows / n)


def sampled_by(df: DataFrame, key: str, by: str, rows: int, least: int, most: int, seed: int = 42) -> DataFrame:
    """About `rows` rows of df, dealt evenly over the values of `by`: all rows of a value that has no more than its part.

    What small values leave goes to larger ones. A part is never below `least`,
    so that no value is left out where there are many, nor so large that all come to over `most` rows, unless
    there are more values than that: each gives one row at least. Rows are chosen by a hash of the key and the text. A count for
    each value comes to the driver. Null values are left out.
    """
    df = df.where(F.col(by).isNotNull())
    sizes = sorted((r["count"], r[by]) for r in df.groupBy(by).count().collect())
    rates, left = [], rows
    least = max(1, min(least, most // max(len(sizes), 1)))
    for i, (n, value) in enumerate(sizes):
        part = max(left // (len(sizes) - i), least)
        left = max(left - min(n, part), 0)
        if n > part:
            rates.append((value, part, (part + 6 * part**0.5 + 6) / n))  # so many that the part is there, whatever the chance
    if not rates:
        return df
    table = df.sparkSession.createDataFrame(rates, f"_by {df.schema[by].dataType.simpleString()}, _part long, _rate double")
    met = df.join(F.broadcast(table) if len(rates) <= 100_000 else table, F.col(by) == F.col("_by"), "left").withColumn("_share", share(key, "text", seed=seed))
    drawn = met.where(F.col("_rate").isNull() | (F.col("_share") < F.col("_rate")))
    placed = drawn.withColumn("_place", F.row_number().over(Window.partitionBy(by).orderBy("_share")))
    return placed.where(F.col("_rate").isNull() | (F.col("_place") <= F.col("_part"))).select(*df.columns)


def apart(docs: DataFrame, used: Sequence[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with every column but `used` under a name that no operator has, and a function that gives back the columns of docs."""
    hidden = {c: f"__{i}" for i, c in enumerate(docs.columns) if c not in used}
    return docs.select(*[F.col(f"`{c}`").alias(hidden.get(c, c)) for c in docs.columns]), lambda out: out.select(*[F.col(f"`{hidden.get(c, c)}`").alias(c) for c in docs.columns])


def small_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Lowers the bytes that the session puts into an Arrow batch, for rows that carry whole texts in and out of Python."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).rstrip("b")
    if not now.isdigit() or int(now) > most:
        spark.conf.set(name, str(most))


def give_back() -> None:
    """Gives the system what Arrow has freed but keeps: workers live on from stage to stage, beside the executor's heap."""
    pa.default_memory_pool().release_unused()


def map_text(df: DataFrame, keep: Sequence[str], fn: Callable[..., Sequence[Sequence]], fields: str, column: str = "text", beside: Sequence[str] = ()) -> DataFrame:
    """The columns `keep` of df as they are, and new `fields` (DDL) that fn makes of a batch of texts, one sequence for each field.

    With `beside`, fn also gets a batch of those columns. Columns of df that
    share a name with a field are replaced; apart() keeps them. A text of any
    length is one value of one batch: fn sees it whole.
    """
    new = StructType.fromDDL(fields)
    keep = [c for c in keep if c not in new.names]
    schema = StructType([*df.select(*keep).schema.fields, *new.fields])
    at = keep.index(column) if column in keep and df.schema[column].dataType.simpleString() == "string" else len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in new.fields]
        more = lambda b: [pa.RecordBatch.from_arrays(b.columns[-len(beside) :], names=list(beside))] if beside else []
        for whole in batches:
            rows = max(1, int(len(whole) * AT_ONCE / max(whole.column(at).nbytes, 1)))
            for start in range(0, len(whole), rows):
                b = whole.slice(start, rows)
                made = fn(b.column(at).to_pylist(), *more(b))
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *[pa.array(x, k) for x, k in zip(made, kinds, strict=True)]], names=schema.names)
                del b, made
            del whole
            give_back()

    text = [F.col(column).cast("string").alias("_text_")] if at == len(keep) else []
    return df.select(*keep, *text, *[F.col(c).alias(f"_{i}_") for i, c in enumerate(beside)]).mapInArrow(run, schema)
