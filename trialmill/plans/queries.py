"""The registered queries over the driver's tables, each with the SQL that it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import rounded
from ..functions.design import bandpass_matrix, notch_matrix
from ..operators import acquire, artifacts, evaluate, features, models, permute, profile, robust, spectral, split
from ..sources import binding, order, store, wide
from ..streaming import pairing, stream
from . import phases

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
CAP, CLASSES = 100, [0, 1, 2, 3]
DIGITS = [-1, *range(1, 10)]
SHUFFLES_OF_A_MODEL = 10  # as in the reference, for classical models
BANDS = (("low", 0.0, 16.0), ("middle", 16.0, 40.0), ("high", 40.0, 80.0), ("top", 80.0, 125.0))
N = 32  # samples to a segment of the 64-sample signals


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql.strip()
        return f

    return register


# --- SQL that several oracles share -------------------------------------------------------------------------------

ROWS = """r AS (SELECT event_id AS seq, CASE event_type WHEN 'view' THEN -1 WHEN 'click' THEN 0 WHEN 'signup' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END AS label,
  user_id AS sessionnum, CAST(ts AS DATE) AS block, ts, value FROM events)"""
PAIRS = ROWS + """, p AS (SELECT d.*, b.seq AS blank_seq FROM r d JOIN r b ON d.seq = b.seq + 1 AND b.label = -1 WHERE d.label <> -1)"""
CAPPED = PAIRS + f""", c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY seq) AS taken FROM p) WHERE taken <= {CAP})"""
TRIALS = """t AS (SELECT vec_id AS trial_id, CASE WHEN label = 0 THEN -1 ELSE label END AS label_digit, CASE WHEN label = 0 THEN 0 ELSE 1 END AS label_binary,
  vec_id // 50 AS sessionnum, vec_id // 10 AS blocknum, vec_id % 10 AS blockpos FROM embeddings)"""
SIGNALS = """s AS (SELECT vec_id AS trial_id, CAST(c AS INTEGER) AS channel, list_transform(list_slice(embedding, 16 * c + 1, 16 * c + 16), lambda x: CAST(x AS DOUBLE)) AS signal
  FROM embeddings, (SELECT unnest(range(4)) AS c))"""
LONG = """g AS (SELECT vec_id AS trial_id, 0 AS channel, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS signal FROM embeddings)"""
SAMPLES = SIGNALS + """, x AS (SELECT trial_id, channel, i, signal[i + 1] AS v FROM s, (SELECT unnest(range(16)) AS i))"""
UNIT = "CAST('0x' || substr(md5(concat_ws('|', {}))  , 1, 8) AS BIGINT) / 4294967296.0"
SPLIT = f"""b AS (SELECT sessionnum, blocknum, CASE WHEN {UNIT.format("'42', CAST(sessionnum AS VARCHAR), CAST(blocknum AS VARCHAR)")} < 0.2 THEN 'val' ELSE 'train' END AS split
  FROM (SELECT DISTINCT sessionnum, blocknum FROM t))"""
#: Whatever is fitted is fitted on the train share of the block split.
TRAIN = f"""{TRIALS}, {SPLIT}, tr AS (SELECT trial_id FROM t JOIN b USING (sessionnum, blocknum) WHERE split = 'train')"""
OWN = "(SELECT * FROM q WHERE trial_id IN (SELECT trial_id FROM tr))"
FIT = """m AS (SELECT channel, quantile_cont(v, 0.5) AS center FROM x GROUP BY channel),
f AS (SELECT x.channel, m.center, greatest(1.4826 * quantile_cont(abs(v - center), 0.5), 1e-8) AS scale FROM x JOIN m USING (channel) GROUP BY x.channel, m.center)"""
DEAD = """s AS (SELECT vec_id AS trial_id, CAST(c AS INTEGER) AS channel, CASE WHEN c = 4 THEN list_transform(range(16), lambda i: CAST(0 AS DOUBLE)) ELSE list_transform(list_slice(embedding, 16 * c + 1, 16 * c + 16), lambda x: CAST(x AS DOUBLE)) END AS signal
  FROM embeddings, (SELECT unnest(range(5)) AS c)), x AS (SELECT trial_id, channel, i, signal[i + 1] AS v FROM s, (SELECT unnest(range(16)) AS i))"""


def measures(samples: str) -> str:
    """Diagnostics from samples(trial_id, channel, i, v)."""
    return f"""j AS (SELECT *, v - lag(v) OVER (PARTITION BY trial_id, channel ORDER BY i) AS d FROM {samples}),
q AS (SELECT trial_id, channel, max(abs(v)) AS amplitude, max(abs(d)) AS jump, stddev_pop(v) AS std, CASE WHEN var_pop(v) > 0 THEN kurtosis_pop(v) END AS kurtosis FROM j GROUP BY trial_id, channel)"""


LIMITS = """l AS (SELECT quantile_cont(amplitude, 0.995) AS amplitude, quantile_cont(jump, 0.995) AS jump, quantile_cont(kurtosis, 0.995) AS kurtosis, quantile_cont(std, 0.005) AS flatline FROM {})"""
FLAGS = """k AS (SELECT trial_id, channel, coalesce(q.amplitude > l.amplitude, false) AS is_amplitude, coalesce(q.jump > l.jump, false) AS is_jump,
  coalesce(q.kurtosis > l.kurtosis, false) AS is_kurtosis, coalesce(q.std <= l.flatline, false) AS is_flatline FROM q, l),
a AS (SELECT *, is_amplitude OR is_jump OR is_kurtosis OR is_flatline AS is_any FROM k),
n AS (SELECT trial_id, count(*) FILTER (is_any) AS n_flagged, count(*) FILTER (is_any) >= {least} AS trial_concern FROM a GROUP BY trial_id)"""
TRAINED = f"{TRAIN}, {SAMPLES}, {measures('x')}, {LIMITS.format(OWN)}, {FLAGS.format(least=1)}"
PSD = LONG + f""", e AS (SELECT trial_id, channel, o, list_slice(signal, o + 1, o + {N}) AS z FROM g, (SELECT unnest([0, 16, 32]) AS o)),
w AS (SELECT trial_id, channel, o, i, (z[i + 1] - list_avg(z)) * (0.5 - 0.5 * cos(2 * pi() * i / {N})) AS v FROM e, (SELECT unnest(range({N})) AS i)),
h AS (SELECT trial_id, channel, o, k, sum(v * cos(2 * pi() * k * i / {N})) AS re, sum(v * sin(2 * pi() * k * i / {N})) AS im FROM w, (SELECT unnest(range({N // 2 + 1})) AS k) GROUP BY trial_id, channel, o, k),
y AS (SELECT trial_id, channel, CAST(k AS INTEGER) AS k, k * 250.0 / {N} AS freq, avg((re * re + im * im) * CASE WHEN k IN (0, {N // 2}) THEN 1 ELSE 2 END / (250.0 * 12)) AS power FROM h GROUP BY trial_id, channel, k)"""


def band_sql(lo: float, hi: float, name: str) -> str:
    return f"coalesce(sum((power + before) / 2 * {250.0 / N}) FILTER (freq BETWEEN {lo} AND {hi} AND freq - {250.0 / N} >= {lo}), 0.0) AS {name}"


BAND_POWER = PSD + f""", yy AS (SELECT *, lag(power) OVER (PARTITION BY trial_id, channel ORDER BY k) AS before FROM y),
bp AS (SELECT trial_id, channel, {', '.join(band_sql(lo, hi, name) for name, lo, hi in BANDS)} FROM yy GROUP BY trial_id, channel),
fr AS (SELECT trial_id, channel, arg_max(freq, {{power: power, k: -k}}) AS dominant_freq, sum((power + before) / 2 * {250.0 / N}) AS total_power FROM yy GROUP BY trial_id, channel)"""
MOMENTS = """mo AS (SELECT trial_id, channel, count(*) AS n, avg(v) AS mean, sum(v) AS s1, sum(v * v) AS s2, sum(v * v * v) AS s3, var_pop(v) AS variance, kurtosis_pop(v) AS kp FROM {0} GROUP BY trial_id, channel),
zc AS (SELECT trial_id, channel, avg(CASE WHEN d <> 0 THEN 1.0 ELSE 0.0 END) AS zero_crossing_rate FROM (SELECT trial_id, channel, sign(v) - lag(sign(v)) OVER (PARTITION BY trial_id, channel ORDER BY i) AS d FROM {0}) WHERE d IS NOT NULL GROUP BY trial_id, channel),
st AS (SELECT mo.trial_id, mo.channel, mean, variance, CASE WHEN variance < 1e-12 THEN 0.0 ELSE (s3 / n - 3 * mean * s2 / n + 2 * mean * mean * mean) / pow(variance, 1.5) END AS skewness,
  CASE WHEN variance < 1e-12 THEN 0.0 ELSE kp END AS kurtosis, zero_crossing_rate FROM mo JOIN zc USING (trial_id, channel))"""
LONG_SAMPLES = "x AS (SELECT trial_id, channel, i, signal[i + 1] AS v FROM g, (SELECT unnest(range(64)) AS i))"
BINARY = "pr AS (SELECT doc_id AS trial_id, quality AS y, 1 - toxic AS yhat FROM labels)"
MULTI = "pr AS (SELECT CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS y, CAST(1 + o_custkey % 5 AS INTEGER) AS yhat FROM orders)"
CONFUSION = """cm AS (SELECT a.y, b.yhat, CAST(coalesce(n, 0) AS BIGINT) AS n FROM (SELECT y FROM pr UNION SELECT yhat FROM pr) a(y) CROSS JOIN (SELECT y FROM pr UNION SELECT yhat FROM pr) b(yhat)
  LEFT JOIN (SELECT y, yhat, count(*) AS n FROM pr GROUP BY y, yhat) c ON a.y = c.y AND b.yhat = c.yhat),
pc AS (SELECT label, support, CASE WHEN said > 0 THEN hit / said ELSE 0.0 END AS precision, CASE WHEN support > 0 THEN hit / support ELSE 0.0 END AS recall
  FROM (SELECT l.y AS label, CAST(sum(n) FILTER (cm.y = l.y AND yhat = l.y) AS DOUBLE) AS hit, CAST(sum(n) FILTER (cm.y = l.y) AS BIGINT) AS support, sum(n) FILTER (yhat = l.y) AS said FROM cm, (SELECT DISTINCT y FROM cm) l GROUP BY l.y)),
pf AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM pc)"""
ACCURACY = "(SELECT sum(n) FILTER (y = yhat) / sum(n) FROM cm)"


# --- the tables as trials --------------------------------------------------------------------------------------------


def rows(spark: SparkSession, sf: str) -> DataFrame:
    return binding.stream_rows(binding.table(spark, sf, "events"))


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    return acquire.paired(rows(spark, sf).select("seq", "label", "sessionnum"))


def trials(spark: SparkSession, sf: str) -> DataFrame:
    return binding.trials(binding.table(spark, sf, "embeddings"))


def signals(spark: SparkSession, sf: str) -> DataFrame:
    return binding.signals(binding.table(spark, sf, "embeddings"))


def long_signals(spark: SparkSession, sf: str) -> DataFrame:
    return binding.long_signals(binding.table(spark, sf, "embeddings"))


def dead(spark: SparkSession, sf: str) -> DataFrame:
    return binding.with_dead_channel(signals(spark, sf))


def binary(spark: SparkSession, sf: str) -> DataFrame:
    return binding.table(spark, sf, "labels").select(F.col("doc_id").alias("trial_id"), F.col("quality").alias("y"), (1 - F.col("toxic")).alias("yhat"))


def multiclass(spark: SparkSession, sf: str) -> DataFrame:
    return binding.table(spark, sf, "orders").select(F.substring("o_orderpriority", 1, 1).cast("int").alias("y"), (1 + F.col("o_custkey") % 5).cast("int").alias("yhat"))


def train_ids(spark: SparkSession, sf: str) -> DataFrame:
    """The trials of the block split's train share."""
    x = trials(spark, sf)
    return split.with_split(x, split.assign_blocks(x)).where("split = 'train'").select("trial_id")


def fit_part(df: DataFrame, spark: SparkSession, sf: str) -> DataFrame:
    return df.join(train_ids(spark, sf), "trial_id", "left_semi")


def flagged(spark: SparkSession, sf: str) -> DataFrame:
    """Flags of all trials by thresholds from the training part."""
    measured = artifacts.metrics(signals(spark, sf))
    return artifacts.flags(measured, artifacts.thresholds(fit_part(measured, spark, sf)))


def trial_flags(spark: SparkSession, sf: str) -> DataFrame:
    return artifacts.concern(flagged(spark, sf), least=1)


def round_all(df: DataFrame) -> DataFrame:
    """Doubles to six places, as the oracles have them."""
    return df.select(*[rounded(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# --- acquisition -----------------------------------------------------------------------------------------------------


@query(f"WITH {ROWS} SELECT seq, label, sessionnum FROM r WHERE seq < {CAP * 10 * 5}")
def scan_guard(spark, sf):
    return acquire.scan_guard(rows(spark, sf), CAP).select("seq", "label", "sessionnum")


@query(f"WITH {PAIRS} SELECT seq, label, sessionnum, blank_seq FROM p")
def paired_trials(spark, sf):
    return pairs(spark, sf).select("seq", "label", "sessionnum", "blank_seq")


@query(f"WITH {ROWS} SELECT seq, label FROM r WHERE label <> -1 AND seq - 1 NOT IN (SELECT seq FROM r WHERE label = -1)")
def unpaired_digits(spark, sf):
    return acquire.unpaired(rows(spark, sf).select("seq", "label"))


@query(f"WITH {ROWS}, g AS (SELECT *, lag(label) OVER (ORDER BY seq) AS label_before, lag(seq) OVER (ORDER BY seq) AS blank_seq FROM r WHERE seq % 7 <> 3) SELECT seq, label, blank_seq FROM g WHERE label <> -1 AND label_before = -1")
def paired_over_gaps(spark, sf):
    """Pairs by order of rows, where every seventh row is missing."""
    return acquire.paired(rows(spark, sf).where("seq % 7 <> 3").select("seq", "label")).select("seq", "label", "blank_seq")


@query(f"WITH {ROWS}, g AS (SELECT *, lag(label) OVER w AS label_before, lag(seq) OVER w AS blank_seq FROM r WINDOW w AS (PARTITION BY sessionnum ORDER BY seq)) SELECT seq, label, blank_seq, sessionnum FROM g WHERE label <> -1 AND label_before = -1")
def paired_in_sessions(spark, sf):
    return acquire.paired(rows(spark, sf).select("seq", "label", "sessionnum"), ["sessionnum"]).select("seq", "label", "blank_seq", "sessionnum")


@query(f"WITH {ROWS}, g AS (SELECT event_id, label, row_number() OVER (ORDER BY event_id) - 1 AS seq FROM (SELECT *, seq AS event_id FROM r WHERE seq % 5 <> 2)) SELECT seq, event_id, label FROM g")
def file_order(spark, sf):
    """Rows without an order of their own, in several files: numbered densely by file and place, after which they pair as they stand."""
    path, x = store.scratch(spark, "files"), rows(spark, sf).where("seq % 5 <> 2").select(F.col("seq").alias("event_id"), "label")
    x.repartitionByRange(5, "event_id").sortWithinPartitions("event_id").write.parquet(path)
    return order.in_file_order(spark, path).select("seq", "event_id", "label")


@query(f"WITH {ROWS} SELECT seq, sessionnum, label, lag(label) OVER (PARTITION BY sessionnum ORDER BY seq) AS prev_label FROM r")
def prev_label(spark, sf):
    return acquire.previous_label(rows(spark, sf))


@query(f"WITH {CAPPED} SELECT seq, label, blank_seq, taken FROM c")
def capped_pairs(spark, sf):
    return acquire.capped(pairs(spark, sf), CAP).select("seq", "label", "blank_seq", "taken")


@query(f"WITH {PAIRS} SELECT seq, label, row_number() OVER (PARTITION BY label ORDER BY seq) AS running FROM p")
def running_fill(spark, sf):
    return acquire.capped(pairs(spark, sf), None).select("seq", "label", F.col("taken").alias("running"))


@query(f"WITH {CAPPED} SELECT k.label, coalesce(n, 0) AS accepted, {CAP} AS target, coalesce(n, 0) >= {CAP} AS is_full FROM (SELECT unnest([0, 1, 2, 3]) AS label) k LEFT JOIN (SELECT label, count(*) AS n FROM c GROUP BY label) USING (label)")
def class_fill(spark, sf):
    return acquire.class_fill(acquire.capped(pairs(spark, sf), CAP), CLASSES, CAP)


@query(f"WITH {CAPPED} SELECT CASE WHEN count(*) FILTER (n >= {CAP}) = 4 THEN max(last) END AS stop_seq FROM (SELECT label, count(*) AS n, max(seq) AS last FROM c GROUP BY label)")
def stop_position(spark, sf):
    return acquire.stop_position(acquire.capped(pairs(spark, sf), CAP), CLASSES, CAP)


POOL = CAPPED + """, o AS (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS k FROM c),
po AS (SELECT 2 * k AS position, seq, label FROM o UNION ALL SELECT 2 * k + 1, blank_seq, -1 FROM o)"""


@query(f"WITH {POOL} SELECT position, seq, label FROM po")
def pool_order(spark, sf):
    return acquire.pool_order(acquire.capped(pairs(spark, sf), CAP))


@query(f"WITH {POOL} SELECT position, seq, label AS label_digit, CASE WHEN label = -1 THEN 0 ELSE 1 END AS label_binary FROM po")
def acquire_pool(spark, sf):
    return acquire.acquire(rows(spark, sf), CAP)


@query(f"WITH {ROWS}, v AS (SELECT label, lag(label) OVER (PARTITION BY sessionnum ORDER BY seq) AS p FROM r) SELECT count(*) FILTER ((label = -1) <> (p = -1)) AS n_changes, count(*) FILTER ((label = -1) = (p = -1)) AS n_same FROM v WHERE p IS NOT NULL")
def label_alternation(spark, sf):
    return acquire.alternation(rows(spark, sf))


@query(f"WITH {ROWS} SELECT seq, label AS label_digit, CASE WHEN label = -1 THEN 0 ELSE 1 END AS label_binary, sessionnum FROM r")
def label_views(spark, sf):
    return acquire.with_binary(rows(spark, sf)).select("seq", "label_digit", "label_binary", "sessionnum")


# --- profile and validation --------------------------------------------------------------------------------------------


@query(f"WITH {ROWS} SELECT label, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS percent FROM r GROUP BY label")
def label_distribution(spark, sf):
    return profile.label_distribution(rows(spark, sf))


@query(f"WITH {ROWS} SELECT count(DISTINCT label) AS n_labels, count(DISTINCT sessionnum) AS n_sessions, count(DISTINCT (sessionnum, block)) AS n_blocks FROM r")
def distinct_counts(spark, sf):
    return profile.distinct_counts(rows(spark, sf))


@query(f"WITH {ROWS} SELECT sessionnum, count(*) AS n_trials FROM r GROUP BY sessionnum")
def session_counts(spark, sf):
    return profile.counts_by(rows(spark, sf), "sessionnum")


@query(f"WITH {ROWS} SELECT sessionnum, CAST(block AS VARCHAR) AS block, count(*) AS n_trials FROM r GROUP BY sessionnum, block")
def block_counts(spark, sf):
    return profile.counts_by(rows(spark, sf), "sessionnum", "block").withColumn("block", F.col("block").cast("string"))


@query(f"WITH {TRIALS} SELECT CAST(k.d AS INTEGER) AS label_digit, coalesce(n, 0) AS n, n_total, n_blank, n_digit FROM (SELECT unnest([-1, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10]) AS d) k LEFT JOIN (SELECT label_digit, count(*) AS n FROM t GROUP BY label_digit) c ON c.label_digit = k.d, (SELECT count(*) AS n_total, count(*) FILTER (label_binary = 0) AS n_blank, count(*) FILTER (label_binary = 1) AS n_digit FROM t)")
def pool_validation(spark, sf):
    return profile.pool_validation(trials(spark, sf), [*DIGITS, 10])


@query(f"WITH {SIGNALS} SELECT channel, CAST(16 * count(*) AS BIGINT) AS n_values, count(*) FILTER (trial_id % 100 = 0) AS n_nan, CAST(0 AS BIGINT) AS n_inf FROM s GROUP BY channel")
def nan_audit(spark, sf):
    spoilt = F.transform("signal", lambda x, i: F.when((i == 0) & (F.col("trial_id") % 100 == 0), F.lit(float("nan"))).otherwise(x))
    return profile.nan_audit(signals(spark, sf).withColumn("signal", spoilt))


@query(f"WITH {ROWS} SELECT seq, label, sessionnum FROM r ORDER BY seq LIMIT 50")
def head_sample(spark, sf):
    return profile.head_sample(rows(spark, sf), 50).select("seq", "label", "sessionnum")


@query(f"WITH {ROWS} SELECT DISTINCT sessionnum, CAST(block AS VARCHAR) AS block FROM r ORDER BY 1, 2")
def sorted_blocks(spark, sf):
    return rows(spark, sf).select("sessionnum", F.col("block").cast("string").alias("block")).distinct().orderBy("sessionnum", "block")


@query(f"WITH {ROWS}, v AS (SELECT *, ts < lag(ts) OVER (PARTITION BY sessionnum, block ORDER BY seq) AS back FROM r) SELECT sessionnum, CAST(block AS VARCHAR) AS block, count(*) AS n_rows, count(*) FILTER (back) AS n_inversions FROM v GROUP BY sessionnum, block")
def order_audit(spark, sf):
    return profile.order_audit(rows(spark, sf)).withColumn("block", F.col("block").cast("string"))


@query("SELECT c AS channel, CAST(16 AS BIGINT) AS n_columns, CAST(16 * (SELECT count(*) FROM embeddings) AS BIGINT) AS n_values FROM (VALUES ('AF3'), ('Pz'), ('T10'), ('T9')) v(c)")
def channel_names(spark, sf):
    raw = binding.wide(binding.table(spark, sf, "embeddings"))
    names = spark.createDataFrame([(n, c) for n in wide.channel_names(raw.columns) for c in raw.columns if wide.role_of(c) == "signal" and c.rpartition("_")[0] == n], "channel string, column string")
    return wide.unpivoted(raw).join(names, "column").groupBy("channel").agg(F.count_distinct("column").alias("n_columns"), F.count("value").alias("n_values"))


@query("SELECT role, n_columns, CAST(n_columns * (SELECT count(*) FROM embeddings) AS BIGINT) AS n_values FROM (VALUES ('signal', CAST(64 AS BIGINT)), ('image', 4), ('label', 1), ('metadata', 3)) v(role, n_columns)")
def column_roles(spark, sf):
    raw = binding.wide(binding.table(spark, sf, "embeddings"))
    return profile.column_roles(wide.unpivoted(raw), [c for c in raw.columns if c != "trial_id"])


@query(f"WITH {SAMPLES} SELECT trial_id, CAST(CASE channel WHEN 2 THEN 0 WHEN 3 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS INTEGER) AS channel, CASE channel WHEN 2 THEN 'AF3' WHEN 3 THEN 'Pz' WHEN 1 THEN 'T10' ELSE 'T9' END AS name, CAST(i AS INTEGER) AS i, round(v, 6) + 0.0 AS value FROM x")
def wide_to_signal(spark, sf):
    x = wide.to_signals(binding.wide(binding.table(spark, sf, "embeddings")))
    return round_all(x.select("trial_id", "channel", "name", F.posexplode("signal").alias("i", "value")))


@query("SELECT CAST(4 AS BIGINT) AS n_channels, 16 AS min_samples, 16 AS max_samples, CAST(64 AS BIGINT) AS values_per_trial, true AS is_regular")
def signal_shape_check(spark, sf):
    return profile.shape_check(wide.to_signals(binding.wide(binding.table(spark, sf, "embeddings"))))


@query(f"WITH {SAMPLES}, {FIT} SELECT round(min(center), 6) + 0.0 AS min_center, round(max(center), 6) + 0.0 AS max_center, round(min(scale), 6) + 0.0 AS min_scale, round(max(scale), 6) + 0.0 AS max_scale FROM f")
def range_stats(spark, sf):
    return profile.range_stats(robust.fit(signals(spark, sf)))


# --- splits --------------------------------------------------------------------------------------------------------------


@query(f"WITH {TRIALS}, {SPLIT} SELECT trial_id, sessionnum, blocknum, split FROM t JOIN b USING (sessionnum, blocknum)")
def split_assign(spark, sf):
    x = trials(spark, sf)
    return split.with_split(x, split.assign_blocks(x)).select("trial_id", "sessionnum", "blocknum", "split")


@query(f"WITH {TRIALS} SELECT sessionnum, CASE WHEN {UNIT.format("'42', CAST(sessionnum AS VARCHAR)")} < 0.2 THEN 'val' ELSE 'train' END AS split FROM (SELECT DISTINCT sessionnum FROM t)")
def split_session(spark, sf):
    return split.assign_sessions(trials(spark, sf))


@query(f"WITH {TRIALS}, v AS (SELECT sessionnum, blocknum, min(trial_id) AS starts FROM t GROUP BY sessionnum, blocknum) SELECT sessionnum, blocknum, CASE WHEN percent_rank() OVER (ORDER BY starts, sessionnum, blocknum) >= 0.8 THEN 'val' ELSE 'train' END AS split FROM v")
def split_chrono(spark, sf):
    return split.assign_chronological(trials(spark, sf))


@query(f"WITH {TRIALS}, {SPLIT} SELECT split, label_binary, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY split), 2) AS percent FROM t JOIN b USING (sessionnum, blocknum) GROUP BY split, label_binary")
def split_balance(spark, sf):
    x = trials(spark, sf)
    return split.balance(split.with_split(x, split.assign_blocks(x)))


@query(f"WITH {TRIALS}, {SPLIT} SELECT split, label_binary, count(*) AS n FROM t JOIN b USING (sessionnum, blocknum) GROUP BY ROLLUP (split, label_binary)")
def split_balance_rollup(spark, sf):
    x = trials(spark, sf)
    return split.balance_rollup(split.with_split(x, split.assign_blocks(x)))


@query(f"WITH {TRIALS}, {SPLIT}, v AS (SELECT sessionnum, blocknum, count(DISTINCT split) AS k, count(*) FILTER (split = 'train') AS a, count(*) FILTER (split = 'val') AS z FROM t JOIN b USING (sessionnum, blocknum) GROUP BY sessionnum, blocknum) SELECT count(*) FILTER (k > 1) AS n_overlap, CAST(sum(a) AS BIGINT) AS n_train, CAST(sum(z) AS BIGINT) AS n_val FROM v")
def split_validation(spark, sf):
    x = trials(spark, sf)
    return split.validation(split.with_split(x, split.assign_blocks(x)))


@query(f"WITH {TRIALS}, {SPLIT} SELECT split, count(*) AS n FROM t JOIN b USING (sessionnum, blocknum) GROUP BY split")
def split_sink_counts(spark, sf):
    x = trials(spark, sf)
    back = store.write(split.with_split(x, split.assign_blocks(x)), store.scratch(spark, "splits"), ("split",))
    parts = [back.where(F.col("split") == s).groupBy("split").agg(F.count(F.lit(1)).alias("n")) for s in ("train", "val")]
    return parts[0].unionByName(parts[1])


@query(f"WITH {TRIALS}, {SPLIT} SELECT trial_id, label_digit, split FROM t JOIN b USING (sessionnum, blocknum)")
def split_pool(spark, sf):
    return split.split_pool(trials(spark, sf)).select("trial_id", "label_digit", "split")


@query("SELECT user_id AS sessionnum FROM events WHERE ts < TIMESTAMP '2024-01-21' INTERSECT SELECT user_id FROM events WHERE ts >= TIMESTAMP '2024-01-21'")
def session_overlap(spark, sf):
    x, late = rows(spark, sf), F.col("ts") >= F.lit("2024-01-21").cast("timestamp")
    return split.overlap(x.where(~late), x.where(late), "sessionnum")


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS block FROM events WHERE ts < TIMESTAMP '2024-01-21' INTERSECT SELECT CAST(CAST(ts AS DATE) AS VARCHAR) FROM events WHERE ts >= TIMESTAMP '2024-01-20 12:00:00'")
def block_overlap(spark, sf):
    x = rows(spark, sf).withColumn("block", F.col("block").cast("string"))
    at = lambda s: F.lit(s).cast("timestamp")
    return split.overlap(x.where(F.col("ts") < at("2024-01-21")), x.where(F.col("ts") >= at("2024-01-20 12:00:00")), "block")


# --- robust scale -----------------------------------------------------------------------------------------------------------


@query(f"WITH {SAMPLES}, {FIT} SELECT channel, round(center, 6) + 0.0 AS center, round(scale, 6) + 0.0 AS scale FROM f")
def robust_fit(spark, sf):
    return round_all(robust.fit(signals(spark, sf)))


@query(f"WITH {SAMPLES}, {FIT} SELECT channel, round(center, 6) + 0.0 AS center, round(scale, 6) + 0.0 AS scale FROM f")
def norm_params_roundtrip(spark, sf):
    path = store.scratch(spark, "norm_params")
    store.write(robust.fit(signals(spark, sf)), path)
    return round_all(store.params(spark, path))


@query(f"WITH {DEAD}, {FIT} SELECT channel FROM f WHERE scale <= 1e-7")
def bad_channels(spark, sf):
    return robust.bad_channels(robust.fit(dead(spark, sf)))


@query(f"WITH {DEAD}, {FIT} SELECT channel FROM f WHERE scale > 1e-7")
def good_channels(spark, sf):
    return robust.good_channels(robust.bad_channels(robust.fit(dead(spark, sf))), 5)


@query(f"WITH {DEAD}, {FIT} SELECT trial_id, channel FROM s WHERE channel IN (SELECT channel FROM f WHERE scale > 1e-7)")
def exclude_channels(spark, sf):
    x = dead(spark, sf)
    return robust.exclude(x, robust.bad_channels(robust.fit(x))).select("trial_id", "channel")


@query(f"WITH {SAMPLES}, {FIT} SELECT trial_id, channel, CAST(i AS INTEGER) AS i, round((v - center) / scale, 6) + 0.0 AS value FROM x JOIN f USING (channel)")
def normalize(spark, sf):
    x = signals(spark, sf)
    return robust.normalize(x, robust.fit(x)).select("trial_id", "channel", F.posexplode("signal").alias("i", "value")).withColumn("value", rounded(F.col("value")))


# --- artifacts ----------------------------------------------------------------------------------------------------------------


CONSTANT = """s0 AS (SELECT * FROM s_), s AS (SELECT trial_id, channel, CASE WHEN trial_id % 97 = 0 AND channel = 0 THEN list_transform(signal, lambda v: CAST(0.5 AS DOUBLE)) ELSE signal END AS signal FROM s0)"""


@query(f"WITH {SAMPLES.replace('s AS (', 's_ AS (').replace(', x AS', ', ' + CONSTANT + ', x AS', 1)}, {measures('x')} SELECT trial_id, channel, round(amplitude, 6) + 0.0 AS amplitude, round(jump, 6) + 0.0 AS jump, round(std, 6) + 0.0 AS std, round(kurtosis, 6) + 0.0 AS kurtosis FROM q")
def artifact_metrics(spark, sf):
    still = F.when((F.col("trial_id") % 97 == 0) & (F.col("channel") == 0), F.transform("signal", lambda x: F.lit(0.5))).otherwise(F.col("signal"))
    return round_all(artifacts.metrics(signals(spark, sf).withColumn("signal", still)))


@query(f"WITH {TRAIN}, {SAMPLES}, {measures('x')}, {LIMITS.format(OWN)} SELECT round(amplitude, 6) + 0.0 AS amplitude, round(jump, 6) + 0.0 AS jump, round(kurtosis, 6) + 0.0 AS kurtosis, round(flatline, 6) + 0.0 AS flatline FROM l")
def artifact_thresholds(spark, sf):
    return round_all(artifacts.thresholds(fit_part(artifacts.metrics(signals(spark, sf)), spark, sf)).select(*artifacts.CRITERIA))


@query(f"WITH {TRAIN}, {SAMPLES}, {measures('x')}, {LIMITS.format(OWN)} SELECT name, round(value, 6) + 0.0 AS value FROM (SELECT unnest(['amplitude', 'jump', 'kurtosis', 'flatline']) AS name, unnest([amplitude, jump, kurtosis, flatline]) AS value FROM l)")
def threshold_params(spark, sf):
    path = store.scratch(spark, "thresholds")
    limits = artifacts.thresholds(fit_part(artifacts.metrics(signals(spark, sf)), spark, sf))
    store.write(limits.select(*artifacts.CRITERIA).unpivot([], list(artifacts.CRITERIA), "name", "value"), path)
    return round_all(store.params(spark, path))


@query(f"WITH {TRAINED} SELECT * FROM a")
def artifact_flags(spark, sf):
    return flagged(spark, sf)


@query(f"WITH {TRAIN}, {SAMPLES}, {measures('x')}, {LIMITS.format(OWN)}, {FLAGS.format(least=1)} SELECT trial_id, n_flagged, trial_concern FROM n")
def trial_concern(spark, sf):
    return trial_flags(spark, sf)


@query(f"""WITH {TRAINED}, z AS (SELECT trial_id, bool_or(is_amplitude) AS am, bool_or(is_jump) AS ju, bool_or(is_kurtosis) AS ku, bool_or(is_flatline) AS fl, count(*) FILTER (is_any) AS nf FROM a GROUP BY trial_id)
SELECT split, count(*) FILTER (am) AS n_amplitude, count(*) FILTER (ju) AS n_jump, count(*) FILTER (ku) AS n_kurtosis, count(*) FILTER (fl) AS n_flatline, round(avg(CAST(nf > 0 AS INTEGER)), 6) AS any_rate, round(avg(CAST(nf >= 1 AS INTEGER)), 6) AS concern_rate
FROM z JOIN t USING (trial_id) JOIN b USING (sessionnum, blocknum) GROUP BY split""")
def artifact_rates(spark, sf):
    x = trials(spark, sf)
    return artifacts.rates(flagged(spark, sf), split.with_split(x, split.assign_blocks(x)), least=1)


@query(f"WITH {TRAINED} SELECT t.trial_id, label_digit FROM t JOIN n ON t.trial_id = n.trial_id WHERE NOT trial_concern")
def clean_trials(spark, sf):
    return artifacts.clean(trials(spark, sf), trial_flags(spark, sf)).select("trial_id", "label_digit")


@query(f"WITH {TRAINED}, {MOMENTS.format('x')} SELECT st.trial_id, st.channel, round(mean, 6) + 0.0 AS mean, n_flagged, trial_concern FROM st JOIN n USING (trial_id)")
def features_with_flags(spark, sf):
    x = features.statistics(signals(spark, sf)).select("trial_id", "channel", "mean")
    return round_all(features.with_flags(x, trial_flags(spark, sf)))


# --- spectra and filters ------------------------------------------------------------------------------------------------------


@query(f"WITH {PSD} SELECT trial_id, channel, k, freq, round(power, 6) + 0.0 AS power FROM y")
def welch_psd(spark, sf):
    return round_all(spectral.bins(spectral.psd(long_signals(spark, sf), nperseg=N), N))


@query(f"WITH {BAND_POWER} SELECT trial_id, channel, {', '.join(f'round({n}, 6) + 0.0 AS {n}' for n, _, _ in BANDS)} FROM bp")
def band_power(spark, sf):
    x = spectral.psd(long_signals(spark, sf), nperseg=N)
    return round_all(x.select("trial_id", "channel", *spectral.band_columns(BANDS, N)))


@query(f"WITH {BAND_POWER} SELECT trial_id, channel, dominant_freq, round(total_power, 6) + 0.0 AS total_power FROM fr")
def freq_features(spark, sf):
    x = spectral.psd(long_signals(spark, sf), nperseg=N)
    return round_all(x.select("trial_id", "channel", *spectral.frequency_columns(N)))


@query(f"WITH {BAND_POWER} SELECT trial_id, channel, dominant_freq FROM fr")
def dominant_freq(spark, sf):
    x = spectral.bins(spectral.psd(long_signals(spark, sf), nperseg=N), N)
    best = F.max(F.struct("power", (-F.col("k")).alias("k"), "freq"))
    return x.groupBy("trial_id", "channel").agg(best.alias("b")).select("trial_id", "channel", F.col("b.freq").alias("dominant_freq"))


DIFFERENCE = f"""{PSD}, {TRIALS}, df AS (SELECT channel, k, freq, avg(power) FILTER (label_binary = 1) AS digit_power, avg(power) FILTER (label_binary = 0) AS blank_power FROM y JOIN t USING (trial_id) GROUP BY channel, k, freq),
ld AS (SELECT *, log10(digit_power + 1e-12) - log10(blank_power + 1e-12) AS log_diff FROM df)"""


@query(f"WITH {DIFFERENCE} SELECT channel, k, freq, round(digit_power, 6) + 0.0 AS digit_power, round(blank_power, 6) + 0.0 AS blank_power, round(log_diff, 6) + 0.0 AS log_diff FROM ld")
def class_psd_diff(spark, sf):
    return round_all(spectral.class_difference(spectral.psd(long_signals(spark, sf), nperseg=N), trials(spark, sf), N))


@query(f"""WITH {DIFFERENCE}, au AS (SELECT avg(abs(log_diff)) FILTER (freq <= 40) AS lo, avg(abs(log_diff)) FILTER (freq > 40) AS hi FROM ld),
ac AS (SELECT count(*) FILTER (m) AS n FROM (SELECT avg(abs(log_diff)) FILTER (freq > 40) > avg(abs(log_diff)) FILTER (freq <= 40) AS m FROM ld GROUP BY channel))
SELECT round(lo, 6) AS mean_below, round(hi, 6) AS mean_above, round(hi / lo, 6) AS ratio, n AS n_channels_above FROM au, ac""")
def cutoff_audit(spark, sf):
    difference = spectral.class_difference(spectral.psd(long_signals(spark, sf), nperseg=N), trials(spark, sf), N)
    return round_all(spectral.cutoff_audit(difference, 40.0))


def matrix_sql(m) -> str:
    """The matrix as rows (i, w) of VALUES."""
    return "mx AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, [{', '.join(f'{v:.17e}' for v in row)}])" for i, row in enumerate(m)) + ") v(i, w))"


@query(f"WITH {LONG}, {matrix_sql(bandpass_matrix(64))} SELECT trial_id, channel, i, round(list_dot_product(w, signal), 6) + 0.0 AS value FROM g, mx")
def bandpass(spark, sf):
    x = spectral.bandpass(long_signals(spark, sf))
    return x.select("trial_id", "channel", F.posexplode("signal").alias("i", "value")).withColumn("value", rounded(F.col("value")))


@query(f"WITH {LONG}, {matrix_sql(notch_matrix(64) @ bandpass_matrix(64))} SELECT trial_id, channel, i, round(list_dot_product(w, signal), 6) + 0.0 AS value FROM g, mx")
def notch(spark, sf):
    x = spectral.notch(spectral.bandpass(long_signals(spark, sf)))
    return x.select("trial_id", "channel", F.posexplode("signal").alias("i", "value")).withColumn("value", rounded(F.col("value")))


@query("SELECT count(*) AS n_signals, CAST(0 AS BIGINT) AS n_bad FROM embeddings")
def filter_finite(spark, sf):
    return spectral.filter_finite(spectral.bandpass(long_signals(spark, sf)))


@query(f"WITH {LONG} SELECT trial_id, channel, CAST(i AS INTEGER) AS i, round(signal[i + 1], 6) + 0.0 AS value, 10 AS n_inside FROM g, (SELECT unnest(range(27, 37)) AS i)")
def edge_mask(spark, sf):
    x = spectral.edge_mask(long_signals(spark, sf))
    return x.select("trial_id", "channel", "n_inside", F.posexplode("signal").alias("i", "value")).where("value IS NOT NULL").withColumn("value", rounded(F.col("value")))


# --- features ------------------------------------------------------------------------------------------------------------------


@query(f"WITH {SAMPLES}, {MOMENTS.format('x')} SELECT trial_id, channel, round(mean, 6) + 0.0 AS mean, round(variance, 6) + 0.0 AS variance, round(skewness, 6) + 0.0 AS skewness, round(kurtosis, 6) + 0.0 AS kurtosis, round(zero_crossing_rate, 6) AS zero_crossing_rate FROM st")
def stat_features(spark, sf):
    return round_all(features.statistics(signals(spark, sf)))


@query(f"WITH {SAMPLES}, {MOMENTS.format('x')} SELECT trial_id, channel, round(zero_crossing_rate, 6) AS zero_crossing_rate FROM zc")
def zero_crossing(spark, sf):
    return round_all(features.statistics(signals(spark, sf)).select("trial_id", "channel", "zero_crossing_rate"))


@query(f"WITH {SAMPLES} SELECT trial_id, channel, CAST(i AS INTEGER) AS i, round(d, 6) + 0.0 AS jump FROM (SELECT *, v - lag(v) OVER (PARTITION BY trial_id, channel ORDER BY i) AS d FROM x) WHERE d IS NOT NULL")
def jump_long(spark, sf):
    return round_all(features.jumps_long(signals(spark, sf)))


@query("SELECT vec_id AS trial_id, CAST(i AS INTEGER) AS i, round(CAST(embedding[i + 1] AS DOUBLE), 6) + 0.0 AS value FROM embeddings, (SELECT unnest(range(64)) AS i)")
def flatten_trial(spark, sf):
    return round_all(features.flattened(signals(spark, sf)).select("trial_id", F.posexplode("values").alias("i", "value")))


ALL_FEATURES = f"{BAND_POWER}, {LONG_SAMPLES}, {MOMENTS.format('x')}, al AS (SELECT * FROM bp JOIN st USING (trial_id, channel) JOIN fr USING (trial_id, channel))"
NAMES = features.feature_names(BANDS)


@query(f"WITH {ALL_FEATURES} SELECT trial_id, CAST(unnest(range({len(NAMES)})) AS INTEGER) AS position, unnest([{', '.join(f'round({n}, 6) + 0.0' for n in NAMES)}]) AS value FROM al")
def trial_features(spark, sf):
    x = features.channel_features(long_signals(spark, sf), BANDS, N)
    return round_all(features.trial_vectors(x, BANDS).select("trial_id", F.posexplode("features").alias("position", "value")))


@query(f"""WITH {TRAIN}, {SAMPLES}, {MOMENTS.format('x')}, fe AS (SELECT trial_id, channel, unnest(['mean', 'variance']) AS feature, unnest([mean, variance]) AS value FROM st),
sc AS (SELECT channel, feature, avg(value) AS m, CASE WHEN stddev_pop(value) > 0 THEN stddev_pop(value) ELSE 1.0 END AS d FROM fe WHERE trial_id IN (SELECT trial_id FROM tr) GROUP BY channel, feature)
SELECT trial_id, channel, feature, round((value - m) / d, 6) + 0.0 AS value FROM fe JOIN sc USING (channel, feature)""")
def standard_scale(spark, sf):
    x = features.statistics(signals(spark, sf)).unpivot(["trial_id", "channel"], ["mean", "variance"], "feature", "value")
    return round_all(features.scale_apply(x, features.scale_fit(fit_part(x, spark, sf))).select("trial_id", "channel", "feature", "value"))


@query(f"WITH {TRIALS} SELECT trial_id, label_binary AS y FROM t")
def stage1_view(spark, sf):
    return features.stage_view(trials(spark, sf), "stage1").select("trial_id", "y")


@query(f"WITH {TRIALS} SELECT trial_id, label_digit AS y FROM t WHERE label_digit <> -1")
def stage2_view(spark, sf):
    return features.stage_view(trials(spark, sf), "stage2").select("trial_id", "y")


# --- evaluation ------------------------------------------------------------------------------------------------------------------


@query(f"WITH {MULTI}, {CONFUSION} SELECT y, yhat, n FROM cm")
def confusion_matrix(spark, sf):
    return evaluate.confusion(multiclass(spark, sf))


@query(f"WITH {BINARY}, {CONFUSION} SELECT round({ACCURACY}, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM pf WHERE label = 1")
def metrics_binary(spark, sf):
    return round_all(evaluate.metrics(binary(spark, sf)))


@query(f"WITH {MULTI}, {CONFUSION} SELECT round({ACCURACY}, 6) AS accuracy, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1 FROM pf")
def metrics_macro(spark, sf):
    return round_all(evaluate.metrics(multiclass(spark, sf), "macro"))


@query(f"WITH {MULTI}, {CONFUSION} SELECT label, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM pf")
def per_class_metrics(spark, sf):
    return round_all(evaluate.per_class(evaluate.confusion(multiclass(spark, sf))))


@query(f"WITH {MULTI}, {CONFUSION} SELECT y, yhat, n FROM cm WHERE y <> yhat ORDER BY n DESC, y, yhat LIMIT 5")
def confused_pairs(spark, sf):
    return evaluate.confused_pairs(evaluate.confusion(multiclass(spark, sf)))


@query(f"WITH {MULTI}, to1 AS (SELECT y FROM pr GROUP BY y ORDER BY count(*) DESC, y LIMIT 1) SELECT (SELECT y FROM to1) AS yhat, count(*) AS n, round(avg(CAST(y = (SELECT y FROM to1) AS INTEGER)), 6) AS accuracy FROM pr")
def majority_baseline(spark, sf):
    x = evaluate.majority(multiclass(spark, sf))
    return round_all(x.groupBy("yhat").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("y") == F.col("yhat")).cast("double")).alias("accuracy")))


@query("""WITH a AS (SELECT o_orderstatus = 'F' AS y, o_totalprice AS score FROM orders), b AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM a)
SELECT round((sum(r) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2.0) / (CAST(count(*) FILTER (y) AS DOUBLE) * count(*) FILTER (NOT y)), 6) AS auc, count(*) FILTER (y) AS n_pos, count(*) FILTER (NOT y) AS n_neg FROM b""")
def roc_auc(spark, sf):
    x = binding.table(spark, sf, "orders").select((F.col("o_orderstatus") == "F").cast("int").alias("y"), F.col("o_totalprice").alias("score"))
    return round_all(evaluate.roc_auc(x))


#: Two models that SQL can fit too: nearest centroid of the embeddings, and the train share's most frequent label. Every fifth session is the test set.
MODELS = f"""{TRAIN}, pa AS (SELECT trial_id, sessionnum, label_binary AS y, CASE WHEN sessionnum % 5 = 4 THEN 'test' ELSE split END AS part FROM t JOIN b USING (sessionnum, blocknum)),
xx AS (SELECT vec_id AS trial_id, i, CAST(v AS DOUBLE) AS v FROM (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding) AS v FROM embeddings)),
ce AS (SELECT y AS yhat, i, avg(v) AS m FROM pa JOIN xx USING (trial_id) WHERE part = 'train' GROUP BY y, i),
di AS (SELECT trial_id, yhat, round(sum((v - m) * (v - m)), 9) AS d FROM xx JOIN ce USING (i) GROUP BY trial_id, yhat),
be AS (SELECT trial_id, arg_min(yhat, {{d: d, y: yhat}}) AS yhat FROM di GROUP BY trial_id),
ma AS (SELECT y FROM pa WHERE part = 'train' GROUP BY y ORDER BY count(*) DESC, y LIMIT 1),
sa AS (SELECT 'centroid' AS model, trial_id, sessionnum, part, y, yhat FROM pa JOIN be USING (trial_id) UNION ALL SELECT 'majority', trial_id, sessionnum, part, y, (SELECT y FROM ma) FROM pa),
re AS (SELECT model, part AS split, avg(CAST(y = yhat AS INTEGER)) AS value FROM sa WHERE part <> 'train' GROUP BY model, part)"""
#: With the flags of TRAINED, whose own tables MODELS has already.
MODELS_AND_FLAGS = MODELS + TRAINED[len(TRAIN) :]


def parts(spark: SparkSession, sf: str) -> DataFrame:
    """trial_id, sessionnum, y, part, x: every trial with its embedding."""
    x = trials(spark, sf)
    part = F.when(F.col("sessionnum") % 5 == 4, "test").otherwise(F.col("split")).alias("part")
    x = split.with_split(x, split.assign_blocks(x)).select("trial_id", "sessionnum", F.col("label_binary").alias("y"), part)
    vectors = binding.table(spark, sf, "embeddings").select(F.col("vec_id").alias("trial_id"), F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    return store.write(x.join(vectors, "trial_id"), store.scratch(spark, "parts"))


def centres(rows_: DataFrame) -> DataFrame:
    return permute.centroids(rows_.where("part = 'train'").withColumn("perm", F.lit(0)))


def said(spark: SparkSession, sf: str) -> DataFrame:
    """model, trial_id, sessionnum, part, y, yhat of both models."""
    x = parts(spark, sf)
    near = permute.nearest(x.select("trial_id", "y", "x"), centres(x)).select("trial_id", "yhat").join(x.drop("x"), "trial_id").withColumn("model", F.lit("centroid"))
    most = evaluate.majority(x.where("part = 'train'")).select("yhat").limit(1)
    common = x.drop("x").crossJoin(F.broadcast(most)).withColumn("model", F.lit("majority"))  # one row
    return near.unionByName(common)


def results(spark: SparkSession, sf: str) -> DataFrame:
    by = said(spark, sf).where("part <> 'train'").groupBy("model", F.col("part").alias("split")).agg(F.avg((F.col("y") == F.col("yhat")).cast("double")).alias("value"))
    return by.select(F.lit("all").alias("variant_tag"), F.lit("stage1").alias("stage"), "model", "split", F.lit("accuracy").alias("metric"), "value")


@query(f"WITH {MODELS} SELECT 'all' AS variant_tag, 'stage1' AS stage, v.model, 'accuracy' AS metric, round(v.value, 6) AS val, round(t.value, 6) AS test, round(v.value - t.value, 6) + 0.0 AS gap FROM re v JOIN re t ON v.model = t.model AND v.split = 'val' AND t.split = 'test'")
def val_test_gap(spark, sf):
    return round_all(evaluate.val_test_gap(results(spark, sf)))


@query(f"WITH {MODELS} SELECT 'all' AS variant_tag, 'stage1' AS stage, model, round(value, 6) AS accuracy FROM re WHERE split = 'val' ORDER BY value DESC, model LIMIT 1")
def best_model(spark, sf):
    return round_all(evaluate.best_model(results(spark, sf)))


@query(f"WITH {MODELS} SELECT 'all' AS variant_tag, 'stage1' AS stage, model, split, 'accuracy' AS metric, round(value, 6) AS value FROM re")
def model_compare(spark, sf):
    return round_all(results(spark, sf))


@query(f"WITH {MODELS_AND_FLAGS} SELECT sessionnum, count(*) AS n_trials, round(avg(CAST(y = yhat AS INTEGER)), 6) AS accuracy, round(avg(CAST(trial_concern AS INTEGER)), 6) AS concern_rate FROM sa JOIN n USING (trial_id) WHERE model = 'centroid' AND part <> 'train' GROUP BY sessionnum")
def session_breakdown(spark, sf):
    x = said(spark, sf).where("model = 'centroid' AND part <> 'train'").join(trial_flags(spark, sf), "trial_id")
    return round_all(evaluate.session_breakdown(x))


def ablation_sql(condition: str, where: str) -> str:
    return f"SELECT '{condition}' AS condition, round(acc, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM (WITH pr AS (SELECT y, yhat FROM sa JOIN n USING (trial_id) WHERE model = 'centroid' AND part = 'val'{where}), {CONFUSION} SELECT *, {ACCURACY} AS acc FROM pf WHERE label = 1)"


@query(f"WITH {MODELS_AND_FLAGS} " + " UNION ALL ".join(ablation_sql(c, w) for c, w in (("all", ""), ("clean", " AND NOT trial_concern"))))
def ablation_compare(spark, sf):
    x = said(spark, sf).where("model = 'centroid' AND part = 'val'").select("trial_id", "y", "yhat")
    return round_all(evaluate.ablation(x, trial_flags(spark, sf)))


@query("SELECT o_orderpriority AS name, count(*) AS total, CASE o_orderpriority WHEN '1-URGENT' THEN 0.2 WHEN '2-HIGH' THEN 0.5 ELSE 1.0 END AS fraction, CASE o_orderpriority WHEN '1-URGENT' THEN CAST(floor(count(*) * 0.2) AS BIGINT) WHEN '2-HIGH' THEN CAST(floor(count(*) * 0.5) AS BIGINT) END AS target FROM orders GROUP BY o_orderpriority")
def target_counts(spark, sf):
    fraction = F.when(F.col("name") == "1-URGENT", 0.2).when(F.col("name") == "2-HIGH", 0.5).otherwise(1.0)
    x = binding.table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("name")).agg(F.count(F.lit(1)).alias("total"))
    return evaluate.target_counts(x.withColumn("fraction", fraction))


#: How far apart the two classes' centroids are at each place: what the centroid model goes by.
IMPORTANCE = MODELS + ", im AS (SELECT i AS position, abs(max(m) FILTER (yhat = 1) - max(m) FILTER (yhat = 0)) AS value FROM ce GROUP BY i)"
PARTS = [f"part{i}" for i in range(16)]


def weights(spark: SparkSession, sf: str) -> DataFrame:
    x = centres(parts(spark, sf)).select("yhat", F.posexplode("centroid").alias("position", "m"))
    of = lambda y: F.max(F.when(F.col("yhat") == y, F.col("m")))
    return x.groupBy("position").agg(F.abs(of(1) - of(0)).alias("value"))


@query(f"WITH {IMPORTANCE} SELECT 'part' || (position % 16) AS feature, round(sum(value), 6) AS importance FROM im GROUP BY position % 16")
def importance_by_type(spark, sf):
    return round_all(evaluate.importance_by(weights(spark, sf), 16, PARTS)[0])


@query(f"WITH {IMPORTANCE} SELECT CAST(position // 16 AS INTEGER) AS channel, round(sum(value), 6) AS importance FROM im GROUP BY position // 16 ORDER BY importance DESC LIMIT 3")
def importance_by_channel(spark, sf):
    return round_all(evaluate.importance_by(weights(spark, sf), 16, PARTS)[1].orderBy(F.desc("importance")).limit(3))


# --- samples, shuffled labels --------------------------------------------------------------------------------------------------------


@query("SELECT vec_id AS trial_id FROM embeddings ORDER BY md5(concat_ws('|', '42', CAST(vec_id AS VARCHAR))), vec_id LIMIT 200")
def subsample_n(spark, sf):
    return permute.subsample(trials(spark, sf), 200).select("trial_id")


SHUFFLES = """ps AS (SELECT CAST(unnest(range(1, {p} + 1)) AS INTEGER) AS perm), ba AS (SELECT vec_id AS trial_id, label AS y FROM embeddings WHERE {where}),
ai AS (SELECT perm, trial_id, row_number() OVER (PARTITION BY perm ORDER BY trial_id) AS r FROM ba, ps),
ah AS (SELECT perm, y, row_number() OVER (PARTITION BY perm ORDER BY md5(concat_ws('|', '42', CAST(perm AS VARCHAR), CAST(trial_id AS VARCHAR))), trial_id) AS r FROM ba, ps),
sh AS (SELECT 0 AS perm, trial_id, y FROM ba UNION ALL SELECT ai.perm, ai.trial_id, ah.y FROM ai JOIN ah USING (perm, r))"""


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    return binding.table(spark, sf, "embeddings").select(F.col("vec_id").alias("trial_id"), F.col("label").alias("y"))


@query(f"WITH {SHUFFLES.format(p=3, where='true')} SELECT perm, trial_id, y FROM sh")
def permute_labels(spark, sf):
    return permute.permuted(labelled(spark, sf), 3)


CENTROIDS = f"""{TRAIN}, {SHUFFLES.format(p=10, where='vec_id IN (SELECT trial_id FROM tr)')}, xx AS (SELECT vec_id AS trial_id, i, CAST(v AS DOUBLE) AS v FROM (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding) AS v FROM embeddings)),
ce AS (SELECT perm, y AS yhat, i, avg(v) AS m FROM sh JOIN xx USING (trial_id) GROUP BY perm, y, i),
di AS (SELECT perm, xx.trial_id, yhat, round(sum((v - m) * (v - m)), 9) AS d FROM xx JOIN ce USING (i) WHERE trial_id NOT IN (SELECT trial_id FROM tr) GROUP BY perm, xx.trial_id, yhat),
be AS (SELECT perm, trial_id, arg_min(yhat, {{d: d, y: yhat}}) AS yhat FROM di GROUP BY perm, trial_id),
ru AS (SELECT perm, avg(CAST(yhat = label AS INTEGER)) AS accuracy FROM be JOIN embeddings ON vec_id = trial_id GROUP BY perm)"""


def centroid_runs(spark: SparkSession, sf: str) -> DataFrame:
    x = binding.table(spark, sf, "embeddings").select(F.col("vec_id").alias("trial_id"), F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    y, own = labelled(spark, sf), train_ids(spark, sf)
    return permute.centroid_runs(x, y.join(own, "trial_id", "left_semi"), y.join(own, "trial_id", "left_anti"), 10)


@query(f"WITH {CENTROIDS} SELECT perm, round(accuracy, 6) AS accuracy FROM ru")
def perm_test_centroid(spark, sf):
    return round_all(centroid_runs(spark, sf))


@query(f"WITH {CENTROIDS}, su AS (SELECT max(accuracy) FILTER (perm = 0) AS real, avg(accuracy) FILTER (perm > 0) AS shuffled_mean, stddev_pop(accuracy) FILTER (perm > 0) AS shuffled_std FROM ru) SELECT round(real, 6) AS real, round(shuffled_mean, 6) AS shuffled_mean, round(shuffled_std, 6) AS shuffled_std, round(real - shuffled_mean, 6) + 0.0 AS gap, CASE WHEN shuffled_std > 0 THEN round((real - shuffled_mean) / shuffled_std, 6) + 0.0 END AS gap_in_stds FROM su")
def perm_summary(spark, sf):
    return round_all(evaluate.permutation_summary(centroid_runs(spark, sf)))


# --- models: rows only -----------------------------------------------------------------------------------------------------------------


def model_data(spark: SparkSession, sf: str) -> DataFrame:
    """trial_id, split, y, features: each trial's own features, binary labels."""
    x = trials(spark, sf)
    vectors = store.write(features.trial_vectors(features.channel_features(long_signals(spark, sf), BANDS, N), BANDS), store.scratch(spark, "features"))
    return store.write(phases.stage_data(split.with_split(x, split.assign_blocks(x)), vectors, "stage1"), store.scratch(spark, "stage"))


def predicted(name: str) -> Query:
    def run(spark, sf):
        data = model_data(spark, sf)
        return models.fit(name, data.where("split = 'train'"))(data.where("split = 'val'")).select("trial_id", "y", "yhat")

    return run


def elimination(d: int) -> str:
    """Gauss-Jordan steps over e0(i, j, v), a square of d columns and right sides behind it: the solutions are what e{d} has behind it."""
    step = """e{n} AS MATERIALIZED (SELECT a.i, a.j, CASE WHEN a.i = {k} THEN a.v / p.v ELSE a.v - c.v * r.v / p.v END AS v FROM e{k} a
  JOIN e{k} p ON p.i = {k} AND p.j = {k} JOIN e{k} r ON r.i = {k} AND r.j = a.j JOIN e{k} c ON c.i = a.i AND c.j = {k})"""
    return ", ".join(step.format(k=k, n=k + 1) for k in range(d))


D = len(NAMES)
LDA = f"""{ALL_FEATURES}, {TRAIN}, fv AS (SELECT trial_id, unnest(range({D})) AS j, unnest([{', '.join(NAMES)}]) AS v FROM al),
sc AS (SELECT j, avg(v) AS m, CASE WHEN stddev_pop(v) > 0 THEN stddev_pop(v) ELSE 1.0 END AS d FROM fv WHERE trial_id IN (SELECT trial_id FROM tr) GROUP BY j),
z AS MATERIALIZED (SELECT trial_id, j, (v - m) / d AS v, label_binary AS y, trial_id IN (SELECT trial_id FROM tr) AS is_train FROM fv JOIN sc USING (j) JOIN t USING (trial_id)),
lc AS MATERIALIZED (SELECT y, j, avg(v) AS v, count(*) AS n FROM z WHERE is_train GROUP BY y, j),
lp AS MATERIALIZED (SELECT a.j AS i, b.j, sum((a.v - ca.v) * (b.v - cb.v)) / count(*) AS v FROM z a JOIN z b USING (trial_id) JOIN lc ca ON ca.y = a.y AND ca.j = a.j JOIN lc cb ON cb.y = a.y AND cb.j = b.j WHERE a.is_train GROUP BY a.j, b.j),
e0 AS MATERIALIZED (SELECT i, j, v + CASE WHEN i = j THEN (SELECT 1e-6 * greatest(sum(v) FILTER (i = j) / {D}, 1e-12) FROM lp) ELSE 0 END AS v FROM lp UNION ALL SELECT j, {D} + y, v FROM lc),
{elimination(D)},
ow AS (SELECT y, -0.5 * sum(e.v * lc.v) + ln(max(n) / (SELECT sum(n) FROM lc WHERE j = 0)) AS o FROM e{D} e JOIN lc ON e.i = lc.j AND e.j = {D} + lc.y GROUP BY y),
sd AS (SELECT trial_id, ow.y AS yhat, sum(z.v * e.v) + max(o) AS score FROM z JOIN e{D} e ON e.i = z.j AND e.j >= {D} JOIN ow ON e.j = {D} + ow.y WHERE NOT is_train GROUP BY trial_id, ow.y),
pr AS (SELECT trial_id, max(label_binary) AS y, arg_max(yhat, {{s: score, y: -yhat}}) AS yhat FROM sd JOIN t USING (trial_id) GROUP BY trial_id)"""


@query(f"WITH {LDA} SELECT trial_id, y, yhat FROM pr")
def lda_predict(spark, sf):
    return predicted("lda")(spark, sf)


@query()
def svm_predict(spark, sf):
    return predicted("svm")(spark, sf)


@query()
def svm_rbf_predict(spark, sf):
    return predicted("svm_rbf")(spark, sf)


@query()
def rf_predict(spark, sf):
    return predicted("random_forest")(spark, sf)


@query()
def evaluate_model(spark, sf):
    data = model_data(spark, sf)
    return models.evaluate("svm", data.where("split = 'train'"), data.where("split = 'val'"))[0]


@query(f"WITH {LDA}, {CONFUSION} SELECT 'lda' AS model, round({ACCURACY}, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM pf WHERE label = 1")
def evaluate_lda(spark, sf):
    """Fit and val metrics of a discriminant."""
    data = model_data(spark, sf)
    return round_all(models.evaluate("lda", data.where("split = 'train'"), data.where("split = 'val'"))[0])


@query()
def rf_importance(spark, sf):
    data = model_data(spark, sf)
    predict = models.fit("random_forest", data.where("split = 'train'"))
    return evaluate.importance_by(models.importances(predict, spark), len(NAMES), NAMES)[0]


@query()
def test_eval(spark, sf):
    data = model_data(spark, sf)
    held, path = F.col("sessionnum") % 5 == 4, store.scratch(spark, "run")
    phases.run_model(data.where(~held), "svm", "stage1", path, "all", permutations=0)
    return phases.evaluate_test(data.where(held), "svm", "stage1", path, "all")


@query()
def perm_test_svm(spark, sf):
    data = model_data(spark, sf).select("trial_id", "split", "y", "features")
    fit = lambda train: models.fit("svm_cheap", train)
    return permute.model_runs(fit, data.where("split = 'train'"), data.where("split = 'val'"), SHUFFLES_OF_A_MODEL)


# --- whole phases -----------------------------------------------------------------------------------------------------------------------


FILTERED = f"""{LONG}, {TRAIN}, {matrix_sql(bandpass_matrix(64))}, fi AS (SELECT trial_id, channel, i, list_dot_product(w, signal) AS v FROM g, mx),
x AS (SELECT * FROM fi WHERE trial_id IN (SELECT trial_id FROM tr)), {FIT},
no AS (SELECT trial_id, channel, i, (v - center) / scale AS v FROM fi JOIN f USING (channel) WHERE scale > 1e-7), {measures('no')},
{LIMITS.format(OWN)}, {FLAGS.format(least=3)}"""


@query(f"WITH {FILTERED} SELECT trial_id, split, n_flagged, trial_concern FROM n JOIN t USING (trial_id) JOIN b USING (sessionnum, blocknum)")
def preprocess_train_val(spark, sf):
    parted = split.split_pool(trials(spark, sf)).select("trial_id", "split")
    return phases.preprocess(spark, parted, long_signals(spark, sf), store.scratch(spark, "run"))


@query(f"WITH {FILTERED} SELECT trial_id, n_flagged, trial_concern FROM n WHERE trial_id NOT IN (SELECT trial_id FROM tr)")
def apply_fitted_test(spark, sf):
    path = store.scratch(spark, "run")
    parted = split.split_pool(trials(spark, sf)).select("trial_id", "split")
    phases.preprocess(spark, parted, long_signals(spark, sf), path)
    new = long_signals(spark, sf).join(parted.where("split = 'val'").select("trial_id"), "trial_id", "left_semi")
    return phases.apply_fitted(spark, new, path)


@query(f"WITH {PAIRS}, w AS (SELECT label, count(*) AS n FROM p GROUP BY label) SELECT label, n FROM w")
def append_sink_counts(spark, sf):
    """Two appended batches are one table."""
    path, x = store.scratch(spark, "pool"), pairs(spark, sf).select("seq", "label", "blank_seq")
    for part in (x.where("seq % 2 = 0"), x.where("seq % 2 = 1")):
        back = store.write(part, path)
    return back.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {FILTERED} SELECT split, count(DISTINCT trial_id) AS n_trials, round(avg(abs(v)), 6) AS mean_abs, count(DISTINCT trial_id) FILTER (trial_concern) AS n_concern, count(DISTINCT trial_id) FILTER (label_binary = 1) AS n_digit FROM no JOIN n USING (trial_id) JOIN t USING (trial_id) JOIN b USING (sessionnum, blocknum) GROUP BY split")
def filtered_sink_counts(spark, sf):
    """Filtered and normalized signals with labels and flags in a sink by variant and split, read back."""
    path, parted = store.scratch(spark, "run"), split.split_pool(trials(spark, sf))
    flags = store.write(phases.preprocess(spark, parted, long_signals(spark, sf), path), f"{path}/trial_flags")
    back = store.write(phases.normalized(spark, parted, flags, path).withColumn("variant", F.lit("all")), f"{path}/normalized", ("variant", "split"))
    x = back.where("variant = 'all'").select("split", "trial_id", "trial_concern", "label_binary", F.explode("signal").alias("v"))
    only = lambda c: F.count_distinct(F.when(c, F.col("trial_id")))
    return round_all(x.groupBy("split").agg(F.count_distinct("trial_id").alias("n_trials"), F.avg(F.abs("v")).alias("mean_abs"), only(F.col("trial_concern")).alias("n_concern"), only(F.col("label_binary") == 1).alias("n_digit")))


@query(f"WITH {TRIALS}, {SPLIT}, {SAMPLES}, {MOMENTS.format('x')}, z AS (SELECT split, trial_id, mean FROM st JOIN t USING (trial_id) JOIN b USING (sessionnum, blocknum)) SELECT split, count(*) AS n_rows, round(avg(mean), 6) + 0.0 AS mean FROM z GROUP BY split")
def feature_sink_counts(spark, sf):
    """Features in a sink by split, read back."""
    x = trials(spark, sf)
    rows_ = features.statistics(signals(spark, sf)).join(split.with_split(x, split.assign_blocks(x)).select("trial_id", "split"), "trial_id")
    back = store.write(rows_, store.scratch(spark, "features"), ("split",))
    return round_all(back.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.avg("mean").alias("mean")))


@query(f"WITH {BINARY}, {CONFUSION} SELECT 'all' AS variant_tag, 'stage1' AS stage, 'not_toxic' AS model, 'val' AS split, unnest(['accuracy', 'precision', 'recall', 'f1']) AS metric, round(unnest([{ACCURACY}, precision, recall, f1]), 6) AS value FROM pf WHERE label = 1")
def results_sink(spark, sf):
    """A result row in the sink by variant, stage and model, read back by its keys."""
    row = phases.result_rows(evaluate.metrics(binary(spark, sf)), "all", "stage1", "not_toxic", "val")
    back = store.write(row, store.scratch(spark, "results"), ("variant_tag", "stage", "model"))
    return round_all(back.where("variant_tag = 'all' AND stage = 'stage1'").select("variant_tag", "stage", "model", "split", "metric", "value"))


RAW = f"""{TRIALS}, ra AS (SELECT *, trial_id AS seq, lag(label_digit) OVER (ORDER BY trial_id) AS label_before FROM t),
pa AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label_digit ORDER BY seq) AS taken FROM ra WHERE label_digit <> -1 AND label_before = -1) WHERE taken <= 4 AND seq < 4 * 10 * 5),
na AS (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS k FROM pa), pool AS (SELECT 2 * k AS trial_id, seq FROM na UNION ALL SELECT 2 * k + 1, seq - 1 FROM na)"""


def raw_files(spark: SparkSession, sf: str) -> str:
    """The wide rows in several files, without a number of their own."""
    path = store.scratch(spark, "raw")
    binding.wide(binding.table(spark, sf, "embeddings")).repartitionByRange(4, "trial_id").sortWithinPartitions("trial_id").drop("trial_id").write.parquet(path)
    return path


@query(f"WITH {RAW}, {SAMPLES} SELECT p.trial_id, p.seq, ra.label_digit, CASE x.channel WHEN 2 THEN 0 WHEN 3 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS channel, round(avg(v), 6) + 0.0 AS mean FROM pool p JOIN ra USING (seq) JOIN x ON x.trial_id = p.seq GROUP BY ALL")
def raw_pool(spark, sf):
    """A capped pool from raw files: rows by order of files, pairs, signals of what was accepted."""
    raw = phases.ordered(spark, raw_files(spark, sf))
    pool = store.write(phases.pool_trials(raw, 4), store.scratch(spark, "pool"))
    x = phases.pool_signals(raw, pool).join(pool, "trial_id")
    mean = F.aggregate("signal", F.lit(0.0), lambda a, v: a + v) / F.size("signal")
    return round_all(x.select("trial_id", "seq", "label_digit", "channel", mean.alias("mean")))


@query()
def whole_run(spark, sf):
    """Raw rows to results: pool, split, filter, fits, flags, features, a model and its shuffled-label test."""
    raw = binding.wide(binding.table(spark, sf, "embeddings")).withColumnRenamed("trial_id", "seq")
    long_rows = raw.select("seq", "label", "sessionnum", "blocknum", "blockpos", *[F.col(f"{n}_{i}").alias(f"all_{c * 16 + i}") for c, n in enumerate(binding.WIDE) for i in range(16)])
    return phases.run(spark, long_rows, store.scratch(spark, "whole"), "lda", bands=BANDS, nperseg=N, permutations=SHUFFLES_OF_A_MODEL)


# --- streams -----------------------------------------------------------------------------------------------------------------------------


SCHEMA = "seq long, label int, sessionnum long, ts timestamp"


def event_stream(spark: SparkSession, sf: str, batches: int) -> DataFrame:
    """The events as a stream of so many batches, one file or more each, dealt by a hash: a blank and its digit come in any order."""
    path, x = store.scratch(spark, "events"), rows(spark, sf).select("seq", "label", "sessionnum", "ts")
    for i in range(batches):  # one after the other, as they would arrive
        x.where(F.pmod(F.xxhash64("seq"), F.lit(batches)) == i).write.mode("append").parquet(path)
    return stream.read_rows(spark, path, SCHEMA, 1)


@query(f"WITH {PAIRS} SELECT seq, label, blank_seq, sessionnum FROM p")
def stream_pairs(spark, sf):
    """Pairs of a stream whose rows come in no order, by place."""
    told = stream.drain(pairing.by_place(event_stream(spark, sf, 2)), "pairs")
    return pairing.pairs(told).select("seq", "label", "blank_seq", "sessionnum")


@query(f"WITH {ROWS} SELECT 'unpaired' AS kind, seq, label FROM r WHERE label <> -1 AND seq - 1 NOT IN (SELECT seq FROM r WHERE label = -1)")
def stream_unpaired(spark, sf):
    """The other output of the same stream: with the pairs, every digit."""
    told = stream.drain(pairing.by_place(event_stream(spark, sf, 2)), "unpaired", by=("kind",))
    return pairing.unpaired(told).select("kind", "seq", "label")


LATE = f"""{ROWS}, h AS (SELECT *, seq % 11 = 5 AND seq < (SELECT max(seq) // 2 FROM r) AS is_held FROM r),
i AS (SELECT *, max(seq) FILTER (NOT is_held) OVER (PARTITION BY sessionnum) AS passed FROM h),
g AS (SELECT *, lag(label) OVER w AS label_before, lag(seq) OVER w AS seq_before FROM i WHERE NOT is_held OR passed IS NULL OR seq > passed WINDOW w AS (PARTITION BY sessionnum ORDER BY seq))"""


@query(f"""WITH {LATE} SELECT CASE WHEN label_before = -1 THEN 'pair' ELSE 'unpaired' END AS kind, seq, label, CASE WHEN label_before = -1 THEN seq_before END AS blank_seq, sessionnum FROM g WHERE label <> -1
UNION ALL SELECT 'late', seq, label, NULL, sessionnum FROM i WHERE label <> -1 AND is_held AND seq <= passed""")
def stream_sessions(spark, sf):
    """Every digit, by session: the first half but for some rows, the second half, then the rows held back. Each batch goes on from the checkpoint of the one before."""
    path, at, x = store.scratch(spark, "events"), store.scratch(spark, "sessions"), rows(spark, sf).select("seq", "label", "sessionnum", "ts")
    half = x.agg(F.max("seq")).first()[0] // 2
    held = (F.col("seq") % 11 == 5) & (F.col("seq") < half)
    for part in (~held & (F.col("seq") < half), F.col("seq") >= half, held):
        x.where(part).write.mode("append").parquet(path)
        told = stream.drain(pairing.by_session(stream.read_rows(spark, path, SCHEMA)), "sessions", at)
    return told.select("kind", "seq", "label", "blank_seq", "sessionnum")


@query(f"WITH {PAIRS} SELECT label, least(count(*), {CAP}) AS n, true AS is_within FROM p GROUP BY label")
def stream_capped(spark, sf):
    """The cap holds over several batches."""
    kept = stream.drain_capped(pairing.pairs(pairing.by_place(event_stream(spark, sf, 3))), CAP)
    return kept.groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumn("is_within", F.col("n") <= CAP)


@query(f"WITH {CAPPED}, e AS (SELECT max(last) AS last FROM (SELECT label, count(*) AS n, max(seq) AS last FROM c GROUP BY label) HAVING count(*) FILTER (n >= {CAP}) = 4) SELECT seq, label, blank_seq FROM c WHERE seq <= coalesce((SELECT last FROM e), seq)")
def stream_stopped(spark, sf):
    """Batches in order of seq; the query ends with the one in which the last class fills, and has what the scan to the stop position has."""
    path, at, x = store.scratch(spark, "events"), store.scratch(spark, "stopped"), rows(spark, sf).select("seq", "label", "sessionnum", "ts")
    size = x.agg(F.max("seq")).first()[0] // 6 + 1
    for i in range(6):
        x.where(F.floor(F.col("seq") / size) == i).write.mode("append").parquet(path)
        kept = stream.drain_capped(pairing.pairs(pairing.by_place(stream.read_rows(spark, path, SCHEMA))), CAP, classes=CLASSES, at=at)
    return kept.select("seq", "label", "blank_seq")


@query(f"""WITH {TRAIN}, {SAMPLES.replace(', x AS (SELECT trial_id, channel, i, signal', ', x0 AS (SELECT trial_id, channel, i, signal')}, x AS (SELECT * FROM x0 WHERE trial_id IN (SELECT trial_id FROM tr)), {FIT},
no AS (SELECT trial_id, channel, i, (v - center) / scale AS v FROM x0 JOIN f USING (channel) WHERE scale > 1e-7), {measures('no')}, {LIMITS.format(OWN)}, {FLAGS.format(least=1)} SELECT * FROM a""")
def stream_flags(spark, sf):
    own = fit_part(signals(spark, sf), spark, sf)
    params = store.write(robust.fit(own), store.scratch(spark, "norm_params"))
    bad = store.write(robust.bad_channels(params), store.scratch(spark, "bad_channels"))
    limits = store.write(artifacts.thresholds(artifacts.metrics(robust.normalize(robust.exclude(own, bad), params))), store.scratch(spark, "thresholds"))
    schema = binding.table(spark, sf, "embeddings").schema
    arriving = binding.signals(spark.readStream.schema(schema).parquet(f"{sf}/embeddings*.parquet"))
    return stream.drain(stream.flags(arriving, params, bad, limits), "flags")
