"""Quality classifier by co-training.

Two logistic regressions see different views of a document: its text content
(hashed byte n-grams and shares of characters) and its metadata (source,
language, length). In each round either view goes over all unlabelled documents
and hands the other those that it is surest of and has not handed over before,
with the label that it gives them. A view that knows little is still asked, but
its labels weigh as much as its calibrated certainty exceeds the labels' usual
share. Both are then calibrated on labelled rows that neither has seen, and the
calibrated log-odds are added.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORDS, forget, map_text, sampled, save
from .linear import byte_grams, decide, logistic, sigmoid
from .quality_rules import kind_counts

GRAMS, BUCKETS = 256, 64
VIEWS = ("text", "meta")
META = ("source", "lang", "n_chars")


def text_view(text: str | None) -> np.ndarray:
    text = text or ""
    words = WORDS.findall(text)
    upper, lower, digits = kind_counts(text)
    n, letters, chars = len(words) + 5, upper + lower + 20, sum(map(len, words))
    same = sum(map(str.__eq__, words, words[1:]))
    shares = [math.log1p(len(words)) / 10, upper / letters, (chars - upper - lower - digits) / n, digits / n, same / n, chars / n / 10, len(set(words)) / n]
    # in half precision, as the views of the unlabelled documents are kept
    return np.concatenate([np.array(shares, np.float16), byte_grams(text, GRAMS, (1, 2), case=True).astype(np.float16)]).astype(np.float32)


def meta_columns(docs: DataFrame, kinds: Sequence[tuple[str, bool]]) -> list[Column]:
    """Numbers as doubles, all else as strings; a column that docs lacks is null."""
    return [(F.col(f"`{c}`") if c in docs.columns else F.lit(None)).cast("double" if numeric else "string").alias(f"_m{i}") for i, (c, numeric) in enumerate(kinds)]


def meta_view(rows: pd.DataFrame, kinds: Sequence[tuple[str, bool]]) -> np.ndarray:
    """A hashed indicator for each value of a text column, log sizes of the others; nulls are values of their own."""
    parts = [np.zeros((len(rows), 0))]
    for i, (_, numeric) in enumerate(kinds):
        column = rows[f"_m{i}"]
        if numeric:
            x = column.to_numpy(dtype=float, na_value=np.nan)
            parts.append(np.stack([np.log1p(np.maximum(np.nan_to_num(x), 0)) / 10, np.isnan(x)], axis=1))
        else:
            bucket = [xxhash.xxh32_intdigest("" if v is None or v != v else f"={v}", i) % BUCKETS for v in column]
            parts.append(np.eye(BUCKETS)[bucket] if bucket else np.zeros((0, BUCKETS)))
    return np.hstack(parts)


@dataclass
class Model:
    kinds: tuple[tuple[str, bool], ...]  # metadata columns, and which of them are numbers
    weights: list[np.ndarray]  # of the text view and of the metadata view
    scales: list[tuple[float, float]]
    prior: float
    handed: list[tuple[int, str, int, int, float]] = field(default_factory=list)  # round, from which view, label, rows, mean weight

    def odds(self, view: int, x: np.ndarray) -> np.ndarray:
        return decide(x, self.weights[view]) * self.scales[view][0] + self.scales[view][1]


def calibrated(margin: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and offset that make log-odds of margins; an informative view has a slope of 0 at least."""
    if len(set(y)) < 2:
        return 0.0, prior
    w = logistic(margin[:, None] / 4, y, ridge=1e-4)
    return (w[0] / 4, w[1]) if w[0] > 0 else (0.0, prior)


def viewed(docs: DataFrame, kinds: Sequence[tuple[str, bool]]) -> DataFrame:
    """doc_id, metadata and the text view (`_x`), a row for each row of docs; `_t` tells rows of different content apart."""
    meta = [f"_m{i}" for i in range(len(kinds))]
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *meta_columns(docs, kinds), F.col("text").cast("string").alias("text"))
    x = map_text(x, ["doc_id", *meta], lambda texts: [[text_view(t).astype(np.float16).tobytes() for t in texts]], "_x binary")
    return x.withColumn("_t", F.xxhash64("_x", *meta))


def arrays(rows: pd.DataFrame, kinds: Sequence[tuple[str, bool]]) -> list[np.ndarray]:
    """The two views of rows of viewed()."""
    text = np.frombuffer(b"".join(rows._x), np.float16).reshape(len(rows), -1).astype(np.float32) if len(rows) else np.zeros((0, GRAMS + 7), np.float32)
    return [text, meta_view(rows, kinds)]


def surest(pool: DataFrame, model: Model, given: list[set[int]], n: tuple[int, int]) -> pd.DataFrame:
    """(view, label, odds, _t), at most 2 * sum(n) rows: of each view the n[label] rows of the pool that it is surest to have the label, without those in given[view].

    Rows of equal content count once; ties go to the smaller hash of the
    content. Each task sends n rows of a view and label at most.
    """
    shared = pool.sparkSession.sparkContext.broadcast((model, [np.array(sorted(g), np.int64) for g in given]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[tuple[int, int], pd.DataFrame] = {}
        for b in batches:
            m, done = shared.value
            for v, x in enumerate(arrays(b, m.kinds)):
                rows = pd.DataFrame({"odds": m.odds(v, x), "_t": b._t})
                rows = rows[~np.isin(rows._t, done[v])].drop_duplicates("_t")
                for label in (0, 1):
                    both = pd.concat([best.get((v, label), rows[:0]), rows]).drop_duplicates("_t")
                    best[v, label] = both.iloc[np.lexsort((both._t, -both.odds if label else both.odds))[: n[label]]]
        for (v, label), rows in best.items():
            yield rows.assign(view=v, label=label)[["view", "label", "odds", "_t"]]

    found = save(pool.drop("doc_id").mapInPandas(run, "view int, label int, odds double, _t long").dropDuplicates(["view", "label", "_t"]), "surest")
    sure = F.when(F.col("label") == 1, F.col("odds")).otherwise(-F.col("odds"))
    parts = [found.where((F.col("view") == v) & (F.col("label") == label)).orderBy(sure.desc(), "_t").limit(n[label]) for v in (0, 1) for label in (0, 1)]
    out = parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3]).toPandas()
    forget(found)
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", meta: tuple[str, ...] = META, sample_rows: int = 6000, rounds: int = 3, per_round: int = 200, seed: int = 42) -> Model:
    """Fits on about sample_rows labelled rows, chosen by a hash of doc_id, and on what the views hand over from all unlabelled rows.

    labels(doc_id, <label> 0 or 1); null labels don't count, and a doc_id with
    several is good if at least half of them are; of rows of docs that repeat a
    doc_id one is learned from. A quarter of the labelled rows is kept for
    calibration. In each round a view hands over per_round rows, in the labels'
    proportions, one of each label at least. No or one-sided labels: every score is the prior
    (0.5 without labels). A metadata column that docs lacks counts as null. To
    the driver come the views of the labelled sample and of the rows handed
    over, rounds * 2 * per_round at most.
    """
    numeric = {f.name for f in docs.schema.fields if f.dataType.typeName() in {"byte", "short", "integer", "long", "float", "double", "decimal"}}
    kinds = tuple((c, c in numeric) for c in meta)
    views = save(viewed(docs, kinds), "views")
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg(label) >= 0.5).cast("int").alias("_y"))
    chosen = sampled(known, "doc_id", sample_rows, seed)  # sample_rows rows at most, but for the luck of the hash
    one = F.min(F.struct("_t", "_x", *[f"_m{i}" for i in range(len(kinds))])).alias("r")
    seen = views.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "_y").agg(one).select("doc_id", "_y", "r.*").toPandas().sort_values("doc_id", kind="stable")
    x, y = arrays(seen, kinds), seen._y.to_numpy(dtype=float)
    if len(set(y)) < 2:
        prior = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
        odds = math.log(prior / (1 - prior))
        return Model(kinds, [np.zeros(a.shape[1] + 1) for a in x], [(0.0, odds)] * 2, odds)
    hold = np.arange(len(y)) % 4 == 0
    if len(set(y[~hold])) < 2:
        hold = np.ones(len(y), bool)
    learn = ~hold if not hold.all() else hold
    share = float(y.mean())
    prior = math.log(np.clip(share, 0.01, 0.99) / (1 - np.clip(share, 0.01, 0.99)))
    pool = save(views.join(known.select("doc_id"), "doc_id", "left_anti"), "unlabelled")
    forget(views)
    n_good = min(max(1, round(per_round * share)), max(per_round - 1, 1))
    more: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = [[], []]  # rows, labels and weights that each view was given
    given: list[set[int]] = [set(), set()]
    handed = []
    for r in range(rounds + 1):
        weights = []
        for v in (0, 1):
            rows = np.vstack([x[v][learn], *[m[0] for m in more[v]]])
            weights.append(logistic(rows, np.concatenate([y[learn], *[m[1] for m in more[v]]]), np.concatenate([np.ones(learn.sum()), *[m[2] for m in more[v]]])))
        scales = [calibrated(decide(a[hold], w), y[hold], prior) for a, w in zip(x, weights, strict=True)]
        model = Model(kinds, weights, scales, prior, handed)
        if r == rounds:
            break
        told = surest(pool, model, given, (max(1, per_round - n_good), n_good))
        if told.empty:
            break
        asked = docs.sparkSession.createDataFrame([(int(t),) for t in set(told._t)], "_t long")  # 2 * per_round at most
        rows = pool.join(F.broadcast(asked), "_t").groupBy("_t").agg(one).select("r.*").toPandas()
        at = {t: i for i, t in enumerate(rows._t)}
        both = arrays(rows, kinds)
        for v in (0, 1):
            mine = told[told["view"] == v].sort_values(["label", "_t"])
            labelled = mine["label"].to_numpy(dtype=float)
            p = np.where(labelled == 1, sigmoid(mine.odds.to_numpy()), sigmoid(-mine.odds.to_numpy()))
            usual = np.where(labelled == 1, share, 1 - share)
            weight = 0.5 * np.clip((p - usual) / np.maximum(1 - usual, 1e-9), 0, 1)
            more[1 - v].append((both[1 - v][[at[t] for t in mine._t]], labelled, weight))
            given[v] |= set(mine._t)
            handed += [(r, VIEWS[v], k, int((weight[labelled == k] > 0).sum()), float(weight[labelled == k].mean()) if (labelled == k).any() else 0.0) for k in (0, 1)]
    forget(pool)
    return model


def score(docs: DataFrame, model: Model, keep: Sequence[str] = ("doc_id",), least: float = 0.25) -> DataFrame:
    """The columns `keep`, text_odds, meta_odds, quality_score and kept: a row for each row of docs.

    quality_score adds the views' calibrated log-odds and takes off one prior.
    kept: a score of at least `least`, which by default rejects only what is
    surely poor. Null text is scored as empty; null and missing
    metadata is a value of its own; repeated rows get equal scores.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred weights
    meta = [f"_m{i}" for i in range(len(model.kinds))]

    def odds_of(texts: list[str | None], rows) -> list:
        m = shared.value
        text = np.stack([text_view(t) for t in texts]) if texts else np.zeros((0, GRAMS + 7))
        return [m.odds(0, text), m.odds(1, meta_view(rows.to_pandas(), m.kinds))]

    x = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, "text"])], *meta_columns(docs, model.kinds))
    out = map_text(x, keep, odds_of, "text_odds double, meta_odds double", beside=meta)
    odds = F.col("text_odds") + F.col("meta_odds") - F.lit(model.prior)
    out = out.withColumn("quality_score", 1 / (1 + F.exp(-odds)))
    return out.withColumn("kept", F.col("quality_score") >= least)
