"""Language identification by hierarchical discrimination.

The language family is predicted first, by one-versus-rest linear support
vector machines; inside the family, one-versus-one machines separate the
closely related languages, and the language with most pairwise wins is taken
(ties go to the larger sum of margins, then to the first code). Features are
hashed byte n-grams of the whole text; the machines are fitted on a bounded
sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, give_back, map_text, sampled_by
from .linear import byte_grams, decide, expanded, packed_grams, sigmoid, svm

# ISO 639-1 codes by language family. A code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "uralic": "et fi hu",
    "turkic": "az kk ky tk tr tt ug uz",
    "indo-aryan": "bn gu hi mr ne pa sd si ur",
    "iranian": "fa ku ps tg",
    "semitic": "am ar he mt",
    "dravidian": "kn ml ta te",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
LETTER = regex.compile(r"\p{L}")
LETTER_IN_JAVA = r"\p{L}"
LEAST_ROWS = 100  # of a language in the sample, where it has as many
MOST_ROWS = 40_000  # of the sample, unless there are more languages
FEW_MACHINES = 64  # are fitted on the driver, which has the sample; more on executors, to which it is sent packed
MOST_OTHERS = 8000  # rows of other families that a family's machine learns from


@dataclass
class Model:
    dims: int
    families: dict[str, list[str]]
    family_weights: dict[str, np.ndarray]
    pair_weights: dict[tuple[str, str], np.ndarray]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each text; `und` and 0 if it is null or has no letter, or if nothing was learned.

        The score is the squashed family margin times that of the closest pair.
        """
        out = [("und", 0.0)] * len(texts)
        at = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
        if not at or not self.families:
            return out
        x = np.stack([byte_grams(texts[i], self.dims) for i in at])
        names = list(self.families)
        margins = np.stack([decide(x, self.family_weights[f]) for f in names], axis=1) if len(names) > 1 else np.full((len(at), 1), 9.0)
        pairs = {p: decide(x, w) for p, w in self.pair_weights.items()}
        for row, i in enumerate(at):
            best = int(np.argmax(margins[row]))
            languages = self.families[names[best]]
            sure = float(sigmoid(3 * margins[row, best]))
            wins, sums, close = dict.fromkeys(languages, 0), dict.fromkeys(languages, 0.0), dict.fromkeys(languages, 9.0)
            for a, b in combinations(languages, 2):
                m = float(pairs[a, b][row])
                wins[a if m > 0 else b] += 1
                sums[a], sums[b] = sums[a] + m, sums[b] - m
                close[a], close[b] = min(close[a], m), min(close[b], -m)
            first = min(languages, key=lambda c: (-wins[c], -sums[c], c))
            out[i] = (first, sure * float(sigmoid(3 * np.array(close[first]))))
        return out


def machine(rows_of: Callable[[np.ndarray], np.ndarray], lang: np.ndarray, family: np.ndarray, one: str, other: str, seed: int) -> np.ndarray:
    """Weights that tell a language from another, or (other empty) a family from the rest; rows_of gives the features of rows of the sample."""
    if other:
        rows, sign = np.flatnonzero((lang == one) | (lang == other)), lang
    else:
        rest = np.flatnonzero(family != one)
        rows = np.sort(np.concatenate([np.flatnonzero(family == one), rest if len(rest) <= MOST_OTHERS else np.random.default_rng(seed).permutation(rest)[:MOST_OTHERS]]))
        sign = family
    return svm(rows_of(rows), np.where(sign[rows] == one, 1, -1))


def fit(docs: DataFrame, dims: int = 2048, sample_rows: int = 8000, seed: int = 42) -> Model:
    """Fits on about sample_rows rows of docs(doc_id, text, lang), dealt evenly over languages and chosen by a hash.

    Rows with a null language or without a letter don't count. A rare language
    gives all its rows, and none gets a part below LEAST_ROWS while MOST_ROWS rows suffice for that, nor below one row, so every language
    is learned at any size and any number of languages. The sample is the only thing that comes to the
    driver, besides a count for each language: sample_rows packed rows of a fraction of dims bytes, MOST_ROWS where there are hundreds of languages. Each pair of
    related languages, and each family, is a machine of dims weights. Few machines are fitted on the driver, on sample_rows * dims floats; where there are more
    than FEW_MACHINES, executors unpack the sample, a larger one than MOST_OTHERS rows for each machine as far as it learns from it.
    """

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b[[bool(LETTER.search(t)) for t in b.text]]
            yield pd.DataFrame({"lang": b.lang, "x": [packed_grams(t, dims) for t in b.text]})

    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(LETTER_IN_JAVA)).select("doc_id", "text", "lang")
    rows = sampled_by(labelled, "doc_id", "lang", sample_rows, LEAST_ROWS, MOST_ROWS, seed).select("text", "lang").mapInPandas(features, "lang string, x binary").toPandas()
    if rows.empty:
        return Model(dims, {}, {}, {})
    packed: list[bytes] = []
    counts: dict[str, int] = {}
    for code, mine in rows.groupby("lang", sort=True).x:  # in order of language and features, whatever the order of arrival
        floats = expanded(list(mine), dims)
        packed += mine.iloc[np.argsort(floats.view(f"S{4 * dims}").ravel(), kind="stable")].tolist()
        counts[code] = len(mine)
    lang = np.repeat(np.array(list(counts), object), list(counts.values()))
    del rows, mine, floats
    give_back()
    families: dict[str, list[str]] = {}
    for code in counts:
        families.setdefault(FAMILY_OF.get(code.lower().split("-")[0], code), []).append(code)
    of = {code: f for f, codes in families.items() for code in codes}
    family = np.array([of[c] for c in lang])
    spark = docs.sparkSession
    names = list(families) if len(families) > 1 else []
    tasks = [(f, "") for f in names] + [p for codes in families.values() for p in combinations(codes, 2)]
    if len(tasks) <= FEW_MACHINES:  # the sample is here already
        x = expanded(packed, dims)
        found = {t: machine(lambda at: x if len(at) == len(x) else x[at], lang, family, *t, seed) for t in tasks}
        return Model(dims, families, {f: found[f, ""] for f in names}, {p: w for p, w in found.items() if p[1]})
    shared = spark.sparkContext.broadcast((packed, lang, family))  # the sample, bounded as it is

    def machines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packed, lang, family = shared.value
        x = expanded(packed, dims) if len(packed) <= MOST_OTHERS else None  # a larger sample is unpacked for each machine, as far as it learns from it
        rows_of = lambda at: expanded([packed[i] for i in at], dims) if x is None else x if len(at) == len(x) else x[at]
        for b in batches:
            for one, other in zip(b.one, b.other, strict=True):
                yield pd.DataFrame({"one": [one], "other": [other], "w": [machine(rows_of, lang, family, one, other, seed).tobytes()]})

    listed = spark.createDataFrame(tasks, "one string, other string").repartition(min(len(tasks), 4 * spark.sparkContext.defaultParallelism))
    found = {(r.one, r.other): np.frombuffer(r.w) for r in listed.mapInPandas(machines, "one string, other string, w binary").collect()}
    shared.unpersist()
    return Model(dims, families, {f: found[f, ""] for f in names}, {p: w for p, w in found.items() if p[1]})


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns `keep`) with lang_pred and score added (replacing columns of these names): a row for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # dims weights for each family and for each pair of related languages
    return map_text(docs, docs.columns if keep is None else keep, lambda texts: list(zip(*shared.value.predict(texts), strict=True)) or [[], []], "lang_pred string, score double")


def predict_held_out(docs: DataFrame, mod: int = 5, **options: int) -> DataFrame:
    """doc_id, held_out, lang_pred, score: a row for each row of docs(doc_id, text, lang).

    Learns from rows whose crc32(doc_id as text) mod `mod` is not 0; predicts
    every row from its text alone. No labelled rows: every row is `und`.
    Ties, repeated rows and null ids are rows like others.
    """
    model = fit(docs.where(crc_mod("doc_id", mod) != 0), **options)
    out = identify(docs, model, ["doc_id"])
    return out.select("doc_id", (crc_mod("doc_id", mod) == 0).alias("held_out"), "lang_pred", "score")
