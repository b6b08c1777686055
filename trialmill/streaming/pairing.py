"""Pairing of blanks and digits in a stream, as keyed state.

Two forms, by what is known of the rows' order. Both give every digit row once: paired
with the blank right before it, or unpaired. No bound on time is needed.

by_place: the stream has dense sequence numbers. Rows come in any order; each
tells the place after its own what it was, and a digit waits until it has been told.

by_session: numbers have gaps, but a session's rows come in order, from one batch
to the next. Of a session the state holds the last number seen, and whether it was a
blank. A row behind that number comes too late to pair, and is told apart.

Tasks work on whole numbers, many places or sessions at a time, and states are their bytes: a state is asked for once a
batch, and costs no conversion of single values.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What both forms give: kind is pair, unpaired or late; blank_seq is null but for pairs.
FIELDS = "kind string, seq long, label int, blank_seq long, sessionnum long, ts timestamp"
#: Places whose state is kept together.
PLACES = 4096
BLANK = -1
#: States that sessions are dealt to, by a hash: a task asks for one state, not for one of each session.
STATES = 1024
#: What stands for null in tasks, where all values are whole numbers; times are microseconds.
NONE = -(1 << 63)
INPUT = ("seq", "label", "sessionnum", "ts")
_TOLD = "kind int, seq long, label long, blank_seq long, sessionnum long, ts long"
_KINDS = ("pair", "unpaired", "late")
PAIR, UNPAIRED, LATE = range(3)
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state_on_disk(spark: SparkSession) -> None:
    """State goes to RocksDB, which these processors need; streams started later in the session have it too."""
    spark.conf.set(_STORE, _ROCKS)


def numbers(rows: DataFrame) -> DataFrame:
    """seq, label, sessionnum and ts as longs without nulls."""
    ts = F.unix_micros(F.col("ts").cast("timestamp"))
    return rows.select(*[F.coalesce(c.cast("long"), F.lit(NONE)).alias(n) for n, c in zip(INPUT, (F.col("seq"), F.col("label"), F.col("sessionnum"), ts), strict=True)])


def named(told: DataFrame) -> DataFrame:
    """FIELDS of _TOLD."""
    value = lambda c: F.nullif(F.col(c), F.lit(NONE))
    kind = F.element_at(F.array(*[F.lit(k) for k in _KINDS]), F.col("kind") + 1)
    return told.select(kind.alias("kind"), value("seq").alias("seq"), value("label").cast("int").alias("label"), value("blank_seq").alias("blank_seq"), value("sessionnum").alias("sessionnum"), F.timestamp_micros(value("ts")).alias("ts"))


def taken(batches: Iterator[pd.DataFrame]) -> np.ndarray:
    """The rows of a key: a column for each of INPUT."""
    return np.concatenate([b[list(INPUT)].to_numpy(np.int64) for b in batches])


def result(rows: np.ndarray, kind: np.ndarray | int, blank: np.ndarray | int) -> pd.DataFrame:
    return pd.DataFrame({"kind": np.zeros(len(rows), np.int32) + np.int32(kind), "seq": rows[:, 0], "label": rows[:, 1], "blank_seq": np.zeros(len(rows), np.int64) + blank, "sessionnum": rows[:, 2], "ts": rows[:, 3]})


def last_of_each(values: np.ndarray) -> np.ndarray:
    """Of sorted values, which are the last of their kind."""
    return np.append(values[1:] != values[:-1], True)


def places_of(values: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each value stands among sorted ones, and whether it is there."""
    at = np.searchsorted(among, values)
    known = at < len(among)
    known[known] = among[at[known]] == values[known]
    return at, known


class _ByPlace(StatefulProcessor):
    """Of some thousand places: the digits that wait to be told what came before, and places that came with nothing yet to tell it to."""

    def __init__(self, first: int, places: int) -> None:
        self.first, self.places = first, places

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getValueState("waiting", "digits binary, told binary")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        x = taken(rows)
        before = self.waiting.get()
        begin = int(key[0]) * self.places
        own = x[:, 0] >= begin  # the others are the last place of the key before
        digits, told = x[own], x[:, :2]
        if before is not None:
            digits = np.concatenate([np.frombuffer(before[0], np.int64).reshape(-1, 4), digits])
            told = np.concatenate([np.frombuffer(before[1], np.int64).reshape(-1, 2), told])
        # places of this key and the one before it: the label told, or nothing
        label, is_told, is_asked = np.zeros(self.places + 1, np.int64), np.zeros(self.places + 1, bool), np.zeros(self.places + 1, bool)
        label[told[:, 0] - begin + 1], is_told[told[:, 0] - begin + 1] = told[:, 1], True
        at = digits[:, 0] - begin
        known = is_told[at] | (digits[:, 0] == self.first)
        is_asked[at] = True
        judged = digits[known & (digits[:, 1] != BLANK)]
        if len(judged):
            at = judged[:, 0] - begin
            pair = is_told[at] & (label[at] == BLANK)
            yield result(judged, np.where(pair, PAIR, UNPAIRED), np.where(pair, judged[:, 0] - 1, NONE))
        at = told[:, 0] - begin + 1
        left, open_ = digits[~known], told[(at < self.places) & ~is_asked[np.minimum(at, self.places)]]  # the last place tells the next key
        if len(left) or len(open_):
            self.waiting.update((left.tobytes(), open_.tobytes()))
        elif before is not None:
            self.waiting.clear()

    def close(self) -> None:
        pass


def placed(rows: DataFrame, places: int) -> DataFrame:
    """numbers(rows) and _key; the last row of a key also under the key after it."""
    key = F.expr(f"(seq - pmod(seq, {places})) div {places}")
    last = F.pmod("seq", F.lit(places)) == places - 1
    return numbers(rows).withColumn("_key", F.explode(F.when(last, F.array(key, key + 1)).otherwise(F.array(key))))


def by_place(rows: DataFrame, first: int = 0, places: int = PLACES) -> DataFrame:
    """FIELDS of a stream of rows(seq, label, sessionnum, ts): seq is dense from `first` and no row is sent twice.

    Keys are of `places` places each, so state and tasks are spread over as many keys as the stream is long; a key's last
    row stands under the next key too. A place's state goes
    once the next one has come: what waits is no more than what came out of order, and one row at the stream's end.
    """
    keep_state_on_disk(rows.sparkSession)
    return named(placed(rows, places).groupBy("_key").transformWithStateInPandas(_ByPlace(first, places), _TOLD, "append", "None"))


class _BySession(StatefulProcessor):
    """Of the sessions of a state: each one's number, the last place seen, and whether a blank stood there, in order of session."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "sessions binary")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        x = taken(rows)
        x = x[np.lexsort((x[:, 1], x[:, 0], x[:, 2]))]
        before = self.last.get()
        held = np.frombuffer(before[0], np.int64).reshape(-1, 3) if before is not None else np.zeros((0, 3), np.int64)
        at, known = places_of(x[:, 2], held[:, 0])
        late = np.zeros(len(x), bool)
        late[known] = x[known, 0] <= held[at[known], 1]
        behind = x[late & (x[:, 1] != BLANK)]
        if len(behind):
            yield result(behind, LATE, NONE)
        x, at, known = x[~late], at[~late], known[~late]
        if not len(x):
            return
        is_last = last_of_each(x[:, 2])
        is_first = np.append(True, is_last[:-1])
        after_blank, seq_before = np.append(False, x[:-1, 1] == BLANK), np.append(NONE, x[:-1, 0])
        after_blank[is_first] = False
        carried = is_first & known
        after_blank[carried], seq_before[carried] = held[at[carried], 2] == 1, held[at[carried], 1]
        digits = x[:, 1] != BLANK
        if digits.any():
            yield result(x[digits], np.where(after_blank, PAIR, UNPAIRED)[digits], np.where(after_blank, seq_before, NONE)[digits])
        end = x[is_last]
        now = np.stack([end[:, 2], end[:, 0], end[:, 1] == BLANK], axis=1)
        now = np.concatenate([held[~places_of(held[:, 0], now[:, 0])[1]], now])
        self.last.update((now[now[:, 0].argsort()].tobytes(),))

    def close(self) -> None:
        pass


def by_session(rows: DataFrame, states: int = STATES) -> DataFrame:
    """FIELDS of a stream of rows(seq, label, sessionnum, ts): pairs within each session, in order of seq, whatever its gaps.

    Rows of a batch come in any order, and are sorted; a digit of a later batch that is not behind what its session has
    passed is judged, and `late` otherwise. Sessions are dealt to `states` states by a hash, and a batch's rows of one state
    meet in one task: read so many files at once that they fit. A checkpoint keeps the number of states.
    """
    keep_state_on_disk(rows.sparkSession)
    keyed = numbers(rows).withColumn("_key", F.pmod(F.xxhash64("sessionnum"), F.lit(states)))
    return named(keyed.groupBy("_key").transformWithStateInPandas(_BySession(), _TOLD, "append", "None"))


def pairs(told: DataFrame) -> DataFrame:
    return told.where("kind = 'pair'").drop("kind")


def unpaired(told: DataFrame) -> DataFrame:
    """The other output: digits without a blank right before them, and late ones."""
    return told.where("kind <> 'pair'").select("kind", "seq", "label", "sessionnum", "ts")
