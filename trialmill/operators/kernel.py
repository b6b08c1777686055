"""A machine with the RBF kernel, in the primal: Newton steps over all rows, on the span of kernel functions at landmark rows.

Up to LANDMARKS training rows, every row is a landmark, and the machine is the
exact one: it minimises |w|**2 / 2 + C * (sum of hinge losses) over the kernel's whole space.
Of more rows so many are drawn by hash, and w is kept to what they span (Nystrom); all rows still count in the loss.
The hinge's corner is rounded by a width that shrinks from step to step; a step
takes one pass for gradient and curvature and one for its length, both of which add up over tasks.
Classes beyond two are told by a machine for each pair, and votes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that a fit may keep as landmarks, and their kernel matrix on the driver.
LANDMARKS = 2048
#: Widths of the hinge's rounded corner, one after the other; within the first lie all rows at the start.
WIDTHS = (2.0, 0.5, 0.1, 0.02, 0.004, 0.0008, 0.0002)
#: Lengths of a step that are tried at once.
LENGTHS = 2.0 ** -np.arange(12)
#: Rows whose kernel values a task holds.
AT_ONCE = 1024


def rbf(x: np.ndarray, at: np.ndarray, gamma: float) -> np.ndarray:
    far = (x**2).sum(axis=1)[:, None] + (at**2).sum(axis=1) - 2 * (x @ at.T)
    return np.exp(-gamma * np.maximum(far, 0))


@dataclass
class Kernel:
    """Decision values sum(beta * k(x, landmark)) + offset of each pair of classes; a positive one is a vote for the second."""

    gamma: float
    landmarks: np.ndarray
    labels: list[int]
    betas: np.ndarray  # a row for each pair, in the order of combinations(labels, 2)
    offsets: np.ndarray

    def decide(self, x: np.ndarray) -> np.ndarray:
        parts = [rbf(x[at : at + AT_ONCE], self.landmarks, self.gamma) @ self.betas.T for at in range(0, max(len(x), 1), AT_ONCE)]
        return np.concatenate(parts) + self.offsets

    def vote(self, x: np.ndarray) -> np.ndarray:
        """The class with the most votes, ties to the lesser label."""
        votes = np.zeros((len(x), len(self.labels)), np.int64)
        said = self.decide(x) > 0
        for i, (a, b) in enumerate(combinations(range(len(self.labels)), 2)):
            votes[:, a] += ~said[:, i]
            votes[:, b] += said[:, i]
        return np.asarray(self.labels)[votes.argmax(axis=1)]

    def predicted(self, features: str) -> Column:
        @F.pandas_udf("int")
        def vote(x: pd.Series) -> pd.Series:
            return pd.Series(self.vote(np.stack(x)) if len(x) else [], dtype="int32")

        return vote(features)


@dataclass
class Step:
    """What a pass over rows needs: the map onto the landmarks' span (None: kernel values as they are), the point (w and offset last), and the corner's width."""

    gamma: float
    landmarks: np.ndarray
    onto: np.ndarray | None
    point: np.ndarray
    width: float
    direction: np.ndarray | None = None

    def mapped(self, x: np.ndarray) -> np.ndarray:
        values = rbf(x, self.landmarks, self.gamma)
        return np.concatenate([values if self.onto is None else values @ self.onto, np.ones((len(x), 1))], axis=1)

    def lift(self) -> np.ndarray:
        """From mapped rows' space to that of kernel values; the offset stays."""
        n, r = self.onto.shape
        out = np.zeros((n + 1, r + 1))
        out[:n, :r], out[n, r] = self.onto, 1
        return out

    def slope(self, m: np.ndarray, sign: np.ndarray) -> np.ndarray:
        """The loss's gradient over mapped rows, and its curvature below it: one row and a square."""
        room = 1 - sign * (m @ self.point)
        inside = np.abs(room) < self.width
        rise = np.where(inside, (room + self.width) / (2 * self.width), room > 0)
        near = m[inside]
        return np.concatenate([-(sign * rise)[None] @ m, near.T @ near / (2 * self.width)])

    def losses(self, m: np.ndarray, sign: np.ndarray) -> np.ndarray:
        """The summed loss at each of LENGTHS along the direction, and at the point itself, last."""
        at, step = sign * (m @ self.point), sign * (m @ self.direction)
        room = 1 - (at[:, None] + step[:, None] * np.append(LENGTHS, 0))
        return np.where(np.abs(room) < self.width, (room + self.width) ** 2 / (4 * self.width), np.maximum(room, 0)).sum(axis=0)[None]


Pass = Callable[[Step, str], np.ndarray]


def over_rows(rows: DataFrame) -> Pass:
    """Passes over rows(x, sign) as Spark jobs: tasks add up their batches, and vectors are added up by place.

    Tasks work on kernel values, and what they add up is mapped here, once: mapping each row would cost them as much as its curvature.
    """

    def run_pass(step: Step, what: str) -> np.ndarray:
        lift = step.lift()
        step = replace(step, onto=None, point=lift @ step.point, direction=None if step.direction is None else lift @ step.direction)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = None
            for b in batches:
                for at in range(0, len(b), AT_ONCE):
                    part = b.iloc[at : at + AT_ONCE]
                    made = getattr(step, what)(step.mapped(np.stack(part["x"])), part["sign"].to_numpy())
                    total = made if total is None else total + made
            if total is not None:
                yield pd.DataFrame({"i": range(len(total)), "v": list(total)})

        parts = rows.mapInPandas(run, "i int, v array<double>").groupBy("i").agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v"))
        found = np.stack(parts.toPandas().sort_values("i").v)
        return found if what == "losses" else np.concatenate([found[:1] @ lift, lift.T @ found[1:] @ lift])

    return run_pass


def over_arrays(x: np.ndarray, sign: np.ndarray, step: Step) -> Pass:
    """The same over rows that are here; they are mapped once."""
    m = step.mapped(x)
    return lambda step, what: getattr(step, what)(m, sign)


def solved(run_pass: Pass, step: Step, cost: float, close: float = 1e-6, rounds: int = 25) -> np.ndarray:
    """The point at which |w|**2 / 2 + cost * loss is least."""
    size = len(step.point)
    keep = np.ones(size)
    keep[-1] = 0  # the offset is free
    for width in WIDTHS:
        step.width = width
        for _ in range(rounds):
            found = run_pass(step, "slope")
            slope = keep * step.point + cost * found[0]
            curve = np.diag(keep + (1 - keep) * 1e-6) + cost * found[1:]
            step.direction = -np.linalg.solve(curve, slope)
            if -(slope @ step.direction) < close**2 * max(1.0, step.point @ step.point):
                break
            lost = run_pass(step, "losses")[0]
            ends = step.point + np.append(LENGTHS, 0)[:, None] * step.direction
            worth = 0.5 * (ends * keep * ends).sum(axis=1) + cost * lost
            best = int(worth.argmin())
            if best == len(LENGTHS):
                break
            step.point = ends[best]
    return step.point


def fit(train: DataFrame, gamma: float, cost: float = 1.0, landmarks: int = LANDMARKS) -> Kernel:
    """A machine on train(y, x array): exact where there are `landmarks` rows or fewer, which are then solved for on the driver."""
    rows = train.select(F.col("y").cast("int").alias("y"), "x")
    some = rows.orderBy(F.xxhash64("x", "y"), "y").limit(landmarks + 1).toPandas()  # a task sends so many at most
    whole = len(some) <= landmarks
    some = some.iloc[:landmarks]
    labels = sorted(r.y for r in rows.select("y").distinct().collect())
    at = np.unique(np.stack(some.x), axis=0)
    value, vector = np.linalg.eigh(rbf(at, at, gamma))
    good = value > 1e-10 * value[-1]
    onto = vector[:, good] / np.sqrt(value[good])
    betas, offsets = [], []
    for a, b in combinations(labels, 2):
        step = Step(gamma, at, onto, np.zeros(onto.shape[1] + 1), WIDTHS[0])
        if whole:
            pair = some[some.y.isin([a, b])]
            run_pass = over_arrays(np.stack(pair.x), np.where(pair.y == b, 1.0, -1.0), step)
        else:
            run_pass = over_rows(rows.where(F.col("y").isin(a, b)).select("x", F.when(F.col("y") == b, 1.0).otherwise(-1.0).alias("sign")))
        point = solved(run_pass, step, cost)
        betas.append(onto @ point[:-1])
        offsets.append(point[-1])
    betas = np.array(betas).reshape(-1, len(at))
    used = (np.abs(betas) > 1e-7 * max(cost, 1e-300)).any(axis=0) if len(betas) else np.zeros(len(at), bool)
    return Kernel(gamma, at[used], [int(y) for y in labels], betas[:, used], np.array(offsets))
