"""Logistic regression in Newton steps: a pass over the rows gives the loss, its slope and its curvature, for many fits together.

A pass has one partial sum a task, of the size of the curvatures. What is left after a dropped input starts from where the
last curvature puts it, so a round takes one to three passes rather than a fit from zero, and shares them with the rounds after it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recall_engine.staging import drop, new_path, stage

#: Iterations from which on a fit is taken to be one that is meant to reach the optimum.
CONVERGED = 100
#: Half the squared Newton decrement under which the step taken is the last.
SMALL = 1e-12
#: Numbers that a task sums up in one pass at most, and rounds of an elimination that are fitted together.
MOST, AHEAD = 1 << 17, 6


def reaches_optimum(classifier) -> bool:
    """Whether ``classifier`` minimises the mean loss with a square penalty to its end, on vectors as they are."""
    if not isinstance(classifier, LogisticRegression):
        return False
    plain = classifier.getElasticNetParam() == 0.0 and not classifier.getStandardization() and classifier.getFitIntercept()
    plain = plain and classifier.getRegParam() > 0.0 and classifier.getFamily() == "auto" and not classifier.isDefined("weightCol")
    bounds = ("lowerBoundsOnCoefficients", "upperBoundsOnCoefficients", "lowerBoundsOnIntercepts", "upperBoundsOnIntercepts")
    return plain and classifier.getMaxIter() >= CONVERGED and not any(classifier.isSet(b) for b in bounds)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row as one cell: its inputs and its label. Cells are small, so that readers and writers hold few bytes at a time."""
    for batch in batches:
        if batch.num_rows:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            y = batch.column("y").to_numpy(zero_copy_only=False)
            cells = np.ascontiguousarray(np.column_stack([x, y]), dtype=np.float64)
            ends = np.arange(batch.num_rows + 1, dtype=np.int32) * (8 * cells.shape[1])
            packed = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(cells)])
            yield pa.RecordBatch.from_arrays([packed, batch.column("y")], ["cell", "y"])


def _unpacked(cells: pa.BinaryArray, width: int) -> np.ndarray:
    if not len(cells):
        return np.empty((0, width))
    start = int(np.frombuffer(cells.buffers()[1], dtype=np.int32)[cells.offset])
    return np.frombuffer(cells.buffers()[2], dtype=np.float64, count=len(cells) * width, offset=start).reshape(-1, width)


@dataclass(frozen=True)
class _Point:
    """Where a pass looks: the weights of the inputs ``left`` and the intercept, with the curvature if ``curved``."""

    left: tuple[int, ...]
    weights: np.ndarray
    curved: bool

    @property
    def numbers(self) -> int:
        size = len(self.weights)
        return 1 + size + (size * size if self.curved else 0)


class Curved:
    """Rows in cells; ``at`` gives the penalised mean loss with its slope and curvature for some of the inputs."""

    def __init__(self, training: DataFrame, inputs: int, penalty: float = 0.0, label: str = "label") -> None:
        self.spark, self.inputs, self.penalty = training.sparkSession, inputs, penalty
        rows = training.select(vector_to_array("all").alias("x"), F.col(label).cast("double").alias("y"))
        self.path = new_path(self.spark, "curved")
        self.cells = stage(rows.mapInArrow(_packed, "cell binary, y double"), "curved", self.path)
        counted = self.cells.agg(F.count(F.lit(1)), F.count_if(F.col("y") == 1.0), F.count_if(F.col("y") == 0.0))
        self.rows, self.ones, zeros = counted.first()
        self.odd = self.rows - self.ones - zeros  # an unknown label is one as well
        self.passes = 0

    @property
    def two_classes(self) -> bool:
        """Whether the labels are zeros and ones, both of them."""
        return not self.odd and 0 < self.ones < self.rows

    def share(self) -> float:
        """The intercept without any input."""
        part = self.ones / self.rows
        return float(np.log(part / (1 - part)))

    def many(self, points: Sequence[_Point]) -> list[tuple[float, np.ndarray, np.ndarray | None]]:
        """Mean loss, slope and curvature, without a penalty, at every point: as many in one pass as ``MOST`` numbers a task hold."""
        found: list[tuple[float, np.ndarray, np.ndarray | None]] = []
        while len(found) < len(points):
            part, numbers = [], 0
            for point in points[len(found) :]:
                numbers += point.numbers
                if part and numbers > MOST:
                    break
                part.append(point)
            found += self._pass(part)
        return found

    def _pass(self, points: Sequence[_Point]) -> list[tuple[float, np.ndarray, np.ndarray | None]]:
        width, ends = self.inputs + 1, np.cumsum([0, *[p.numbers for p in points]])
        groups: dict[tuple[int, ...], list[int]] = {}
        for i, point in enumerate(points):
            groups.setdefault(point.left, []).append(i)

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(ends[-1])
            for batch in batches:
                block = _unpacked(batch.column("cell"), width)
                y = block[:, -1:]
                for left, members in groups.items():
                    a = np.column_stack([block[:, list(left)], np.ones(len(block))])
                    margin = a @ np.column_stack([points[i].weights for i in members])
                    small = np.exp(-np.abs(margin))
                    p = np.where(margin >= 0.0, 1.0, small) / (1.0 + small)
                    losses = (np.log1p(small) + np.maximum(margin, 0.0) - y * margin).sum(0)
                    slopes = a.T @ (p - y)
                    for at, i in enumerate(members):
                        size, start = a.shape[1], ends[i]
                        total[start] += losses[at]
                        total[start + 1 : start + 1 + size] += slopes[:, at]
                        if points[i].curved:
                            total[start + 1 + size : ends[i + 1]] += ((a * (p[:, at] * (1.0 - p[:, at]))[:, None]).T @ a).ravel()
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

        parts = self.cells.select("cell").mapInArrow(sums, "part binary").collect()  # one row a task
        self.passes += 1
        total = sum((np.frombuffer(bytes(r.part)) for r in parts), np.zeros(ends[-1])) / self.rows
        found = []
        for i, point in enumerate(points):
            size, mine = len(point.weights), total[ends[i] : ends[i + 1]]
            found.append((float(mine[0]), mine[1 : 1 + size], mine[1 + size :].reshape(size, size) if point.curved else None))
        return found

    def optima(self, problems: Sequence[Problem], steps: int = 100) -> None:
        """Brings all ``problems`` to their least loss, together: a pass serves all that are not there yet."""
        for _ in range(steps):
            open_ = [p for p in problems if not p.done]
            if not open_:
                return
            for problem, found in zip(open_, self.many([_Point(p.left, p.here, p.wants) for p in open_]), strict=True):
                problem.take(*found)

    def optimum(self, left: Sequence[int], start: np.ndarray, steps: int = 100) -> tuple[np.ndarray, np.ndarray]:
        """The weights of least loss with the square penalty and the curvature before the last step."""
        problem = Problem(tuple(left), self.penalty, False, start)
        self.optima([problem], steps)
        return problem.here, problem.bent()

    def end(self) -> None:
        drop(self.spark, self.path)


class Problem:
    """A fit on the inputs ``left``: the mean loss plus ``penalty`` times the sum of the weights' sizes (``l1``) or half their squares.

    Without a ``curve`` to begin with every pass gives it a new one. With one it keeps that until steps gain too little.
    A step that raises the loss is halved.
    """

    def __init__(self, left: tuple[int, ...], penalty: float, l1: bool, start: np.ndarray, curve: np.ndarray | None = None) -> None:
        self.left, self.penalty, self.l1 = left, penalty, l1
        self.here = self.kept = np.array(start, dtype=np.float64)
        self.step, self.loss, self.gain = np.zeros_like(self.here), np.inf, np.inf
        self.curve, self.always, self.wants, self.stale = curve, curve is None, curve is None, curve is not None
        self.done = False

    def _cost(self, weights: np.ndarray) -> float:
        sizes = np.abs(weights[:-1])  # the intercept has no penalty
        return self.penalty * float(sizes.sum() if self.l1 else 0.5 * (sizes @ sizes))

    def bent(self) -> np.ndarray:
        """The curvature, with that of a square penalty."""
        return self.curve if self.l1 else self.curve + np.diag(np.append(np.full(len(self.left), self.penalty), 0.0))

    def take(self, loss: float, slope: np.ndarray, curve: np.ndarray | None) -> None:
        """What a pass found at ``here``."""
        loss += self._cost(self.here)
        if not loss <= self.loss + 1e-12 * abs(self.loss) and np.abs(self.step).max() > 1e-12:
            if self.stale:  # the curvature is taken anew where the step began
                self.here, self.step, self.wants = self.kept, np.zeros_like(self.here), True
            else:
                self.step = self.step / 2
                self.here = self.kept + self.step
            return
        self.loss, self.kept = loss, self.here
        if curve is not None:
            self.curve = curve
        self.stale = curve is None
        if self.l1:
            self.step = _lasso(self.curve, slope, self.kept, self.penalty) - self.kept
            gain = -(slope @ self.step + self._cost(self.kept + self.step) - self._cost(self.kept))
        else:
            slope = slope + np.append(self.penalty * self.kept[:-1], 0.0)
            self.step = -_solved(self.bent(), slope)
            gain = -(slope @ self.step)
        self.here = self.kept + self.step
        self.done = bool(gain < 2 * SMALL)
        self.wants = self.always or bool(self.stale and gain > 0.1 * self.gain)
        self.gain = gain


def _lasso(curve: np.ndarray, slope: np.ndarray, weights: np.ndarray, penalty: float) -> np.ndarray:
    """The weights of least squared model plus ``penalty`` times the sizes of all but the last: signs are guessed and mended.

    With the signs of the weights that are not zero known, these are the solution of a linear system; a weight that would change its
    sign on the way stops at zero, and the zero that pulls the most joins, until none pulls more than the penalty.
    """
    size = len(weights)
    bent = curve + np.eye(size) * (1e-13 * max(float(np.trace(curve)), 1e-300) / size)  # inputs may depend on each other
    goal, costs = bent @ weights - slope, np.append(np.full(size - 1, penalty), 0.0)
    value = lambda z: 0.5 * (z @ bent @ z) - goal @ z + costs @ np.abs(z)
    z, signs = weights.copy(), np.sign(weights)
    signs[-1] = 1.0
    for _ in range(50 * size):
        active = np.flatnonzero(signs)
        aim = z.copy()
        aim[active] = _solved(bent[np.ix_(active, active)], goal[active] - costs[active] * signs[active])
        turned = active[(costs[active] > 0) & (aim[active] * signs[active] < 0)]
        if len(turned):
            # The best of the end and of every point on the way where a weight is zero.
            tries = [(value(aim), aim)]
            for i in turned:
                between = z + (aim - z) * (z[i] / (z[i] - aim[i]))
                between[i] = 0.0
                tries.append((value(between), between))
            best, aim = min(tries, key=lambda t: t[0])
            if not best < value(z):
                aim = z.copy()
                aim[turned[z[turned] == 0.0]] = 0.0
                signs[turned[z[turned] == 0.0]] = 0.0
                if not (z[turned] == 0.0).any():
                    break
                continue
            z = aim
            intercept = signs[-1]
            signs = np.sign(z)
            signs[-1] = intercept
            continue
        z = aim
        pull = goal - bent @ z
        pull[active] = 0.0
        first = int(np.abs(pull).argmax())
        if not abs(pull[first]) > costs[first] * (1 + 1e-6) + 1e-15:
            break
        signs[first] = np.sign(pull[first])
    return z


def _solved(curve: np.ndarray, value: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.solve(curve, value)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(curve, value, rcond=None)[0]


def penalised_grid(rows: Curved, choices: Sequence[tuple[int, ...]], penalties: Sequence[float], l1: bool) -> list[list[np.ndarray]]:
    """The weights, intercept last, of every choice of inputs under every penalty.

    A choice is fitted under its smallest penalty first; all others start there, with that curvature.
    """
    least = min(penalties)
    first = [Problem(tuple(left), least, l1, np.append(np.zeros(len(left)), rows.share())) for left in choices]
    rows.optima(first)
    others = [[Problem(f.left, penalty, l1, f.here, f.curve) for penalty in penalties] for f in first]
    rows.optima([p for some in others for p in some])
    return [[p.here for p in some] for some in others]


def eliminate(training: DataFrame, inputs: int, keep: int, penalty: float, width: int, label: str = "label") -> list[list[int]] | None:
    """The inputs dropped in each round; None where the labels are not zeros and ones, both of them.

    What the next rounds would drop by the last curvature is fitted in the same passes; a round counts once its own optimum drops the same.
    """
    rows = Curved(training, inputs, penalty, label)
    try:
        if not rows.two_classes:
            return None
        left, dropped = tuple(range(inputs)), []
        if inputs <= keep:
            return dropped
        weights, curve = rows.optimum(left, np.append(np.zeros(inputs), rows.share()))
        while len(left) > keep:
            guesses, here, bent, some = [], weights, curve, left
            while len(some) > keep and len(guesses) < AHEAD:
                out = _weakest(here, min(width, len(some) - keep))
                stay = [i for i in range(len(some) + 1) if i not in set(out)]
                # On the last curvature, the least loss without the dropped inputs.
                here = here[stay] + _solved(bent[np.ix_(stay, stay)], bent[np.ix_(stay, out)] @ here[out])
                gone, bent, some = [some[i] for i in out], bent[np.ix_(stay, stay)], tuple(some[i] for i in stay[:-1])
                guesses.append((gone, Problem(some, penalty, False, here)))
            rows.optima([problem for _, problem in guesses if len(problem.left) > keep])
            for gone, problem in guesses:
                out = _weakest(weights, min(width, len(left) - keep))
                if [left[i] for i in out] != gone:
                    break
                dropped.append(gone)
                left = problem.left
                if len(left) > keep:
                    weights, curve = problem.here, problem.bent()
        return dropped
    finally:
        rows.end()


def _weakest(weights: np.ndarray, count: int) -> list[int]:
    return sorted(sorted(range(len(weights) - 1), key=lambda i: (weights[i] ** 2, i))[:count])
