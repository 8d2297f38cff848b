"""A feed-forward network fitted by all tasks together.

Layers, loss, start weights and steps are those of Spark's MultilayerPerceptronClassifier: sigmoid layers, a softmax on top, cross-entropy, L-BFGS with a strong
Wolfe line search. A pass over the rows, which stay in the executors as blocks, gives loss and gradient as one vector per task; Spark's own passes take several
times as long, since they multiply small matrices without a native library. Rows count the same; Spark gives those of incomplete blocks more weight.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame

from tradewake.operators.boosted_trees import added, gathered, matrix

# Rows multiplied at once, so that what is in between stays in the processor's cache.
CHUNK = 1_024
# Steps that the search direction remembers, trials of a line search and of its narrowing, and gains (of values or gradients) that count as none.
CORRECTIONS, TRIALS, SMALLEST, VALUES = 10, 10, 1e-6, 20


def _block(columns: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in gathered(batches):
        won = block.column(columns).to_numpy()
        if not ((won == 0) | (won == 1)).all():
            raise ValueError("a label is neither 0 nor 1")
        made = np.ascontiguousarray(matrix(block, columns).T), won.astype(np.int8)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(made)], pa.binary())], ["block"])


def blocks(rows: DataFrame, inputs: Sequence[Column], label: Column) -> RDD:
    """Inputs and labels of the rows as blocks that stay in the executors."""
    named = rows.select(*[c.cast("double").alias(f"_{i}") for i, c in enumerate(inputs)], label.cast("double").alias("_label"))
    made, most = named.mapInArrow(partial(_block, len(inputs)), "block binary").rdd, rows.sparkSession.sparkContext.defaultParallelism
    made = made.coalesce(most) if made.getNumPartitions() > most else made
    return made.map(lambda r: pickle.loads(r["block"])).persist(StorageLevel.MEMORY_AND_DISK)


def _layers(weights: np.ndarray, sizes: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Matrix and offsets of each layer, as Spark lays them out."""
    out, at = [], 0
    for n, m in zip(sizes, sizes[1:]):
        out.append((weights[at : at + n * m].reshape(n, m), weights[at + n * m : at + n * m + m]))
        at += n * m + m
    return out


def _forward(x: np.ndarray, layers, room: list[np.ndarray]) -> list[np.ndarray]:
    """Values of all layers, the last ones probabilities, in the room given for them."""
    values = [x]
    for i, ((w, b), z) in enumerate(zip(layers, room)):
        np.matmul(values[-1], w, out=z)
        z += b
        if i + 1 < len(layers):
            # The sigmoid function.
            np.negative(z, out=z)
            np.minimum(z, 700.0, out=z)
            np.exp(z, out=z)
            z += 1.0
            np.reciprocal(z, out=z)
        else:
            z -= z.max(axis=1, keepdims=True)
            np.exp(z, out=z)
            z /= z.sum(axis=1, keepdims=True)
        values.append(z)
    return values


def _passed(weights: np.ndarray, sizes: Sequence[int], backward: bool, rows) -> Iterator[np.ndarray]:
    """Sum of the losses, rows, and the sum of the gradients if wanted."""
    layers, out = _layers(weights, sizes), np.zeros(2 + len(weights) * backward)
    parts = _layers(out[2:], sizes) if backward else []
    # Used again for every chunk: new arrays cost more than what is done with them.
    room = [[np.empty((CHUNK, m)) for m in sizes[1:]] for _ in range(3)]
    for x, won in rows:
        for start in range(0, len(x), CHUNK):
            y = won[start : start + CHUNK]
            places, errors, slopes = ([z[: len(y)] for z in some] for some in room)
            values = _forward(x[start : start + CHUNK], layers, places)
            delta, place = values[-1], np.arange(len(y))
            right = delta[place, y] if backward else delta[place, y].clip(1e-15, 1 - 1e-15)
            with np.errstate(divide="ignore"):
                out[:2] -= np.log(right).sum(), -len(y)
            if not backward:
                continue
            delta[place, y] -= 1.0
            for i in range(len(layers) - 1, -1, -1):
                parts[i][0][...] += values[i].T @ delta
                parts[i][1][...] += delta.sum(axis=0)
                if i:
                    # Times the slope of the sigmoid function, h (1 - h).
                    below, slope = errors[i - 1], slopes[i - 1]
                    np.matmul(delta, layers[i][0].T, out=below)
                    np.subtract(1.0, values[i], out=slope)
                    slope *= values[i]
                    below *= slope
                    delta = below
    yield out


def loss(rows: RDD, weights: np.ndarray, sizes: Sequence[int]) -> float | None:
    """Mean loss, none without rows."""
    found = added(rows.mapPartitions(partial(_passed, weights, sizes, False)), 2)
    return found[0] / found[1] if found[1] else None


def loss_and_gradient(rows: RDD, sizes: Sequence[int]) -> Callable[[np.ndarray], tuple[float, np.ndarray]]:
    """The mean loss and its gradient as a function of the weights; asked for the same weights again, it takes no pass."""
    last: list = []

    def found(weights: np.ndarray) -> tuple[float, np.ndarray]:
        if not last or not np.array_equal(last[0], weights):
            got = added(rows.mapPartitions(partial(_passed, weights, sizes, True)), 2 + len(weights))
            if not got[1]:
                raise ValueError("no rows to fit a network on")
            last[:] = weights.copy(), got[0] / got[1], got[2:] / got[1]
        return last[1], last[2]

    return found


class SearchFailed(Exception):
    """No step was found."""


def _between(low, high) -> float:
    """Least point of the cubic through two trials (step, value, slope), not too near to either."""
    low, high = (low, high) if low[0] <= high[0] else (high, low)
    if low[0] == high[0]:
        return math.nan
    d1 = low[2] + high[2] - 3 * (low[1] - high[1]) / (low[0] - high[0])
    square = d1 * d1 - low[2] * high[2]
    d2 = math.sqrt(square) if square >= 0 else math.nan
    width, below = high[0] - low[0], high[2] - low[2] + 2 * d2
    t = high[0] - width * (high[2] + d2 - d1) / below if below else math.nan
    if t < low[0] + 0.1 * width:
        return low[0] + 0.1 * width
    return low[0] + 0.9 * width if t > low[0] + 0.9 * width else t


def _step(value, x: np.ndarray, direction: np.ndarray, t: float) -> float:
    """A step along the direction that meets the strong Wolfe conditions."""

    def trial(t: float):
        f, g = value(x + direction * t)
        return t, f, float(g @ direction)

    low = start = trial(0.0)
    if start[2] > 0:
        raise SearchFailed
    high = None
    for i in range(TRIALS):
        c = trial(t)
        if not math.isfinite(c[1]):
            t /= 2
            continue
        if c[1] > start[1] + 1e-4 * t * start[2] or (c[1] >= low[1] and i > 0):
            high = c
            break
        if abs(c[2]) <= 0.9 * abs(start[2]):
            return c[0]
        if c[2] >= 0:
            low, high = c, low
            break
        low, t = c, t * 1.5
    if high is None:
        raise SearchFailed
    for _ in range(TRIALS):
        c = trial(_between(low, high))
        if c[1] > start[1] + 1e-4 * c[0] * start[2] or c[1] >= low[1]:
            high = c
            continue
        if abs(c[2]) <= 0.9 * abs(start[2]):
            return c[0]
        if c[2] * (high[0] - low[0]) >= 0:
            high = low
        low = c
    raise SearchFailed


def _direction(gradient: np.ndarray, steps: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Descent by the last steps and what they changed in the gradient, newest first."""
    direction, shares = gradient.copy(), []
    if steps and not float(steps[0][0] @ steps[0][1]) > 0:
        raise SearchFailed
    for s, y in steps:
        if not (at := float(s @ y)):
            raise SearchFailed
        shares.append(float(s @ direction) / at)
        direction -= shares[-1] * y
    if steps:
        s, y = steps[0]
        direction *= float(s @ y) / float(y @ y)
    for (s, y), share in zip(reversed(steps), reversed(shares)):
        direction += (share - float(y @ direction) / float(s @ y)) * s
    return -direction


def lbfgs(value: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, rounds: int) -> np.ndarray:
    """Weights after at most so many steps."""
    (f, g), steps, failed, done = value(x), [], False, 0
    first, values = abs(f), [math.inf]
    while done < rounds:
        if np.linalg.norm(g) <= max(SMALLEST * abs(f), 1e-8):
            break
        try:
            direction = _direction(g, steps)
            t = _step(value, x, direction, 1.0 if done else 1.0 / np.linalg.norm(direction))
            if t * np.linalg.norm(g) < 1e-10:
                raise SearchFailed
        except SearchFailed:
            if failed:
                break
            failed, steps = True, []
            continue
        new = x + direction * t
        f_new, g_new = value(new)
        steps = [(new - x, g_new - g), *steps][:CORRECTIONS]
        values = [*values, f_new][-VALUES:]
        x, f, g, failed, done = new, f_new, g_new, False, done + 1
        if abs(f - max(values)) <= SMALLEST * first:
            break
    return x
