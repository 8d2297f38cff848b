"""Boosted trees of very many small segments, fitted side by side.

A Spark ML classifier takes hundreds of small jobs whatever the size of its rows, so one per segment costs hours where there are thousands of segments.
Here Spark brings the rows of a segment together and the task that gets them boosts trees on them, with the settings and rules of ``models.fit_boosted``:
logistic loss, a first tree of weight one, quantile bins, a share of the rows per tree and of the columns per node, and the rounds up to the best one
on the holdout. Only the random draws differ. The trees of a segment are one row; rows to score meet them by segment, many rows in parts.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewake.operators import models
from tradewake.operators.boosted_trees import cuts
from tradewake.session import cut_lineage

# Training rows that a segment fitted in one task has at most, and rows scored together.
MOST_ROWS, SCORED_ROWS = 200_000, 100_000


def thresholds(values: np.ndarray, most: int) -> np.ndarray:
    """At most ``most`` cuts between distinct values, as far apart in rows as can be."""
    return cuts(*np.unique(values, return_counts=True), most)


def _grown(codes: np.ndarray, bins: int, target: np.ndarray, drawn: np.ndarray, depth: int, columns: int, rng: np.random.Generator):
    """A regression tree by variance on the rows drawn: column (-1: none), cut and value of each node, and the node every row ends in.

    The children of node i are 2 i and 2 i + 1, the root is 1.
    """
    n, d = codes.shape
    column, cut, value = np.full(2 ** (depth + 1), -1), np.zeros(2 ** (depth + 1), dtype=np.int64), np.zeros(2 ** (depth + 1))
    node = np.ones(n, dtype=np.int64)
    for level in range(depth + 1):
        first = 2**level
        used = np.flatnonzero(drawn & (node >= first))
        at = node[used] - first
        counts, sums = np.bincount(at, minlength=first), np.bincount(at, target[used], first)
        value[first : 2 * first] = sums / np.maximum(counts, 1)
        if level == depth or not len(used):
            break
        cells = (at[:, None] * (d * bins) + np.arange(d) * bins + codes[used]).ravel()
        left = np.bincount(cells, minlength=first * d * bins).reshape(first, d, bins).cumsum(2)[:, :, :-1]
        left_sum = np.bincount(cells, np.repeat(target[used], d), first * d * bins).reshape(first, d, bins).cumsum(2)[:, :, :-1]
        right, right_sum = counts[:, None, None] - left, sums[:, None, None] - left_sum
        gain = left_sum**2 / np.maximum(left, 1) + right_sum**2 / np.maximum(right, 1) - (sums**2 / np.maximum(counts, 1))[:, None, None]
        gain[(left == 0) | (right == 0)] = 0.0
        if columns < d:
            np.put_along_axis(gain, rng.random((first, d)).argsort(axis=1)[:, columns:, None], 0.0, axis=1)
        gain = gain.reshape(first, -1)
        best = gain.argmax(axis=1)
        split = gain[np.arange(first), best] > 1e-9
        column[first : 2 * first] = np.where(split, best // (bins - 1), -1)
        cut[first : 2 * first] = best % (bins - 1)
        moving = np.flatnonzero((node >= first) & (column[node] >= 0))
        own = node[moving]
        node[moving] = 2 * own + (codes[moving, column[own]] > cut[own])
    return column, cut, value, node


def boosted(x: np.ndarray, won: np.ndarray, held: np.ndarray, seed: int, rounds: int, rate: float, depth: int, row_share: float, column_share: float,
            bins: int, patience: int) -> tuple[list[int], list[float], list[float]]:
    """Columns, thresholds and weighted values of the nodes of all trees kept, tree after tree; ``held`` rows only decide how many."""
    rng = np.random.default_rng(seed)
    own = ~held if not held.all() else held
    n, d = x.shape
    cuts = [thresholds(x[own, i], min(bins, max(int(own.sum()), 2)) - 1) for i in range(d)]
    codes = np.stack([np.searchsorted(c, x[:, i]) for i, c in enumerate(cuts)], axis=1)
    widest = max(max(len(c) for c in cuts) + 1, 2)
    sign, margin = 2.0 * won - 1.0, np.zeros(n)
    trees, losses = [], []
    for i in range(rounds):
        target = sign if i == 0 else 4.0 * sign / (1.0 + np.exp(np.minimum(2.0 * sign * margin, 700.0)))
        drawn = own & (rng.random(n) < row_share)
        if not drawn.any():
            drawn = own
        column, cut, value, node = _grown(codes, widest, target, drawn, depth, int(np.ceil(column_share * d)), rng)
        value = value * (1.0 if i == 0 else rate)
        margin += value[node]
        at = [cuts[c][k] if c >= 0 else 0.0 for c, k in zip(column.tolist(), cut.tolist())]
        trees.append((column.tolist(), at, value.tolist()))
        if held.any():
            losses.append(float(np.logaddexp(0.0, -2.0 * sign[held] * margin[held]).mean()))
            if i - int(np.argmin(losses)) >= patience:
                break
    kept = trees[: models.stop_round(losses, patience)] if losses else trees
    return tuple([v for tree in kept for v in tree[part]] for part in range(3))


def margins(x: np.ndarray, column: np.ndarray, cut: np.ndarray, value: np.ndarray, depth: int) -> np.ndarray:
    """Sum of the values of the leaves that rows end in."""
    total, rows, slots = np.zeros(len(x)), np.arange(len(x)), 2 ** (depth + 1)
    for start in range(0, len(column), slots):
        node = np.ones(len(x), dtype=np.int64)
        for _ in range(depth):
            own = column[start + node]
            node = np.where(own >= 0, 2 * node + (x[rows, own] > cut[start + node]), node)
        total += value[start + node]
    return total


@dataclass(frozen=True)
class SegmentTrees:
    """The boosted trees of many segments, one row each: segment, columns, thresholds, values."""

    trees: DataFrame
    columns: tuple[str, ...]
    depth: int
    segment: str = "category"

    @classmethod
    def fit(cls, train: DataFrame, columns: Sequence[str], holdout: str, key: str, rounds: int = 50, rate: float = 0.05, depth: int = 5, row_share: float = 0.7,
            column_share: float = 0.8, bins: int = 128, patience: int = models.PATIENCE["boosted"], segment: str = "category") -> SegmentTrees:
        """A model per segment of ``train``; no segment may have more rows than a task can hold."""
        names, label = list(columns), models.LABEL

        def fit_one(rows: pd.DataFrame) -> pd.DataFrame:
            # Draws go by the order of the rows, which a shuffle leaves open.
            rows = rows.sort_values([key, *names, label])
            x, held = rows[names].to_numpy(dtype=float), rows[holdout].to_numpy(dtype=bool)
            name = rows[segment].iloc[0]
            found = boosted(x, rows[label].to_numpy(dtype=float), held, models.SEED + int(name), rounds, rate, depth, row_share, column_share, bins, patience)
            return pd.DataFrame({segment: [name], "column": [found[0]], "cut": [found[1]], "value": [found[2]]})

        kind = train.schema[segment].dataType.simpleString()
        schema = f"{segment} {kind}, column array<int>, cut array<double>, value array<double>"
        chosen = train.select(segment, holdout, key, *names, label)
        return cls(cut_lineage(chosen.groupBy(segment).applyInPandas(fit_one, schema)), tuple(columns), depth, segment)

    def score(self, inputs: DataFrame, probability: str, predicted: str, threshold: float) -> DataFrame:
        """The rows of the segments that have a model, with the win probability and the decision."""
        names, depth, most = list(self.columns), self.depth, SCORED_ROWS
        # Segments with many rows are scored in parts, each beside a copy of the trees.
        parts = inputs.groupBy(self.segment).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("_parts"))
        parts = cut_lineage(parts.join(self.trees.select(self.segment), self.segment))
        part = F.pmod(F.xxhash64(*inputs.columns), F.col("_parts").cast("long")).cast("int")
        rows = inputs.join(parts, self.segment).select(*inputs.columns, part.alias("_part"))
        trees = self.trees.join(parts, self.segment).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            x = np.column_stack([left[c].to_numpy() for c in names]).astype(float) if left.num_rows else np.zeros((0, len(names)))
            found = np.zeros(0)
            if left.num_rows:
                model = [right[c][0].values.to_numpy(zero_copy_only=False) for c in ("column", "cut", "value")]
                found = 1.0 / (1.0 + np.exp(np.minimum(-2.0 * margins(x, *model, depth), 700.0)))
            return left.drop_columns(["_part"]).append_column("_p", pa.array(found, pa.float64()))

        keys = [self.segment, "_part"]
        fields = ", ".join(f"`{c}` {t}" for c, t in [*inputs.dtypes, ("_p", "double")])
        scored = rows.groupBy(*keys).cogroup(trees.groupBy(*keys)).applyInArrow(meet, fields)
        return scored.withColumnRenamed("_p", probability).withColumn(predicted, (F.col(probability) >= threshold).cast("int"))
