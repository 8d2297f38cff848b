"""Boosted trees of one set of rows, fitted by all tasks together.

The rows become blocks of binned columns that stay in the executors. One pass over the blocks gives, for a level of a tree, the number of rows and the sum of
the target by node, column and bin; the driver adds one such table per task, whose size doesn't depend on the rows, and picks the splits. Rules and settings are
those of Spark's GBTClassifier, and the result is its model: logistic loss, a first tree of weight one, a share of the rows per tree and of the columns per node.
Two things differ. The thresholds come from all rows and not from a sample of them, and a row is drawn by its hash, so draws don't depend on the layout.
"""

from __future__ import annotations

import json
import pickle
import time
import uuid
from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewake.session import delete_paths, scratch_path, shared_folder

# Rows of a block; values kept of a column while its thresholds are looked for: they are exact up to so many distinct ones, else off by a share of some 1 / SUMMARY of the rows.
BLOCK_ROWS, SUMMARY = 100_000, 8_192
# Rounds after which the blocks are written to the shared folder, and tasks whose tables the driver adds by itself.
WRITTEN_EVERY, ADDED_AT_ONCE = 10, 32


# --------------------------------------------------------------------------- thresholds


def cuts(distinct: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """At most ``most`` cuts between distinct values, as far apart in rows as can be."""
    middles = (distinct[:-1] + distinct[1:]) / 2
    if len(middles) <= most:
        return middles
    below = counts.cumsum()[:-1]
    targets = counts.sum() / (most + 1) * np.arange(1, most + 1)
    after = np.searchsorted(below, targets).clip(1, len(below) - 1)
    return middles[np.unique(np.where(targets - below[after - 1] <= below[after] - targets, after - 1, after))]


def summary(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and their rows; of more than SUMMARY values, the last of each of as many groups of about the same number of rows."""
    distinct, place = np.unique(values, return_inverse=True)
    rows = np.bincount(place, counts, len(distinct))
    if len(distinct) <= SUMMARY:
        return distinct, rows
    total = rows.cumsum()
    group = ((total - rows / 2) * (SUMMARY / total[-1])).astype(np.int64)
    last = np.flatnonzero(np.append(group[1:] != group[:-1], True))
    return distinct[last], np.diff(total[last], prepend=0.0)


def merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return summary(np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]]))


def matrix(block: pa.Table, columns: int) -> np.ndarray:
    """The first columns, a row each."""
    x = np.stack([block.column(i).to_numpy() for i in range(columns)])
    if np.isnan(x).any():
        raise ValueError("an input is null or not a number")
    return x


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together to blocks."""
    waiting, rows = [], 0
    for batch in batches:
        if batch.num_rows:
            waiting, rows = [*waiting, batch], rows + batch.num_rows
        if rows >= BLOCK_ROWS:
            yield pa.Table.from_batches(waiting)
            waiting, rows = [], 0
    if waiting:
        yield pa.Table.from_batches(waiting)


def _summaries(columns: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Summary of each column over the fitted rows of a task."""
    found: list = [None] * columns
    for block in gathered(batches):
        own = ~block.column(columns + 1).to_numpy()
        for i, values in enumerate(matrix(block, columns)):
            new = summary(values[own], np.ones(int(own.sum())))
            found[i] = new if found[i] is None else merged(found[i], new)
    if found[0] is not None:
        yield pa.RecordBatch.from_arrays([pa.array(range(columns), pa.int32()), pa.array([pickle.dumps(f) for f in found], pa.binary())], ["at", "block"])


def _thresholds(rows: DataFrame, columns: int, bins: int) -> tuple[list[np.ndarray], int]:
    """Thresholds of each column and the number of rows to fit on."""
    parts = rows.mapInArrow(partial(_summaries, columns), "at int, block binary").rdd.map(lambda r: (r["at"], pickle.loads(r["block"])))
    found = parts.reduceByKey(merged, max(1, min(columns, rows.sparkSession.sparkContext.defaultParallelism))).collectAsMap()
    n = int(found[0][1].sum()) if found else 0
    return [cuts(*found[i], min(bins, max(n, 2)) - 1) for i in range(columns)] if n else [], n


# --------------------------------------------------------------------------- passes


def _coded(found: list[np.ndarray], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks: bins by column and row, +1 or -1 for the label, whether a row is held out, its hash, the sum of the trees so far."""
    d, kind = len(found), np.uint8 if max(map(len, found)) < 256 else np.uint16
    for block in gathered(batches):
        codes = np.stack([np.searchsorted(c, x).astype(kind) for c, x in zip(found, matrix(block, d))])
        won = block.column(d).to_numpy().astype(float)
        if not ((won == 0) | (won == 1)).all():
            raise ValueError("a label is neither 0 nor 1")
        made = codes, (2 * won - 1).astype(np.int8), block.column(d + 1).to_numpy(), (block.column(d + 2).to_numpy() & 0xFFFFFFFF).astype(np.uint32), np.zeros(len(won))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(made)], pa.binary())], ["block"])


def _drawn(keys: np.ndarray, draw: int, share: float) -> np.ndarray:
    """A share of the rows, another for each draw (mixing of splitmix64)."""
    z = keys + np.uint64(((draw + 1) * 0x9E3779B97F4A7C15) % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))) >> np.uint64(11) < np.uint64(int(share * 2**53))


def _ends(codes: np.ndarray, column: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """Node that each row is in; the children of node i are 2 i and 2 i + 1, the root is 1."""
    n = codes.shape[1]
    # A node without a split leads back to itself; arrays are used again, as new ones cost more than what is done with them.
    inner, flat = column >= 0, codes.reshape(-1)
    start, least, step = np.where(inner, column, 0) * n, np.where(inner, cut, 0), np.where(inner, 2, 1) * np.arange(len(column))
    node, rows, at, limit = np.ones(n, dtype=np.intp), np.arange(n), np.empty(n, dtype=np.intp), np.empty(n, dtype=np.intp)
    right, moving = np.empty(n, dtype=bool), np.empty(n, dtype=bool)
    for _ in range(levels):
        np.take(start, node, out=at, mode="clip")
        at += rows
        np.take(least, node, out=limit, mode="clip")
        np.greater(flat.take(at), limit, out=right)
        np.take(inner, node, out=moving, mode="clip")
        right &= moving
        np.take(step, node, out=at, mode="clip")
        np.add(at, right, out=node)
    return node


def _carried(column: np.ndarray, cut: np.ndarray, value: np.ndarray, depth: int, block):
    """A block with one more tree in its sums."""
    codes, sign, held, keys, margin = block
    return codes, sign, held, keys, margin + value[_ends(codes, column, cut, depth)]


def _totals(column: np.ndarray, cut: np.ndarray, slot: np.ndarray, level: int, bins: int, draw: int, share: float, first: bool, blocks) -> Iterator[np.ndarray]:
    """Rows and sums of the target by slot, column and bin; the loss and the rows held out at the end."""
    out, slots = None, int(slot.max()) + 1
    for codes, sign, held, keys, margin in blocks:
        d = len(codes)
        if out is None:
            out = np.zeros(2 * slots * d * bins + 2)
            counts, sums = out[:-2].reshape(2, d, slots * bins)
        if level == 0 and held.any():
            out[-2:] += np.logaddexp(0.0, -2.0 * sign[held] * margin[held]).sum(), held.sum()
        at = slot[_ends(codes, column, cut, level)]
        used = np.flatnonzero(~held & (at >= 0) & (_drawn(keys, draw, share) if share < 1 else True))
        own, base, cell = sign[used].astype(float), at[used] * bins, np.empty(len(used), dtype=np.intp)
        target = own if first else 4.0 * own / (1.0 + np.exp(np.minimum(2.0 * own * margin[used], 700.0)))
        codes = codes[:, used]
        for i in range(d):
            np.add(base, codes[i], out=cell)
            counts[i] += np.bincount(cell, minlength=slots * bins)
            sums[i] += np.bincount(cell, target, slots * bins)
    if out is not None:
        yield out


def added(passes: RDD, width: int) -> np.ndarray:
    """Sum of the vectors that the tasks give."""
    if passes.getNumPartitions() > ADDED_AT_ONCE:
        return passes.treeReduce(np.add)
    return sum(passes.collect(), np.zeros(width))


def _grown(blocks: RDD, d: int, bins: int, depth: int, columns: int, seed: int, draw: int, share: float, first: bool, root: np.ndarray):
    """Column (-1: none), cut, rows, sum and gain of the nodes of a tree; ``root`` is the pass over its first level."""
    rng = np.random.default_rng([seed, draw])
    column, cut = np.full(2 ** (depth + 1), -1), np.zeros(2 ** (depth + 1), dtype=np.int64)
    rows, total, gains = (np.zeros(2 ** (depth + 1)) for _ in range(3))
    table = root[:-2].reshape(2, d, 1, bins).transpose(0, 2, 1, 3)
    rows[1], total[1] = table[0, 0, 0].sum(), table[1, 0, 0].sum()
    nodes = np.array([1])
    for level in range(depth):
        left, left_sum = table[0].cumsum(2)[:, :, :-1], table[1].cumsum(2)[:, :, :-1]
        n, s = rows[nodes][:, None, None], total[nodes][:, None, None]
        gain = left_sum**2 / np.maximum(left, 1) + (s - left_sum) ** 2 / np.maximum(n - left, 1) - s**2 / np.maximum(n, 1)
        gain[(left == 0) | (left == n)] = 0.0
        if columns < d:
            np.put_along_axis(gain, rng.random((2**level, d))[nodes - 2**level].argsort(axis=1)[:, columns:, None], 0.0, axis=1)
        flat = gain.reshape(len(nodes), -1)
        # Gains that differ by less than their rounding errors are ties, of which the first wins.
        best = np.round(flat / flat.max(axis=1, keepdims=True).clip(1e-300), 9).argmax(axis=1)
        most = flat[np.arange(len(nodes)), best]
        split = np.flatnonzero(most > 1e-9)
        if not len(split):
            break
        own, best = nodes[split], best[split]
        column[own], cut[own], gains[own] = best // (bins - 1), best % (bins - 1), most[split]
        rows[2 * own], total[2 * own] = left.reshape(len(nodes), -1)[split, best], left_sum.reshape(len(nodes), -1)[split, best]
        rows[2 * own + 1], total[2 * own + 1] = rows[own] - rows[2 * own], total[own] - total[2 * own]
        if level + 1 == depth:
            break
        # Only the smaller child of each node is counted; the other one is what is left of the node.
        small = np.where(rows[2 * own] <= rows[2 * own + 1], 2 * own, 2 * own + 1)
        slot = np.full(2 ** (level + 2), -1)
        slot[small] = np.arange(len(small))
        job = partial(_totals, column, cut, slot, level + 1, bins, draw, share, first)
        counted = added(blocks.mapPartitions(job), 2 * len(small) * d * bins + 2)[:-2].reshape(2, d, len(small), bins).transpose(0, 2, 1, 3)
        nodes = np.concatenate([small, small ^ 1])
        table = np.concatenate([counted, table[:, split] - counted], axis=1)
    return column, cut, rows, total, gains


# --------------------------------------------------------------------------- fitting


def fit(train: DataFrame, columns: Sequence[str], label: str, held: str | None, rounds: int, rate: float, depth: int, row_share: float, column_share: float, bins: int,
        seed: int, patience: int, names: dict[str, str]):
    """All rows but those held out decide the trees, those held out how many of them are kept: up to the best, looked for until ``patience`` bring no gain."""
    spark, d = train.sparkSession, len(columns)
    # Passes are written out every few rounds.
    shared_folder(spark)
    numbers = [F.col(c).cast("double") for c in [*columns, label]]
    kept = train if held is None else train.where(F.col(held).isNotNull())
    rows = kept.select(*[x.alias(f"_{i}") for i, x in enumerate(numbers)], (F.lit(False) if held is None else F.col(held)).alias("_held"), F.xxhash64(*train.columns).alias("_key"))
    found, n = _thresholds(rows, d, bins)
    if not n:
        raise ValueError("no rows to fit boosted trees on")
    widest, some = max(max(map(len, found)) + 1, 2), int(np.ceil(column_share * d))
    made = rows.mapInArrow(partial(_coded, found), "block binary").rdd
    made = made.coalesce(max(1, spark.sparkContext.defaultParallelism)) if made.getNumPartitions() > spark.sparkContext.defaultParallelism else made
    blocks = made.map(lambda r: pickle.loads(r["block"])).persist(StorageLevel.MEMORY_AND_DISK)
    trees, losses, before, written = [], [], None, []
    column, cut, slot = np.full(2, -1), np.zeros(2, dtype=np.int64), np.array([-1, 0])

    def at_root(draw: int, share: float, first: bool) -> np.ndarray:
        return added(blocks.mapPartitions(partial(_totals, column, cut, slot, 0, widest, draw, share, first)), 2 * d * widest + 2)

    try:
        for i in range(rounds + 1):
            root = at_root(seed + i, row_share, i == 0)
            if before is not None:
                before.unpersist()
            if i and i % WRITTEN_EVERY == 0:
                written.append(blocks.getCheckpointFile())
                delete_paths(spark, written[:-1])
                written = written[-1:]
            if i and root[-1]:
                losses.append(root[-2] / root[-1])
            if i == rounds or (losses and i - 1 - int(np.argmin(losses)) >= patience):
                break
            share = row_share
            if not root[:widest].any():
                # Too few rows for a draw.
                share = 1.0
                root = at_root(seed + i, share, i == 0)
            trees.append(_grown(blocks, d, widest, depth, some, seed, seed + i, share, i == 0, root))
            if i + 1 == rounds and not root[-1]:
                break
            before, value = blocks, trees[-1][3] / np.maximum(trees[-1][2], 1) * (1.0 if i == 0 else rate)
            blocks = before.map(partial(_carried, *trees[-1][:2], value, depth)).persist(StorageLevel.MEMORY_AND_DISK)
            if (i + 1) % WRITTEN_EVERY == 0:
                blocks.checkpoint()
    finally:
        for cached in (before, blocks):
            if cached is not None:
                cached.unpersist()
        delete_paths(spark, [w for w in written if w])
    keep = int(np.argmin(losses)) + 1 if losses else len(trees)
    settings = {"maxIter": rounds, "stepSize": rate, "maxDepth": depth, "subsamplingRate": row_share, "featureSubsetStrategy": str(column_share), "maxBins": bins, "seed": seed}
    return spark_model(spark, trees[:keep], found, rate, settings | names)


def _nodes(tree, found: list[np.ndarray]) -> Iterator[tuple]:
    """Nodes from the root on, left before right, as Spark numbers them."""
    column, cut, rows, total, gains = (x.tolist() for x in tree)
    order, stack = {}, [1]
    while stack:
        node = stack.pop()
        order[node] = len(order)
        if column[node] >= 0:
            stack += [2 * node + 1, 2 * node]
    for node, at in order.items():
        n, s, c = rows[node], total[node], column[node]
        mean = s / max(n, 1)
        ends = (gains[node] / n, order[2 * node], order[2 * node + 1], c, float(found[c][cut[node]])) if c >= 0 else (-1.0, -1, -1, -1, 0.0)
        yield at, mean, n, s, mean * s, *ends


def spark_model(spark: SparkSession, trees: Sequence[tuple], found: list[np.ndarray], rate: float, params: dict):
    """The trees as Spark's model, by way of its saved form. The impurities of nodes aren't kept, only their gains."""
    # Here, as the tasks import this module and do without.
    from pyspark.ml.classification import GBTClassificationModel

    path = scratch_path(spark, "boosted")

    def described(kind: str, uid: str, some: dict, **more) -> str:
        return json.dumps({"class": f"org.apache.spark.ml.{kind}", "timestamp": int(time.time() * 1000), "sparkVersion": spark.version, "uid": uid, "paramMap": some, "defaultParamMap": {"impurity": "variance"}, **more})

    uid = f"GBTClassifier_{uuid.uuid4().hex[:12]}"
    spark.createDataFrame([(described("classification.GBTClassificationModel", uid, params, numFeatures=len(found), numTrees=len(trees)),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    own = {k: v for k, v in params.items() if k in ("featuresCol", "labelCol", "predictionCol", "maxDepth", "maxBins", "seed")}
    each = [(i, described("regression.DecisionTreeRegressionModel", f"{uid}_{i}", own), 1.0 if i == 0 else rate) for i in range(len(trees))]
    spark.createDataFrame(each, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    flat = [(i, *node) for i, tree in enumerate(trees) for node in _nodes(tree, found)]
    kinds = {"treeID": pa.int32(), "id": pa.int32(), "prediction": pa.float64(), "n": pa.float64(), "s": pa.float64(), "q": pa.float64(), "gain": pa.float64(), "leftChild": pa.int32(), "rightChild": pa.int32(), "featureIndex": pa.int32(), "cut": pa.float64()}
    table = pa.table({name: pa.array(values, kind) for (name, kind), values in zip(kinds.items(), zip(*flat))})
    threshold = F.when(F.col("featureIndex") >= 0, F.array("cut")).otherwise(F.array().cast("array<double>")).alias("leftCategoriesOrThreshold")
    node = F.struct(
        "id", "prediction", F.lit(0.0).alias("impurity"), F.array("n", "s", "q").alias("impurityStats"), F.col("n").cast("long").alias("rawCount"), "gain", "leftChild", "rightChild",
        F.struct("featureIndex", threshold, F.lit(-1).alias("numCategories")).alias("split"),
    )
    spark.createDataFrame(table).select("treeID", node.alias("nodeData")).write.parquet(f"{path}/data")
    model = GBTClassificationModel.load(path)
    delete_paths(spark, [path])
    return model
