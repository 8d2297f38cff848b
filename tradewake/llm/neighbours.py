"""Approximate nearest neighbours by stable projections and a kd-tree.

Vectors are projected to ``DIMENSIONS`` normal random directions. Of a true distance d the projected one is d times
the root of a chi-square variable, so once the next projected neighbour lies beyond q times the k-th distance found, q being
the ``CERTAINTY`` quantile, a missed true neighbour is as unlikely as that. Largest inner products become smallest
distances by one more coordinate, which lifts every vector to the largest norm.

A kd-tree over the projections, fitted on ``SAMPLE`` vectors at most, deals all vectors to leaves. A query visits leaves in the
order of their distance in rounds of growing size; after each the stopping test is made against the next leaf, and
within a leaf against each projected neighbour. Leaves are worked on in chunks of vectors and blocks of queries, so
neither a large leaf nor a popular one is one task's work. Equal vectors are one point with its smallest ids.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite component take no part; shorter ones count as padded with
zeros; equal scores go to the smaller id; rows that share an id stand for the smaller vector; with fewer candidates than asked for, all
are returned; no vectors, no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradewake.llm.common import table
from tradewake.session import cut_lineage

NEAREST = 20
QUERY_STEP = 20
DIMENSIONS = 8
CERTAINTY = 0.95
SAMPLE = 16_384
LEAF_ROWS = 2_048
MOST_LEAVES = 256
CHUNK_ROWS = 4_096
BLOCK_QUERIES = 1_024
SEED = 11
# Neighbours in a leaf that are verified before its stopping distance is known.
FIRST = 64


def chi_square_quantile(p: float, degrees: int = DIMENSIONS) -> float:
    """Quantile of the chi-square distribution with an even number of degrees."""
    def below(x: float) -> float:
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(degrees // 2))

    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < p else (low, middle)
    return high


class Projection:
    """Directions for padded vectors and their lifting coordinate."""

    def __init__(self, width: int, norm: float):
        self.width, self.norm = width, norm
        self.directions = np.random.default_rng(SEED).standard_normal((width + 1, DIMENSIONS))

    def padded(self, vectors) -> np.ndarray:
        out = np.zeros((len(vectors), self.width))
        for i, v in enumerate(vectors):
            out[i, : len(v)] = v
        return out

    def points(self, x: np.ndarray) -> np.ndarray:
        lift = np.sqrt(np.maximum(self.norm**2 - (x * x).sum(axis=1), 0.0))
        return x @ self.directions[:-1] + lift[:, None] * self.directions[-1]

    def queries(self, x: np.ndarray) -> np.ndarray:
        return x @ self.directions[:-1]

    def squared(self, x: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """Squared lifted distances that belong to inner products."""
        return np.maximum((x * x).sum(axis=1) + self.norm**2 - 2 * scores, 0.0)


class Tree:
    """kd-tree on the widest dimension; leaves are numbered from 0."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.splits: list[tuple] = []
        self.leaves = 0
        self._grow(sample, max(leaves, 1))

    def _grow(self, sample: np.ndarray, leaves: int) -> int:
        at = len(self.splits)
        self.splits.append(())
        dimension = int(np.argmax(np.ptp(sample, axis=0))) if len(sample) else 0
        cut = float(np.median(sample[:, dimension])) if len(sample) else 0.0
        low = sample[:, dimension] < cut if len(sample) else np.zeros(0, bool)
        if leaves < 2 or not low.any():
            self.splits[at] = (-1, 0.0, self.leaves, 0)
            self.leaves += 1
            return at
        left = self._grow(sample[low], leaves // 2)
        right = self._grow(sample[~low], leaves - leaves // 2)
        self.splits[at] = (dimension, cut, left, right)
        return at

    def leaf(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        waiting = [(0, np.arange(len(x)))]
        while waiting:
            node, rows = waiting.pop()
            dimension, cut, left, right = self.splits[node]
            if dimension < 0:
                out[rows] = left
            elif len(rows):
                low = x[rows, dimension] < cut
                waiting += [(left, rows[low]), (right, rows[~low])]
        return out


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, vec) of the vectors that take part, one row per id."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vec")).filter("vec_id IS NOT NULL AND vec IS NOT NULL")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.filter(finite & F.exists("vec", lambda x: x != 0))
    first = Window.partitionBy("vec_id").orderBy("vec")
    return rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """(point, ids, vec): each different vector, named by its smallest id, with that many of its smallest ids."""
    ranks = Window.partitionBy("hash", "vec").orderBy("vec_id")
    few = rows.withColumn("hash", F.xxhash64("vec")).withColumn("_n", F.row_number().over(ranks)).filter(F.col("_n") <= keep)
    # A list of at most ``keep`` ids.
    return few.groupBy("hash", "vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("point"), "ids", "vec")


def order_of_leaves(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of projections to boxes."""
    out = np.zeros((len(x), len(low)))
    for d in range(x.shape[1]):
        gap = np.maximum(low[:, d][None, :] - x[:, d][:, None], 0.0) + np.maximum(x[:, d][:, None] - high[:, d][None, :], 0.0)
        out += gap * gap
    return out


def search_unit(q: np.ndarray, qp: np.ndarray, reach: np.ndarray, p: np.ndarray, pp: np.ndarray, ids: list, keep: int, projection: Projection, quantile: float) -> list[list[tuple[float, int]]]:
    """For each query the best (-score, id) among the points, verified in projected order until the stopping test holds.

    reach: squared k-th distance known so far.
    """
    apart = ((qp[:, None, :] - pp[None, :, :]) ** 2).sum(axis=2) if len(pp) * len(qp) <= 1 << 18 else np.maximum((qp**2).sum(1)[:, None] + (pp**2).sum(1)[None, :] - 2 * qp @ pp.T, 0.0)
    found = []
    first = np.argpartition(apart, FIRST, axis=1)[:, :FIRST] if len(p) > FIRST else np.tile(np.arange(len(p)), (len(q), 1))
    for i in range(len(q)):
        scores = p[first[i]] @ q[i]
        bound = reach[i]
        if len(scores) >= keep:
            bound = min(bound, projection.squared(q[i : i + 1], np.partition(scores, -keep)[-keep][None])[0])
        chosen = np.flatnonzero(apart[i] < quantile * bound)
        if len(p) > FIRST:
            chosen = np.union1d(chosen, first[i])
        else:
            chosen = first[i]
        scores = p[chosen] @ q[i]
        best = chosen[np.argsort(-scores, kind="stable")[: 2 * keep]] if len(scores) > 2 * keep else chosen
        pairs = sorted((-float(s), int(v)) for j, s in zip(best, p[best] @ q[i]) for v in ids[j])
        found.append(pairs[:keep])
    return found


def nearest(vectors: DataFrame, step: int = QUERY_STEP, k: int = NEAREST, certainty: float = CERTAINTY) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest of every vector whose id is divisible by ``step``."""
    spark = vectors.sparkSession
    keep = k + 1
    rows = cut_lineage(valid(vectors))
    points = cut_lineage(distinct_vectors(rows, keep))
    facts = points.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("width"), F.max(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))).alias("norm")).first()
    if not facts["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    projection = Projection(facts["width"], facts["norm"])
    # At most SAMPLE vectors, of width dimensions.
    sample = points.select("vec").orderBy(F.xxhash64("vec")).limit(SAMPLE).toPandas()
    leaves = min(MOST_LEAVES, -(-facts["n"] // LEAF_ROWS), max(len(sample) // 8, 1))
    tree = Tree(projection.points(projection.padded(sample["vec"])), leaves)
    shared = spark.sparkContext.broadcast((projection, tree))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        projection, tree = shared.value
        for batch in batches:
            at = projection.points(projection.padded(batch["vec"]))
            batch["leaf"] = tree.leaf(at).astype(np.int32)
            batch["at"] = list(at)
            yield batch

    dealt = cut_lineage(points.mapInPandas(deal, "point long, ids array<long>, vec array<double>, leaf int, at array<double>"))
    ends = [f(F.col("at")[d]).alias(f"{name}{d}") for d in range(DIMENSIONS) for name, f in (("low", F.min), ("high", F.max))]
    # One row per leaf.
    boxes = dealt.groupBy("leaf").agg(F.count("*").alias("n"), *ends).orderBy("leaf").toPandas()
    low, high = (boxes[[f"{name}{d}" for d in range(DIMENSIONS)]].to_numpy() for name in ("low", "high"))
    chunks = {int(leaf): -(-int(n) // CHUNK_ROWS) for leaf, n in zip(boxes["leaf"], boxes["n"])}
    places = spark.sparkContext.broadcast((projection, boxes["leaf"].to_numpy(), low, high, chi_square_quantile(certainty)))

    # Equal query vectors are searched for once.
    asked = rows.filter(F.col("vec_id") % step == 0).withColumn("hash", F.xxhash64("vec"))
    asked = cut_lineage(asked.groupBy("hash", "vec").agg(F.min("vec_id").alias("query")).select("query", "vec"))
    state = asked.select("query", "vec", F.lit(None).cast("double").alias("reach"), F.expr("cast(array() as array<struct<far: double, vec_id: long>>)").alias("best"))
    done, size = 0, 1
    while done < len(boxes):
        state = cut_lineage(visit(state, dealt, places, chunks, done, done + size, keep))
        done, size = done + size, 3 * (done + size)
    ids = cut_lineage(rows.filter(F.col("vec_id") % step == 0).join(asked.withColumnRenamed("query", "point"), "vec").select(F.col("vec_id").alias("query_id"), "point"))
    best = state.select(F.col("query").alias("point"), "best")
    own = ids.join(best, "point").select("query_id", F.expr(f"slice(filter(best, b -> b.vec_id <> query_id), 1, {k})").alias("best"))
    each = own.select("query_id", F.posexplode("best").alias("place", "b"))
    return each.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.far")).alias("score"))


def visit(state: DataFrame, dealt: DataFrame, places, chunks: dict[int, int], begin: int, end: int, keep: int) -> DataFrame:
    """One round: every query that isn't done visits its leaves number begin to end, nearest first."""
    spark = state.sparkSession

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        projection, leaves, low, high, quantile = places.value
        for batch in batches:
            apart = order_of_leaves(projection.queries(projection.padded(batch["vec"])), low, high)
            order = np.argsort(apart, axis=1, kind="stable")[:, begin:end]
            reach = batch["reach"].astype(float).fillna(np.inf).to_numpy()
            out = []
            for i, (query, vec) in enumerate(zip(batch["query"], batch["vec"])):
                # The stopping test against each next leaf.
                near = order[i][apart[i][order[i]] < quantile * reach[i]]
                out += [(int(leaves[j]), query, vec, reach[i]) for j in near]
            yield pd.DataFrame(out, columns=["leaf", "query", "vec", "reach"])

    visits = cut_lineage(state.select("query", "vec", "reach").mapInPandas(choose, "leaf int, query long, vec array<double>, reach double"))
    # One row per leaf.
    blocks = {r["leaf"]: -(-r["n"] // BLOCK_QUERIES) for r in visits.groupBy("leaf").agg(F.count("*").alias("n")).collect()}

    def sizes() -> DataFrame:
        return F.broadcast(spark.createDataFrame([(leaf, chunks[leaf], n) for leaf, n in blocks.items()], "leaf int, chunks int, blocks int"))

    left = visits.join(sizes(), "leaf").withColumn("block", F.pmod(F.xxhash64("query"), "blocks").cast("int")).withColumn("chunk", F.explode(F.expr("sequence(0, chunks - 1)"))).drop("chunks", "blocks")
    right = dealt.join(sizes(), "leaf").withColumn("chunk", F.pmod(F.xxhash64("point"), "chunks").cast("int")).withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)"))).drop("chunks", "blocks")

    def search(queries: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or points.empty:
            return pd.DataFrame({"query": [], "best": []})
        projection, _, _, _, quantile = places.value
        q, p = projection.padded(queries["vec"]), projection.padded(points["vec"])
        found = search_unit(q, projection.queries(q), queries["reach"].to_numpy(), p, np.stack(points["at"]), list(points["ids"]), keep, projection, quantile)
        return pd.DataFrame({"query": queries["query"], "best": [[{"far": s, "vec_id": v} for s, v in f] for f in found]})

    keys = ["leaf", "chunk", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, "query long, best array<struct<far: double, vec_id: long>>")
    found = cut_lineage(found.groupBy("query").agg(F.flatten(F.collect_list("best")).alias("more")))
    merged = state.join(found, "query", "left").withColumn("best", F.slice(F.array_sort(F.concat("best", F.coalesce("more", F.expr("slice(best, 1, 0)")))), 1, keep))
    return merged.mapInPandas(reaching(places, keep), "query long, vec array<double>, reach double, best array<struct<far: double, vec_id: long>>")


def reaching(places, keep: int):
    """Sets reach to the squared k-th distance found so far."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        projection = places.value[0]
        for batch in batches:
            scores = np.array([-b[-1]["far"] if len(b) >= keep else -np.inf for b in batch["best"]])
            x = projection.padded(batch["vec"])
            batch["reach"] = np.where(np.isinf(scores), np.inf, projection.squared(x, np.where(np.isinf(scores), 0.0, scores)))
            yield batch[["query", "vec", "reach", "best"]]

    return scan


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
