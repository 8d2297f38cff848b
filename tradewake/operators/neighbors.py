"""Exact neighbours and density components by a tree of bounding boxes.

Points are turned onto their principal axes, which keeps distances, and split along their widest axis until a leaf holds few distinct
points, however dense the region. Searches work on leaves, not on points: a leaf meets the leaves whose boxes are near, nearest first, in rounds; after
each round its points know their neighbours better, so the reach within which further leaves are met shrinks. Leaf points travel as one array per leaf and no table
of point pairs is built.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewake.session import cut_lineage

# Fixed value: the neighbour looked at, the point itself counting as the first.
NEIGHBOUR = 13
LEAF_POINTS = 24
FAN_OUT = 8
# Leaves met in the first round and at most in a later one.
FIRST_ROUND, LARGEST_ROUND = 8, 32
# Points compared with a leaf at once.
SEARCHERS = 256


def search_leaf(d: int) -> int:
    """Points of a leaf for searches by k-th distance: with more axes a leaf must hold more, or its points reach over many leaves."""
    return min(LEAF_POINTS * 3 ** max(d - 3, 0), 2048)


def _total(parts: list[Column]) -> Column:
    return reduce(Column.__add__, parts)


def principal_axes(points: DataFrame, axes: Sequence[str]) -> np.ndarray:
    """Orthonormal columns by falling variance."""
    d = len(axes)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    found = points.agg(*[F.covar_pop(axes[i], axes[j]).alias(f"{i}_{j}") for i, j in pairs]).first()
    matrix = np.zeros((d, d))
    for (i, j), value in zip(pairs, found):
        matrix[i, j] = matrix[j, i] = value or 0.0
    return np.linalg.eigh(matrix)[1][:, ::-1]


def _split_level(points: DataFrame, d: int, most: int = LEAF_POINTS) -> DataFrame:
    """Axis and cut values of every node that is still too large."""
    quantiles = [i / FAN_OUT for i in range(1, FAN_OUT)]
    at = [F.col("_x")[i] for i in range(d)]
    stats = points.groupBy("_node").agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.min(a) for a in at]).alias("lo"), F.array(*[F.max(a) for a in at]).alias("hi"),
        F.array(*[F.percentile_approx(a, quantiles, 1000) for a in at]).alias("q"),
    ).where(F.col("n") > most)
    spans = [F.struct((F.col("hi")[i] - F.col("lo")[i]).alias("span"), F.lit(i).alias("axis")) for i in range(d)]
    chosen = stats.withColumn("axis", (F.greatest(*spans) if d > 1 else spans[0])["axis"])
    chosen = chosen.select("_node", "axis", F.get("lo", F.col("axis")).alias("low"), F.get("hi", F.col("axis")).alias("high"), F.get("q", F.col("axis")).alias("q"))
    above = F.filter(F.array_distinct("q"), lambda q: q > F.col("low"))
    # Many equal values can swallow all quantiles; the middle still divides the node.
    usable = F.when(F.size(above) > 0, above).otherwise(F.array((F.col("low") + F.col("high")) / 2))
    return chosen.where(F.col("high") > F.col("low")).select("_node", F.col("axis").alias("_axis"), usable.alias("_cuts"))


def _descend(points: DataFrame, cuts: DataFrame) -> DataFrame:
    child = F.coalesce(F.size(F.filter("_cuts", lambda c: c <= F.get("_x", F.col("_axis")))), F.lit(0))
    child = F.when(F.col("_axis").isNull(), 0).otherwise(child)
    return points.join(cuts, "_node", "left").withColumn("_node", F.col("_node") * FAN_OUT + child).drop("_axis", "_cuts")


def _near(a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column) -> Column:
    """Squared distance of two boxes."""
    gaps = F.zip_with(F.zip_with(a_lo, b_hi, lambda p, q: p - q), F.zip_with(b_lo, a_hi, lambda p, q: p - q), lambda p, q: F.greatest(p, q, F.lit(0.0)))
    return F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g)


def _far(a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column) -> Column:
    """Squared largest distance between two boxes."""
    spans = F.zip_with(F.zip_with(a_hi, b_lo, lambda p, q: p - q), F.zip_with(b_hi, a_lo, lambda p, q: p - q), lambda p, q: F.greatest(p, q))
    return F.aggregate(spans, F.lit(0.0), lambda s, g: s + g * g)


class Tree:
    """Distinct points in leaves of at most ``leaf_points``, with the boxes of every level.

    Equal points are kept once with their number, so copies can't fill a leaf. All leaves are at the same depth.
    """

    def __init__(self, points: DataFrame, key: str, axes: Sequence[str], leaf_points: int = LEAF_POINTS):
        self.key, self.axes = key, tuple(axes)
        self.plain = points.select(key, *[F.col(a).cast("double").alias(a) for a in axes]).dropna(subset=list(axes))
        self.turn = principal_axes(self.plain, axes)
        distinct = self.plain.groupBy(*axes).agg(F.count(F.lit(1)).alias("_w"), F.min(key).alias("_pid"))
        self.placed = cut_lineage(distinct.select("_pid", *axes, self.turned().alias("_x"), "_w", F.lit(0).cast("long").alias("_node")))
        self.cuts: list[DataFrame] = []
        # 20 levels fill the bits of a node's number; leaves that are still large by then stay so.
        while len(self.cuts) < 20:
            cuts = cut_lineage(_split_level(self.placed, len(self.axes), leaf_points))
            if cuts.isEmpty():
                break
            self.cuts.append(cuts)
            self.placed = _descend(self.placed, cuts)
        self.placed = cut_lineage(self.placed.withColumnRenamed("_node", "_leaf"))
        at = [F.col("_x")[i] for i in range(len(self.axes))]
        self.leaves = cut_lineage(self.placed.groupBy(F.col("_leaf").alias("leaf")).agg(
            F.array(*[F.min(a) for a in at]).alias("lo"), F.array(*[F.max(a) for a in at]).alias("hi"), F.sum("_w").alias("weight"),
            F.array_sort(F.collect_list(F.struct(F.col("_pid").alias("pid"), F.col("_w").alias("w"), F.col("_x").alias("x")))).alias("points"),
        ))
        self.visits = 0

    @property
    def levels(self) -> int:
        return len(self.cuts)

    def turned(self) -> Column:
        """A point on the principal axes."""
        return F.array(*[_total([F.col(a) * F.lit(float(v)) for a, v in zip(self.axes, column)]) for column in self.turn.T])

    def boxes(self, level: int) -> DataFrame:
        node = F.floor(F.col("leaf") / FAN_OUT ** (self.levels - level)).cast("long")
        d = range(len(self.axes))
        found = self.leaves.groupBy(node.alias("node")).agg(*[F.min(F.col("lo")[i]).alias(f"lo_{i}") for i in d], *[F.max(F.col("hi")[i]).alias(f"hi_{i}") for i in d])
        return found.select("node", F.array(*[f"lo_{i}" for i in d]).alias("lo"), F.array(*[f"hi_{i}" for i in d]).alias("hi"), F.floor(F.col("node") / FAN_OUT).cast("long").alias("parent"))

    def partners(self, searchers: DataFrame) -> DataFrame:
        """(leaf, partner, near) for searchers (leaf, lo, hi, reach): all leaves within the reach, squared, of the searcher's box; null reaches all."""
        walk = searchers.select("leaf", "lo", "hi", "reach", F.lit(0).cast("long").alias("at"))
        for level in range(1, self.levels + 1):
            box = self.boxes(level).select(F.col("parent").alias("at"), F.col("node").alias("next"), F.col("lo").alias("box_lo"), F.col("hi").alias("box_hi"))
            walk = walk.join(box, "at").withColumn("near", _near(F.col("lo"), F.col("hi"), F.col("box_lo"), F.col("box_hi")))
            walk = walk.where(F.col("reach").isNull() | (F.col("near") <= F.col("reach"))).select("leaf", "lo", "hi", "reach", F.col("next").alias("at"), "near")
        if not self.levels:
            walk = walk.withColumn("near", F.lit(0.0))
        return walk.select("leaf", F.col("at").alias("partner"), "near")

    def search(self, state: DataFrame, meet: Callable, schema: str) -> DataFrame:
        """Runs rounds of searchers against leaves, nearest first, until no leaf within reach is left.

        state has id, leaf (for ties only), lo, hi, reach and whatever ``meet`` works on; ``meet`` takes a pandas frame of state rows with ``partners``,
        the point lists of the leaves met, and returns the state with shorter reaches.
        """
        pairs = cut_lineage(self.partners(state.select(F.col("id").alias("leaf"), "lo", "hi", "reach")).withColumn(
            "rank", F.row_number().over(Window.partitionBy("leaf").orderBy("near", "partner"))))
        done, size = 0, FIRST_ROUND
        while True:
            reaches = state.select(F.col("id").alias("leaf"), "reach")
            open_ = pairs.where((F.col("rank") > done) & (F.col("rank") <= done + size)).join(reaches, "leaf").where(F.col("reach").isNull() | (F.col("near") <= F.col("reach")))
            met = cut_lineage(open_.select("leaf", "partner"))
            count = met.count()
            if not count and not pairs.where(F.col("rank") > done + size).join(reaches, "leaf").where(F.col("reach").isNull() | (F.col("near") <= F.col("reach"))).limit(1).count():
                return state
            self.visits += count
            points = self.leaves.select(F.col("leaf").alias("partner"), "points")
            gathered = met.join(points, "partner").groupBy(F.col("leaf").alias("id")).agg(F.flatten(F.collect_list("points")).alias("partners"))
            state = cut_lineage(state.join(gathered, "id", "left").mapInPandas(_each(meet), schema))
            done, size = done + size, min(4 * size, LARGEST_ROUND)


def _each(meet: Callable) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield meet(batch)

    return run


def _coordinates(points, d: int) -> np.ndarray:
    return np.array([p["x"] for p in points], dtype=float).reshape(-1, d)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all rows of b, by differences, so that equal points are at distance zero."""
    away = a[:, None, :] - b[None, :, :]
    return np.einsum("ijk,ijk->ij", away, away)


def squared_by_axis(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all rows of b, added up axis by axis as those of boxes are."""
    total = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        away = a[:, i, None] - b[None, :, i]
        total += away * away
    return total


def _least(distances: np.ndarray, k: int) -> np.ndarray:
    """The k smallest of each row in any order, filled up with infinity."""
    if distances.shape[1] < k:
        return np.pad(distances, ((0, 0), (0, k - distances.shape[1])), constant_values=np.inf)
    return np.partition(distances, k - 1, axis=1)[:, :k]


def _nearest_k(a: np.ndarray, b: np.ndarray, times: np.ndarray, k: int) -> np.ndarray:
    """Squared distances from each row of a to its k nearest of b, whose rows count several times each."""
    repeats = np.minimum(times, k)
    found = [np.empty((0, k))]
    for at in range(0, len(a), SEARCHERS):
        distances = squared_by_axis(a[at : at + SEARCHERS], b)
        found.append(_least(distances if (repeats == 1).all() else np.repeat(distances, repeats, axis=1), k))
    return np.concatenate(found)


def _floats(packed: bytes, width: int) -> np.ndarray:
    return np.frombuffer(packed, dtype=float).reshape(-1, width)


def _enough(tree: Tree, k: int) -> DataFrame:
    """(leaf, first): squared distance within which every point of a leaf has k points; null if there are fewer.

    It is the largest distance within the smallest node around the leaf that holds k points.
    """
    found, first = tree.leaves.select("leaf", "lo", "hi"), None
    for level in range(tree.levels, -1, -1):
        node = F.floor(F.col("leaf") / FAN_OUT ** (tree.levels - level)).cast("long")
        held = tree.leaves.groupBy(node.alias("node")).agg(F.sum("weight").alias("held")).where(F.col("held") >= k)
        box = tree.boxes(level).join(held, "node").select("node", F.col("lo").alias("box_lo"), F.col("hi").alias("box_hi"))
        far = _far(F.col("lo"), F.col("hi"), F.col("box_lo"), F.col("box_hi"))
        found = found.withColumn("node", node).join(box, "node", "left").withColumn(f"far_{level}", far).drop("node", "box_lo", "box_hi")
        first = F.col(f"far_{level}") if first is None else F.coalesce(first, F.col(f"far_{level}"))
    return found.select("leaf", first.alias("first"))


def kth_distance(points: DataFrame, key: str, axes: Sequence[str], k: int = NEIGHBOUR, tree: Tree | None = None) -> DataFrame:
    """Distance from each point to its k-th nearest, itself included; null with fewer than k points.

    The points of a leaf first meet each other, then those of the nearest leaves, then those of all leaves left within reach. A leaf gets only
    the points of another whose own reach touches its box.
    """
    tree = tree or Tree(points, key, axes, search_leaf(len(axes)))
    d = len(axes)
    # A row holds the points of a leaf.
    points.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    schema = "leaf long, lo array<double>, hi array<double>, reach double, w binary, x binary, bound binary, best binary"

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for leaf, lo, hi, first, w, x in batch[["leaf", "lo", "hi", "first", "w", "x"]].itertuples(index=False):
                w, x = np.asarray(w, dtype="<i8"), np.asarray(x, dtype=float).reshape(-1, d)
                best = _nearest_k(x, x, w, k)
                bound = np.minimum(best.max(axis=1), np.inf if first is None or np.isnan(first) else first)
                rows.append((leaf, lo, hi, float(bound.max()), w.tobytes(), x.tobytes(), bound.tobytes(), best.tobytes()))
            yield pd.DataFrame(rows, columns=["leaf", "lo", "hi", "reach", "w", "x", "bound", "best"])

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for leaf, x, bound, partners, boxes in batch[["leaf", "x", "bound", "partners", "boxes"]].itertuples(index=False):
                x, bound, rows = _floats(x, d), np.frombuffer(bound), []
                for partner, box in zip(partners, np.asarray(boxes, dtype=float).reshape(-1, 2, d)):
                    near = np.zeros(len(x))
                    for i in range(d):
                        gap = np.maximum(np.maximum(box[0, i] - x[:, i], x[:, i] - box[1, i]), 0.0)
                        near += gap * gap
                    at = np.flatnonzero(near <= bound)
                    if len(at):
                        rows.append((leaf, partner, at.astype("<i8").tobytes(), x[at].tobytes()))
                yield pd.DataFrame(rows, columns=["leaf", "partner", "at", "x"])

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            best = [_nearest_k(_floats(x, d), _floats(other, d), np.frombuffer(w, dtype="<i8"), k).tobytes() for x, other, w in zip(batch["x"], batch["other_x"], batch["other_w"])]
            yield batch[["leaf", "at"]].assign(best=best)

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bests, bounds, reaches = [], [], []
            for bound, best, ats, founds in zip(batch["bound"], batch["best"], batch["ats"], batch["founds"]):
                best = _floats(best, k).copy()
                for at, found in zip(*((ats, founds) if ats is not None else ((), ()))):
                    at = np.frombuffer(at, dtype="<i8")
                    best[at] = _least(np.concatenate([best[at], _floats(found, k)], axis=1), k)
                bound = np.minimum(np.frombuffer(bound), best.max(axis=1))
                bests.append(best.tobytes())
                bounds.append(bound.tobytes())
                reaches.append(float(bound.max()))
            yield batch.assign(best=bests, bound=bounds, reach=reaches).drop(columns=["ats", "founds"])

    def visit(state: DataFrame, pairs: DataFrame) -> DataFrame:
        boxes = tree.leaves.select(F.col("leaf").alias("partner"), F.concat("lo", "hi").alias("box"))
        asked = pairs.join(boxes, "partner").groupBy("leaf").agg(F.collect_list(F.struct("partner", "box")).alias("met"))
        asked = asked.select("leaf", F.col("met.partner").alias("partners"), F.flatten("met.box").alias("boxes"))
        routed = cut_lineage(state.select("leaf", "x", "bound").join(asked, "leaf").mapInPandas(route, "leaf long, partner long, at binary, x binary"))
        tree.visits += routed.count()
        others = state.select(F.col("leaf").alias("partner"), F.col("x").alias("other_x"), F.col("w").alias("other_w"))
        found = routed.join(others, "partner").mapInPandas(measure, "leaf long, at binary, best binary")
        found = found.groupBy("leaf").agg(F.collect_list(F.struct("at", "best")).alias("found"))
        return cut_lineage(state.join(found, "leaf", "left").select(*state.columns, F.col("found.at").alias("ats"), F.col("found.best").alias("founds")).mapInPandas(merge, schema))

    def within(state: DataFrame) -> DataFrame:
        reach = F.when(F.col("reach") < float("inf"), F.col("reach"))
        return tree.partners(state.select("leaf", "lo", "hi", reach.alias("reach"))).where("leaf <> partner")

    content = tree.leaves.select("leaf", "lo", "hi", F.col("points.w").alias("w"), F.flatten("points.x").alias("x"))
    state = cut_lineage(content.join(_enough(tree, k), "leaf").mapInPandas(own, schema))
    nearest_first = Window.partitionBy("leaf").orderBy("near", "partner")
    close = cut_lineage(within(state).withColumn("rank", F.row_number().over(nearest_first)).where(F.col("rank") <= FIRST_ROUND).select("leaf", "partner"))
    state = visit(state, close)
    state = visit(state, within(state).select("leaf", "partner").join(close, ["leaf", "partner"], "left_anti"))

    def last(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kth = [[None if v == np.inf else v for v in np.sqrt(_floats(best, k).max(axis=1)).tolist()] for best in batch["best"]]
            yield batch[["leaf"]].assign(kth=kth)

    kth = state.select("leaf", "best").mapInPandas(last, "leaf long, kth array<double>")
    pids = tree.leaves.select("leaf", F.col("points.pid").alias("pid"))
    each = pids.join(kth, "leaf").select(F.explode(F.arrays_zip("pid", "kth")).alias("e")).select(F.col("e.pid").alias("_pid"), F.col("e.kth").alias("_distance"))
    per_value = tree.placed.select("_pid", *axes).join(each, "_pid", "left").drop("_pid")
    return tree.plain.join(per_value, list(axes), "left").select(key, F.col("_distance").alias("distance"))


def nearest(tree: Tree, points: DataFrame, key: str, reach: float) -> DataFrame:
    """(key, pid, distance): the tree's nearest point within the reach, for points with the tree's axes; ties go to the smaller pid."""
    d = len(tree.axes)
    rows = points.select(key, *[F.col(a).cast("double").alias(a) for a in tree.axes]).dropna(subset=list(tree.axes))
    rows = rows.select(F.col(key).alias("_key"), tree.turned().alias("_x"), F.lit(0).cast("long").alias("_node"))
    for cuts in tree.cuts:
        rows = _descend(rows, cuts)
    pid = tree.placed.schema["_pid"].dataType.simpleString()
    limit = float(reach) ** 2

    # Every point is a searcher of its own; the leaf it falls into is met first and shortens its reach.
    state = rows.join(tree.leaves.select(F.col("leaf").alias("_node"), "points"), "_node", "left")

    def meet(batch: pd.DataFrame) -> pd.DataFrame:
        best, reaches = [], []
        for x, found, within, partners in zip(batch["x"], batch["best"], batch["reach"], batch["partners"]):
            if partners is not None and len(partners):
                distances = squared(np.array([x], dtype=float), _coordinates(partners, d))[0]
                least = distances.min()
                if least <= within:
                    other = min(p["pid"] for p, v in zip(partners, distances) if v == least)
                    if found is None or least < within or other < found:
                        found, within = other, float(least)
            best.append(found)
            reaches.append(within)
        return batch.assign(best=pd.array(best, dtype="Int64") if pid == "bigint" else best, reach=reaches).drop(columns="partners")

    fields = "id {0}, x array<double>, lo array<double>, hi array<double>, reach double, best {1}".format(rows.schema["_key"].dataType.simpleString(), pid)
    start = state.select(F.col("_key").alias("id"), F.col("_x").alias("x"), F.col("_x").alias("lo"), F.col("_x").alias("hi"), F.lit(limit).alias("reach"), F.lit(None).cast(pid).alias("best"), F.col("points").alias("partners"))
    state = tree.search(cut_lineage(start.mapInPandas(_each(meet), fields)), meet, fields)
    return state.where(F.col("best").isNotNull()).select(F.col("id").alias(key), F.col("best").alias("pid"), F.sqrt("reach").alias("distance"))


def reached_components(tree: Tree, reach: float) -> tuple[DataFrame, DataFrame]:
    """Vertices of the tree's points, (pid, cell), and the edges (a, b) between vertices whose points lie within the reach of each other.

    Pairs of nodes are followed from the root. Where all of two nodes is within reach, each becomes one vertex and the pair is done, so a dense
    region costs as much as the nodes that cover it, not as its points. Undecided pairs end at leaves, whose points are compared; the points of a leaf
    that hang together are one vertex.
    """
    d, limit = len(tree.axes), float(reach) ** 2
    name = lambda level, node: F.concat(F.lit(f"n{level:02d}:"), node.cast("string"))
    root = tree.boxes(0)
    pairs = root.select(F.col("node").alias("a"), F.col("node").alias("b"), F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi"), F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"))
    whole, edges = [], []
    for level in range(tree.levels + 1):
        if level:
            box = tree.boxes(level)
            sides = [box.select(F.col("parent").alias(s), F.col("node").alias(f"{s}_next"), F.col("lo").alias(f"{s}_lo"), F.col("hi").alias(f"{s}_hi")) for s in "ab"]
            pairs = pairs.select("a", "b").join(sides[0], "a").join(sides[1], "b").where("a_next <= b_next")
            pairs = pairs.select(F.col("a_next").alias("a"), F.col("b_next").alias("b"), "a_lo", "a_hi", "b_lo", "b_hi")
        sides = [F.col(c) for c in ("a_lo", "a_hi", "b_lo", "b_hi")]
        judged = cut_lineage(pairs.where(_near(*sides) <= limit).withColumn("all", _far(*sides) <= limit))
        decided = judged.where("all")
        whole.append(decided.select(F.lit(level).alias("level"), F.explode(F.array("a", "b")).alias("node")).distinct())
        edges.append(decided.where("a <> b").select(name(level, F.col("a")).alias("a"), name(level, F.col("b")).alias("b")))
        pairs = judged.where(~F.col("all"))
    whole = cut_lineage(reduce(DataFrame.unionByName, whole))
    # A whole node below another one is part of it; leaves below one or more hang on the uppermost.
    above = None
    named = tree.leaves.select("leaf")
    for level in range(tree.levels + 1):
        marks = whole.where(F.col("level") == level).select(F.col("node").alias(f"node_{level}"), name(level, F.col("node")).alias(f"at_{level}"))
        up = F.floor(F.col("leaf") / FAN_OUT ** (tree.levels - level)).cast("long")
        named = named.withColumn(f"node_{level}", up).join(marks, f"node_{level}", "left")
        above = F.col(f"at_{level}") if above is None else F.coalesce(above, F.col(f"at_{level}"))
    named = cut_lineage(named.select("leaf", above.alias("top"), F.array_compact(F.array(*[f"at_{i}" for i in range(tree.levels + 1)])).alias("tops")))
    edges.append(named.where(F.size("tops") > 1).select(F.explode(F.slice("tops", 2, tree.levels + 1)).alias("a"), F.col("top").alias("b")).distinct())

    def parts(x: np.ndarray, ids: list, top: str | None) -> list[str]:
        """Vertex of each point of a leaf."""
        if top is not None:
            return [top] * len(ids)
        close, found = squared(x, x) <= limit, [-1] * len(ids)
        for first in range(len(ids)):
            waiting = [first] if found[first] < 0 else []
            while waiting:
                i = waiting.pop()
                if found[i] < 0:
                    found[i] = first
                    waiting += [j for j in np.flatnonzero(close[i]).tolist() if found[j] < 0]
        return [f"p{ids[i]}" for i in found]

    def vertices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for points, top in zip(batch["points"], batch["top"]):
                ids = [p["pid"] for p in points]
                rows += zip(ids, parts(_coordinates(points, d), ids, top))
            yield pd.DataFrame(rows, columns=["pid", "cell"])

    def touching(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = set()
            for one, top, other, other_top in zip(batch["points"], batch["top"], batch["others"], batch["other_top"]):
                x, y = _coordinates(one, d), _coordinates(other, d)
                a, b = parts(x, [p["pid"] for p in one], top), parts(y, [p["pid"] for p in other], other_top)
                rows |= {(a[i], b[j]) for i, j in np.argwhere(squared(x, y) <= limit).tolist()}
            yield pd.DataFrame(sorted(rows), columns=["a", "b"])

    contents = cut_lineage(tree.leaves.select("leaf", "points").join(named.select("leaf", "top"), "leaf"))
    others = contents.select(F.col("leaf").alias("b"), F.col("points").alias("others"), F.col("top").alias("other_top"))
    left = pairs.where("a <> b").select("a", "b").join(contents.withColumnRenamed("leaf", "a"), "a").join(others, "b")
    edges.append(left.select("points", "top", "others", "other_top").mapInPandas(touching, "a string, b string"))
    pid = tree.placed.schema["_pid"].dataType.simpleString()
    members = contents.select("points", "top").mapInPandas(vertices, f"pid {pid}, cell string")
    return members, reduce(DataFrame.unionByName, edges).where("a <> b").distinct()
