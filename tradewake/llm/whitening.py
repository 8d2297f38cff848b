"""Embedding whitening from a covariance weighted by how often a vector occurs.

Entries are put on a grid (x = floor(1024 c) + 100000), and equal x vectors are grouped. A distinct vector enters the fit with its count, or with one if copies shall
not count. The covariance is a weighted product of centred matrices, summed over blocks of rows: the centre is the whole number nearest to the
mean, so that products of usual embeddings are exact whatever the order of the sums, and the rest of the mean is taken off at the end. Its eigenvectors, a
matrix of dimensions squared, are found on the driver. Every distinct vector is whitened once and joined back to the rows by a digest of x, so only
digests are shuffled for the rows; a vector that a third of all rows share is one row of the fit, and its rows are split at run time.

Defined cases: vectors that are null, empty or hold a null or non-finite entry take no part; of vectors of unlike lengths, those of the commonest length do
(the longest, if equally common); fewer dimensions than components give as many components; a component without variance (below 1e-12 of the
trace) has null ``whitened``, and takes no part in ``identity_error``; without any variance ``explained`` and ``identity_error`` are null; a deviation beyond a
long is null; entries beyond 2^40 count as 2^40; equal rows, and rows with equal or null ids, give a result each; no rows, no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewake.llm.common import small_batches, table
from tradewake.session import cut_lineage

COMPONENTS = 8
# Fixed values of the grid.
SCALE, SHIFT = 1024, 100_000
LARGEST = float(2**40)
# Share of the trace below which a component counts as without variance.
NOTHING = 1e-12


def gridded(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """vec_id and x of the rows that take part."""
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = rows.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.filter(F.col("v").isNotNull() & (F.size("v") > 0) & finite)
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    rows = rows.filter(F.size("v") == (sizes[0]["d"] if sizes else 0))
    place = lambda c: F.floor(F.least(F.greatest(c, F.lit(-LARGEST)), F.lit(LARGEST)) * SCALE).cast("long") + SHIFT
    return rows.select("vec_id", F.transform("v", place).alias("x"))


def digest(x: Column) -> Column:
    return F.sha2(F.array_join(x.cast("array<string>"), ",").cast("binary"), 256)


def matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def summed(distinct: DataFrame, d: int) -> tuple[int, list[int]]:
    """Weights of all vectors together, and the weighted sum per dimension, exactly."""
    wide = F.col("weight").cast("decimal(38,0)")
    parts = distinct.select(F.posexplode("x").alias("i", "c"), wide.alias("weight")).groupBy("i").agg(F.sum("weight").alias("n"), F.sum(F.col("c").cast("decimal(20,0)") * F.col("weight").cast("decimal(18,0)")).alias("s"))
    # One row per dimension.
    rows = sorted(parts.collect())
    return (int(rows[0]["n"]), [int(r["s"]) for r in rows]) if rows else (0, [0] * d)


def scatter(distinct: DataFrame, centre: np.ndarray) -> np.ndarray:
    """Weighted sum of the outer products of the vectors less the centre."""
    d = len(centre)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            if batch.num_rows:
                away = matrix(batch, "x").astype(float) - centre
                total += (away * batch.column("weight").to_numpy()[:, None]).T @ away
        i, j = np.indices((d, d))
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], ["i", "j", "s"])

    sums = distinct.select("x", "weight").mapInArrow(multiply, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    found = np.zeros((d, d))
    # One row per pair of dimensions.
    for i, j, s in sums.collect():
        found[i, j] = s
    return found


class Whitening:
    """Mean, eigenvectors and eigenvalues of a fit."""

    def __init__(self, distinct: DataFrame, components: int):
        first = distinct.select(F.size("x").alias("d")).first()
        d = first["d"] if first else 0
        self.n, self.sums = summed(distinct, d)
        self.mean = np.array([s / self.n for s in self.sums]) if self.n else np.zeros(d)
        centre = np.rint(self.mean)
        rest = self.mean - centre
        covariance = scatter(distinct, centre) / max(self.n, 1) - np.outer(rest, rest)
        values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
        order = np.argsort(-values, kind="stable")[:components]
        self.values, vectors = values[order], vectors[:, order]
        # Signs are free; the largest entry of a component is made positive.
        signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))]) if d else np.ones(0)
        self.vectors = vectors * signs
        self.trace = float(np.trace(covariance))

    def apply(self, distinct: DataFrame) -> DataFrame:
        """key, weight, deviation and whitened (array, null where a component has no variance) per distinct vector."""
        n, sums, mean = self.n, self.sums, self.mean
        used = self.values > NOTHING * max(self.trace, 0.0)
        directions = self.vectors / np.sqrt(np.where(used, self.values, 1.0))

        def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            limit = np.array(sums, dtype=object)
            for batch in batches:
                x = matrix(batch, "x")
                away = (x.astype(float) - mean) * float(n)
                if len(x) and float(np.abs(away).max()) ** 2 * x.shape[1] < 2.0**62 and n * max(1, int(np.abs(x).max())) < 2**62:
                    steps = x * n - np.array(sums, dtype=np.int64)
                    deviations = (steps * steps).sum(axis=1).tolist()
                else:
                    # Whole numbers of any size.
                    deviations = [int(((row * n - limit) ** 2).sum()) for row in x.astype(object)]
                white = ((x.astype(float) - mean) @ directions).tolist()
                rows = [[value if use else None for value, use in zip(row, used)] for row in white]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key"), batch.column("weight"), pa.array([v if v < 2**63 else None for v in deviations], pa.int64()), pa.array(rows, pa.list_(pa.float64()))],
                    ["key", "weight", "deviation", "white"],
                )

        return distinct.select("key", "x", "weight").mapInArrow(whiten, "key string, weight long, deviation long, white array<double>")

    def identity_error(self, whitened: DataFrame) -> float | None:
        """Largest entry, as an absolute value, of the whitened covariance less the identity."""
        k = len([v for v in self.values if v > NOTHING * max(self.trace, 0.0)])
        if not k:
            return None
        w = F.col("weight").cast("double")
        means = whitened.agg(*[(F.sum(w * F.get("white", F.lit(i))) / self.n).alias(str(i)) for i in range(k)]).first()
        away = [F.get("white", F.lit(i)) - F.lit(means[i]) for i in range(k)]
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        found = whitened.agg(*[(F.sum(w * away[i] * away[j]) / self.n).alias(f"{i}_{j}") for i, j in pairs]).first()
        return max(abs(value - (i == j)) for value, (i, j) in zip(found, pairs))


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, count_copies: bool = True) -> DataFrame:
    """vec_id, n, deviation, whitened, explained (arrays by component) and identity_error of every row that takes part.

    With ``count_copies`` the fit is over all rows, otherwise over the distinct vectors.
    """
    small_batches(rows.sparkSession)
    placed = gridded(rows, key, vector).withColumn("key", digest(F.col("x")))
    weight = F.count("*") if count_copies else F.lit(1).cast("long")
    distinct = cut_lineage(placed.groupBy("key").agg(F.first("x").alias("x"), weight.alias("weight")))
    fit = Whitening(distinct, components)
    # Written out, so that the join with the rows can split a vector that very many rows share.
    whitened = cut_lineage(fit.apply(distinct))
    error = fit.identity_error(whitened)
    explained = F.array(*[F.lit(float(v / fit.trace) if fit.trace > 0 else None).cast("double") for v in fit.values]).cast("array<double>")
    return placed.select("vec_id", "key").join(whitened, "key").select(
        "vec_id", F.lit(fit.n).cast("long").alias("n"), "deviation", F.col("white").alias("whitened"), explained.alias("explained"), F.lit(error).cast("double").alias("identity_error")
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whiten(table(spark, sf_dir, "embeddings"))
    each = found.select("vec_id", F.posexplode("whitened").alias("at", "whitened"), "n", "deviation", "explained", "identity_error")
    return each.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", F.get("explained", F.col("at")).alias("explained"), "identity_error")
