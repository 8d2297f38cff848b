"""Density segments of traders: DBSCAN without border points.

The radius is a quantile of the distances to the k-th nearest neighbour. A trader with k traders within the radius, itself included, is a core
point; core points within the radius of each other belong together; groups with too few traders, and all other traders, are noise
(Campello et al., 2013, call this DBSCAN*). Everything is exact, on standardised profiles. Labels differ from those of hierarchical
density clustering, which has no single radius.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradewake.operators import neighbors
from tradewake.operators.models import Scaler
from tradewake.session import cut_lineage

# Smallest segment, traders that make a core point, label of noise.
MIN_SEGMENT_TRADERS, MIN_SAMPLES, NOISE = 700, 5, -1
# Part of the traders that are core points.
RADIUS_QUANTILE = 0.75
# Digits that the radius is rounded to.
RADIUS_DIGITS = 4


def connected_groups(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Smallest node name reachable from each node.

    ``nodes`` has ``cell``; ``edges`` has ``a, b``, each pair once. Every round
    takes the smallest label among the neighbours and then follows labels one
    step further, so the number of rounds grows with the logarithm of a group's
    length. Each round is written out, which keeps the lineage short and lets a
    lost executor resume from files.
    """
    both = cut_lineage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = cut_lineage(nodes.select("cell", F.col("cell").alias("label")))
    # Labels only ever fall, so this ends.
    while True:
        offered = both.join(labels.withColumnRenamed("cell", "b"), "b").groupBy(F.col("a").alias("cell")).agg(F.min("label").alias("_offer"))
        nearer = labels.join(offered, "cell", "left").select("cell", "label", F.least("label", "_offer").alias("_new"))
        further = labels.select(F.col("cell").alias("_new"), F.col("label").alias("_next"))
        moved = cut_lineage(
            nearer.join(further, "_new", "left").select("cell", "label", F.least("_new", "_next").alias("_new"))
        )
        changed = not moved.where(F.col("_new") < F.col("label")).isEmpty()
        labels = moved.select("cell", F.col("_new").alias("label"))
        if not changed:
            return labels


@dataclass(frozen=True)
class SegmentModel:
    """Scaler, radius, the core points with their segment, and the segment of every trader the model was fitted on."""

    scaler: Scaler
    radius: float
    core: DataFrame
    members: DataFrame
    key: str = "address"

    @classmethod
    def fit(cls, profiles: DataFrame, columns: Sequence[str], min_samples: int = MIN_SAMPLES, min_traders: int = MIN_SEGMENT_TRADERS,
            radius: float | None = None, quantile: float = RADIUS_QUANTILE, key: str = "address") -> SegmentModel:
        scaler = Scaler.fit(profiles, columns)
        scaled = cut_lineage(scaler.transform(profiles.dropna(subset=list(columns)).select(key, *columns)))
        distances = cut_lineage(neighbors.kth_distance(scaled, key, columns, min_samples))
        if radius is None:
            radius = distances.agg(F.round(F.percentile("distance", quantile), RADIUS_DIGITS)).first()[0] or 0.0
        core = cut_lineage(scaled.join(distances.where(F.col("distance") <= radius).select(key), key, "left_semi"))
        tree = neighbors.Tree(core, key, columns)
        cells, edges = neighbors.reached_components(tree, radius)
        cells = cut_lineage(cells)
        labels = connected_groups(cells.select("cell").distinct().unionByName(edges.select(F.explode(F.array("a", "b")).alias("cell"))).distinct(), edges)
        named = cells.withColumnRenamed("pid", "_pid").join(labels, "cell").select("_pid", F.col("label").alias("_label"))
        points = cut_lineage(tree.placed.select("_pid", *columns, "_w").join(named, "_pid"))
        sizes = points.groupBy("_label").agg(F.sum("_w").alias("traders"), F.min("_pid").alias("first"))
        # At most traders / min_traders rows remain to be numbered.
        order = Window.orderBy(F.desc("traders"), "first")
        kept = sizes.where(F.col("traders") >= min_traders).withColumn("category", (F.row_number().over(order) - 1).cast("int"))
        grouped = cut_lineage(points.join(kept.select("_label", "category"), "_label").select("_pid", *columns, "category"))
        members = core.join(grouped.drop("_pid"), list(columns)).select(key, "category")
        return cls(scaler, float(radius), grouped, cut_lineage(members), key)

    def segment(self, profiles: DataFrame) -> DataFrame:
        """Segment of each trader the model was fitted on; traders that are no core point are noise."""
        joined = profiles.join(self.members, self.key, "left")
        return joined.select(*profiles.columns, F.coalesce("category", F.lit(NOISE)).alias("category"))

    def assign(self, profiles: DataFrame) -> DataFrame:
        """Segment and strength of new traders.

        A trader belongs to the segment of the nearest core point within the radius; the strength falls from 1 on that point to 0 at the
        radius. Traders without one, or with a missing value, are noise with strength 0.
        """
        columns = self.scaler.columns
        tree = neighbors.Tree(self.core.select("_pid", *columns), "_pid", columns)
        # One search per distinct key.
        scaled = self.scaler.transform(profiles.select(self.key, *columns))
        found = neighbors.nearest(tree, scaled, self.key, self.radius).join(self.core.select(F.col("_pid").alias("pid"), "category"), "pid")
        strength = F.lit(1.0) - F.col("distance") / F.lit(self.radius) if self.radius else F.lit(1.0)
        matched = found.select(self.key, F.col("category"), strength.alias("strength"))
        return profiles.join(matched, self.key, "left").select(
            *profiles.columns, F.coalesce("category", F.lit(NOISE)).alias("category"), F.coalesce("strength", F.lit(0.0)).alias("strength")
        )

    def save(self, path: str) -> None:
        """Writes the model below a folder: core points, members, and one row of settings with the scaler and its columns."""
        spark = self.core.sparkSession
        self.core.write.mode("overwrite").parquet(f"{path}/core")
        self.members.write.mode("overwrite").parquet(f"{path}/members")
        settings = [(self.key, self.radius, list(self.scaler.columns), list(self.scaler.means), list(self.scaler.deviations))]
        schema = "key string, radius double, columns array<string>, means array<double>, deviations array<double>"
        spark.createDataFrame(settings, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/settings")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SegmentModel:
        row = spark.read.parquet(f"{path}/settings").first()
        scaler = Scaler(tuple(row["columns"]), tuple(row["means"]), tuple(row["deviations"]))
        return cls(scaler, row["radius"], spark.read.parquet(f"{path}/core"), spark.read.parquet(f"{path}/members"), row["key"])
