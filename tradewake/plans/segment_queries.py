"""Neighbour distances and density segments of trader profiles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import functions as F

from tradewake.functions import labels
from tradewake.operators import aggregates, evaluate, models, neighbors, relations, segments
from tradewake.operators.aggregates import PROFILE_COLUMNS
from tradewake.operators.segment_trees import MOST_ROWS, SegmentTrees
from tradewake.plans.aggregate_queries import PROFILE_CTE, labelled_trades
from tradewake.plans.catalog import query, r, rounded
from tradewake.plans.inputs import Inputs, with_outcome, with_outcome_names
from tradewake.plans.model_queries import NEWER_COLUMNS, fit_segment, holdout, training_rows
from tradewake.session import cut_lineage, scratch_path

# Sizes that suit the few hundred traders of the small inputs.
SAMPLES, TRADERS = 3, 5

SCALED_CTE = PROFILE_CTE + """,
scaled AS (SELECT address, """ + ", ".join(
    f"({c} - AVG({c}) OVER ()) / STDDEV_POP({c}) OVER () AS {c}" for c in PROFILE_COLUMNS
) + " FROM profile)"


def _squared(a: str, b: str) -> str:
    return " + ".join(f"({a}.x{i} - {b}.x{i}) * ({a}.x{i} - {b}.x{i})" for i in range(len(PROFILE_COLUMNS)))


def _segments_cte(members: str) -> str:
    """DBSCAN without border points as SQL, by all pairs: scale on the members, find the radius, close over core points."""
    position = ", ".join(f"(p.{c} - s.m_{c}) / s.d_{c} AS x{i}" for i, c in enumerate(PROFILE_COLUMNS))
    stats = ", ".join(f"AVG({c}) AS m_{c}, STDDEV_POP({c}) AS d_{c}" for c in PROFILE_COLUMNS)
    return PROFILE_CTE + f""",
stats AS (SELECT {stats} FROM profile WHERE {members}),
placed AS (SELECT p.address, {position} FROM profile p, stats s),
points AS (SELECT * FROM placed WHERE {members}),
pairs AS (SELECT a.address AS a, b.address AS b, SQRT({_squared("a", "b")}) AS d FROM points a, points b),
kth AS (SELECT a AS address, LIST_SORT(LIST(d))[{SAMPLES}] AS distance FROM pairs GROUP BY a),
radius AS (SELECT ROUND(QUANTILE_CONT(distance, {segments.RADIUS_QUANTILE}), {segments.RADIUS_DIGITS}) AS r FROM kth),
core AS (SELECT address FROM kth, radius WHERE distance <= r),
links AS (SELECT a, b FROM pairs, radius WHERE d <= r AND a IN (SELECT address FROM core) AND b IN (SELECT address FROM core)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
grouped AS (SELECT a AS address, MIN(b) AS label FROM reach GROUP BY a),
sizes AS (SELECT label, COUNT(*) AS traders FROM grouped GROUP BY label HAVING COUNT(*) >= {TRADERS}),
numbered AS (SELECT label, CAST(ROW_NUMBER() OVER (ORDER BY traders DESC, label) - 1 AS INT) AS category FROM sizes),
cores AS (SELECT address, category FROM grouped JOIN numbered USING (label))
"""


def profiles(inputs: Inputs):
    return cut_lineage(aggregates.trader_profile(labelled_trades(inputs), approximate=False))


@query(
    "knn_distance",
    f"""SELECT a.address, {r("SQRT(LIST_SORT(LIST(d))[13])", 6, "distance")} FROM (
      SELECT a.address, {" + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in PROFILE_COLUMNS)} AS d FROM scaled a, scaled b) a
      GROUP BY a.address""",
    SCALED_CTE,
)
def knn_distance(inputs: Inputs):
    found = profiles(inputs)
    scaled = models.Scaler.fit(found, PROFILE_COLUMNS).transform(found)
    return rounded(neighbors.kth_distance(scaled, "address", PROFILE_COLUMNS), "distance")


def fit_segments(known):
    return segments.SegmentModel.fit(known, PROFILE_COLUMNS, SAMPLES, TRADERS)


@query(
    "segment_users",
    "SELECT address, COALESCE(category, -1) AS category FROM points LEFT JOIN cores USING (address)",
    _segments_cte("TRUE"),
)
def segment_users(inputs: Inputs):
    found = profiles(inputs)
    return fit_segments(found).segment(found).select("address", "category")


@query(
    "assign_segments",
    f"""SELECT address, COALESCE(ARG_MIN(category, d) FILTER (WHERE d <= r), -1) AS category,
      {r("COALESCE(1 - MIN(d) FILTER (WHERE d <= r) / ANY_VALUE(r), 0)", name="strength")}
      FROM (SELECT n.address, c.category, SQRT({_squared("n", "p")}) AS d, r FROM placed n, points p JOIN cores c ON p.address = c.address, radius
        WHERE n.address % 5 = 0) GROUP BY address""",
    _segments_cte("address % 5 <> 0"),
)
def assign_segments(inputs: Inputs):
    """Every fifth trader is new to segments made of the others. The saved model is loaded again before it is used."""
    found = profiles(inputs)
    path = scratch_path(inputs.spark, "segments")
    fit_segments(found.where("address % 5 <> 0")).save(path)
    assigned = segments.SegmentModel.load(inputs.spark, path).assign(found.where("address % 5 = 0"))
    return rounded(assigned.select("address", "category", "strength"), "strength")


def with_category(rows, categories):
    """Rows with the segment of their trader; traders without a profile belong to none."""
    return rows.join(categories, "address", "left").withColumn("category", F.coalesce("category", F.lit(-1)))


def past_segments(inputs: Inputs):
    """(address, category) of the traders known before the profile date."""
    known = cut_lineage(aggregates.trader_profile(labelled_trades(inputs).where(F.col("timestamp") < inputs.profile_date), approximate=False))
    return cut_lineage(fit_segments(known).segment(known).select("address", "category"))


# Segments with the most training rows, each of which gets a Spark job series of its own; so does any too large for a task.
OWN_FITS = 8


@dataclass(frozen=True)
class FittedSegments:
    """Models of single segments, noise among them, and the trees of all the others."""

    single: dict[int, models.SegmentModels]
    many: SegmentTrees | None = None

    def score(self, rows):
        """All rows, each scored with the models of its segment; those whose segment has none count as noise."""
        single = F.col("category").isin(*self.single)
        if self.many is None:
            return models.score_by_segment(rows.withColumn("category", F.when(single, F.col("category")).otherwise(-1)), self.single)
        modelled = self.many.trees.select("category", F.lit(True).alias("_many"))
        rows = cut_lineage(rows.join(modelled, "category", "left").withColumn("category", F.when(single | F.col("_many"), F.col("category")).otherwise(-1)))
        others = self.many.score(rows.where("_many").drop("_many"), "probability_new", "prediction", models.LIVE_THRESHOLD)
        return relations.union_all(models.score_by_segment(rows.where("_many IS NULL").drop("_many"), self.single), others)


def segment_models(train, columns=NEWER_COLUMNS):
    """A model of its own for every segment that has rows of both classes; the traders without a segment get a second one, on the price alone.

    However many segments there are, few have jobs of their own: the largest, and those with more training rows than a task takes. The
    others are fitted together, each within a task.
    """
    sizes = train.where("category <> -1").groupBy("category").agg(F.countDistinct(models.LABEL).alias("classes"), F.count(F.lit(1)).alias("n"))
    usable = cut_lineage(sizes.where("classes = 2").select("category", "n"))
    largest = usable.orderBy(F.desc("n"), "category").limit(OWN_FITS)
    # At most OWN_FITS segments and one per MOST_ROWS training rows.
    own = [row["category"] for row in largest.unionByName(usable.where(F.col("n") > MOST_ROWS)).distinct().orderBy("category").collect()]
    noise = train.join(usable.select("category"), "category", "left_anti")
    work = [(noise, columns), (noise, ("price",))] + [(train.where(F.col("category") == c), columns) for c in own]
    current, previous, *fitted = models.fit_all(fit_segment, work)
    single = {c: models.SegmentModels(m) for c, m in zip(own, fitted)} | {-1: models.SegmentModels(current, previous)}
    rest = usable.where(~F.col("category").isin(*own)) if own else usable
    if rest.isEmpty():
        return FittedSegments(single)
    rows = train.join(rest.select("category"), "category", "left_semi").withColumn("holdout", holdout())
    return FittedSegments(single, SegmentTrees.fit(rows, columns, "holdout", "trade_id", **models.BOOSTED_SEGMENT))


@query("score_live_segments")
def score_live_segments(inputs: Inputs):
    """Live scoring end to end: segments of past traders, a model per segment, hits of two model versions by outcome.

    All trades from the profile date on are live; profiles, segments and models come from those before.
    """
    rows = training_rows(inputs).join(inputs.trades.select("trade_id", "timestamp"), "trade_id")
    rows = cut_lineage(with_category(rows, past_segments(inputs)))
    live = F.col("timestamp") >= inputs.profile_date
    scored = segment_models(rows.where(~live)).score(rows.where(live))
    index = labels.winning_index_by_threshold(F.col("outcome_prices"))
    winners = with_outcome_names(inputs.markets).select("condition_id", F.try_element_at(labels.string_list(F.col("outcomes")), index + 1).alias("winner"))
    bought = with_outcome(inputs.trades).select("trade_id", "outcome")
    return evaluate.prediction_hits(scored.join(bought, "trade_id").join(winners, "condition_id", "left"))
