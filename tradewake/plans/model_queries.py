"""Training, scoring and backtests on the point-in-time features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradewake.functions import scalars
from tradewake.operators import aggregates, evaluate, models, relations, sampling
from tradewake.plans.aggregate_queries import PROFILE_CTE, labelled_trades
from tradewake.plans.catalog import query, r, rounded
from tradewake.plans.inputs import Inputs
from tradewake.plans.sampling_queries import trade_hash
from tradewake.plans.window_queries import features
from tradewake.session import cut_lineage

# The corrected running ratios feed the models.
MODEL_COLUMNS = (
    "time_since_start", "time_until_end", "hour_of_day", "day_of_week", "winrate_prior", "cum_spent_prior", "cum_max_spent",
    "highest_price_yet", "lowest_price_yet", "avg_price_prior", "time_since_last_trade", "role", "usd_amount", "token_amount",
    "price", "direction",
)
# The newer models do without the role.
NEWER_COLUMNS = tuple(c for c in MODEL_COLUMNS if c != "role")
KEYS = ("trade_id", "address", "condition_id")


def training_rows(inputs: Inputs):
    """Model inputs, written once so that every pass of a training job re-reads them."""
    rows = models.model_inputs(features(inputs), MODEL_COLUMNS, KEYS)
    return cut_lineage(sampling.train_test_flag(rows, draw("split")))


def draw(purpose: str):
    """A hash of the trade of its own for each purpose, so that split, samples and holdout don't depend on one another."""
    return F.pmod(F.xxhash64(F.lit(purpose), F.col("trade_id")), F.lit(1_000_000))


def holdout():
    """A tenth of the trades, which decides when to stop."""
    return draw("holdout") % 10 == 0


def fit_segment(train, columns):
    """Boosted trees with the settings of the segments; a tenth of the rows decides when to stop."""
    rows = models.fitting_rows(train.withColumn("holdout", holdout()), "trade_id")
    return models.fit_boosted(rows, columns, holdout="holdout", **models.BOOSTED_SEGMENT)


def _split(rows):
    return rows.where(~F.col("is_test")), rows.where(F.col("is_test"))


def _table(inputs: Inputs, rows, schema: str):
    return inputs.spark.createDataFrame(rows, schema)


def _measured(model, test):
    out = evaluate.confusion_metrics(model.score(test))
    return rounded(out, "accuracy", "precision", "recall", "f1")


@query(
    "standardize",
    "SELECT address, " + ", ".join(
        r(f"({c} - AVG({c}) OVER ()) / STDDEV_POP({c}) OVER ()", name=c) for c in aggregates.PROFILE_COLUMNS
    ) + " FROM profile",
    PROFILE_CTE,
)
def standardize(inputs: Inputs):
    profile = aggregates.trader_profile(labelled_trades(inputs), approximate=False)
    scaler = models.Scaler.fit(profile, aggregates.PROFILE_COLUMNS)
    return rounded(scaler.transform(profile).select("address", *aggregates.PROFILE_COLUMNS), *aggregates.PROFILE_COLUMNS)


@query("pca_2d")
def pca_2d(inputs: Inputs):
    profile = aggregates.trader_profile(labelled_trades(inputs), approximate=False)
    scaled = models.Scaler.fit(profile, aggregates.PROFILE_COLUMNS).transform(profile)
    points, explained = models.pca_2d(scaled, aggregates.PROFILE_COLUMNS, "address")
    return points.withColumns({"explained_1": F.lit(explained[0]), "explained_2": F.lit(explained[1])})


@query("model_logreg")
def model_logreg(inputs: Inputs):
    train, _ = _split(training_rows(inputs))
    model = models.fit_logistic(train, MODEL_COLUMNS, **models.LOGISTIC)
    return _table(inputs, models.ranked_weights(model), "feature string, weight double")


@query("model_rf")
def model_rf(inputs: Inputs):
    train, test = _split(training_rows(inputs))
    fitted = models.fit_forest(models.fitting_rows(train, "trade_id", models.FOREST_SAMPLE), MODEL_COLUMNS, **models.FOREST)
    return _measured(fitted, test)


@query("model_gbt")
def model_gbt(inputs: Inputs):
    train, test = _split(training_rows(inputs))
    rows = sampling.sample_per_group(train, "condition_id", 20, draw("market sample"), "trade_id")
    return _measured(models.fit_boosted(models.fitting_rows(rows, "trade_id"), MODEL_COLUMNS, **models.BOOSTED), test)


@query("model_gbt_segment")
def model_gbt_segment(inputs: Inputs):
    train, test = _split(training_rows(inputs))
    return _measured(fit_segment(train, MODEL_COLUMNS), test)


@query("model_mlp")
def model_mlp(inputs: Inputs):
    train, test = _split(training_rows(inputs))
    rows = train.withColumn("holdout", holdout())
    return _measured(models.fit_network(rows, MODEL_COLUMNS, holdout="holdout", **models.NETWORK), test)


@query("cv_scores")
def cv_scores(inputs: Inputs):
    folded = cut_lineage(sampling.stratified_folds(training_rows(inputs), models.LABEL, trade_hash(), "trade_id"))
    return rounded(models.fold_scores(models.out_of_fold(folded, MODEL_COLUMNS, fit_segment)), "accuracy")


@query("feature_importance")
def feature_importance(inputs: Inputs):
    train, _ = _split(training_rows(inputs))
    model = fit_segment(train, MODEL_COLUMNS)
    return _table(inputs, models.importances(model), "feature string, gain double, splits long")


@query("score_by_segment")
def score_by_segment(inputs: Inputs):
    rows = training_rows(inputs).withColumn("category", (F.col("address") % 4 - 1).cast("int"))
    train, test = _split(rows)
    categories = (-1, 0, 1, 2)
    own = {c: train.where(F.col("category") == c) for c in categories}
    *current, previous = models.fit_all(fit_segment, [(own[c], MODEL_COLUMNS) for c in categories] + [(own[-1], ("price",))])
    fitted = {c: models.SegmentModels(m, previous if c == -1 else None) for c, m in zip(categories, current)}
    scored = models.score_by_segment(test, fitted)
    return scored.select("trade_id", "category", "probability_new", "prediction", "probability_old", "predictionold")


@query("backtest")
def backtest(inputs: Inputs):
    """Portfolio line (bucket null) and price buckets, over markets that no model has seen."""
    unseen = F.pmod(F.xxhash64(F.lit("market"), F.col("condition_id")), F.lit(5)) == 0
    rows = training_rows(inputs).withColumn("is_test", unseen)
    train, test = _split(rows)
    scored = cut_lineage(fit_segment(train, MODEL_COLUMNS).score(test))
    parts = []
    for least in (None, models.CONFIDENT):
        summary, buckets = models.backtest(scored, least)
        line = summary.select(F.lit(None).cast("string").alias("price_bucket"), F.col("trades").alias("n"), "win_rate", "total_return", scalars.ratio(F.col("total_return"), F.col("trades")).alias("avg_return"))
        parts += [p.withColumn("more_than", F.lit(least).cast("double")) for p in (line, buckets.select(F.col("price_bucket").cast("string"), "n", "win_rate", "total_return", "avg_return"))]
    return rounded(relations.union_all(*parts), "win_rate", "total_return", "avg_return")
