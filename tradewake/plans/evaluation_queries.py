"""Evaluation tables on a deterministic score: the price as win probability."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradewake.functions import scalars
from tradewake.operators import evaluate, windows
from tradewake.plans.catalog import query, r, rounded
from tradewake.plans.inputs import Inputs, with_outcome, with_outcome_names
from tradewake.functions import labels


def _bucket_case(edges, middle: bool = False) -> str:
    parts = []
    for lo, hi in scalars.bucket_bounds(edges):
        value = f"CAST({round((lo + hi) / 2, 4)} AS DOUBLE)" if middle else f"'{scalars.bucket_label(lo, hi)}'"
        parts.append(f"WHEN price > {lo} AND price <= {hi} THEN {value}")
    return f"CASE {' '.join(parts)} END"


RETURN = "CASE WHEN won THEN 1 - price - 0.05 * (1 - price) * price ELSE -price - 0.05 * (1 - price) * price END"
SCORED_CTE = f"""
scored AS (
  SELECT trade_id, address, condition_id, price, usd_amount, nonusdc_side, won, CAST(won AS INT) AS y,
    price AS predicted_prob, CAST(price > 0.5 AS INT) AS predicted, address % 6 AS bucket,
    {_bucket_case(scalars.BUCKET_EDGES_TO_100)} AS price_bucket, {_bucket_case(scalars.BUCKET_EDGES_TO_90)} AS bucket_90,
    {_bucket_case(scalars.BUCKET_EDGES_TO_90, True)} AS middle, {RETURN} AS ret
  FROM labelled WHERE won IS NOT NULL),
confusion AS (
  SELECT COUNT(*) AS samples, COUNT(*) FILTER (WHERE predicted = 1 AND y = 1) AS tp, COUNT(*) FILTER (WHERE predicted = 1 AND y = 0) AS fp,
    COUNT(*) FILTER (WHERE predicted = 0 AND y = 1) AS fn, COUNT(*) FILTER (WHERE predicted = 0 AND y = 0) AS tn FROM scored),
measures AS (
  SELECT *, (tp + tn) / samples AS accuracy,
    CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall,
    CASE WHEN tn + fn > 0 THEN tn / (tn + fn) ELSE 0 END AS precision0, CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END AS recall0
  FROM confusion),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1,
    CASE WHEN precision0 + recall0 > 0 THEN 2 * precision0 * recall0 / (precision0 + recall0) ELSE 0 END AS f10,
    tn + fp AS s0, tp + fn AS s1 FROM measures)
"""


def scored_trades(inputs: Inputs):
    """Labelled trades scored by their price."""
    labelled = windows.label_trades(inputs.trades, inputs.markets).where(F.col("won").isNotNull())
    return labelled.withColumns(
        {
            "predicted_prob": F.col("price"),
            "predicted": scalars.flag(F.col("price") > 0.5),
            "bucket": F.col("address") % 6,
        }
    )


@query(
    "baseline_predict",
    "SELECT trade_id, price, CAST(price > 0.5 AS INT) AS over_half, CAST(price > 0.45 AS INT) AS over_45, CAST(price >= 0.5 AS INT) AS at_least_half FROM trades",
)
def baseline_predict(inputs: Inputs):
    p = F.col("price")
    return inputs.trades.select(
        "trade_id", "price", scalars.flag(p > 0.5).alias("over_half"), scalars.flag(p > 0.45).alias("over_45"),
        scalars.flag(p >= 0.5).alias("at_least_half"),
    )


@query(
    "confusion_metrics",
    f"SELECT samples, tp, fp, fn, tn, {r('accuracy')}, {r('precision')}, {r('recall')}, {r('f1')} FROM f",
    SCORED_CTE,
)
def confusion_metrics(inputs: Inputs):
    return rounded(evaluate.confusion_metrics(scored_trades(inputs)), "accuracy", "precision", "recall", "f1")


@query(
    "accuracy_by_bucket",
    f"SELECT bucket, COUNT(*) AS samples, {r('AVG(CAST(predicted = y AS INT))', name='accuracy')} FROM scored GROUP BY bucket",
    SCORED_CTE,
)
def accuracy_by_bucket(inputs: Inputs):
    return rounded(evaluate.accuracy_by(scored_trades(inputs), ["bucket"]), "accuracy")


@query(
    "classification_report",
    f"""SELECT label, {r("p", name="precision")}, {r("rc", name="recall")}, {r("ff", name="f1")}, support FROM (
      SELECT '0' AS label, precision0 AS p, recall0 AS rc, f10 AS ff, s0 AS support FROM f
      UNION ALL SELECT '1', precision, recall, f1, s1 FROM f
      UNION ALL SELECT 'accuracy', accuracy, accuracy, accuracy, s0 + s1 FROM f
      UNION ALL SELECT 'macro avg', (precision0 + precision) / 2, (recall0 + recall) / 2, (f10 + f1) / 2, s0 + s1 FROM f
      UNION ALL SELECT 'weighted avg', (precision0 * s0 + precision * s1) / (s0 + s1), (recall0 * s0 + recall * s1) / (s0 + s1),
        (f10 * s0 + f1 * s1) / (s0 + s1), s0 + s1 FROM f)""",
    SCORED_CTE,
)
def classification_report(inputs: Inputs):
    return rounded(evaluate.classification_report(scored_trades(inputs)), "precision", "recall", "f1")


AUC_CTE = SCORED_CTE + """,
ranked AS (SELECT bucket, y, RANK() OVER (ORDER BY predicted_prob) + (COUNT(*) OVER (PARTITION BY predicted_prob) - 1) / 2.0 AS rk FROM scored),
ranked_in AS (SELECT bucket, y, RANK() OVER (PARTITION BY bucket ORDER BY predicted_prob)
  + (COUNT(*) OVER (PARTITION BY bucket, predicted_prob) - 1) / 2.0 AS rk FROM scored),
per_bucket AS (SELECT bucket, CAST(SUM(y) AS BIGINT) AS positives, CAST(SUM(1 - y) AS BIGINT) AS negatives,
  (CAST(SUM(rk * y) AS DOUBLE) - CAST(SUM(y) AS DOUBLE) * (SUM(y) + 1) / 2) / NULLIF(CAST(SUM(y) AS DOUBLE) * SUM(1 - y), 0) AS auc
  FROM ranked_in GROUP BY bucket)
"""


@query(
    "auc_global",
    f"""SELECT CAST(SUM(y) AS BIGINT) AS positives, CAST(SUM(1 - y) AS BIGINT) AS negatives,
      {r("(CAST(SUM(rk * y) AS DOUBLE) - CAST(SUM(y) AS DOUBLE) * (SUM(y) + 1) / 2) / (CAST(SUM(y) AS DOUBLE) * SUM(1 - y))", name="auc")} FROM ranked""",
    AUC_CTE,
)
def auc_global(inputs: Inputs):
    return rounded(evaluate.auc(scored_trades(inputs)), "auc")


@query("auc_by_bucket", f"SELECT bucket, positives, negatives, {r('auc')} FROM per_bucket", AUC_CTE)
def auc_by_bucket(inputs: Inputs):
    return rounded(evaluate.auc(scored_trades(inputs), ["bucket"]), "auc")


@query("auc_mean_of_buckets", f"SELECT {r('AVG(auc)', name='auc')}, COUNT(auc) AS groups FROM per_bucket", AUC_CTE)
def auc_mean_of_buckets(inputs: Inputs):
    return rounded(evaluate.mean_auc(scored_trades(inputs), ["bucket"]), "auc")


@query("trade_return", f"SELECT trade_id, price, won, {r('ret', name='return')} FROM scored", SCORED_CTE)
def trade_return(inputs: Inputs):
    gained = scalars.trade_return(F.col("won"), F.col("price")).alias("return")
    return rounded(scored_trades(inputs).select("trade_id", "price", "won", gained), "return")


@query("price_bucket", "SELECT trade_id, price, price_bucket, bucket_90 FROM scored", SCORED_CTE)
def price_bucket(inputs: Inputs):
    p = F.col("price")
    return scored_trades(inputs).select(
        "trade_id", "price", scalars.price_bucket(p).alias("price_bucket"),
        scalars.price_bucket(p, scalars.BUCKET_EDGES_TO_90).alias("bucket_90"),
    )


@query(
    "bucket_summary",
    f"""SELECT price_bucket, COUNT(ret) AS n, {r("AVG(y)", name="win_rate")}, {r("SUM(ret)", name="total_return")},
      {r("AVG(ret)", name="avg_return")} FROM scored WHERE predicted = 1 AND price_bucket IS NOT NULL GROUP BY price_bucket""",
    SCORED_CTE,
)
def bucket_summary(inputs: Inputs):
    bought = scored_trades(inputs).where("predicted = 1")
    return rounded(evaluate.price_bucket_summary(bought), "win_rate", "total_return", "avg_return")


@query(
    "expected_return",
    f"""SELECT bucket_90 AS price_bucket, {r("AVG(y)", name="market_win_rate")}, {r("AVG(y) FILTER (WHERE predicted = 1)", name="model_win_rate")},
      COUNT(y) FILTER (WHERE predicted = 1) AS model_count, COUNT(y) AS total_count,
      {r("AVG(y) FILTER (WHERE predicted = 1) - ANY_VALUE(middle) - 0.02", name="expected_return")},
      {r("(COUNT(y) FILTER (WHERE predicted = 1)) / COUNT(y)", name="selection_rate")}
      FROM scored WHERE bucket_90 IS NOT NULL GROUP BY bucket_90""",
    SCORED_CTE,
)
def expected_return(inputs: Inputs):
    out = evaluate.expected_return(scored_trades(inputs))
    return rounded(out, "market_win_rate", "model_win_rate", "expected_return", "selection_rate")


@query(
    "portfolio_summary",
    f"""SELECT COUNT(*) FILTER (WHERE predicted = 1 AND price > 0.7) AS trades, {r("AVG(y) FILTER (WHERE predicted = 1 AND price > 0.7)", name="win_rate")},
      {r("SUM(price) FILTER (WHERE predicted = 1 AND price > 0.7)", 4, "invested")}, {r("SUM(ret) FILTER (WHERE predicted = 1 AND price > 0.7)", 4, "total_return")},
      MIN(price) FILTER (WHERE predicted = 1 AND price > 0.7) AS min_confidence, MAX(price) FILTER (WHERE predicted = 1 AND price > 0.7) AS max_confidence,
      {r("SUM(predicted) / COUNT(*)", name="selected_share")},
      {r("SUM(ret) FILTER (WHERE predicted = 1 AND price > 0.7) / SUM(price) FILTER (WHERE predicted = 1 AND price > 0.7) * 100", name="roi_percent")} FROM scored""",
    SCORED_CTE,
)
def portfolio_summary(inputs: Inputs):
    out = evaluate.portfolio_summary(scored_trades(inputs), more_than=0.7)
    return rounded(rounded(out, "win_rate", "selected_share", "roi_percent"), "invested", "total_return", digits=4)


@query(
    "prediction_hits",
    """SELECT outcome, COUNT(*) AS n, COUNT(*) FILTER (WHERE (price > 0.8) = hit) AS prediction_hits,
      COUNT(*) FILTER (WHERE (price > 0.8) <> hit) AS prediction_misses,
      COUNT(*) FILTER (WHERE (address % 4 = 0 AND price > 0.6) = hit) AS predictionold_hits,
      COUNT(*) FILTER (WHERE (address % 4 = 0 AND price > 0.6) <> hit) AS predictionold_misses
      FROM (SELECT t.*, COALESCE(outcome = CASE WHEN outcome_prices LIKE '%, ''1''%' THEN name2 WHEN outcome_prices IS NOT NULL THEN name1 END, FALSE) AS hit
        FROM named_trades t LEFT JOIN named_markets m ON t.condition_id = m.condition_id) GROUP BY outcome""",
)
def prediction_hits(inputs: Inputs):
    index = labels.winning_index_by_threshold(F.col("outcome_prices"))
    winner = F.try_element_at(labels.string_list(F.col("outcomes")), index + 1)
    winners = with_outcome_names(inputs.markets).select("condition_id", winner.alias("winner"))
    p = F.col("price")
    scored = with_outcome(inputs.trades).join(winners, "condition_id", "left").withColumns(
        {
            "prediction": scalars.flag(p > 0.8),
            "predictionold": F.when(F.col("address") % 4 == 0, scalars.flag(p > 0.6)),
        }
    )
    return evaluate.prediction_hits(scored)
