"""Evaluation of predictions: counts, ranking quality, price buckets and returns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewake.functions import scalars
from tradewake.operators import prefix
from tradewake.operators.prefix import DEFAULT_POLICY, SplitPolicy
from tradewake.session import cut_lineage


def _number_of(condition: Column) -> Column:
    return F.count_if(condition)


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def _f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)


def confusion_metrics(scored: DataFrame, label: str = "won", predicted: str = "predicted", by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts with accuracy, precision, recall and F1; an empty denominator gives 0."""
    y, p = F.col(label).cast("int"), F.col(predicted).cast("int")
    counts = scored.where(y.isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("samples"),
        _number_of((p == 1) & (y == 1)).alias("tp"),
        _number_of((p == 1) & (y == 0)).alias("fp"),
        _number_of((p == 0) & (y == 1)).alias("fn"),
        _number_of((p == 0) & (y == 0)).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return (
        counts.withColumn("accuracy", _share(tp + tn, F.col("samples")))
        .withColumn("precision", _share(tp, tp + fp))
        .withColumn("recall", _share(tp, tp + fn))
        .withColumn("f1", _f1(F.col("precision"), F.col("recall")))
    )


def accuracy_by(scored: DataFrame, by: Sequence[str], label: str = "won", predicted: str = "predicted") -> DataFrame:
    """Rows and accuracy per group."""
    y, p = F.col(label).cast("int"), F.col(predicted).cast("int")
    known = scored.where(y.isNotNull())
    return known.groupBy(*by).agg(F.count(F.lit(1)).alias("samples"), F.avg((y == p).cast("int")).alias("accuracy"))


def classification_report(scored: DataFrame, label: str = "won", predicted: str = "predicted") -> DataFrame:
    """Precision, recall, F1 and support of both classes, with macro and weighted averages."""
    c = confusion_metrics(scored, label, predicted)

    def measures(name: str, hit: str, false: str, missed: str) -> Column:
        precision = _share(F.col(hit), F.col(hit) + F.col(false))
        recall = _share(F.col(hit), F.col(hit) + F.col(missed))
        return F.struct(
            F.lit(name).alias("label"), precision.alias("precision"), recall.alias("recall"),
            _f1(precision, recall).alias("f1"), (F.col(hit) + F.col(missed)).alias("support"),
        )

    both = c.select(measures("0", "tn", "fn", "fp").alias("n"), measures("1", "tp", "fp", "fn").alias("y"), "accuracy")
    support = F.col("n.support") + F.col("y.support")

    def averaged(name: str, combine) -> Column:
        values = [combine(F.col(f"n.{m}"), F.col(f"y.{m}")).alias(m) for m in ("precision", "recall", "f1")]
        return F.struct(F.lit(name).alias("label"), *values, support.alias("support"))

    def macro(a: Column, b: Column) -> Column:
        return (a + b) / 2

    def weighted(a: Column, b: Column) -> Column:
        return _share(a * F.col("n.support") + b * F.col("y.support"), support)

    accuracy = F.struct(
        F.lit("accuracy").alias("label"), F.col("accuracy").alias("precision"), F.col("accuracy").alias("recall"),
        F.col("accuracy").alias("f1"), support.alias("support"),
    )
    rows = F.array(F.col("n"), F.col("y"), accuracy, averaged("macro avg", macro), averaged("weighted avg", weighted))
    return both.select(F.inline(rows))


def auc(
    scored: DataFrame, by: Sequence[str] = (), label: str = "won", score: str = "predicted_prob", policy: SplitPolicy = DEFAULT_POLICY
) -> DataFrame:
    """Area under the ROC curve by rank sums, tied scores counting half; null for a single class.

    Rows are counted per distinct score first, and the running count of negatives
    is split over tasks when one group has very many distinct scores.
    """
    keys = list(by) or ["_all"]
    y = F.col(label).cast("int")
    source = scored if by else scored.withColumn("_all", F.lit(0))
    counted = source.where(y.isNotNull() & F.col(score).isNotNull()).groupBy(*keys, score).agg(
        _number_of(y == 1).alias("_pos"), _number_of(y == 0).alias("_neg")
    )
    # Sizing and ranking both read the counts, so they are written once.
    counted = cut_lineage(counted)
    ranked = prefix.running_columns(counted, keys, [score], [prefix.prior_sum("_below", "_neg")], policy)
    wins = F.col("_pos") * (F.coalesce("_below", F.lit(0)) + F.col("_neg") / 2)
    out = ranked.groupBy(*keys).agg(F.sum(wins).alias("_wins"), F.sum("_pos").alias("positives"), F.sum("_neg").alias("negatives"))
    pairs = F.col("positives").cast("double") * F.col("negatives")
    return out.select(*by, "positives", "negatives", scalars.ratio(F.col("_wins"), pairs).alias("auc"))


def mean_auc(scored: DataFrame, by: Sequence[str], **options) -> DataFrame:
    """Mean of per-group AUCs, groups of a single class left out."""
    return auc(scored, by, **options).agg(F.avg("auc").alias("auc"), F.count("auc").alias("groups"))


def price_bucket_summary(bought: DataFrame) -> DataFrame:
    """Count, win rate and return of bought trades per price bucket."""
    priced = bought.withColumns(
        {
            "price_bucket": scalars.price_bucket(F.col("price")),
            "return": scalars.trade_return(F.col("won"), F.col("price")),
        }
    )
    return priced.where(F.col("price_bucket").isNotNull()).groupBy("price_bucket").agg(
        F.count("return").alias("n"),
        F.avg(F.col("won").cast("int")).alias("win_rate"),
        F.sum("return").alias("total_return"),
        F.avg("return").alias("avg_return"),
    )


def expected_return(scored: DataFrame, predicted: str = "predicted", fee: float = scalars.FLAT_FEE) -> DataFrame:
    """Market against model per price bucket: win rates, counts, expected return, selection rate."""
    edges = scalars.BUCKET_EDGES_TO_90
    chosen = F.col(predicted) == 1
    y = F.col("won").cast("int")
    table = (
        scored.withColumns(
            {
                "price_bucket": scalars.price_bucket(F.col("price"), edges),
                "_middle": scalars.bucket_midpoint(F.col("price"), edges),
            }
        )
        .where(F.col("price_bucket").isNotNull())
        .groupBy("price_bucket", "_middle")
        .agg(
            F.avg(y).alias("market_win_rate"),
            F.avg(F.when(chosen, y)).alias("model_win_rate"),
            F.count(F.when(chosen, y)).alias("model_count"),
            F.count(y).alias("total_count"),
        )
    )
    return table.withColumns(
        {
            "expected_return": F.col("model_win_rate") - F.col("_middle") - fee,
            "selection_rate": scalars.ratio(F.col("model_count"), F.col("total_count")),
        }
    ).drop("_middle")


def portfolio_summary(
    scored: DataFrame, predicted: str = "predicted", confidence: str = "predicted_prob", more_than: float | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Result of buying every predicted win: trades, win rate, invested, return, ROI, confidence range."""
    taken = F.coalesce(F.col(predicted) == 1, F.lit(False))
    if more_than is not None:
        taken = taken & (F.col(confidence) > more_than)

    def of_taken(column: Column) -> Column:
        return F.when(taken, column)

    gained = scalars.trade_return(F.col("won"), F.col("price"))
    out = scored.groupBy(*by).agg(
        _number_of(taken).alias("trades"),
        F.avg(of_taken(F.col("won").cast("int"))).alias("win_rate"),
        F.sum(of_taken(F.col("price"))).alias("invested"),
        F.sum(of_taken(gained)).alias("total_return"),
        F.min(of_taken(F.col(confidence))).alias("min_confidence"),
        F.max(of_taken(F.col(confidence))).alias("max_confidence"),
        scalars.ratio(F.sum(F.col(predicted).cast("int")), F.count(F.lit(1))).alias("selected_share"),
    )
    return out.withColumn("roi_percent", scalars.ratio(F.col("total_return"), F.col("invested")) * 100)


def prediction_hits(scored: DataFrame, predictions: Sequence[str] = ("prediction", "predictionold")) -> DataFrame:
    """Per outcome, how often each model version agrees with the market winner; no prediction counts as 'no'."""
    is_winner = F.coalesce(F.col("outcome") == F.col("winner"), F.lit(False))
    hits = []
    for p in predictions:
        correct = F.coalesce(F.col(p) == 1, F.lit(False)) == is_winner
        hits += [_number_of(correct).alias(f"{p}_hits"), _number_of(~correct).alias(f"{p}_misses")]
    return scored.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), *hits)
