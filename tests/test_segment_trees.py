"""Trees of many segments agree with Spark's in what they learn, and few fits have jobs of their own."""

import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from tradewake.operators import boosted_trees, models, segment_trees
from tradewake.plans import model_queries, segment_queries

COLUMNS = model_queries.NEWER_COLUMNS


def trades(segments, each):
    """Trades whose price decides, upwards in even segments and downwards in odd ones."""
    rng = random.Random(4)
    for s in segments:
        for i in range(each):
            values = [rng.random() for _ in COLUMNS]
            up = values[COLUMNS.index("price")] > 0.5
            yield (s * 100_000 + i, s, *values, float(rng.random() < (0.9 if up == (s % 2 == 0) else 0.1)))


def frame(spark, rows):
    return spark.createDataFrame(list(rows), "trade_id long, category int, " + ", ".join(f"{c} double" for c in COLUMNS) + ", won double")


def test_many_segments_take_few_fits(spark, monkeypatch):
    train, test = frame(spark, [*trades(range(-1, 30), 200), *trades([30], 1)]), frame(spark, trades(range(-1, 32), 60))
    monkeypatch.setattr(segment_queries, "OWN_FITS", 2, raising=False)
    fits, fit = [], segment_queries.fit_segment
    settings = models.BOOSTED_SEGMENT | {"rounds": 10}
    monkeypatch.setattr(models, "BOOSTED_SEGMENT", settings)
    monkeypatch.setattr(segment_queries, "fit_segment", lambda rows, columns: fits.append(columns) or fit(rows, columns))
    fitted = segment_queries.segment_models(train)
    assert len(fits) == 4
    out = fitted.score(test).cache()
    assert out.count() == test.count() == out.select("trade_id").distinct().count()
    # Segments without a model, for lack of rows or of a second class, count as noise, which has two models.
    assert {r["category"] for r in out.where("trade_id >= 3000000").select("category").distinct().collect()} == {-1}
    assert out.where("(category = -1) <> (probability_old is not null)").isEmpty() and out.where("probability_new is null").isEmpty()
    right = out.where("trade_id < 3000000 and category >= 0").groupBy("category").agg(F.avg(((F.col("probability_new") > 0.5) == (F.col("won") == 1)).cast("int")).alias("part")).collect()
    assert len(right) == 30 and min(r["part"] for r in right) > 0.6 and sum(r["part"] for r in right) / 30 > 0.8


@pytest.mark.parametrize("share", [1.0, 0.75])
def test_trees_agree_with_those_of_spark(spark, share):
    """Almost the same without random draws, as good with them."""
    train, test = frame(spark, trades([0], 1500)).withColumn("holdout", F.col("trade_id") % 10 == 0), frame(spark, trades([0], 3000)).where("trade_id >= 1500")
    settings = models.BOOSTED_SEGMENT | {"row_share": share, "column_share": share}
    ours = segment_trees.SegmentTrees.fit(train, COLUMNS, "holdout", "trade_id", **settings).score(test, "p", "prediction", 0.5)
    theirs = models.fit_boosted(train, COLUMNS, holdout="holdout", **settings).score(test, "q")
    both = ours.select("trade_id", "p").join(theirs.select("trade_id", "q", "won"), "trade_id").toPandas()
    losses = [-np.log(np.where(both["won"] == 1, p, 1 - p)).mean() for p in (both["p"], both["q"])]
    assert len(both) == 1500 and losses[0] == pytest.approx(losses[1], rel=0.05)
    if share == 1.0:
        assert (both["p"] - both["q"]).abs().median() < 1e-9


def test_rows_of_a_segment_are_scored_in_parts(spark, monkeypatch):
    train, test = frame(spark, trades([3, 4], 100)).withColumn("holdout", F.lit(False)), frame(spark, trades([3, 4, 5], 90))
    fitted = segment_trees.SegmentTrees.fit(train, COLUMNS, "holdout", "trade_id", **models.BOOSTED_SEGMENT | {"rounds": 3})
    score = lambda: {r["trade_id"]: r["p"] for r in fitted.score(test, "p", "prediction", 0.5).collect()}
    whole = score()
    monkeypatch.setattr(segment_trees, "SCORED_ROWS", 7)
    assert len(whole) == 180 and score() == whole


def test_thresholds():
    assert segment_trees.thresholds(np.array([1.0, 1.0, 3.0]), 5).tolist() == [2.0]
    assert segment_trees.thresholds(np.array([2.0, 2.0]), 5).tolist() == []
    assert segment_trees.thresholds(np.arange(100.0), 3).tolist() == [24.5, 49.5, 74.5]


def test_unused_last_column_has_no_gain(spark):
    rows = frame(spark, trades([0], 200)).withColumn("still", F.lit(1.0)).withColumn("holdout", F.col("trade_id") % 10 == 0)
    ranked = models.importances(models.fit_boosted(rows, ("price", "still"), rounds=3, depth=2, holdout="holdout"))
    assert ranked[1] == ("still", 0.0, 0) and ranked[0][1] > 0.99


def test_folds_are_fitted_side_by_side(spark):
    """Several fits have begun before the first ends."""
    rows = frame(spark, trades([0], 100)).withColumn("fold", F.col("trade_id") % 3)
    met = threading.Barrier(3)

    def fit(train, columns):
        met.wait(60)
        return models.fit_logistic(train, columns)

    assert models.out_of_fold(rows, COLUMNS, fit, k=3).count() == 100


def test_segments_are_fitted_on_all_their_rows(spark, monkeypatch):
    """Also where there are more than two million."""
    seen = []
    monkeypatch.setattr(models, "fit_boosted", lambda rows, columns, **settings: seen.append(rows))
    rows = 2_100_000
    model_queries.fit_segment(spark.range(rows).select(F.col("id").alias("trade_id"), F.lit(0.5).alias("price"), F.lit(1.0).alias(models.LABEL)), ("price",))
    assert seen[0].count() == rows and 0 < seen[0].where("holdout").count() < rows / 5


def test_thresholds_come_from_all_rows(spark):
    """Values of two rows in a hundred thousand are split on; a sample of the rows would miss them."""
    names = [f"rare_{i}" for i in range(4)]
    rows = spark.range(100_000).select("id", *[F.when(F.col("id").isin(17 + 20_011 * i, 9_000 + 20_011 * i), 1.0).otherwise(0.0).alias(c) for i, c in enumerate(names)])
    train = rows.withColumn(models.LABEL, F.greatest(*names))
    fitted = models.fit_boosted(train, names, rounds=2, depth=5, row_share=1.0, column_share=1.0, bins=128)
    assert all(splits > 0 for _, _, splits in models.importances(fitted))
    assert fitted.score(train).where(F.col("predicted") != F.col(models.LABEL)).isEmpty()


def test_blocks_and_tasks_make_no_difference(spark, monkeypatch):
    """Rows are drawn by their hash, so trees don't depend on where the rows are; the saved form keeps the sums."""
    train = frame(spark, trades([0], 1500)).withColumn("holdout", F.col("trade_id") % 10 == 0)
    settings = models.BOOSTED_SEGMENT | {"rounds": 4}
    shown = lambda rows: models.fit_boosted(rows, COLUMNS, holdout="holdout", **settings).score(train).orderBy("trade_id").toPandas()["predicted_prob"].to_numpy()
    whole = shown(train.coalesce(1))
    monkeypatch.setattr(boosted_trees, "ADDED_AT_ONCE", 2)
    assert np.allclose(shown(train.repartition(5)), whole, atol=1e-9) and whole.std() > 0.05


def test_summaries_keep_the_ranks(monkeypatch):
    monkeypatch.setattr(boosted_trees, "SUMMARY", 1000)
    values = np.random.default_rng(1).normal(size=200_000)
    parts = [boosted_trees.summary(p, np.ones(len(p))) for p in np.split(values, 8)]
    merged = parts[0]
    for part in parts[1:]:
        merged = boosted_trees.merged(merged, part)
    assert len(merged[0]) <= 1000 and merged[1].sum() == len(values)
    below = np.searchsorted(np.sort(values), boosted_trees.cuts(*merged, 127)) / len(values)
    assert len(below) == 127 and np.abs(below - np.arange(1, 128) / 128).max() < 0.005


def test_trees_refuse_what_spark_refuses(spark):
    rows = frame(spark, trades([0], 50))
    for bad in (rows.withColumn("price", F.when(F.col("trade_id") > 3, F.col("price"))), rows.withColumn("won", F.col("won") + 1), rows.where("false")):
        with pytest.raises(Exception, match="null or not a number|neither 0 nor 1|no rows"):
            models.fit_boosted(bad, COLUMNS, rounds=2, depth=2)
