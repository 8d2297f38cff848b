"""Models find a planted signal and repeat themselves."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tradewake.operators import evaluate, models, neighbors, network, sampling, segments
from tradewake.operators.models import Scaler
from tradewake.session import scratch_path

COLUMNS = ("price", "noise", "gap")


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(3)
    rows = []
    for i in range(1200):
        price, noise = rng.random(), rng.random()
        won = rng.random() < (0.9 if (price > 0.5) == (noise > 0.3) else 0.15)
        rows.append((i, price, noise, None if i % 9 == 0 else rng.random(), won, i % 4 - 1))
    df = spark.createDataFrame(rows, "trade_id long, price double, noise double, gap double, won boolean, category int")
    ready = models.model_inputs(df, COLUMNS, ("trade_id", "category"))
    return sampling.train_test_flag(ready, sampling.key_hash(F.col("trade_id"))).cache()


def accuracy(model, rows):
    return evaluate.confusion_metrics(model.score(rows)).first()["accuracy"]


def test_trees_beat_the_baseline(planted):
    train, test = planted.where("not is_test"), planted.where("is_test")
    baseline = evaluate.confusion_metrics(test.withColumn("predicted", (F.col("price") > 0.5).cast("int"))).first()["accuracy"]
    forest = models.fit_forest(train, COLUMNS, trees=15, depth=6)
    boosted = models.fit_boosted(train, COLUMNS, rounds=8, rate=0.3, depth=4)
    assert accuracy(forest, test) > baseline and accuracy(boosted, test) > baseline
    ranked = models.importances(boosted)
    assert {ranked[0][0], ranked[1][0]} == {"price", "noise"} and sum(g for _, g, _ in ranked) == pytest.approx(1.0)
    assert all(n > 0 for _, _, n in ranked[:2])


def test_stop_round():
    assert models.stop_round([3.0, 2.0, 2.5, 1.0, 1.1, 1.2], 10) == 4
    assert models.stop_round([3.0, 2.0, 2.5, 2.1, 1.0], 2) == 2
    assert models.stop_round([1.0], 1) == 1 and models.stop_round([2.0, 2.0, 2.0], 5) == 1


def test_boosting_stops_at_the_best_round_of_the_holdout(spark, planted):
    rows = planted.withColumn("holdout", F.col("trade_id") % 4 == 0)
    settings = {"rounds": 14, "rate": 0.9, "depth": 5}
    whole = models.fit_boosted(rows.where("not holdout"), COLUMNS, **settings)
    losses = models.holdout_losses(whole, rows.where("holdout"))
    assert len(losses) == 14
    best, since = 0, 0
    for i in range(1, 14):
        best, since = (i, 0) if losses[i] < losses[best] else (best, since + 1)
        if since == 3:
            break
    stopped = models.fit_boosted(rows, COLUMNS, **settings, holdout="holdout", patience=3)
    assert stopped.estimator.getNumTrees == best + 1 < 14
    # The trees kept are the first ones, scores come out, and the model can be saved.
    assert models.holdout_losses(stopped, rows.where("holdout")) == pytest.approx(losses[: best + 1])
    path = scratch_path(spark, "model")
    stopped.save(path)
    again = models.load_classifier(path)
    assert again.score(planted).agg(F.sum("predicted_prob")).first()[0] == pytest.approx(stopped.score(planted).agg(F.sum("predicted_prob")).first()[0])
    assert models.importances(stopped)[0][0] in ("price", "noise")


def test_network_keeps_its_best_epoch(planted):
    rows = planted.withColumn("holdout", F.col("trade_id") % 4 == 0)
    model, losses = models.fit_network_epochs(rows, COLUMNS, "holdout", (4,), rounds=24, patience=2, epoch=3)
    best = losses.index(min(losses))
    assert 1 < len(losses) <= 8 and (len(losses) == 8 or len(losses) == best + 3)
    assert models.log_loss(model.score(rows.where("holdout"))) == pytest.approx(min(losses)) and min(losses) < losses[0]


def test_same_seed_same_scores(planted):
    a, b = (models.fit_forest(planted, COLUMNS, trees=5, depth=4).score(planted).agg(F.sum("predicted_prob")).first()[0] for _ in range(2))
    assert a == pytest.approx(b)


def test_logistic_weights_and_reload(spark, planted):
    model = models.fit_logistic(planted, COLUMNS)
    assert models.ranked_weights(model)[0][0] == "price"
    path = scratch_path(spark, "model")
    model.save(path)
    again = models.load_classifier(path)
    assert again.score(planted).agg(F.sum("predicted_prob")).first()[0] == pytest.approx(model.score(planted).agg(F.sum("predicted_prob")).first()[0])


def test_every_row_is_scored_out_of_fold_once(planted):
    folded = sampling.stratified_folds(planted, "won", sampling.key_hash(F.col("trade_id")), "trade_id", k=3)
    out = models.out_of_fold(folded, COLUMNS, models.fit_logistic, k=3)
    assert out.count() == planted.count() == out.select("trade_id").distinct().count()
    assert models.fold_scores(out).count() == 3


def test_segment_models(planted):
    fitted = {c: models.SegmentModels(models.fit_logistic(planted, COLUMNS), models.fit_logistic(planted, ("price",)) if c == -1 else None) for c in (-1, 0)}
    out = models.score_by_segment(planted, fitted)
    assert out.where("category = 0 and predictionold is not null").isEmpty()
    assert out.where("category = -1 and predictionold is null").isEmpty()
    assert out.count() == planted.where("category in (-1, 0)").count()


def test_backtest_totals_agree(planted):
    scored = models.fit_logistic(planted, COLUMNS).score(planted)
    summary, buckets = models.backtest(scored)
    row, parts = summary.first(), buckets.agg(F.sum("n").alias("n"), F.sum("total_return").alias("r")).first()
    assert row["trades"] == parts["n"] and row["total_return"] == pytest.approx(parts["r"])


def test_network_learns(planted):
    model = models.fit_network(planted, COLUMNS, hidden=(8, 4), rounds=40)
    assert accuracy(model, planted) > 0.6


def test_constant_column_is_only_centred(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    out = Scaler.fit(df, ["a", "b"]).transform(df).orderBy("a").collect()
    assert [tuple(r) for r in out] == [(-1.0, 0.0), (1.0, 0.0)]


def clustered(count):
    """Dense core, far outliers, many copies of one point."""
    rng = random.Random(11)
    rows = [(i, rng.gauss(0, 0.01), rng.gauss(0, 0.01), float(rng.randint(0, 2))) for i in range(count)]
    rows += [(count + i, rng.uniform(-50, 50), rng.uniform(-50, 50), 1.0) for i in range(15)]
    rows += [(count + 100 + i, 3.0, 3.0, 1.0) for i in range(120)]
    return rows


@pytest.mark.parametrize("k", [1, 13])
def test_kth_distance_matches_brute_force(spark, k):
    rows = clustered(400)
    df = spark.createDataFrame(rows, "address long, x double, y double, z double")
    ours = {r["address"]: r["distance"] for r in neighbors.kth_distance(df, "address", ["x", "y", "z"], k).collect()}
    assert len(ours) == len(rows)
    for a in rows[::7]:
        d = sorted(math.dist(a[1:], b[1:]) for b in rows)[k - 1]
        assert ours[a[0]] == pytest.approx(d, abs=1e-12)


def test_kth_distance_with_too_few_points(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 1.0)], "address long, x double")
    assert [r["distance"] for r in neighbors.kth_distance(df, "address", ["x"], 3).collect()] == [None, None]


def plain_segments(rows, radius, min_samples, min_traders):
    """DBSCAN without border points over (key, coordinates...), by comparing all pairs."""
    near = {a[0]: {b[0] for b in rows if math.dist(a[1:], b[1:]) <= radius} for a in rows}
    core = {k for k, found in near.items() if len(found) >= min_samples}
    left, groups = set(core), []
    while left:
        group, waiting = set(), [min(left)]
        while waiting:
            k = waiting.pop()
            if k not in group:
                group.add(k)
                waiting += (near[k] & core) - group
        groups.append(group)
        left -= group
    kept = sorted((g for g in groups if len(g) >= min_traders), key=lambda g: (-len(g), min(g)))
    return {k: i for i, g in enumerate(kept) for k in g}


def blobs():
    rng = random.Random(5)
    rows = [(i, rng.uniform(0, 4), rng.uniform(0, 1), rng.gauss(0, 0.2)) for i in range(400)]
    rows += [(1000 + i, rng.uniform(20, 22), rng.uniform(20, 21), rng.gauss(5, 0.2)) for i in range(200)]
    # Copies of one point, a thin bridge of points that hang together, and outliers.
    rows += [(2000 + i, 10.0, 10.0, 0.0) for i in range(90)]
    rows += [(3000 + i, -20.0 + 0.15 * i, 30.0, 1.0) for i in range(80)]
    return rows + [(4000 + i, -30.0 - 7 * i, 40.0 + 5 * i, 0.0) for i in range(6)]


@pytest.mark.parametrize("radius", [0.02, 0.12, 0.4, 5.0])
def test_segments_equal_those_of_all_pairs(spark, radius):
    rows, columns = blobs(), ["x", "y", "z"]
    df = spark.createDataFrame(rows, "address long, x double, y double, z double")
    model = segments.SegmentModel.fit(df, columns, min_samples=4, min_traders=10, radius=radius)
    scaled = [(r[0], *((v - m) / s for v, m, s in zip(r[1:], model.scaler.means, model.scaler.deviations))) for r in rows]
    want = plain_segments(scaled, radius, 4, 10)
    assert {r["address"]: r["category"] for r in model.segment(df).collect()} == {r[0]: want.get(r[0], -1) for r in rows}
    # Half of the points again, slightly moved, and some that are far from all.
    rng = random.Random(6)
    new = [(k, x + rng.gauss(0, 0.1), y, z) for k, x, y, z in rows[::9]] + [(9000, 500.0, 500.0, 0.0), (9001, None, 1.0, 1.0)]
    got = {r["address"]: (r["category"], r["strength"]) for r in model.assign(spark.createDataFrame(new, "address long, x double, y double, z double")).collect()}
    cores = [p for p in scaled if p[0] in want]
    for key, *at in new:
        placed = None if None in at else [(v - m) / s for v, m, s in zip(at, model.scaler.means, model.scaler.deviations)]
        distance, _, category = min(((math.dist(placed, c[1:]), c[0], want[c[0]]) for c in cores), default=(math.inf, 0, 0)) if placed else (math.inf, 0, 0)
        assert got[key][0] == (category if distance <= radius else -1)
        assert got[key][1] == pytest.approx(1 - distance / radius if distance <= radius else 0.0, abs=1e-9)


def test_segment_radius_and_saved_model(spark, tmp_path):
    df = spark.createDataFrame(blobs(), "address long, x double, y double, z double")
    model = segments.SegmentModel.fit(df, ["x", "y", "z"], min_samples=4, min_traders=10)
    distances = sorted(r["distance"] for r in neighbors.kth_distance(model.scaler.transform(df), "address", ["x", "y", "z"], 4).collect())
    at = segments.RADIUS_QUANTILE * (len(distances) - 1)
    low = distances[int(at)]
    assert model.radius == pytest.approx(low + (at - int(at)) * (distances[int(at) + 1] - low), abs=1e-4)
    model.save(f"{tmp_path}/segments")
    again = segments.SegmentModel.load(spark, f"{tmp_path}/segments")
    assert (again.scaler, again.radius, again.key) == (model.scaler, model.radius, model.key)
    assert sorted(map(tuple, again.segment(df).collect())) == sorted(map(tuple, model.segment(df).collect()))
    assert sorted(map(tuple, again.assign(df).collect())) == sorted(map(tuple, model.assign(df).collect()))


def test_no_traders_no_segments(spark):
    df = spark.createDataFrame([], "address long, x double, y double")
    model = segments.SegmentModel.fit(df, ["x", "y"])
    assert model.segment(df).collect() == [] and model.assign(df).collect() == []


def test_neighbour_search_visits_few_leaves(spark):
    rng = random.Random(8)
    rows = [(i, *(rng.gauss(c * 3, 1) for c in (i % 7, i % 5, i % 3))) for i in range(4000)]
    df = spark.createDataFrame(rows, "address long, x double, y double, z double")
    tree = neighbors.Tree(df, "address", ["x", "y", "z"])
    neighbors.kth_distance(df, "address", ["x", "y", "z"], 13, tree).count()
    assert 0 < tree.visits < 0.2 * tree.leaves.count() ** 2


def test_kth_distance_takes_as_many_steps_with_more_leaves(spark, monkeypatch):
    at = np.random.default_rng(3).normal(size=(3000, 7))
    at[2900:] = at[0]
    axes = [f"x{i}" for i in range(7)]
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(at)], ", ".join(["address long", *[f"{a} double" for a in axes]]))
    tree, written, write = neighbors.Tree(df, "address", axes, 100), [], neighbors.cut_lineage
    monkeypatch.setattr(neighbors, "cut_lineage", lambda frame: written.append(1) or write(frame))
    ours = {r["address"]: r["distance"] for r in neighbors.kth_distance(df, "address", axes, 13, tree).collect()}
    # Rounds of a bounded number of leaves would be more the more leaves there are.
    assert tree.leaves.count() > 60 and len(written) <= 6
    for i in range(0, 3000, 50):
        assert ours[i] == pytest.approx(np.sort(np.linalg.norm(at - at[i], axis=1))[12], abs=1e-12)


def test_connected_groups_on_a_long_chain(spark):
    names = [f"{i:03d}" for i in range(120)]
    nodes = spark.createDataFrame([(n,) for n in names], "cell string")
    edges = spark.createDataFrame([(a, b) for a, b in zip(names, names[1:]) if b != "060"], "a string, b string")
    labels = {r["cell"]: r["label"] for r in segments.connected_groups(nodes, edges).collect()}
    assert {labels[n] for n in names[:60]} == {"000"} and {labels[n] for n in names[60:]} == {"060"}


def test_network_takes_the_steps_of_spark(spark, planted):
    """From the same start; blocks of Spark's are whole here, so that all rows count the same."""
    rows = planted.limit(128 * 8).coalesce(1).cache()
    scaler, sizes = Scaler.fit(rows, COLUMNS), [len(COLUMNS), 6, 4, 2]
    start = models._network(spark, COLUMNS, sizes, scaler).estimator.weights.toArray()
    theirs = models.fit_network(rows, COLUMNS, hidden=sizes[1:-1], rounds=6).estimator.weights.toArray()
    made = network.blocks(rows.repartition(3), [scaler.scaled(c) for c in COLUMNS], F.col(models.LABEL))
    value = network.loss_and_gradient(made, sizes)
    ours = network.lbfgs(value, start, 6)
    assert np.allclose(ours, theirs, atol=1e-6) and not np.allclose(ours, start, atol=1e-2)
    # The gradient is the slope of the loss.
    away, (_, slope) = np.random.default_rng(1).normal(size=len(start)) * 1e-5, value(ours)
    assert value(ours + away)[0] - value(ours - away)[0] == pytest.approx(2 * slope @ away, rel=1e-4, abs=1e-12)
    assert network.loss(made, ours, sizes) == pytest.approx(value(ours)[0])
