"""Running columns give the same result whether or not keys are split."""

import random

import pandas as pd
import pytest

from tradewake.operators import aggregates, evaluate, prefix, sampling, windows
from tradewake.operators.prefix import SplitPolicy
from tradewake.plans.inputs import Inputs
from tradewake.plans.sampling_queries import trade_hash
from tradewake.plans.window_queries import history

FINE = SplitPolicy(target_rows=40, fan_out=8)
POLICIES = [FINE, SplitPolicy(target_rows=300, fan_out=4, max_levels=3), SplitPolicy(target_rows=5, fan_out=16), SplitPolicy(target_rows=20, max_groups=2)]
SPECS = [
    prefix.ordinal("n"), prefix.prior_sum("ps", "v"), prefix.prior_count("pc", "v"), prefix.prior_value("lt", "ts"),
    prefix.prior_value("lv", "v"), prefix.peer_max("mx", "v"), prefix.peer_min("mn", "v"),
]


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(7)
    rows = []
    for i in range(2500):
        key = 1 if rng.random() < 0.5 else 2 if rng.random() < 0.3 else rng.randint(3, 30)
        # Key 2 has most of its rows in one second.
        ts = 100 if key == 2 and rng.random() < 0.7 else rng.randint(0, 500)
        rows.append((key if rng.random() > 0.02 else None, ts, i, round(rng.random(), 3) if rng.random() > 0.05 else None))
    return spark.createDataFrame(rows, "k long, ts long, id long, v double")


def frame(df, key="id"):
    return df.toPandas().sort_values(key).reset_index(drop=True).round(9)


@pytest.mark.parametrize("policy", POLICIES)
def test_splitting_changes_nothing(skewed, policy):
    plain = prefix.running_columns(skewed, ["k"], ["ts", "id"], SPECS)
    split = prefix.running_columns(skewed, ["k"], ["ts", "id"], SPECS, policy)
    pd.testing.assert_frame_equal(frame(plain), frame(split))


def test_plain_matches_pandas(skewed):
    ours = frame(prefix.running_columns(skewed.where("k is not null"), ["k"], ["ts", "id"], SPECS, FINE))
    df = skewed.where("k is not null").toPandas().sort_values(["k", "ts", "id"])
    g = df.groupby("k")
    df["n"] = g.cumcount() + 1
    df["pc"] = g["v"].transform(lambda s: s.notna().cumsum().shift(fill_value=0)).astype(int)
    df["lt"] = g["ts"].shift()
    mx = g["v"].cummax().groupby([df.k, df.ts]).transform("max")
    df["mx"] = mx.groupby(df.k).ffill()
    df = df.sort_values("id").reset_index(drop=True)
    for c in ("n", "pc"):
        assert (ours[c] == df[c]).all()
    assert (ours["lt"].fillna(-1) == df["lt"].fillna(-1)).all()
    assert (ours["mx"].fillna(-1) == df["mx"].round(9).fillna(-1)).all()


def test_large_keys_are_cut_below_the_target(skewed):
    cuts = prefix.plan_cuts(skewed, ["k"], ["ts", "id"], FINE)
    split = prefix._apply_cuts(skewed, ["k"], ["ts", "id"], cuts, FINE.fan_out)
    assert split.groupBy("k", prefix.CHUNK).count().agg({"count": "max"}).first()[0] <= FINE.target_rows


def test_trader_history_when_every_trader_is_split(spark, sf_dir):
    inputs = Inputs(spark, sf_dir)
    labelled = windows.label_trades(inputs.trades, inputs.markets)
    split = windows.trader_history(labelled, SplitPolicy(target_rows=20, fan_out=4))
    pd.testing.assert_frame_equal(frame(history(inputs), "trade_id"), frame(split, "trade_id"))


def test_users_of_running_columns_when_split(spark, sf_dir):
    inputs = Inputs(spark, sf_dir)
    labelled = windows.label_trades(inputs.trades, inputs.markets).where("won is not null").select("trade_id", "won", "price", "usd_amount")
    scored = labelled.withColumnRenamed("price", "predicted_prob")
    assert evaluate.auc(scored).first()["auc"] == pytest.approx(evaluate.auc(scored, policy=FINE).first()["auc"])
    a = aggregates.describe(labelled, ["price", "usd_amount"])
    b = aggregates.describe(labelled, ["price", "usd_amount"], policy=FINE)
    pd.testing.assert_frame_equal(frame(a, "feature"), frame(b, "feature"))
    f = sampling.stratified_folds(labelled, "won", trade_hash(), "trade_id")
    g = sampling.stratified_folds(labelled, "won", trade_hash(), "trade_id", policy=SplitPolicy(target_rows=500))
    pd.testing.assert_frame_equal(frame(f, "trade_id"), frame(g, "trade_id"))
    m = windows.market_average_so_far(inputs.trades)
    n = windows.market_average_so_far(inputs.trades, policy=SplitPolicy(target_rows=10))
    pd.testing.assert_frame_equal(frame(m, "trade_id"), frame(n, "trade_id"))


def test_text_addresses_can_be_split(spark):
    rows = [(f"0x{(i * 7919) % 65521:08x}",) for i in range(600)]
    df = spark.createDataFrame(rows, "address string")
    expected = sorted({r[0] for r in rows})
    step = len(expected) // 5
    assert sampling.address_bounds(df, policy=FINE) == [expected[i * step] for i in range(5)]
