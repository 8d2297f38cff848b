"""Samples, splits, folds and top-n."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradewake.operators import sampling, windows
from tradewake.plans.aggregate_queries import PROFILE_CTE, segmented_profile
from tradewake.plans.catalog import query, r, rounded
from tradewake.plans.inputs import Inputs
from tradewake.session import scratch_path
from tradewake.sources import layout

HASH = "({} * 7919 + 42) % 10007"
TRADE_HASH = HASH.format("trade_id")


def trade_hash():
    return sampling.key_hash(F.col("trade_id"))


@query("top_k", "SELECT trade_id, usd_amount FROM trades ORDER BY usd_amount DESC, trade_id LIMIT 25")
def top_k(inputs: Inputs):
    return inputs.trades.select("trade_id", "usd_amount").orderBy(F.desc("usd_amount"), "trade_id").limit(25)


@query(
    "hash_sample_markets",
    f"SELECT condition_id, volume FROM markets WHERE volume > 900000 ORDER BY {HASH.format('condition_id')}, condition_id LIMIT 10",
)
def hash_sample_markets(inputs: Inputs):
    large = inputs.markets.where("volume > 900000").select("condition_id", "volume")
    return sampling.sample_n(large, 10, sampling.key_hash(F.col("condition_id")), "condition_id")


@query("hash_sample_n", f"SELECT trade_id, price FROM trades ORDER BY {TRADE_HASH}, trade_id LIMIT 2000")
def hash_sample_n(inputs: Inputs):
    return sampling.sample_n(inputs.trades.select("trade_id", "price"), 2000, trade_hash(), "trade_id")


@query(
    "sample_per_market",
    f"""SELECT trade_id, condition_id, price FROM trades
      QUALIFY ROW_NUMBER() OVER (PARTITION BY condition_id ORDER BY {TRADE_HASH}, trade_id) <= 20""",
)
def sample_per_market(inputs: Inputs):
    narrow = inputs.trades.select("trade_id", "condition_id", "price")
    return sampling.sample_per_group(narrow, "condition_id", 20, trade_hash(), "trade_id")


@query(
    "sample_diverse_wallets",
    f"""SELECT trade_id, condition_id, address FROM (
      SELECT *, ROW_NUMBER() OVER (PARTITION BY condition_id, address ORDER BY {TRADE_HASH}, trade_id) AS nth FROM trades)
      QUALIFY ROW_NUMBER() OVER (PARTITION BY condition_id ORDER BY nth > 1, {TRADE_HASH}, trade_id) <= 45""",
)
def sample_diverse_wallets(inputs: Inputs):
    narrow = inputs.trades.select("trade_id", "condition_id", "address")
    return sampling.sample_diverse(narrow, "condition_id", "address", 45, trade_hash(), "trade_id")


@query("train_test_split", f"SELECT trade_id, ({TRADE_HASH}) % 10 < 2 AS is_test FROM trades")
def train_test_split(inputs: Inputs):
    return sampling.train_test_flag(inputs.trades.select("trade_id"), trade_hash())


@query(
    "stratified_folds",
    f"""SELECT trade_id, won, CAST((ROW_NUMBER() OVER (PARTITION BY won ORDER BY {TRADE_HASH}, trade_id) - 1) % 5 AS INT) AS fold
      FROM labelled WHERE won IS NOT NULL""",
)
def stratified_folds(inputs: Inputs):
    labelled = windows.label_trades(inputs.trades, inputs.markets).where("won IS NOT NULL").select("trade_id", "won")
    return sampling.stratified_folds(labelled, "won", trade_hash(), "trade_id")


@query(
    "paged_eligible_trades",
    """SELECT trade_id, condition_id, price, CAST(page AS INT) AS page FROM (
      SELECT *, COALESCE(SUM(CAST(price > 0.2 AND price < 0.9 AS INT)) OVER (PARTITION BY condition_id ORDER BY page
        RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM (
        SELECT *, (ROW_NUMBER() OVER (PARTITION BY condition_id ORDER BY timestamp DESC, trade_id DESC) - 1) // 5 AS page
        FROM trades WHERE direction = 'BUY' AND usd_amount >= 5))
      WHERE page < 4 AND seen < 6 AND price > 0.2 AND price < 0.9""",
)
def paged_eligible_trades(inputs: Inputs):
    bought = inputs.trades.where("direction = 'BUY' AND usd_amount >= 5").select("trade_id", "condition_id", "timestamp", "price")
    eligible = (F.col("price") > 0.2) & (F.col("price") < 0.9)
    return sampling.paged_eligible(bought, eligible, page_rows=5, enough=6).drop("timestamp")


@query(
    "split_by_bucket",
    """SELECT trade_id, t.address, CAST((SELECT COUNT(*) FROM bounds WHERE bounds.address <= t.address) AS INT) AS bucket,
      (SELECT COUNT(*) FROM bounds WHERE bounds.address <= t.address) <= 4 AS is_train
      FROM trades t""",
    """members AS (SELECT address, ROW_NUMBER() OVER (ORDER BY address) - 1 AS nth, COUNT(*) OVER () AS n
      FROM (SELECT DISTINCT address FROM trades)),
    bounds AS (SELECT address FROM members WHERE nth % (n // 5) = 0 AND nth // (n // 5) < 5)""",
)
def split_by_bucket(inputs: Inputs):
    """All trades laid out by address range; the training part and the rest each open only their folders."""
    members = inputs.trades.select("trade_id", "address")
    path = scratch_path(inputs.spark, "ranges")
    layout.write_ranges(members, path, sampling.address_bounds(members))
    trained = F.col(layout.RANGE) < sampling.TRAIN_RANGES
    parts = [layout.read_ranges(inputs.spark, path, wanted).withColumn("is_train", F.lit(value)) for wanted, value in ((trained, True), (~trained, False))]
    return parts[0].unionByName(parts[1]).select("trade_id", "address", "bucket", "is_train")


@query(
    "first_per_category",
    f"""SELECT category, address, nTrades, {r("win_rate")} FROM segmented
      QUALIFY ROW_NUMBER() OVER (PARTITION BY category ORDER BY address) = 1""",
    PROFILE_CTE,
)
def first_per_category(inputs: Inputs):
    first = sampling.first_rows(segmented_profile(inputs), ["category"], ["address"])
    return rounded(first.select("category", "address", "nTrades", "win_rate"), "win_rate")
