"""Labels, point-in-time windows and feature tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradewake.operators import windows
from tradewake.plans.catalog import query, r, rounded
from tradewake.plans.inputs import Inputs, PROFILE_DATE_CTE
from tradewake.session import cut_lineage

PIT_CTE = """
pit AS (
  SELECT *,
    ROW_NUMBER() OVER w AS cum_trades,
    SUM(usd_amount) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cum_spent_prior,
    MAX(usd_amount) OVER (PARTITION BY address ORDER BY timestamp) AS cum_max_spent,
    MAX(price) OVER (PARTITION BY address ORDER BY timestamp) AS highest_price_yet,
    MIN(price) OVER (PARTITION BY address ORDER BY timestamp) AS lowest_price_yet,
    CAST(SUM(CAST(won AS INT)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT) AS prior_wins,
    SUM(price) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cum_price_prior,
    timestamp - LAG(timestamp) OVER w AS time_since_last_trade
  FROM labelled
  WINDOW w AS (PARTITION BY address ORDER BY timestamp, trade_id)),
ratios AS (
  SELECT *, CAST(prior_wins AS DOUBLE) / cum_trades AS winrate, cum_price_prior / cum_trades AS avg_price,
    CAST(prior_wins AS DOUBLE) / NULLIF(cum_trades - 1, 0) AS winrate_prior,
    cum_price_prior / NULLIF(cum_trades - 1, 0) AS avg_price_prior
  FROM pit),
features AS (
  SELECT trade_id, address, r.condition_id,
    timestamp - epoch_us(created_at)//1000000 AS time_since_start,
    epoch_us(end_date)//1000000 - timestamp AS time_until_end,
    CAST(hour(make_timestamp(timestamp*1000000)) AS INT) AS hour_of_day,
    CAST(isodow(make_timestamp(timestamp*1000000)) AS INT) AS day_of_week,
    winrate, cum_spent_prior, cum_max_spent, highest_price_yet, lowest_price_yet, avg_price,
    time_since_last_trade, role, usd_amount, token_amount, price,
    CAST(CASE direction WHEN 'BUY' THEN 1 WHEN 'SELL' THEN 0 ELSE -1 END AS INT) AS direction,
    winrate_prior, avg_price_prior, won
  FROM ratios r LEFT JOIN markets m ON r.condition_id = m.condition_id)
"""


def history(inputs: Inputs):
    labelled = windows.label_trades(inputs.trades, inputs.markets)
    return windows.trader_history(labelled, sizing=inputs.trades)


def features(inputs: Inputs):
    return windows.feature_table(history(inputs), inputs.markets)


@query(
    "label_won",
    "SELECT trade_id, address, condition_id, timestamp, nonusdc_side, price, usd_amount, won FROM labelled",
)
def label_won(inputs: Inputs):
    labelled = windows.label_trades(inputs.trades, inputs.markets)
    return labelled.select("trade_id", "address", "condition_id", "timestamp", "nonusdc_side", "price", "usd_amount", "won")


@query(
    "pit_features",
    f"""SELECT trade_id, address, condition_id, timestamp, usd_amount, price, won, cum_trades,
      {r("cum_spent_prior", 4)}, cum_max_spent, highest_price_yet, lowest_price_yet,
      prior_wins, {r("cum_price_prior", 4)}, time_since_last_trade FROM pit""",
    PIT_CTE,
)
def pit_features(inputs: Inputs):
    out = history(inputs).select(
        "trade_id", "address", "condition_id", "timestamp", "usd_amount", "price", "won", "cum_trades",
        "cum_spent_prior", "cum_max_spent", "highest_price_yet", "lowest_price_yet", "prior_wins",
        "cum_price_prior", "time_since_last_trade",
    )
    return rounded(out, "cum_spent_prior", "cum_price_prior", digits=4)


@query(
    "pit_ratios",
    f"""SELECT trade_id, address, cum_trades, {r("winrate")}, {r("avg_price")},
      {r("winrate_prior")}, {r("avg_price_prior")} FROM ratios""",
    PIT_CTE,
)
def pit_ratios(inputs: Inputs):
    names = ("winrate", "avg_price", "winrate_prior", "avg_price_prior")
    return rounded(windows.with_trader_ratios(history(inputs)).select("trade_id", "address", "cum_trades", *names), *names)


@query(
    "feature_table",
    f"""SELECT * REPLACE ({r("winrate")}, {r("cum_spent_prior", 4)}, {r("avg_price")}, {r("token_amount", 4)},
      {r("winrate_prior")}, {r("avg_price_prior")}) FROM features""",
    PIT_CTE,
)
def feature_table(inputs: Inputs):
    out = rounded(features(inputs), "winrate", "avg_price", "winrate_prior", "avg_price_prior")
    return rounded(out, "cum_spent_prior", "token_amount", digits=4)


@query(
    "market_avg_so_far",
    f"""SELECT trade_id, condition_id, timestamp, usd_amount, {r("market_avg_size_so_far")}
      FROM (SELECT *, AVG(usd_amount) OVER (PARTITION BY condition_id ORDER BY timestamp, trade_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS market_avg_size_so_far FROM trades)""",
)
def market_avg_so_far(inputs: Inputs):
    narrow = inputs.trades.select("trade_id", "condition_id", "timestamp", "usd_amount")
    return rounded(windows.market_average_so_far(narrow), "market_avg_size_so_far")


@query(
    "window_count_asis",
    """SELECT trade_id, condition_id, timestamp, COUNT(*) OVER (PARTITION BY condition_id ORDER BY timestamp
        RANGE BETWEEN 3600 PRECEDING AND UNBOUNDED FOLLOWING) AS window_trade_count FROM trades""",
)
def window_count_asis(inputs: Inputs):
    narrow = inputs.trades.select("trade_id", "condition_id", "timestamp")
    return windows.window_trade_count(narrow, look_ahead=True)


@query(
    "window_count_trailing",
    """SELECT trade_id, condition_id, timestamp, COUNT(*) OVER (PARTITION BY condition_id ORDER BY timestamp
        RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS window_trade_count FROM trades""",
)
def window_count_trailing(inputs: Inputs):
    narrow = inputs.trades.select("trade_id", "condition_id", "timestamp")
    return windows.window_trade_count(narrow)


@query(
    "trades_per_user_market",
    """SELECT trade_id, address, condition_id, won,
      COUNT(won) OVER (PARTITION BY address, condition_id) AS trade_by_user_per_market
      FROM labelled WHERE address IS NOT NULL AND condition_id IS NOT NULL""",
)
def trades_per_user_market(inputs: Inputs):
    labelled = windows.label_trades(inputs.trades, inputs.markets).select("trade_id", "address", "condition_id", "won")
    return windows.trades_per_user_market(labelled)


@query(
    "time_since_last",
    """SELECT t.trade_id, t.address, t.timestamp,
      t.timestamp - COALESCE(LAG(t.timestamp) OVER (PARTITION BY t.address ORDER BY t.timestamp, t.trade_id), last_trade)
        AS time_since_last_trade
      FROM trades t LEFT JOIN known k ON t.address = k.address WHERE t.timestamp >= (SELECT since FROM profile_date)""",
    PROFILE_DATE_CTE + ", known AS (SELECT address, MAX(timestamp) AS last_trade FROM trades WHERE timestamp < (SELECT since FROM profile_date) GROUP BY address)",
)
def time_since_last(inputs: Inputs):
    """All trades from the profile date on, with the last trades before it."""
    live = inputs.trades.where(F.col("timestamp") >= inputs.profile_date).select("trade_id", "address", "timestamp")
    past = inputs.trades.where(F.col("timestamp") < inputs.profile_date).groupBy("address").agg(F.max("timestamp").alias("last_trade"))
    return windows.time_since_last(live, cut_lineage(past))


@query(
    "price_series",
    """SELECT t.condition_id, timestamp, trade_id, CASE WHEN nonusdc_side = 'token1' THEN token1 ELSE token2 END AS asset_id,
      (CASE WHEN nonusdc_side = 'token1' THEN token1 ELSE token2 END)
        = (CASE WHEN outcome_prices LIKE '__1%' THEN token1 ELSE token2 END) AS is_winner, price
      FROM trades t JOIN markets m ON t.condition_id = m.condition_id WHERE outcome_prices IS NOT NULL
      ORDER BY t.condition_id, timestamp, trade_id""",
)
def price_series(inputs: Inputs):
    return windows.price_series(inputs.trades, inputs.markets)
