"""Scalar expressions over trades and markets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradewake.functions import labels, scalars
from tradewake.plans.catalog import query
from tradewake.plans.inputs import Inputs, with_outcome, with_outcome_names


@query(
    "winner_token",
    """SELECT condition_id, outcome_prices, CASE WHEN outcome_prices IS NULL THEN NULL
      WHEN outcome_prices LIKE '__1%' THEN token1 ELSE token2 END AS winner FROM markets""",
)
def winner_token(inputs: Inputs):
    winner = labels.winner_token(F.col("outcome_prices"), F.col("token1"), F.col("token2"))
    return inputs.markets.select("condition_id", "outcome_prices", winner.alias("winner"))


@query(
    "winner_outcome",
    """SELECT condition_id, CASE WHEN outcome_prices LIKE '__1''%' THEN name1 WHEN outcome_prices LIKE '%, ''1''%' THEN name2 END AS winner
      FROM named_markets""",
)
def winner_outcome(inputs: Inputs):
    winner = labels.winner_outcome(F.col("outcomes"), F.col("outcome_prices"))
    return with_outcome_names(inputs.markets).select("condition_id", winner.alias("winner"))


@query(
    "parse_outcomes",
    """SELECT condition_id, name1 AS first_outcome, name2 AS second_outcome,
      CASE WHEN outcome_prices LIKE '__1%' THEN 1.0::DOUBLE WHEN outcome_prices LIKE '__0.5%' THEN 0.5::DOUBLE
        WHEN outcome_prices IS NOT NULL THEN 0.0::DOUBLE END AS first_price FROM named_markets""",
)
def parse_outcomes(inputs: Inputs):
    names, prices = labels.string_list(F.col("outcomes")), labels.string_list(F.col("outcome_prices"))
    return with_outcome_names(inputs.markets).select(
        "condition_id", names[0].alias("first_outcome"), names[1].alias("second_outcome"),
        prices[0].cast("double").alias("first_price"),
    )


@query(
    "did_win_threshold",
    """SELECT trade_id, outcome, CASE WHEN outcome_prices LIKE '__1%' THEN outcome = name1 WHEN outcome_prices LIKE '%, ''1''%' THEN outcome = name2
      ELSE FALSE END AS won FROM named_trades t LEFT JOIN named_markets m ON t.condition_id = m.condition_id""",
)
def did_win_threshold(inputs: Inputs):
    lists = with_outcome_names(inputs.markets).select("condition_id", "outcomes", "outcome_prices")
    won = labels.won_by_threshold(F.col("outcome"), F.col("outcomes"), F.col("outcome_prices"))
    return with_outcome(inputs.trades).join(lists, "condition_id", "left").select("trade_id", "outcome", won.alias("won"))


@query(
    "winner_by_threshold",
    """SELECT condition_id, CAST(CASE WHEN outcome_prices LIKE '%, ''1''%' THEN 1 WHEN outcome_prices IS NOT NULL THEN 0 END AS INT) AS winning_index
      FROM markets""",
)
def winner_by_threshold(inputs: Inputs):
    return inputs.markets.select("condition_id", labels.winning_index_by_threshold(F.col("outcome_prices")).alias("winning_index"))


@query(
    "time_parts",
    """SELECT trade_id, timestamp, CAST(hour(make_timestamp(timestamp*1000000)) AS INT) AS hour_of_day,
      CAST(isodow(make_timestamp(timestamp*1000000)) AS INT) AS weekday_1, CAST(isodow(make_timestamp(timestamp*1000000)) - 1 AS INT) AS weekday_0
      FROM trades""",
)
def time_parts(inputs: Inputs):
    at = F.col("timestamp")
    return inputs.trades.select(
        "trade_id", "timestamp", scalars.hour_of_day(at).alias("hour_of_day"),
        scalars.weekday_from_monday_1(at).alias("weekday_1"), scalars.weekday_from_monday_0(at).alias("weekday_0"),
    )


@query(
    "direction_code",
    """SELECT trade_id, direction, CAST(CASE direction WHEN 'BUY' THEN 1 WHEN 'SELL' THEN 0 ELSE -1 END AS INT) AS code,
      CAST(direction = 'BUY' AS INT) AS is_buy FROM trades""",
)
def direction_code(inputs: Inputs):
    d = F.col("direction")
    return inputs.trades.select(
        "trade_id", "direction", scalars.direction_code(d).alias("code"), scalars.direction_flag(d).alias("is_buy")
    )


@query(
    "profile_flag",
    """SELECT event_id AS trade_id, CAST(COALESCE(LENGTH(CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN '-' END) > 0, FALSE) AS INT) AS on_insert,
      CAST(COALESCE(LENGTH(CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN '-' END) > 1, FALSE) AS INT) AS on_holdout FROM events""",
)
def profile_flag(inputs: Inputs):
    image = F.when(F.col("trade_id") % 3 == 0, "").when(F.col("trade_id") % 3 == 1, "-")
    return inputs.trades.select(
        "trade_id", scalars.longer_than(image, 0).alias("on_insert"), scalars.longer_than(image, 1).alias("on_holdout")
    )
