"""Filters, joins and unions between trades, markets and users.

No join here carries a broadcast hint: Spark broadcasts a side it has measured as
small and otherwise sorts and merges, where adaptive execution splits hot keys. It
can do so only when both sides come straight from a shuffle, so a side that is an
aggregate is written out first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewake.functions import labels, scalars
from tradewake.session import cut_lineage

# Open price bands in use.
PRICE_BANDS = ((0.1, 0.9), (0.2, 0.9), (0.05, 0.95), (0.4, 0.6))
# Notional minimum of history and of live trades.
MIN_NOTIONAL_HISTORY, MIN_NOTIONAL_LIVE = 2, 5
# Volume minimums of the market selections.
VOLUME_MINIMUMS = (100_000, 300_000, 600_000, 1_000_000)
# Fixed value: fewest trades of a holdout market.
MIN_MARKET_TRADES = 100
# Fixed value: trades this close to the end (seconds) are dropped.
LATE_TRADE_SECONDS = 30


def in_price_band(trades: DataFrame, low: float, high: float) -> DataFrame:
    """Trades strictly inside a price band."""
    return trades.where((F.col("price") > low) & (F.col("price") < high))


def by_price_band(trades: DataFrame, bands=PRICE_BANDS) -> DataFrame:
    """Each trade once per band it lies in, named ``low-high``; one scan for all bands."""
    names = [F.when((F.col("price") > lo) & (F.col("price") < hi), f"{lo}-{hi}") for lo, hi in bands]
    return trades.select("*", F.explode(F.array_compact(F.array(*names))).alias("band"))


def buys_of_at_least(trades: DataFrame, notional: float) -> DataFrame:
    """Buys with a minimum notional."""
    return trades.where((F.col("direction") == "BUY") & (F.col("usd_amount") >= notional))


def select_markets(markets: DataFrame, min_volume: float, start_epoch: int | None = None, closed_before: int | None = None,
                   excluded_tag: str | None = None) -> DataFrame:
    """Markets above a volume, started after a time, closed by a time, without a tag."""
    out = markets.where(F.col("volume") > min_volume)
    if start_epoch is not None:
        out = out.where(scalars.epoch_of(F.col("created_at")) >= start_epoch)
    if closed_before is not None:
        out = out.where(scalars.epoch_of(F.col("end_date")) <= closed_before)
    if excluded_tag is not None:
        out = out.where(~F.coalesce(F.col("tags") == excluded_tag, F.lit(False)))
    return out


def of_busy_markets(trades: DataFrame, min_trades: int = MIN_MARKET_TRADES) -> DataFrame:
    """Trades of markets with enough trades."""
    busy = cut_lineage(trades.groupBy("condition_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_trades))
    return trades.join(busy, "condition_id", "left_semi")


def with_usable_recurrence(markets: DataFrame) -> DataFrame:
    """Drop markets without recurrence; a null recurrence is dropped even when tags exist."""
    return markets.where("NOT (recurrences IS NULL AND tags IS NULL) AND recurrences <> ''")


def settled_markets(markets: DataFrame) -> DataFrame:
    """Markets with a price settled at exactly 1."""
    return markets.where(labels.is_settled(F.col("outcome_prices")))


def with_tags(markets: DataFrame, lookup: DataFrame) -> DataFrame:
    """Attach tags and recurrences from the lookup."""
    return markets.join(lookup.select("condition_id", "tags", "recurrences"), "condition_id", "left")


def of_addresses(trades: DataFrame, addresses: DataFrame) -> DataFrame:
    """Trades of the given addresses, each trade once."""
    return trades.join(addresses.select("address"), "address", "left_semi")


def unseen(candidates: DataFrame, known: DataFrame, *keys: str) -> DataFrame:
    """Rows whose key is not known yet."""
    return candidates.join(known.select(*keys), list(keys), "left_anti")


def label_by_outcome(trades: DataFrame, winners: DataFrame) -> DataFrame:
    """0/1 label: outcome equals the market's winner; unknown markets count as lost."""
    joined = trades.join(winners.select("condition_id", "market_outcome"), "condition_id", "left")
    return joined.select(*trades.columns, scalars.flag(F.col("outcome") == F.col("market_outcome")).alias("won"))


def trades_markets_users(trades: DataFrame, markets: DataFrame, users: DataFrame) -> DataFrame:
    """Inner join of all three entities."""
    return trades.join(markets, "condition_id", "inner").join(users, "address", "inner")


def clean_trades(trades: DataFrame, markets: DataFrame, users: DataFrame) -> DataFrame:
    """Cleaned trade rows: label, times, late-trade cut and per-trader ratios.

    Expects market times as ISO text (``endDate, startDate, updatedAt,
    marketCreate``) and the trader's ``createdAt``; rows with an unreadable time
    are dropped.
    """
    times = ["endDate", "startDate", "updatedAt", "marketCreate", "createdAt"]
    joined = trades.join(markets, "condition_id", "left").join(users, "address", "left")
    parsed = joined.withColumns({t: scalars.epoch_of_text(F.col(t)) for t in times}).dropna(subset=times)
    at = F.col("timestamp")
    kept = parsed.withColumns(
        {
            "won": scalars.flag(F.col("outcome") == F.col("market_outcome")),
            "start_to_last_update": F.col("updatedAt") - F.col("startDate"),
            "created_to_start": F.col("startDate") - F.col("marketCreate"),
            "trade_time_from_end": F.col("endDate") - at,
            "account_age_at_trade": at - F.col("createdAt"),
            "hour_of_day": scalars.hour_of_day(at),
        }
    ).where(F.col("trade_time_from_end") > LATE_TRADE_SECONDS)
    return kept.withColumns(
        {
            "size_vol": scalars.ratio(F.col("usd_amount"), F.col("volume")),
            "nmark_ntrades": scalars.ratio(F.col("n_markets"), F.col("n_trades")),
            "nwins_ntrades": scalars.ratio(F.col("n_wins"), F.col("n_trades")),
            "avg_price": scalars.ratio(F.col("total_price"), F.col("n_trades")),
            "avg_size": scalars.ratio(F.col("total_size"), F.col("n_trades")),
        }
    )


def market_trade_features(trades: DataFrame, markets: DataFrame) -> DataFrame:
    """Trade features relative to the market: times, relative size, shown confidence."""
    at, price = F.col("timestamp"), F.col("price")
    joined = trades.join(markets.select("condition_id", "volume", "created_at", "end_date"), "condition_id", "left")
    return joined.dropna(subset=["end_date", "created_at"]).select(
        *trades.columns,
        (at - scalars.epoch_of(F.col("created_at"))).alias("start_to_trade"),
        (scalars.epoch_of(F.col("end_date")) - at).alias("trade_to_end"),
        scalars.ratio(F.col("usd_amount"), F.col("volume")).alias("relative_size_usd"),
        scalars.ratio(F.col("token_amount"), F.col("volume")).alias("relative_size_token"),
        scalars.ratio(F.col("usd_amount"), 1 - price).alias("confidence_show_usd"),
        scalars.ratio(F.col("token_amount"), 1 - price).alias("confidence_show_token"),
        scalars.hour_of_day(at).alias("hour_of_day"),
    )


def scoring_frame(user_features: DataFrame, live: DataFrame, start_epoch: int, end_epoch: int) -> DataFrame:
    """Scoring inputs of live trades in one market; ``live`` carries ``time_since_last_trade``.

    Traders without a live trade stay, with empty trade columns. They are added
    by an anti-join: in an outer join a hot trader's trades could not be split.
    Keeps two conventions of the scoring side that differ from training: the day
    of week starts at Monday=0, and the token amount is size times price.
    """
    at = F.col("timestamp")
    columns = ["address", "trade_id", "usd_amount", "price", "timestamp", "direction", "outcome", "time_since_last_trade"]
    rows = live.select(*columns)
    idle = user_features.join(rows, "address", "left_anti")
    joined = union_all(rows.join(user_features, "address", "inner"), idle)
    return joined.select(
        "address", "trade_id",
        (at - start_epoch).alias("time_since_start"),
        (F.lit(end_epoch) - at).alias("time_until_end"),
        scalars.hour_of_day(at).alias("hour_of_day"),
        scalars.weekday_from_monday_0(at).alias("day_of_week"),
        F.col("win_rate").alias("winrate"),
        F.col("total_spent").alias("cum_spent_prior"),
        F.col("max_spent").alias("cum_max_spent"),
        "highest_price_yet", "lowest_price_yet", "avg_price", "time_since_last_trade",
        F.lit(1).alias("role"),
        "usd_amount",
        (F.col("usd_amount") * F.col("price")).alias("token_amount"),
        "price",
        scalars.direction_flag(F.col("direction")).alias("direction"),
        "outcome",
    )


def union_all(*frames: DataFrame) -> DataFrame:
    """Rows of all frames; a column missing from one frame is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
