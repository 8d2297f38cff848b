"""Point-in-time features of traders and markets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradewake.functions import labels, scalars
from tradewake.operators import prefix
from tradewake.operators.prefix import DEFAULT_POLICY, SplitPolicy
from tradewake.session import cut_lineage

# Input columns of the models, in training order.
FEATURE_COLUMNS = (
    "time_since_start", "time_until_end", "hour_of_day", "day_of_week", "winrate",
    "cum_spent_prior", "cum_max_spent", "highest_price_yet", "lowest_price_yet", "avg_price",
    "time_since_last_trade", "role", "usd_amount", "token_amount", "price", "direction",
)
# Fixed value: length of the trade-count window in seconds.
WINDOW_SECONDS = 3600


def label_trades(trades: DataFrame, markets: DataFrame) -> DataFrame:
    """Trades with ``won``; trades of unknown markets stay, with a null label."""
    prices = markets.select("condition_id", "outcome_prices")
    joined = trades.join(prices, "condition_id", "left")
    won = labels.won_by_prices(F.col("nonusdc_side"), F.col("outcome_prices"))
    return joined.select(*trades.columns, won.alias("won"))


def trader_history(labelled: DataFrame, policy: SplitPolicy = DEFAULT_POLICY, sizing: DataFrame | None = None) -> DataFrame:
    """Running features of each trader, from that trader's earlier trades.

    Maxima and minima include the current trade and trades of the same second;
    sums and counts of wins exclude the current trade.
    """
    specs = [
        prefix.ordinal("cum_trades"),
        prefix.prior_sum("cum_spent_prior", "usd_amount"),
        prefix.peer_max("cum_max_spent", "usd_amount"),
        prefix.peer_max("highest_price_yet", "price"),
        prefix.peer_min("lowest_price_yet", "price"),
        prefix.prior_sum("prior_wins", "_won"),
        prefix.prior_sum("cum_price_prior", "price"),
        prefix.prior_value("_previous", "timestamp"),
    ]
    ready = labelled.withColumn("_won", F.col("won").cast("int"))
    out = prefix.running_columns(ready, ["address"], ["timestamp", "trade_id"], specs, policy, sizing)
    return out.withColumn("time_since_last_trade", F.col("timestamp") - F.col("_previous")).drop("_won", "_previous")


def with_trader_ratios(history: DataFrame) -> DataFrame:
    """Win rate and average price so far.

    ``winrate`` and ``avg_price`` divide by a count that includes the current
    trade; ``winrate_prior`` and ``avg_price_prior`` divide by earlier trades only.
    """
    earlier = F.col("cum_trades") - 1
    return history.withColumns(
        {
            "winrate": F.col("prior_wins") / F.col("cum_trades"),
            "avg_price": F.col("cum_price_prior") / F.col("cum_trades"),
            "winrate_prior": scalars.ratio(F.col("prior_wins"), earlier),
            "avg_price_prior": scalars.ratio(F.col("cum_price_prior"), earlier),
        }
    )


def feature_table(history: DataFrame, markets: DataFrame) -> DataFrame:
    """Model inputs of every trade, with market times and coded columns."""
    dates = markets.select(
        "condition_id",
        scalars.epoch_of(F.col("created_at")).alias("_created"),
        scalars.epoch_of(F.col("end_date")).alias("_end"),
    )
    at = F.col("timestamp")
    out = (
        with_trader_ratios(history)
        .join(dates, "condition_id", "left")
        .withColumns(
            {
                "time_since_start": at - F.col("_created"),
                "time_until_end": F.col("_end") - at,
                "hour_of_day": scalars.hour_of_day(at),
                "day_of_week": scalars.weekday_from_monday_1(at),
                "direction": scalars.direction_code(F.col("direction")),
            }
        )
    )
    return out.select("trade_id", "address", "condition_id", *FEATURE_COLUMNS, "winrate_prior", "avg_price_prior", "won")


def market_average_so_far(
    trades: DataFrame, value: str = "usd_amount", name: str = "market_avg_size_so_far", policy: SplitPolicy = DEFAULT_POLICY,
    sizing: DataFrame | None = None,
) -> DataFrame:
    """Mean size of the market's earlier trades, null for the first one."""
    specs = [prefix.prior_sum("_sum", value), prefix.prior_count("_count", value)]
    out = prefix.running_columns(trades, ["condition_id"], ["timestamp", "trade_id"], specs, policy, sizing)
    return out.withColumn(name, scalars.ratio(F.col("_sum"), F.col("_count"))).drop("_sum", "_count")


def window_trade_count(
    trades: DataFrame, seconds: int = WINDOW_SECONDS, look_ahead: bool = False, source: DataFrame | None = None,
    policy: SplitPolicy = DEFAULT_POLICY,
) -> DataFrame:
    """Trades of the same market in the last ``seconds``, the current second included.

    ``look_ahead`` gives the count without an upper bound: everything from
    ``seconds`` before the trade to the end of the market. Each count is a
    difference of two growing frames, which cost one pass.

    With a very large market, trades are first counted per second, so that its
    window has at most one row per second of its life, and the counts are joined
    back. ``source`` may name a cheaper frame with the same trades to count from.
    """
    counted = trades if source is None else source
    market = Window.partitionBy("condition_id")
    growing = market.orderBy("timestamp").rangeBetween
    everything = market if look_ahead else growing(Window.unboundedPreceding, 0)
    too_old = growing(Window.unboundedPreceding, -seconds - 1)
    if not prefix.has_large_keys(counted, ["condition_id"], policy):
        one = F.lit(1)
        return trades.withColumn("window_trade_count", F.count(one).over(everything) - F.count(one).over(too_old))

    per_second = counted.groupBy("condition_id", "timestamp").agg(F.count(F.lit(1)).alias("_n"))
    in_window = F.sum("_n").over(everything) - F.coalesce(F.sum("_n").over(too_old), F.lit(0))
    # Written out, the counts are a plain side of the join: broadcast when small,
    # else sorted and merged with hot keys split at run time.
    counts = cut_lineage(per_second.select("condition_id", "timestamp", in_window.alias("window_trade_count")))
    same = F.col("t.condition_id").eqNullSafe(F.col("c.condition_id")) & (F.col("t.timestamp") == F.col("c.timestamp"))
    return trades.alias("t").join(counts.alias("c"), same, "left").select("t.*", "c.window_trade_count")


def trades_per_user_market(trades: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """Labelled trades of the same trader in the same market, on every trade; null keys drop out.

    Counted with partial aggregation and joined back, so that one very active
    pair is not gathered in one task. ``source`` may name a cheaper frame with the
    same trades to count from.
    """
    keys = ["address", "condition_id"]
    known = (trades if source is None else source).dropna(subset=keys)
    counts = cut_lineage(known.groupBy(*keys).agg(F.count("won").alias("trade_by_user_per_market")))
    return trades.join(counts, keys, "inner")


def time_since_last(trades: DataFrame, last_trades: DataFrame, policy: SplitPolicy = DEFAULT_POLICY) -> DataFrame:
    """Seconds since the previous trade of the batch, else since the trader's last known trade.

    The known trade may lie after the current one, so the result can be negative.
    """
    # Joined before the window, so that a trader cut into chunks is not gathered again.
    known = trades.join(last_trades.select("address", "last_trade"), "address", "left")
    previous = [prefix.prior_value("_previous", "timestamp")]
    numbered = prefix.running_columns(known, ["address"], ["timestamp", "trade_id"], previous, policy, sizing=trades)
    since = F.col("timestamp") - F.coalesce("_previous", "last_trade")
    return numbered.select(*trades.columns, since.alias("time_since_last_trade"))


def price_series(trades: DataFrame, markets: DataFrame) -> DataFrame:
    """Prices of winning and losing tokens in time order per market."""
    tokens = markets.select("condition_id", "token1", "token2", "outcome_prices")
    asset = F.when(F.col("nonusdc_side") == "token1", F.col("token1")).otherwise(F.col("token2"))
    winner = labels.winner_token(F.col("outcome_prices"), F.col("token1"), F.col("token2"))
    return (
        trades.join(tokens, "condition_id", "inner")
        .where(F.col("outcome_prices").isNotNull())
        .select("condition_id", "timestamp", "trade_id", asset.alias("asset_id"), (asset == winner).alias("is_winner"), "price")
        .orderBy("condition_id", "timestamp", "trade_id")
    )
