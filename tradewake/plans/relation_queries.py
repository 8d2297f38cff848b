"""Filters, joins, set operations and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradewake.functions import labels, scalars
from tradewake.operators import aggregates, relations, windows
from tradewake.plans.catalog import query, r, rounded
from tradewake.plans.inputs import Inputs, with_outcome, with_outcome_names
from tradewake.session import cut_lineage, scratch_path
from tradewake.sources import layout, tables

TARGET_MARKET = 7

# Market and trader attributes of the older row store, with times as ISO text.
LEGACY_CTE = """
legacy_markets AS (
  SELECT condition_id, volume,
    CASE WHEN outcome_prices LIKE '__1%' THEN name1 WHEN outcome_prices LIKE '__0''%' THEN name2 END AS market_outcome,
    CASE WHEN condition_id % 31 <> 0 THEN epoch_us(end_date)//1000000 END AS endDate,
    epoch_us(created_at)//1000000 + 86400 AS startDate,
    epoch_us(end_date)//1000000 + 172800 AS updatedAt,
    epoch_us(created_at)//1000000 AS marketCreate FROM named_markets),
legacy_users AS (
  SELECT address, epoch_us(created_at)//1000000 AS createdAt, address % 7 AS n_markets, address % 40 AS n_trades,
    address % 5 AS n_wins, weighted_vol AS total_price, weighted_vol * 2 AS total_size FROM users),
parsed AS (
  SELECT t.*, m.* EXCLUDE (condition_id), u.* EXCLUDE (address)
  FROM named_trades t LEFT JOIN legacy_markets m ON t.condition_id = m.condition_id
    LEFT JOIN legacy_users u ON t.address = u.address
  WHERE endDate IS NOT NULL AND startDate IS NOT NULL AND updatedAt IS NOT NULL AND marketCreate IS NOT NULL
    AND createdAt IS NOT NULL AND endDate - timestamp > 30),
clean AS (
  SELECT trade_id, address, condition_id, timestamp, price, usd_amount, outcome, n_trades,
    CAST(COALESCE(outcome = market_outcome, FALSE) AS INT) AS won,
    updatedAt - startDate AS start_to_last_update, startDate - marketCreate AS created_to_start,
    endDate - timestamp AS trade_time_from_end, timestamp - createdAt AS account_age_at_trade,
    CAST(hour(make_timestamp(timestamp*1000000)) AS INT) AS hour_of_day,
    COUNT(*) OVER (PARTITION BY condition_id ORDER BY timestamp
      RANGE BETWEEN 3600 PRECEDING AND UNBOUNDED FOLLOWING) AS window_trade_count,
    AVG(usd_amount) OVER (PARTITION BY condition_id ORDER BY timestamp, trade_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS market_avg_size_so_far,
    COUNT(*) OVER (PARTITION BY address, condition_id) AS trade_by_user_per_market,
    usd_amount / volume AS size_vol,
    CAST(n_markets AS DOUBLE) / NULLIF(n_trades, 0) AS nmark_ntrades, CAST(n_wins AS DOUBLE) / NULLIF(n_trades, 0) AS nwins_ntrades,
    total_price / NULLIF(n_trades, 0) AS avg_price, total_size / NULLIF(n_trades, 0) AS avg_size
  FROM parsed)
"""

DETAILS_CTE = f"""
target AS (SELECT epoch_us(end_date)//1000000 AS target_end, epoch_us(created_at)//1000000 AS target_start
  FROM markets WHERE condition_id = {TARGET_MARKET}),
history AS (
  SELECT t.*, CASE WHEN outcome_prices LIKE '%0.5%' THEN 0
      WHEN outcome_prices LIKE '__1%' THEN CAST(outcome = name1 AS INT) ELSE CAST(outcome = name2 AS INT) END AS won
  FROM named_trades t JOIN named_markets m ON t.condition_id = m.condition_id
  WHERE outcome_prices IS NOT NULL AND created_at IS NOT NULL AND end_date IS NOT NULL
    AND t.condition_id <> {TARGET_MARKET} AND timestamp < (SELECT target_end FROM target)
    AND direction = 'BUY' AND usd_amount >= 2),
as_of AS (
  SELECT address, AVG(price) AS avg_price, MAX(price) AS highest_price_yet, MIN(price) AS lowest_price_yet,
    AVG(usd_amount) AS avg_spent, MAX(usd_amount) AS max_spent, COUNT(DISTINCT condition_id) AS nMarkets,
    COUNT(*) AS nTrades, SUM(usd_amount) AS total_spent, AVG(won) AS win_rate, MAX(timestamp) AS last_trade
  FROM history GROUP BY address)
"""


def _iso(moment):
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def legacy_markets(inputs: Inputs):
    key, made, end = F.col("condition_id"), F.col("created_at"), F.col("end_date")
    m = with_outcome_names(inputs.markets)
    return m.select(
        key, "volume",
        labels.winner_outcome(F.col("outcomes"), F.col("outcome_prices")).alias("market_outcome"),
        F.when(key % 31 == 0, "unknown").otherwise(_iso(end)).alias("endDate"),
        _iso(made + F.expr("INTERVAL '1' DAY")).alias("startDate"),
        _iso(end + F.expr("INTERVAL '2' DAY")).alias("updatedAt"),
        _iso(made).alias("marketCreate"),
    )


def legacy_users(inputs: Inputs):
    key = F.col("address")
    return inputs.users.select(
        key, _iso(F.col("created_at")).alias("createdAt"), (key % 7).alias("n_markets"), (key % 40).alias("n_trades"),
        (key % 5).alias("n_wins"), F.col("weighted_vol").alias("total_price"), (F.col("weighted_vol") * 2).alias("total_size"),
    )


def clean_dataset(inputs: Inputs):
    """Cleaned trades with the market windows and the per-pair count.

    The cleaned rows feed three computations, so they are written once.
    """
    trades = with_outcome(inputs.trades)
    cleaned = cut_lineage(relations.clean_trades(trades, legacy_markets(inputs), legacy_users(inputs)))
    averaged = windows.market_average_so_far(cleaned)
    counted = windows.window_trade_count(averaged, look_ahead=True, source=cleaned)
    return windows.trades_per_user_market(counted, source=cleaned)


CLEAN_COLUMNS = (
    "trade_id", "address", "condition_id", "timestamp", "price", "usd_amount", "outcome", "n_trades", "won",
    "start_to_last_update", "created_to_start", "trade_time_from_end", "account_age_at_trade", "hour_of_day",
    "window_trade_count", "market_avg_size_so_far", "trade_by_user_per_market", "size_vol", "nmark_ntrades",
    "nwins_ntrades", "avg_price", "avg_size",
)


@query(
    "clean_trades",
    f"""SELECT * REPLACE ({r("market_avg_size_so_far")}, {r("size_vol", 9)}, {r("nmark_ntrades")}, {r("nwins_ntrades")},
      {r("avg_price")}, {r("avg_size")}) FROM clean""",
    LEGACY_CTE,
)
def clean_trades(inputs: Inputs):
    out = clean_dataset(inputs).select(*CLEAN_COLUMNS)
    out = rounded(out, "market_avg_size_so_far", "nmark_ntrades", "nwins_ntrades", "avg_price", "avg_size")
    return rounded(out, "size_vol", digits=9)


@query("scan_project", "SELECT trade_id, address, price, usd_amount FROM trades")
def scan_project(inputs: Inputs):
    return inputs.trades.select("trade_id", "address", "price", "usd_amount")


@query(
    "filter_price_band",
    " UNION ALL ".join(
        f"SELECT '{lo}-{hi}' AS band, trade_id, price FROM trades WHERE price > {lo} AND price < {hi}"
        for lo, hi in relations.PRICE_BANDS
    ),
)
def filter_price_band(inputs: Inputs):
    return relations.by_price_band(inputs.trades.select("trade_id", "price")).select("band", "trade_id", "price")


@query(
    "filter_buy_min_notional",
    "SELECT trade_id, direction, usd_amount FROM trades WHERE direction = 'BUY' AND usd_amount >= 5",
)
def filter_buy_min_notional(inputs: Inputs):
    kept = relations.buys_of_at_least(inputs.trades, relations.MIN_NOTIONAL_LIVE)
    return kept.select("trade_id", "direction", "usd_amount")


@query(
    "filter_markets",
    """SELECT condition_id, volume, tags FROM markets WHERE volume > 600000
      AND epoch_us(created_at)//1000000 >= 1699574400 AND epoch_us(end_date)//1000000 <= 1707436800
      AND (tags IS NULL OR tags <> 'SMALL')""",
)
def filter_markets(inputs: Inputs):
    chosen = relations.select_markets(
        inputs.markets, relations.VOLUME_MINIMUMS[2], start_epoch=1_699_574_400, closed_before=1_707_436_800, excluded_tag="SMALL"
    )
    return chosen.select("condition_id", "volume", "tags")


@query(
    "having_min_trades",
    """SELECT trade_id, condition_id FROM trades WHERE condition_id IN
      (SELECT condition_id FROM trades WHERE direction = 'BUY' GROUP BY condition_id HAVING COUNT(*) >= 20) AND direction = 'BUY'""",
)
def having_min_trades(inputs: Inputs):
    bought = inputs.trades.where(F.col("direction") == "BUY").select("trade_id", "condition_id")
    return relations.of_busy_markets(bought, 20)


@query(
    "filter_recurrence",
    """SELECT condition_id, recurrences, tags FROM markets
      WHERE NOT (recurrences IS NULL AND tags IS NULL) AND recurrences != ''""",
)
def filter_recurrence(inputs: Inputs):
    return relations.with_usable_recurrence(inputs.markets).select("condition_id", "recurrences", "tags")


@query(
    "filter_resolved",
    "SELECT condition_id, outcome_prices FROM markets WHERE outcome_prices LIKE '%''1''%'",
)
def filter_resolved(inputs: Inputs):
    return relations.settled_markets(inputs.markets).select("condition_id", "outcome_prices")


@query(
    "point_lookup",
    f"""SELECT trade_id, address, condition_id, direction, price FROM trades
      WHERE condition_id = {TARGET_MARKET} OR address = 3 OR (direction = 'BUY' AND price > 0.5)""",
)
def point_lookup(inputs: Inputs):
    """A lookup table in order of the market with Bloom filters on the trader; each condition is a scan of its own."""
    path = scratch_path(inputs.spark, "lookup")
    trades = inputs.trades.select("trade_id", "address", "condition_id", "direction", "price")
    layout.write_lookup(trades, path, "condition_id", ["address"], distinct=100_000)
    return layout.lookup(inputs.spark, path, F.col("condition_id") == TARGET_MARKET, F.col("address") == 3, (F.col("direction") == "BUY") & (F.col("price") > 0.5))


@query(
    "replace_category",
    """SELECT trade_id, price + CASE WHEN category = 'Home' THEN 1 ELSE 0 END AS price, category
      FROM (SELECT trade_id, price, outcome AS category FROM named_trades)""",
)
def replace_category(inputs: Inputs):
    """Trades stored by outcome name; one name's trades are written anew and the other folders stay."""
    path = scratch_path(inputs.spark, "categories")
    trades = with_outcome(inputs.trades).select("trade_id", "price", F.col("outcome").alias("category"))
    layout.replace_parts(trades, path, "category")
    layout.replace_parts(trades.where("category = 'Home'").withColumn("price", F.col("price") + 1), path, "category")
    return tables.read_table(inputs.spark, path)


@query(
    "join_inner_three",
    """SELECT t.trade_id, t.condition_id, t.address, t.price, m.volume, u.weighted_vol
      FROM trades t JOIN markets m ON t.condition_id = m.condition_id JOIN users u ON t.address = u.address""",
)
def join_inner_three(inputs: Inputs):
    joined = relations.trades_markets_users(inputs.trades, inputs.markets.drop("created_at"), inputs.users.drop("created_at"))
    return joined.select("trade_id", "condition_id", "address", "price", "volume", "weighted_vol")


@query(
    "market_trade_features",
    f"""SELECT trade_id, t.condition_id, timestamp, price, usd_amount,
      timestamp - epoch_us(created_at)//1000000 AS start_to_trade, epoch_us(end_date)//1000000 - timestamp AS trade_to_end,
      {r("usd_amount / volume", 9, "relative_size_usd")}, {r("token_amount / volume", 9, "relative_size_token")},
      {r("usd_amount / (1 - price)", 4, "confidence_show_usd")}, {r("token_amount / (1 - price)", 4, "confidence_show_token")},
      CAST(hour(make_timestamp(timestamp*1000000)) AS INT) AS hour_of_day
      FROM trades t JOIN markets m ON t.condition_id = m.condition_id
      WHERE created_at IS NOT NULL AND end_date IS NOT NULL AND price > 0.4 AND price < 0.6""",
)
def market_trade_features(inputs: Inputs):
    banded = relations.in_price_band(inputs.trades, *relations.PRICE_BANDS[3])
    out = relations.market_trade_features(banded, inputs.markets).drop(
        "address", "token_amount", "direction", "role", "nonusdc_side"
    )
    return rounded(rounded(out, "relative_size_usd", "relative_size_token", digits=9), "confidence_show_usd", "confidence_show_token", digits=4)


@query(
    "join_tags",
    """SELECT m.condition_id, m.volume, l.tags, l.recurrences FROM (SELECT condition_id, volume FROM markets) m
      LEFT JOIN (SELECT condition_id, tags, recurrences FROM markets WHERE condition_id % 3 <> 0) l
      ON m.condition_id = l.condition_id""",
)
def join_tags(inputs: Inputs):
    lookup = inputs.markets.where("condition_id % 3 <> 0")
    return relations.with_tags(inputs.markets.select("condition_id", "volume"), lookup)


@query(
    "semi_join_segment",
    """SELECT trade_id, address, usd_amount FROM trades WHERE address IN
      (SELECT address FROM labelled GROUP BY address HAVING AVG(CAST(won AS INT)) > 0.5)""",
)
def semi_join_segment(inputs: Inputs):
    labelled = windows.label_trades(inputs.trades, inputs.markets)
    winners = cut_lineage(labelled.groupBy("address").agg(F.avg(F.col("won").cast("int")).alias("rate")).where("rate > 0.5"))
    return relations.of_addresses(inputs.trades.select("trade_id", "address", "usd_amount"), winners)


@query(
    "won_by_outcome",
    """SELECT trade_id, outcome, CAST(CASE WHEN outcome = (SELECT CASE WHEN outcome_prices LIKE '__1%' THEN name1
        WHEN outcome_prices LIKE '__0''%' THEN name2 END FROM named_markets m WHERE m.condition_id = t.condition_id)
        THEN 1 ELSE 0 END AS INT) AS won FROM named_trades t""",
)
def won_by_outcome(inputs: Inputs):
    winners = legacy_markets(inputs).select("condition_id", "market_outcome")
    return relations.label_by_outcome(with_outcome(inputs.trades), winners).select("trade_id", "outcome", "won")


@query(
    "join_then_group",
    f"""SELECT u.age_group, {r("AVG(t.price)", name="avg_price")}, COUNT(*) AS trade_count
      FROM trades t JOIN (SELECT address, address % 30 AS age_group FROM users) u ON t.address = u.address GROUP BY u.age_group""",
)
def join_then_group(inputs: Inputs):
    ages = inputs.users.select("address", (F.col("address") % 30).alias("age_group"))
    joined = inputs.trades.join(ages, "address", "inner")
    grouped = joined.groupBy("age_group").agg(F.avg("price").alias("avg_price"), F.count(F.lit(1)).alias("trade_count"))
    return rounded(grouped, "avg_price")


@query(
    "anti_join_seen",
    "SELECT condition_id, volume FROM markets WHERE condition_id NOT IN (SELECT condition_id FROM trades WHERE direction = 'SELL' AND usd_amount > 100)",
)
def anti_join_seen(inputs: Inputs):
    seen = inputs.trades.where("direction = 'SELL' AND usd_amount > 100")
    return relations.unseen(inputs.markets.select("condition_id", "volume"), seen, "condition_id")


def target_times(inputs: Inputs) -> tuple[int, int]:
    """Start and end of the target market: one row by key."""
    times = inputs.markets.where(F.col("condition_id") == TARGET_MARKET).select(
        scalars.epoch_of(F.col("created_at")).alias("s"), scalars.epoch_of(F.col("end_date")).alias("e")
    )
    row = times.first()
    return row["s"], row["e"]


def as_of_features(inputs: Inputs, end: int):
    bought = relations.buys_of_at_least(with_outcome(inputs.trades), relations.MIN_NOTIONAL_HISTORY)
    return aggregates.trader_features_as_of(bought, with_outcome_names(inputs.markets), TARGET_MARKET, end)


@query(
    "user_features_asof",
    f"""SELECT * REPLACE ({r("avg_price")}, {r("avg_spent")}, {r("total_spent", 4)}, {r("win_rate")}) FROM as_of""",
    DETAILS_CTE,
)
def user_features_asof(inputs: Inputs):
    out = as_of_features(inputs, target_times(inputs)[1])
    return rounded(rounded(out, "avg_price", "avg_spent", "win_rate"), "total_spent", digits=4)


def live_trades(inputs: Inputs):
    """Trades of the target market that are scored."""
    bought = relations.buys_of_at_least(with_outcome(inputs.trades), relations.MIN_NOTIONAL_LIVE)
    return relations.in_price_band(bought.where(F.col("condition_id") == TARGET_MARKET), *relations.PRICE_BANDS[1])


def scoring_inputs(inputs: Inputs):
    start, end = target_times(inputs)
    features = cut_lineage(as_of_features(inputs, end))
    live = live_trades(inputs)
    since = windows.time_since_last(live, features)
    return relations.scoring_frame(features, since, start, end)


@query(
    "score_live",
    f"""SELECT a.address, trade_id, timestamp - target_start AS time_since_start, target_end - timestamp AS time_until_end,
      CAST(hour(make_timestamp(timestamp*1000000)) AS INT) AS hour_of_day,
      CAST(isodow(make_timestamp(timestamp*1000000)) - 1 AS INT) AS day_of_week,
      {r("win_rate", name="winrate")}, {r("total_spent", 4, "cum_spent_prior")}, max_spent AS cum_max_spent,
      highest_price_yet, lowest_price_yet, {r("avg_price")},
      timestamp - COALESCE(LAG(timestamp) OVER (PARTITION BY l.address ORDER BY timestamp, trade_id), last_trade) AS time_since_last_trade,
      CAST(1 AS INT) AS role, usd_amount, {r("usd_amount * price", 4, "token_amount")}, price,
      CAST(COALESCE(direction = 'BUY', FALSE) AS INT) AS direction, outcome
      FROM as_of a LEFT JOIN live l ON a.address = l.address CROSS JOIN target""",
    DETAILS_CTE + f""",
live AS (SELECT * FROM named_trades WHERE condition_id = {TARGET_MARKET} AND direction = 'BUY' AND usd_amount >= 5
  AND price > 0.2 AND price < 0.9)""",
)
def score_live(inputs: Inputs):
    out = scoring_inputs(inputs)
    return rounded(rounded(out, "winrate", "avg_price"), "cum_spent_prior", "token_amount", digits=4)


@query(
    "union_all",
    """SELECT trade_id, condition_id, price FROM trades WHERE condition_id = 1 AND price > 0.05 AND price < 0.95
      UNION ALL SELECT trade_id, condition_id, price FROM trades WHERE condition_id <> 1 AND price > 0.4 AND price < 0.6""",
)
def union_all(inputs: Inputs):
    columns = ["trade_id", "condition_id", "price"]
    first = relations.in_price_band(inputs.trades.where("condition_id = 1"), *relations.PRICE_BANDS[2])
    rest = relations.in_price_band(inputs.trades.where("condition_id <> 1"), *relations.PRICE_BANDS[3])
    return relations.union_all(first.select(*columns), rest.select(*columns))


@query(
    "union_missing_cols",
    """SELECT trade_id, CAST(price > 0.8 AS INT) AS prediction, CAST(price > 0.6 AS INT) AS predictionold
      FROM trades WHERE address % 4 = 0
      UNION ALL SELECT trade_id, CAST(price > 0.8 AS INT), NULL FROM trades WHERE address % 4 <> 0""",
)
def union_missing_cols(inputs: Inputs):
    new = scalars.flag(F.col("price") > 0.8).alias("prediction")
    old = scalars.flag(F.col("price") > 0.6).alias("predictionold")
    noisy = inputs.trades.where("address % 4 = 0").select("trade_id", new, old)
    return relations.union_all(noisy, inputs.trades.where("address % 4 <> 0").select("trade_id", new))
