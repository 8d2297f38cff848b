"""Profiles, summaries and distributions."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import functions as F

from tradewake.operators import aggregates, windows
from tradewake.plans.catalog import query, r, rounded
from tradewake.plans.inputs import Inputs
from tradewake.plans.window_queries import PIT_CTE, features
from tradewake.session import cut_lineage

PROFILE_CTE = """
profile AS (
  SELECT address, COUNT(*) AS nTrades, COUNT(DISTINCT condition_id) AS nMarkets, AVG(CAST(won AS INT)) AS win_rate,
    AVG(usd_amount) AS avg_spent, SUM(usd_amount) AS total_spent, MAX(usd_amount) AS max_spent, AVG(price) AS avg_price
  FROM labelled GROUP BY address),
segmented AS (SELECT *, CAST(address % 4 - 1 AS INT) AS category FROM profile)
"""
PROFILE_ROUNDED = f"""SELECT * REPLACE ({r("win_rate")}, {r("avg_spent")}, {r("total_spent", 4)}, {r("avg_price")}) FROM profile"""
DESCRIBED = ("price", "usd_amount", "token_amount", "time_since_start", "time_until_end", "cum_spent_prior", "winrate")
CORRELATED = ("price", "usd_amount", "token_amount", "time_since_start", "time_until_end", "hour_of_day", "winrate")


def labelled_trades(inputs: Inputs):
    return windows.label_trades(inputs.trades, inputs.markets)


def segmented_profile(inputs: Inputs):
    """Exact trader profile with a given category per trader."""
    profile = aggregates.trader_profile(labelled_trades(inputs), approximate=False)
    return profile.withColumn("category", (F.col("address") % 4 - 1).cast("int"))


def _rounded_profile(df):
    return rounded(rounded(df, "win_rate", "avg_spent", "avg_price"), "total_spent", digits=4)


def _described(values: str, keys: str) -> str:
    """SQL of the describe table over a long relation."""
    names = "".join(f"{k}, " for k in keys.split(", "))
    return f"""SELECT {names}COUNT(value) AS count, {r("AVG(value)", name="mean")}, {r("STDDEV_SAMP(value)", name="std")},
      {r("MIN(value)", name="min")}, {r("MAX(value)", name="max")},
      {r("QUANTILE_CONT(value, 0.25)", name="p25")}, {r("QUANTILE_CONT(value, 0.5)", name="p50")},
      {r("QUANTILE_CONT(value, 0.75)", name="p75")} FROM ({values}) GROUP BY {keys}"""


def _rounded_description(df):
    return rounded(df, "mean", "std", "min", "max", "p25", "p50", "p75")


@query("user_profile", PROFILE_ROUNDED, PROFILE_CTE)
def user_profile(inputs: Inputs):
    return _rounded_profile(aggregates.trader_profile(labelled_trades(inputs), approximate=False))


@query("user_profile_approx")
def user_profile_approx(inputs: Inputs):
    """The sketch differs between engines; a test holds it to the exact count within tolerance."""
    return _rounded_profile(aggregates.trader_profile(labelled_trades(inputs)))


@query("user_profile_exact_having", PROFILE_ROUNDED + " WHERE nTrades > 15", PROFILE_CTE)
def user_profile_exact_having(inputs: Inputs):
    return _rounded_profile(aggregates.active_trader_profile(labelled_trades(inputs)))


@query(
    "user_totals",
    f"""SELECT address, COUNT(*) AS n_trades, CAST(SUM(CASE WHEN nonusdc_side = 'token2' THEN 1 ELSE 0 END) AS BIGINT) AS sum_outcome_index,
      {r("SUM(usd_amount)", 4, "total_size")}, {r("SUM(price)", 4, "total_price")}, MAX(usd_amount) AS max_size
      FROM trades WHERE direction = 'BUY' AND usd_amount >= 2 GROUP BY address""",
)
def user_totals(inputs: Inputs):
    bought = inputs.trades.where("direction = 'BUY' AND usd_amount >= 2")
    indexed = bought.withColumn("outcome_index", (F.col("nonusdc_side") == "token2").cast("int"))
    return rounded(aggregates.trader_totals(indexed), "total_size", "total_price", digits=4)


@query(
    "global_aggregates",
    f"""SELECT COUNT(*) AS n, {r("AVG(price)", name="avg_price")}, {r("SUM(usd_amount)", 4, "total_size")},
      {r("AVG(CAST(won AS INT))", name="win_rate")} FROM labelled""",
)
def global_aggregates(inputs: Inputs):
    out = labelled_trades(inputs).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("price").alias("avg_price"),
        F.sum("usd_amount").alias("total_size"),
        F.avg(F.col("won").cast("int")).alias("win_rate"),
    )
    return rounded(rounded(out, "avg_price", "win_rate"), "total_size", digits=4)


@query(
    "group_aggregates",
    f"""SELECT condition_id, nonusdc_side, COUNT(*) AS n, {r("AVG(price)", name="avg_price")}, {r("SUM(usd_amount)", 4, "total_size")}
      FROM trades GROUP BY condition_id, nonusdc_side""",
)
def group_aggregates(inputs: Inputs):
    out = inputs.trades.groupBy("condition_id", "nonusdc_side").agg(
        F.count(F.lit(1)).alias("n"), F.avg("price").alias("avg_price"), F.sum("usd_amount").alias("total_size")
    )
    return rounded(rounded(out, "avg_price"), "total_size", digits=4)


@query("distinct_markets", "SELECT DISTINCT condition_id FROM trades")
def distinct_markets(inputs: Inputs):
    return inputs.trades.select("condition_id").distinct()


@query("value_counts", "SELECT direction, COUNT(*) AS n FROM trades GROUP BY direction")
def value_counts(inputs: Inputs):
    return aggregates.value_counts(inputs.trades, "direction")


@query("value_counts_by_group", "SELECT nonusdc_side, won, COUNT(*) AS n FROM labelled GROUP BY nonusdc_side, won")
def value_counts_by_group(inputs: Inputs):
    return aggregates.value_counts(labelled_trades(inputs), "nonusdc_side", "won")


@query(
    "describe_features",
    _described(
        " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM features" for c in DESCRIBED), "feature"
    ),
    PIT_CTE,
)
def describe_features(inputs: Inputs):
    # Moments and quartiles both read the features, so the needed columns are written once.
    return _rounded_description(aggregates.describe(cut_lineage(features(inputs).select(*DESCRIBED)), DESCRIBED))


@query(
    "segment_profile",
    _described(
        " UNION ALL ".join(
            f"SELECT category, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM segmented" for c in aggregates.PROFILE_COLUMNS
        ),
        "category, feature",
    ),
    PROFILE_CTE,
)
def segment_profile(inputs: Inputs):
    return _rounded_description(aggregates.describe(segmented_profile(inputs), aggregates.PROFILE_COLUMNS, by=["category"]))


@query(
    "correlation_matrix",
    " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, {r(f'CORR({a}, {b})', name='correlation')} FROM features"
        for a, b in permutations(CORRELATED, 2)
    )
    + "".join(f" UNION ALL SELECT '{a}', '{a}', CAST(1 AS DOUBLE)" for a in CORRELATED),
    PIT_CTE,
)
def correlation_matrix(inputs: Inputs):
    return rounded(aggregates.correlation_matrix(features(inputs), CORRELATED), "correlation")


@query(
    "price_histogram",
    f"""SELECT bin, won, n, {r("CAST(n AS DOUBLE) / SUM(n) OVER (PARTITION BY bin)", name="share")} FROM
      (SELECT CAST(FLOOR(ROUND(price / 0.01, 6)) AS BIGINT) AS bin, won, COUNT(*) AS n FROM labelled WHERE usd_amount > 5 GROUP BY 1, 2)""",
)
def price_histogram(inputs: Inputs):
    return rounded(aggregates.price_histogram(labelled_trades(inputs)), "share")


@query(
    "market_summary",
    f"""SELECT condition_id, {r("AVG(price)", name="avg_price")}, ARG_MAX(price, timestamp * 1000000 + trade_id) AS last_price,
      {r("STDDEV_SAMP(price)", name="price_std")}, COUNT(*) AS n_trades, COUNT(DISTINCT address) AS n_unique_traders,
      {r("AVG(usd_amount)", name="avg_size")}, {r("SUM(usd_amount)", 4, "total_volume")},
      {r("AVG(age)", 4, "avg_account_age")}, {r("STDDEV_SAMP(age)", 4, "account_age_std")},
      {r("SUM(CASE WHEN direction = 'BUY' THEN usd_amount ELSE 0 END) / SUM(usd_amount)", name="buy_pressure")}
      FROM (SELECT t.*, timestamp - epoch_us(created_at)//1000000 AS age FROM trades t LEFT JOIN users u ON t.address = u.address)
      GROUP BY condition_id""",
)
def market_summary(inputs: Inputs):
    out = aggregates.market_summary(inputs.trades, inputs.users)
    out = rounded(out, "avg_price", "price_std", "avg_size", "buy_pressure")
    return rounded(out, "total_volume", "avg_account_age", "account_age_std", digits=4)


@query(
    "table_counts",
    """SELECT 'trades' AS table_name, COUNT(*) AS n FROM trades UNION ALL SELECT 'markets', COUNT(*) FROM markets
      UNION ALL SELECT 'users', COUNT(*) FROM users""",
)
def table_counts(inputs: Inputs):
    return aggregates.table_counts({"trades": inputs.trades, "markets": inputs.markets, "users": inputs.users})
