"""Profiles, summaries and distribution tables."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradewake.functions import labels, scalars
from tradewake.operators import prefix
from tradewake.operators.prefix import DEFAULT_POLICY, SplitPolicy
from tradewake.session import cut_lineage

# Inputs of the segment model, in order.
PROFILE_COLUMNS = ("avg_price", "avg_spent", "max_spent", "nMarkets", "nTrades", "total_spent", "win_rate")
# Fixed value: traders need more trades than this to be profiled exactly.
MIN_PROFILE_TRADES = 15
QUARTILES = (0.25, 0.5, 0.75)


def trader_profile(labelled: DataFrame, approximate: bool = True) -> DataFrame:
    """Activity, win rate and spend of each trader."""
    markets = F.approx_count_distinct("condition_id") if approximate else F.count_distinct("condition_id")
    return labelled.groupBy("address").agg(
        F.count(F.lit(1)).alias("nTrades"),
        markets.alias("nMarkets"),
        F.avg(F.col("won").cast("int")).alias("win_rate"),
        F.avg("usd_amount").alias("avg_spent"),
        F.sum("usd_amount").alias("total_spent"),
        F.max("usd_amount").alias("max_spent"),
        F.avg("price").alias("avg_price"),
    )


def active_trader_profile(labelled: DataFrame, more_than: int = MIN_PROFILE_TRADES) -> DataFrame:
    """Exact profile of traders with more than a number of trades."""
    return trader_profile(labelled, approximate=False).where(F.col("nTrades") > more_than)


def trader_features_as_of(trades: DataFrame, markets: DataFrame, target, target_end: int) -> DataFrame:
    """Trader features from other markets only, before the target market ends.

    ``trades`` carries ``outcome``; ``markets`` carries ``outcomes``. Rows with any
    missing value are dropped before filtering.
    """
    details = markets.select("condition_id", "outcomes", "outcome_prices", "created_at", "end_date")
    columns = ["address", "direction", "usd_amount", "price", "timestamp", "outcome", "condition_id"]
    known = (
        trades.where((F.col("condition_id") != target) & (F.col("timestamp") < target_end))
        .select(*columns)
        .join(details, "condition_id", "left")
        .dropna()
    )
    won = labels.won_by_threshold(F.col("outcome"), F.col("outcomes"), F.col("outcome_prices"))
    return known.withColumn("_won", won.cast("int")).groupBy("address").agg(
        F.avg("price").alias("avg_price"),
        F.max("price").alias("highest_price_yet"),
        F.min("price").alias("lowest_price_yet"),
        F.avg("usd_amount").alias("avg_spent"),
        F.max("usd_amount").alias("max_spent"),
        F.count_distinct("condition_id").alias("nMarkets"),
        F.count(F.lit(1)).alias("nTrades"),
        F.sum("usd_amount").alias("total_spent"),
        F.avg("_won").alias("win_rate"),
        F.max("timestamp").alias("last_trade"),
    )


def trader_totals(trades: DataFrame) -> DataFrame:
    """Totals per trader; the outcome index sum is not a number of wins."""
    return trades.groupBy("address").agg(
        F.count(F.lit(1)).alias("n_trades"),
        F.sum("outcome_index").alias("sum_outcome_index"),
        F.sum("usd_amount").alias("total_size"),
        F.sum("price").alias("total_price"),
        F.max("usd_amount").alias("max_size"),
    )


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    """Number of rows per value, most frequent first."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *columns)


def exact_quantiles(
    long: DataFrame, keys: Sequence[str], value: str, totals: DataFrame, probabilities: Sequence[float] = QUARTILES,
    policy: SplitPolicy = DEFAULT_POLICY,
) -> DataFrame:
    """Linearly interpolated quantiles per key, exact, without gathering a key in one task.

    Equal values are counted first; the running count then shows which value
    stands at each wanted position. ``totals`` holds the keys and their ``count``.
    """
    counted = cut_lineage(long.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n")))
    placed = prefix.running_columns(counted, keys, [value], [prefix.prior_sum("_before", "_n")], policy)
    placed = placed.withColumn("_before", F.coalesce("_before", F.lit(0)))
    placed = placed.join(totals.select(*keys, F.col("count").alias("_total")), list(keys), "inner")

    def at(position):
        inside = (F.col("_before") <= position) & (position < F.col("_before") + F.col("_n"))
        return F.max(F.when(inside, F.col(value)))

    picks, outputs = [], []
    for p in probabilities:
        exact = (F.col("_total") - 1) * F.lit(float(p))
        name = f"p{round(p * 100)}"
        picks += [at(F.floor(exact)).alias(f"_lo_{name}"), at(F.ceil(exact)).alias(f"_hi_{name}")]
        picks.append(F.max(exact - F.floor(exact)).alias(f"_f_{name}"))
        low, high, part = F.col(f"_lo_{name}"), F.col(f"_hi_{name}"), F.col(f"_f_{name}")
        outputs.append((low + (high - low) * part).alias(name))
    return placed.groupBy(*keys).agg(*picks).select(*keys, *outputs)


def describe(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), policy: SplitPolicy = DEFAULT_POLICY) -> DataFrame:
    """Count, mean, sample deviation, extremes and quartiles of each column, per group."""
    doubles = df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns])
    long = doubles.unpivot(list(by), list(columns), "feature", "value")
    keys = [*by, "feature"]
    measures = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    # All columns side by side in one pass; only the finished figures become rows.
    wide = doubles.groupBy(*by).agg(
        *[F.struct(F.lit(c).alias("feature"), *[f(c).alias(m) for m, f in measures.items()]).alias(c) for c in columns]
    )
    moments = cut_lineage(wide.select(*by, F.inline(F.array(*columns))))
    return moments.join(exact_quantiles(long, keys, "value", moments, policy=policy), keys, "left")


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlations of all column pairs in one pass, each pair over its complete rows."""
    pairs = list(combinations(columns, 2))
    row = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    entries = [F.struct(F.lit(c).alias("a"), F.lit(c).alias("b"), F.lit(1.0).alias("correlation")) for c in columns]
    for i, (a, b) in enumerate(pairs):
        for x, y in ((a, b), (b, a)):
            entries.append(F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(f"_{i}").alias("correlation")))
    return row.select(F.inline(F.array(*entries)))


def price_histogram(labelled: DataFrame, width: float = 0.01, more_than: float = 5) -> DataFrame:
    """Trades per price bin and label, with the label's share of the bin; bins start at multiples of the width."""
    counts = (
        labelled.where(F.col("usd_amount") > more_than)
        .groupBy(F.floor(F.round(F.col("price") / width, 6)).alias("bin"), "won")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("bin")))


def market_summary(trades: DataFrame, users: DataFrame) -> DataFrame:
    """Price, activity and account-age figures of each market."""
    opened = users.select("address", scalars.epoch_of(F.col("created_at")).alias("_opened"))
    joined = trades.join(opened, "address", "left").withColumn("_age", F.col("timestamp") - F.col("_opened"))
    bought = F.sum(F.when(F.col("direction") == "BUY", F.col("usd_amount")).otherwise(0.0))
    return joined.groupBy("condition_id").agg(
        F.avg("price").alias("avg_price"),
        F.max_by("price", F.struct("timestamp", "trade_id")).alias("last_price"),
        F.stddev_samp("price").alias("price_std"),
        F.count(F.lit(1)).alias("n_trades"),
        F.count_distinct("address").alias("n_unique_traders"),
        F.avg("usd_amount").alias("avg_size"),
        F.sum("usd_amount").alias("total_volume"),
        F.avg("_age").alias("avg_account_age"),
        F.stddev_samp("_age").alias("account_age_std"),
        scalars.ratio(bought, F.sum("usd_amount")).alias("buy_pressure"),
    )


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count of each table."""
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out
