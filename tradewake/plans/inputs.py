"""Trades, markets and users as views over the driver tables, for Spark and as SQL text.

Both definitions are stated separately so that the SQL side stays an independent check.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewake.session import prepare

# Outcome names of a market, by condition id modulo 3.
OUTCOME_NAMES = (("Yes", "No"), ("Up, fast", "Down"), ("Home", "Away"))


# Schemas of the tables the views read; declaring them saves a footer scan per query.
TABLE_SCHEMAS = {
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
}


class Inputs:
    """Lazy access to the tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = prepare(spark)
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        reader = self.spark.read
        if name in TABLE_SCHEMAS:
            reader = reader.schema(TABLE_SCHEMAS[name])
        return reader.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def trades(self) -> DataFrame:
        return trades_view(self.table("events"), self.n_markets)

    @cached_property
    def n_markets(self) -> int:
        """Markets there are; a count from file footers."""
        return self.table("part").count()

    @cached_property
    def markets(self) -> DataFrame:
        return markets_view(self.table("part"))

    @cached_property
    def profile_date(self) -> int:
        """Second from which trades count as live; profiles, segments and models come from the trades before. Four fifths into the time covered."""
        low, high = self.trades.agg(F.min("timestamp"), F.max("timestamp")).first()
        return 0 if low is None else low + (high - low) * 4 // 5

    @cached_property
    def users(self) -> DataFrame:
        return users_view(self.table("customer"))


def trades_view(events: DataFrame, n_markets: int) -> DataFrame:
    """Trades are dealt over all markets and ten ids that have none; two in seven meet in a hundredth of the markets."""
    busy = max(n_markets // 100, 1)
    price = "(CAST(regexp_extract(props, '[0-9]+', 0) AS INT) + 0.5D) / 100"
    return events.selectExpr(
        "event_id AS trade_id",
        "user_id AS address",
        f"IF(event_id % 7 < 2, (event_id div 7) % {busy}, event_id % {n_markets + 10}) AS condition_id",
        "unix_timestamp(ts) AS timestamp",
        f"{price} AS price",
        "value AS usd_amount",
        f"value / ({price}) AS token_amount",
        "CASE WHEN event_type IN ('purchase', 'view') THEN 'BUY' WHEN event_type IN ('click', 'signup') THEN 'SELL' ELSE 'MERGE' END AS direction",
        "IF(event_id % 2 = 0, 'maker', 'taker') AS role",
        "IF(event_id % 3 = 0, 'token2', 'token1') AS nonusdc_side",
    )


def markets_view(part: DataFrame) -> DataFrame:
    # The first outcome wins for remainders 0 and 1, the second for 2 and 3.
    prices = """CASE WHEN p_partkey % 89 = 0 THEN NULL WHEN p_partkey % 5 < 2 THEN "['1', '0']"
        WHEN p_partkey % 5 < 4 THEN "['0', '1']" ELSE "['0.5', '0.5']" END AS outcome_prices"""
    return part.selectExpr(
        "p_partkey AS condition_id",
        "p_retailprice * 1000 AS volume",
        "IF(p_partkey % 41 <> 0, TIMESTAMP '2023-11-01 00:00:00' + make_dt_interval(p_size), NULL) AS created_at",
        "IF(p_partkey % 97 <> 0, TIMESTAMP '2024-01-05 00:00:00' + make_dt_interval(p_size), NULL) AS end_date",
        prices,
        "2 * p_partkey AS token1",
        "2 * p_partkey + 1 AS token2",
        "CASE p_partkey % 4 WHEN 0 THEN 'daily' WHEN 1 THEN 'once' WHEN 2 THEN '' END AS recurrences",
        "IF(p_partkey % 7 <> 0, p_type, NULL) AS tags",
    )


def users_view(customer: DataFrame) -> DataFrame:
    opened = "TIMESTAMP '2023-06-01 00:00:00' + make_dt_interval(CAST(c_custkey % 300 AS INT))"
    return customer.selectExpr(
        "c_custkey AS address", f"IF(c_custkey % 53 <> 0, {opened}, NULL) AS created_at", "c_acctbal AS weighted_vol"
    )


def outcome_name(condition_id: F.Column, first: F.Column) -> F.Column:
    """Name of the first or second outcome of a market."""
    names = F.when(condition_id % 3 == 0, F.array(*map(F.lit, OUTCOME_NAMES[0])))
    names = names.when(condition_id % 3 == 1, F.array(*map(F.lit, OUTCOME_NAMES[1])))
    names = names.otherwise(F.array(*map(F.lit, OUTCOME_NAMES[2])))
    return F.when(first, names[0]).otherwise(names[1])


def with_outcome(trades: DataFrame) -> DataFrame:
    """Trades with the outcome name they bought."""
    first = F.col("nonusdc_side") == "token1"
    return trades.withColumn("outcome", outcome_name(F.col("condition_id"), first))


def with_outcome_names(markets: DataFrame) -> DataFrame:
    """Markets with their stringified outcome list."""
    key = F.col("condition_id")
    texts = ['["' + '", "'.join(names) + '"]' for names in OUTCOME_NAMES]
    return markets.withColumn(
        "outcomes", F.when(key % 3 == 0, texts[0]).when(key % 3 == 1, texts[1]).otherwise(texts[2])
    )


# The profile date as SQL, for queries that split by it.
PROFILE_DATE_CTE = "profile_date AS (SELECT CAST(MIN(timestamp) + (MAX(timestamp) - MIN(timestamp)) * 4 // 5 AS BIGINT) AS since FROM trades)"

ORACLE_VIEWS = """trades AS (
  SELECT event_id AS trade_id, user_id AS address,
    CASE WHEN event_id % 7 < 2 THEN (event_id // 7) % GREATEST((SELECT COUNT(*) FROM part) // 100, 1)
         ELSE event_id % ((SELECT COUNT(*) FROM part) + 10) END AS condition_id,
    epoch_us(ts)//1000000 AS timestamp,
    (CAST(regexp_extract(props,'[0-9]+',0) AS INT)+CAST(0.5 AS DOUBLE))/100 AS price,
    value AS usd_amount,
    value/((CAST(regexp_extract(props,'[0-9]+',0) AS INT)+CAST(0.5 AS DOUBLE))/100) AS token_amount,
    CASE WHEN event_type IN ('purchase','view') THEN 'BUY'
         WHEN event_type IN ('click','signup') THEN 'SELL' ELSE 'MERGE' END AS direction,
    CASE WHEN event_id % 2 = 0 THEN 'maker' ELSE 'taker' END AS role,
    CASE WHEN event_id % 3 = 0 THEN 'token2' ELSE 'token1' END AS nonusdc_side
  FROM events),
markets AS (
  SELECT p_partkey AS condition_id, p_retailprice*1000 AS volume,
    CASE WHEN p_partkey % 41 <> 0 THEN TIMESTAMP '2023-11-01 00:00:00' + p_size * INTERVAL '1' DAY END AS created_at,
    CASE WHEN p_partkey % 97 <> 0 THEN TIMESTAMP '2024-01-05 00:00:00' + p_size * INTERVAL '1' DAY END AS end_date,
    CASE WHEN p_partkey % 89 = 0 THEN NULL
         WHEN p_partkey % 5 < 2 THEN '[''1'', ''0'']'
         WHEN p_partkey % 5 < 4 THEN '[''0'', ''1'']'
         ELSE '[''0.5'', ''0.5'']' END AS outcome_prices,
    2*p_partkey AS token1, 2*p_partkey+1 AS token2,
    CASE p_partkey % 4 WHEN 0 THEN 'daily' WHEN 1 THEN 'once' WHEN 2 THEN '' END AS recurrences,
    CASE WHEN p_partkey % 7 <> 0 THEN p_type END AS tags
  FROM part),
users AS (
  SELECT c_custkey AS address,
    CASE WHEN c_custkey % 53 <> 0 THEN TIMESTAMP '2023-06-01 00:00:00' + CAST(c_custkey % 300 AS INT) * INTERVAL '1' DAY END AS created_at,
    c_acctbal AS weighted_vol
  FROM customer),
named_markets AS (
  SELECT *, CASE condition_id % 3 WHEN 0 THEN '["Yes", "No"]' WHEN 1 THEN '["Up, fast", "Down"]'
            ELSE '["Home", "Away"]' END AS outcomes,
    CASE condition_id % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'Up, fast' ELSE 'Home' END AS name1,
    CASE condition_id % 3 WHEN 0 THEN 'No' WHEN 1 THEN 'Down' ELSE 'Away' END AS name2
  FROM markets),
named_trades AS (
  SELECT *, CASE WHEN nonusdc_side = 'token1'
    THEN CASE condition_id % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'Up, fast' ELSE 'Home' END
    ELSE CASE condition_id % 3 WHEN 0 THEN 'No' WHEN 1 THEN 'Down' ELSE 'Away' END END AS outcome
  FROM trades),
labelled AS (
  SELECT t.*, CASE WHEN m.outcome_prices IS NULL THEN NULL
      WHEN m.outcome_prices LIKE '__1%' THEN t.nonusdc_side = 'token1'
      ELSE t.nonusdc_side <> 'token1' END AS won
  FROM trades t LEFT JOIN markets m ON t.condition_id = m.condition_id)"""
