"""Sinks, keyed inserts and landed documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradewake.operators import windows
from tradewake.plans.aggregate_queries import PROFILE_CTE, segmented_profile
from tradewake.plans.catalog import query
from tradewake.plans.inputs import Inputs, with_outcome, with_outcome_names
from tradewake.session import cut_lineage, scratch_path
from tradewake.sources import ingest, landed, tables

# Market documents: which optional fields are present depends on the market id.
DOCUMENT_CTE = """
documents_of AS (
  SELECT condition_id, volume, outcomes, outcome_prices,
    CASE WHEN condition_id % 4 = 0 THEN NULL WHEN condition_id % 4 = 1 THEN '' ELSE 'end-' || condition_id END AS end_own,
    CASE WHEN condition_id % 3 <> 0 THEN 'event-end-' || condition_id END AS end_event,
    CASE WHEN condition_id % 5 = 0 THEN '' ELSE 'closed-' || condition_id END AS closed,
    'uma-' || condition_id AS uma,
    CASE WHEN condition_id % 2 = 0 THEN 'start-' || condition_id END AS start_own,
    CASE WHEN condition_id % 5 = 1 THEN 'event-start-' || condition_id END AS start_event,
    CASE WHEN condition_id % 7 = 1 THEN 'created-' || condition_id END AS made,
    'open-' || condition_id AS open_at,
    CASE WHEN condition_id % 6 = 0 THEN NULL ELSE recurrences END AS recurrence, tags
  FROM named_markets)
"""


def market_documents(inputs: Inputs):
    """Market documents as an exchange would land them, derived from the market table."""
    key = F.col("condition_id")

    def text(prefix):
        return F.concat(F.lit(prefix), key)

    parent = F.struct(
        F.when(key % 5 == 1, text("event-start-")).alias("startDate"),
        F.when(key % 3 != 0, text("event-end-")).alias("endDate"),
        F.lit(3).alias("commentCount"),
        F.when(key % 6 != 0, F.array(F.struct(F.col("recurrences").alias("recurrence")))).alias("series"),
    )
    return with_outcome_names(inputs.markets).select(
        key.cast("string").alias("conditionId"), "outcomes", F.col("outcome_prices").alias("outcomePrices"), "volume",
        F.when(key % 2 == 0, text("start-")).alias("startDate"),
        F.when(key % 4 == 1, "").when(key % 4 > 1, text("end-")).alias("endDate"),
        F.when(key % 7 == 1, text("created-")).alias("createdAt"),
        F.when(key % 5 == 0, "").otherwise(text("closed-")).alias("closedTime"),
        text("uma-").alias("umaEndDate"),
        text("open-").alias("acceptingOrdersTimestamp"),
        F.when(F.col("tags").isNotNull(), F.array(F.struct(F.col("tags").alias("label")))).alias("tags"),
        F.array(parent).alias("events"),
        # Eight markets to an event, however many there are.
        F.expr("condition_id div 8").alias("event_id"),
    )


def landed_events(inputs: Inputs):
    """Event documents written as JSON lines to the shared folder and read back with the declared schema."""
    path = scratch_path(inputs.spark, "landed")
    fields = F.struct(*[c for c in market_documents(inputs).columns if c != "event_id"])
    events = market_documents(inputs).groupBy(F.col("event_id").alias("id")).agg(
        F.lit(3).alias("commentCount"), F.collect_list(fields).alias("markets")
    )
    events.write.json(path)
    return landed.read_events(inputs.spark, path)


@query(
    "sink_parquet_roundtrip",
    "SELECT trade_id, address, price, won FROM labelled",
)
def sink_parquet_roundtrip(inputs: Inputs):
    path = scratch_path(inputs.spark, "labelled")
    labelled = windows.label_trades(inputs.trades, inputs.markets).select("trade_id", "address", "price", "won")
    tables.write_table(labelled, path)
    return tables.read_table(inputs.spark, path)


@query(
    "partition_by_category",
    """SELECT t.trade_id, t.address, t.usd_amount, s.category FROM trades t JOIN segmented s ON t.address = s.address""",
    PROFILE_CTE,
)
def partition_by_category(inputs: Inputs):
    """One pass writes a folder per category; all are read back."""
    path = scratch_path(inputs.spark, "by-category")
    categories = cut_lineage(segmented_profile(inputs).select("address", "category"))
    split = inputs.trades.select("trade_id", "address", "usd_amount").join(categories, "address", "inner")
    tables.write_table(split, path, partition_by=["category"])
    return tables.read_table(inputs.spark, path)


@query(
    "insert_or_ignore",
    """SELECT CAST(trade_id // 3 AS VARCHAR) AS trans_hash, MIN(trade_id) AS trade_id, ARG_MIN(price, trade_id) AS price
      FROM trades WHERE trade_id // 3 NOT IN (SELECT trade_id FROM trades WHERE trade_id % 5 = 0) GROUP BY trade_id // 3
      UNION ALL SELECT CAST(trade_id AS VARCHAR), trade_id, 0.0::DOUBLE FROM trades WHERE trade_id % 5 = 0""",
)
def insert_or_ignore(inputs: Inputs):
    """Three trades to a transaction; a fifth of the keys are stored already."""
    stored = inputs.trades.where("trade_id % 5 = 0").select(F.col("trade_id").cast("string").alias("trans_hash"), "trade_id", F.lit(0.0).alias("price"))
    incoming = inputs.trades.select(F.expr("CAST(trade_id div 3 AS STRING)").alias("trans_hash"), "trade_id", "price")
    return ingest.insert_or_ignore(stored, incoming, ingest.TRADE_KEY, ["trade_id"])


@query(
    "insert_or_ignore_composite",
    """SELECT address, timestamp // 86400 AS timestamp, condition_id,
      COALESCE(MIN(trade_id) FILTER (WHERE trade_id % 4 < 2), MIN(trade_id)) AS trade_id FROM trades
      GROUP BY address, timestamp // 86400, condition_id""",
)
def insert_or_ignore_composite(inputs: Inputs):
    daily = inputs.trades.select("address", F.floor(F.col("timestamp") / 86400).alias("timestamp"), "condition_id", "trade_id")
    stored = ingest.insert_or_ignore(daily.where("1 = 0"), daily.where("trade_id % 4 < 2"), ingest.COMPOSITE_TRADE_KEY, ["trade_id"])
    return ingest.insert_or_ignore(stored, daily, ingest.COMPOSITE_TRADE_KEY, ["trade_id"])


@query(
    "ingest_gates",
    """SELECT m.condition_id, CASE WHEN outcome_prices LIKE '__1''%' THEN name1 ELSE name2 END AS market_outcome,
      (SELECT COUNT(*) FROM users WHERE created_at IS NOT NULL AND address % 11 <> 0) AS accepted_users
      FROM named_markets m WHERE outcome_prices LIKE '%''1''%' AND condition_id IN (SELECT condition_id FROM trades)""",
)
def ingest_gates(inputs: Inputs):
    settled = ingest.accepted_markets(with_outcome_names(inputs.markets))
    traded = ingest.markets_with_trades(settled, inputs.trades).select("condition_id", "market_outcome")
    profiles = inputs.users.select(
        "address", F.col("created_at").cast("string").alias("createdAt"), F.when(F.col("address") % 11 == 0, "deleted").alias("error")
    )
    accepted = ingest.accepted_users(profiles).agg(F.count(F.lit(1)).alias("n"))
    return traded.withColumn("accepted_users", accepted.scalar())


@query("ingest_users", "SELECT address FROM users WHERE created_at IS NOT NULL AND address % 11 <> 0")
def ingest_users(inputs: Inputs):
    """Profiles that pass the gate, as they would be stored."""
    profiles = inputs.users.select(
        "address", F.col("created_at").cast("string").alias("createdAt"), F.when(F.col("address") % 11 == 0, "deleted").alias("error")
    )
    return ingest.accepted_users(profiles).select("address")


@query(
    "append_new",
    """SELECT CAST(trade_id AS VARCHAR) AS trans_hash, trade_id, price FROM trades WHERE trade_id % 3 <> 0
      UNION ALL SELECT CAST(trade_id AS VARCHAR), trade_id, price + 1 FROM trades WHERE trade_id % 3 = 0""",
)
def append_new(inputs: Inputs):
    """A stored third of the trades meets all of them again; only new keys are appended."""
    path = scratch_path(inputs.spark, "keyed")
    incoming = inputs.trades.select(F.col("trade_id").cast("string").alias("trans_hash"), "trade_id", "price")
    tables.write_table(incoming.where("trade_id % 3 = 0").withColumn("price", F.col("price") + 1), path)
    ingest.append_new(inputs.spark, path, incoming, ingest.TRADE_KEY, ["trade_id"])
    return tables.read_table(inputs.spark, path)


@query(
    "json_events_explode",
    """SELECT CAST(condition_id AS VARCHAR) AS conditionId, volume, outcomes, outcome_prices AS outcomePrices, CAST(3 AS INT) AS event_comments
      FROM documents_of""",
    DOCUMENT_CTE,
)
def json_events_explode(inputs: Inputs):
    markets = landed.markets_of(landed_events(inputs))
    return markets.select("conditionId", "volume", "outcomes", "outcomePrices", "event_comments")


# Which markets a landing stores; even events land first, then all of them.
LANDED_CTE = """
stored_markets AS (
  SELECT condition_id, CAST(condition_id AS VARCHAR) AS id, CASE WHEN outcome_prices LIKE '__1''%' THEN name1 ELSE name2 END AS market_outcome, volume
  FROM named_markets WHERE outcome_prices LIKE '%''1''%' AND condition_id IN (SELECT condition_id FROM trades)),
stored_trades AS (SELECT * FROM named_trades WHERE condition_id IN (SELECT condition_id FROM stored_markets))
"""


def landed_pages(inputs: Inputs):
    """Pages of a hundred trades, two trades to a transaction, as JSON lines."""
    path = scratch_path(inputs.spark, "pages")
    first = F.col("nonusdc_side") == "token1"
    trade = F.struct(
        "trade_id", F.col("address").cast("string").alias("proxyWallet"), F.col("direction").alias("side"), F.col("usd_amount").alias("size"), "price", "timestamp", "outcome",
        F.when(first, 0).otherwise(1).alias("outcomeIndex"), F.col("condition_id").cast("string").alias("conditionId"),
        F.expr("CAST(trade_id div 2 AS STRING)").alias("transactionHash"), F.when(F.col("address") % 3 == 0, "").otherwise("image").alias("profileImage"),
    )
    pages = with_outcome(inputs.trades).groupBy(F.expr("trade_id div 100").alias("page")).agg(F.array_sort(F.collect_list(trade)).alias("trades"))
    pages.write.json(path)
    return landed.read_trade_pages(inputs.spark, path)


def landed_profiles(inputs: Inputs):
    path = scratch_path(inputs.spark, "profiles")
    inputs.users.select(
        F.col("address").cast("string").alias("proxyWallet"), F.col("created_at").cast("string").alias("createdAt"),
        F.col("weighted_vol").alias("weightedVolume"), F.when(F.col("address") % 11 == 0, "deleted").alias("error"),
    ).write.json(path)
    return landed.read_profiles(inputs.spark, path)


def landed_table(inputs: Inputs, name: str):
    """A keyed table after two landings: the even events, then all events."""
    events, pages, profiles = landed_events(inputs), landed_pages(inputs), landed_profiles(inputs)
    paths = {}
    for table, rows in landed.new_rows(events.where("id % 2 = 0"), pages, profiles).items():
        paths[table] = scratch_path(inputs.spark, f"landed-{table}")
        tables.write_table(rows, paths[table])
    stored = {table: tables.read_table(inputs.spark, path) for table, path in paths.items()}
    tables.write_table(landed.new_rows(events, pages, profiles, stored)[name], paths[name], mode="append")
    return tables.read_table(inputs.spark, paths[name])


@query("land_events", "SELECT DISTINCT condition_id // 8 AS event_id, CAST(3 AS INT) AS event_comments FROM markets")
def land_events(inputs: Inputs):
    return landed_table(inputs, "events").select("event_id", "event_comments")


@query("land_markets", "SELECT id AS condition_id, market_outcome, volume, CAST(3 AS INT) AS event_comments FROM stored_markets", LANDED_CTE)
def land_markets(inputs: Inputs):
    return landed_table(inputs, "markets").select("condition_id", "market_outcome", "volume", "event_comments")


@query(
    "land_trades",
    """SELECT CAST(trade_id // 2 AS VARCHAR) AS trans_hash, CAST(condition_id AS VARCHAR) AS condition_id, CAST(address AS VARCHAR) AS address, timestamp, price,
      usd_amount, outcome, CAST(address % 3 <> 0 AS INT) AS profile_pic FROM stored_trades
      QUALIFY ROW_NUMBER() OVER (PARTITION BY trade_id // 2 ORDER BY (condition_id // 8) % 2, trade_id) = 1""",
    LANDED_CTE,
)
def land_trades(inputs: Inputs):
    return landed_table(inputs, "trades").select("trans_hash", "condition_id", "address", "timestamp", "price", "usd_amount", "outcome", "profile_pic")


@query(
    "land_users",
    """SELECT CAST(address AS VARCHAR) AS address, weighted_vol FROM users
      WHERE created_at IS NOT NULL AND address % 11 <> 0 AND address IN (SELECT address FROM stored_trades)""",
    LANDED_CTE,
)
def land_users(inputs: Inputs):
    return landed_table(inputs, "users").select("address", "weighted_vol")


@query(
    "date_fallback",
    """SELECT CAST(condition_id AS VARCHAR) AS conditionId,
      CASE WHEN COALESCE(end_own, '') <> '' THEN end_own WHEN end_event IS NOT NULL THEN end_event WHEN closed <> '' THEN closed ELSE uma END AS end_date,
      COALESCE(start_own, start_event, made, open_at) AS start_date FROM documents_of""",
    DOCUMENT_CTE,
)
def date_fallback(inputs: Inputs):
    return landed.with_market_dates(market_documents(inputs)).select("conditionId", "end_date", "start_date")


@query(
    "json_tags_recurrence",
    """SELECT CAST(condition_id AS VARCHAR) AS conditionId, COALESCE(tags, '') AS tag_labels, COALESCE(recurrence, 'once') AS recurrence
      FROM documents_of""",
    DOCUMENT_CTE,
)
def json_tags_recurrence(inputs: Inputs):
    markets = landed.with_tags_and_recurrence(landed.markets_of(landed_events(inputs)))
    return markets.select("conditionId", F.array_join("tag_labels", ",").alias("tag_labels"), "recurrence")
