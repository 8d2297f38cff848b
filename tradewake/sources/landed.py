"""Landed JSON documents: events with nested markets, pages of trades, profiles; and the keyed tables they fill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewake import schemas
from tradewake.functions import scalars
from tradewake.session import cut_lineage
from tradewake.sources import ingest

# Fixed value: recurrence of a market outside any series.
NO_SERIES = "once"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Event documents, with the declared schema."""
    return spark.read.schema(schemas.LANDED_EVENT).json(path)


def read_trade_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.LANDED_TRADE_PAGE).json(path)


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.LANDED_PROFILE).json(path)


def trades_of(pages: DataFrame) -> DataFrame:
    """One row per trade of each page, with canonical names, the profile flag and the place of arrival."""
    each = pages.select("page", F.posexplode("trades").alias("place", "t")).select("t.*", "page", "place")
    return schemas.to_canonical(ingest.with_profile_flag(each))


def new_rows(events: DataFrame, pages: DataFrame, profiles: DataFrame, stored: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """Rows that a landing adds to the tables events, markets, trades and users.

    A market is stored once, if it has settled and has trades; trades follow their market, the first of a
    transaction wins; a trader of those trades is stored if there is a profile without error that says when it was
    opened. What ``stored`` holds already isn't added again, and a market in it brings no more trades.
    """
    trades = trades_of(pages)
    markets = schemas.to_canonical(with_tags_and_recurrence(with_market_dates(markets_of(events)))).withColumnRenamed("outcomePrices", "outcome_prices")
    markets = ingest.markets_with_trades(ingest.accepted_markets(markets), trades)
    users = schemas.to_canonical(ingest.accepted_users(profiles))

    def unseen(name: str, rows: DataFrame, key: tuple[str, ...], arrival: list[str]) -> DataFrame:
        known = rows.where("1 = 0") if stored is None else stored[name]
        return cut_lineage(ingest.new_rows(known, rows, key, arrival))

    added = {"markets": unseen("markets", markets, ingest.MARKET_KEY, ["event_id"])}
    # Read again by the traders and the table.
    followed = cut_lineage(trades.join(added["markets"].select("condition_id"), "condition_id", "left_semi"))
    traders = users.join(followed.select("address"), "address", "left_semi")
    return added | {
        "events": unseen("events", events.select(F.col("id").alias("event_id"), F.col("commentCount").alias("event_comments")), ("event_id",), ["event_comments"]),
        "trades": unseen("trades", followed, ingest.TRADE_KEY, ["page", "place"]),
        "users": unseen("users", traders, ingest.USER_KEY, ["createdAt"]),
    }


def markets_of(events: DataFrame) -> DataFrame:
    """One row per market of each event, with the event's comment count."""
    return events.select(F.col("id").alias("event_id"), F.col("commentCount").alias("event_comments"), F.explode("markets").alias("m")).select("m.*", "event_id", "event_comments")


def _parent(field: str) -> Column:
    return F.get(F.col("events"), F.lit(0))[field]


def with_market_dates(markets: DataFrame) -> DataFrame:
    """End and start of a market from the first date that is present."""
    end = scalars.first_present(F.col("endDate"), _parent("endDate"), F.col("closedTime"), F.col("umaEndDate"))
    start = scalars.first_present(F.col("startDate"), _parent("startDate"), F.col("createdAt"), F.col("acceptingOrdersTimestamp"))
    return markets.withColumns({"end_date": end, "start_date": start})


def with_tags_and_recurrence(markets: DataFrame) -> DataFrame:
    """Tag labels and the recurrence of the market's first series."""
    series = F.get(_parent("series"), F.lit(0))
    return markets.withColumns(
        {
            "tag_labels": F.transform(F.coalesce(F.col("tags"), F.array()), lambda t: t["label"]),
            "recurrence": F.coalesce(series["recurrence"], F.lit(NO_SERIES)),
        }
    )
