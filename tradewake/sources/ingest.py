"""Keyed, repeatable inserts and the checks in front of them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewake.functions import labels, scalars
from tradewake.operators import relations, sampling
from tradewake.sources import tables

# Identifying columns of each entity.
TRADE_KEY, USER_KEY, MARKET_KEY = ("trans_hash",), ("address",), ("condition_id",)
COMPOSITE_TRADE_KEY = ("address", "timestamp", "condition_id")


def new_rows(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], arrival: Sequence[Column | str]) -> DataFrame:
    """Rows an insert-or-ignore would add: first arrival per key, unless the key exists.

    A key with a null in it equals no other, so all its rows are added.
    """
    known = reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])
    first = relations.unseen(sampling.first_rows(incoming.where(known), keys, arrival), existing, *keys)
    return first.unionByName(incoming.where(~known))


def append_new(spark: SparkSession, path: str, incoming: DataFrame, keys: Sequence[str], arrival: Sequence[Column | str]) -> None:
    """Insert-or-ignore into a stored table: only rows with new keys are appended."""
    tables.write_table(new_rows(tables.read_table(spark, path), incoming, keys, arrival), path, mode="append")


def insert_or_ignore(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], arrival: Sequence[Column | str]) -> DataFrame:
    """Table contents after the insert."""
    columns = existing.columns
    return existing.unionByName(new_rows(existing, incoming, keys, arrival).select(*columns))


def accepted_markets(markets: DataFrame) -> DataFrame:
    """Markets that may be stored: settled at exactly 1, with the winner's name."""
    return relations.settled_markets(markets).withColumn(
        "market_outcome", labels.winner_outcome(F.col("outcomes"), F.col("outcome_prices"))
    )


def accepted_users(profiles: DataFrame) -> DataFrame:
    """Profiles that may be stored: no error and a creation time."""
    return profiles.where(F.col("error").isNull() & (F.coalesce(F.col("createdAt"), F.lit("")) != ""))


def with_profile_flag(trades: DataFrame, longer_than: int = 0) -> DataFrame:
    """0/1 flag for a profile image."""
    return trades.withColumn("profile_pic", scalars.longer_than(F.col("profileImage"), longer_than))


def markets_with_trades(markets: DataFrame, trades: DataFrame) -> DataFrame:
    """Markets that have at least one trade."""
    return markets.join(trades.select("condition_id"), "condition_id", "left_semi")
