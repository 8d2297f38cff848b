"""Declared schemas of the trade, market and user entities and their rename adapter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_S, _L, _I, _D, _B, _TS = (
    T.StringType(),
    T.LongType(),
    T.IntegerType(),
    T.DoubleType(),
    T.BooleanType(),
    T.TimestampType(),
)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


# Trade rows of the parquet generation; `won` appears after labelling.
TRADES = _struct(
    trade_id=_L, address=_S, condition_id=_S, timestamp=_L, price=_D, usd_amount=_D,
    token_amount=_D, direction=_S, role=_S, nonusdc_side=_S,
)
MARKETS = _struct(
    condition_id=_S, volume=_D, created_at=_TS, end_date=_TS, outcome_prices=_S,
    token1=_S, token2=_S, recurrences=_S, tags=T.ArrayType(_S),
)
USER_STATS = _struct(
    address=_S, nTrades=_L, nMarkets=_L, win_rate=_D, avg_spent=_D, total_spent=_D,
    max_spent=_D, avg_price=_D,
)
USER_CATEGORIES = _struct(address=_S, category=_I)

# Row-store generation, keyed by transaction hash, wallet and market.
LEGACY_TRADES = _struct(
    conditionId=_S, wallet=_S, timestamp=_L, price=_D, size=_D, outcome=_S,
    outcomeIndex=_I, profilePic=_I, trans_hash=_S, won=_I,
)
LEGACY_USERS = _struct(
    wallet=_S, createdAt=_S, weightedVol=_D, nTrades=_I, nMarkets=_I, totalSize=_D,
    nWins=_I, totalPrice=_D, totalValue=_D, maxSize=_D,
)
LEGACY_MARKETS = _struct(
    conditionId=_S, volume=_D, outcome=_S, endDate=_S, slug=_S, startDate=_S,
    createdAt=_S, commentCount=_I, competitive=_D, orderMinSize=_I, updatedAt=_S,
)

# Landed JSON documents.
LANDED_TRADE = _struct(
    proxyWallet=_S, side=_S, size=_D, price=_D, timestamp=_L, outcome=_S,
    outcomeIndex=_I, conditionId=_S, transactionHash=_S, profileImage=_S,
)
_LANDED_PARENT = _struct(
    startDate=_S, endDate=_S, commentCount=_I,
    series=T.ArrayType(_struct(recurrence=_S)),
)
LANDED_MARKET = _struct(
    conditionId=_S, outcomes=_S, outcomePrices=_S, volume=_D, startDate=_S, endDate=_S,
    createdAt=_S, updatedAt=_S, closedTime=_S, umaEndDate=_S,
    acceptingOrdersTimestamp=_S, slug=_S, orderMinSize=_I,
    tags=T.ArrayType(_struct(label=_S)), events=T.ArrayType(_LANDED_PARENT),
)
LANDED_EVENT = _struct(id=_L, commentCount=_I, markets=T.ArrayType(LANDED_MARKET))
# Trades land in pages of bounded length, so that no document grows with its market.
LANDED_TRADE_PAGE = _struct(page=_L, trades=T.ArrayType(LANDED_TRADE))
LANDED_PROFILE = _struct(proxyWallet=_S, createdAt=_S, weightedVolume=_D, error=_S)

# Older column name -> canonical column name.
CANONICAL_NAMES = {
    "wallet": "address",
    "proxyWallet": "address",
    "conditionId": "condition_id",
    "size": "usd_amount",
    "side": "direction",
    "transactionHash": "trans_hash",
    "weightedVol": "weighted_vol",
    "weightedVolume": "weighted_vol",
}


def to_canonical(df: DataFrame) -> DataFrame:
    """Rename older column names to the canonical ones."""
    return df.withColumnsRenamed({old: new for old, new in CANONICAL_NAMES.items() if old in df.columns})
