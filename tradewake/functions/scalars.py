"""Scalar expressions: flags, dates, buckets, codes and returns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper edges of the price buckets, right-closed, starting at 0.
BUCKET_EDGES_TO_90 = (0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
BUCKET_EDGES_TO_100 = (0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)
# Fee of the backtest (times p(1-p)) and of the expected return (flat).
TRADE_FEE_RATE = 0.05
FLAT_FEE = 0.02
# Direction codes of the training features.
DIRECTION_CODES = {"BUY": 1, "SELL": 0}
OTHER_DIRECTION = -1

HOUR, DAY = 3600, 86400


def flag(condition: Column) -> Column:
    """0/1 flag that treats an unknown condition as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def epoch_of_text(text: Column) -> Column:
    """ISO-8601 text to epoch seconds, null when it does not parse."""
    return F.unix_timestamp(F.try_to_timestamp(text))


def epoch_of(moment: Column) -> Column:
    """Timestamp to whole epoch seconds."""
    return F.unix_timestamp(moment)


def hour_of_day(epoch: Column) -> Column:
    """Hour 0..23 in UTC."""
    return F.pmod(F.floor(epoch / HOUR), F.lit(24)).cast("int")


def weekday_from_monday_1(epoch: Column) -> Column:
    """Day of week Monday=1..Sunday=7 in UTC (training features)."""
    return (weekday_from_monday_0(epoch) + 1).cast("int")


def weekday_from_monday_0(epoch: Column) -> Column:
    """Day of week Monday=0..Sunday=6 in UTC (scoring features); day 0 of the epoch is a Thursday."""
    return F.pmod(F.floor(epoch / DAY) + 3, F.lit(7)).cast("int")


def direction_code(direction: Column) -> Column:
    """Training code of the direction."""
    code = reduce(lambda c, kv: c.when(direction == kv[0], kv[1]), DIRECTION_CODES.items(), F)
    return code.otherwise(OTHER_DIRECTION)


def direction_flag(direction: Column) -> Column:
    """Scoring code of the direction: buy or not."""
    return flag(direction == "BUY")


def bucket_label(low: float, high: float) -> str:
    return f"({low}, {high}]"


def bucket_bounds(edges=BUCKET_EDGES_TO_100) -> list[tuple[float, float]]:
    return list(zip((0.0, *edges[:-1]), edges, strict=True))


def price_bucket(price: Column, edges=BUCKET_EDGES_TO_100) -> Column:
    """Right-closed bucket label, null outside all buckets."""
    return reduce(
        lambda c, b: c.when((price > b[0]) & (price <= b[1]), bucket_label(*b)), bucket_bounds(edges), F
    ).otherwise(F.lit(None).cast("string"))


def bucket_midpoint(price: Column, edges=BUCKET_EDGES_TO_90) -> Column:
    """Midpoint of the price bucket."""
    return reduce(
        lambda c, b: c.when((price > b[0]) & (price <= b[1]), round((b[0] + b[1]) / 2, 4)), bucket_bounds(edges), F
    ).otherwise(F.lit(None).cast("double"))


def trade_return(won: Column, price: Column, fee_rate: float = TRADE_FEE_RATE) -> Column:
    """Return per unit after fee: payout (1 or 0) minus price minus fee on p(1-p)."""
    payout = F.when(won.cast("int") == 1, 1.0).otherwise(0.0)
    return payout - price - fee_rate * (1 - price) * price


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that gives null for a zero denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def first_present(*texts: Column) -> Column:
    """First text that is neither null nor empty."""
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts])


def longer_than(text: Column, length: int) -> Column:
    """0/1 flag for a text longer than the given length."""
    return flag(F.length(text) > length)
