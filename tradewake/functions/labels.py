"""Who won: the definitions in use differ on unsettled markets, so each is its own function."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A settled token is priced at exactly this text in the price list.
SETTLED_PRICE = "1"
# Fixed value: 1-based position of the first "1" when the first token won, as in ['1', '0'].
FIRST_TOKEN_POSITION = 3
# Price thresholds of the two numeric definitions.
WON_AT_LEAST = 0.85
SECOND_WON_ABOVE = 0.9


def first_token_won(outcome_prices: Column) -> Column:
    """True when the first "1" stands where the first price starts; null prices give null."""
    return F.instr(outcome_prices, SETTLED_PRICE) == FIRST_TOKEN_POSITION


def won_by_prices(side: Column, outcome_prices: Column) -> Column:
    """Canonical label: the token held is the one that settled at 1.

    A list without a leading "1" (also an even split) counts for the second token.
    """
    return (side == "token1") == first_token_won(outcome_prices)


def winner_token(outcome_prices: Column, token1: Column, token2: Column) -> Column:
    """Identifier of the winning token by the same rule."""
    return F.when(outcome_prices.isNotNull(), F.when(first_token_won(outcome_prices), token1).otherwise(token2))


def is_settled(outcome_prices: Column) -> Column:
    """True when some entry of the price list is exactly "1"."""
    return F.array_contains(string_list(outcome_prices), SETTLED_PRICE)


def string_list(text: Column) -> Column:
    """Parse a stringified list; single and double quotes both work."""
    return F.from_json(text, "array<string>")


def position_in(items: Column, item: Column) -> Column:
    """1-based position of an item, null when it is absent."""
    return F.nullif(F.array_position(items, item), F.lit(0))


def winner_outcome(outcomes: Column, outcome_prices: Column) -> Column:
    """Name of the settled outcome, null when nothing settled at 1."""
    at = position_in(string_list(outcome_prices), F.lit(SETTLED_PRICE))
    return F.try_element_at(string_list(outcomes), at.cast("int"))


def won_by_threshold(outcome: Column, outcomes: Column, outcome_prices: Column) -> Column:
    """True when the chosen outcome's final price reaches the threshold, false when unknown."""
    at = position_in(string_list(outcomes), outcome)
    price = F.try_element_at(string_list(outcome_prices), at.cast("int")).try_cast("double")
    return F.coalesce(price >= WON_AT_LEAST, F.lit(False))


def winning_index_by_threshold(outcome_prices: Column) -> Column:
    """1 when the second price is above the threshold, else 0."""
    second = F.try_element_at(string_list(outcome_prices), F.lit(2)).try_cast("double")
    return (second > SECOND_WON_ABOVE).cast("int")
