"""Reproducible sampling, splits and folds: order by a hash of the key instead of a random draw."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradewake.operators import prefix
from tradewake.operators.prefix import DEFAULT_POLICY, SplitPolicy

# Portable hash of an integer key; any engine can state it.
HASH_FACTOR, HASH_SHIFT, HASH_VALUES = 7919, 42, 10007
# Page size, pages and eligible trades of the early-stopping page scan.
PAGE_ROWS, MAX_PAGES, ENOUGH_ROWS = 1000, 4, 1000
# Fixed value: address ranges of the file split, and how many of them are for training.
ADDRESS_RANGES, TRAIN_RANGES = 5, 5


def key_hash(key: Column, seed: int = HASH_SHIFT) -> Column:
    """Portable hash of an integer key in [0, 10007)."""
    return F.pmod(key.cast("long") * HASH_FACTOR + seed, F.lit(HASH_VALUES))


def text_hash(*columns: Column, seed: int = HASH_SHIFT, values: int = 65_536) -> Column:
    """Hash of any columns with a bounded number of values."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(values))


def sample_n(df: DataFrame, n: int, bucket: Column, *tie_break: str) -> DataFrame:
    """The n rows with the smallest hash.

    Rows are counted per hash value (as many as the hash has values, so a bounded
    table), which gives the largest hash that can be in the sample. Only rows up
    to it are ordered, so the final top-n sees about n rows rather than n per task.
    """
    hashed = df.withColumn("_hash", bucket)
    counts = sorted(hashed.groupBy("_hash").agg(F.count(F.lit(1)).alias("n")).collect())
    taken, last = 0, None
    for value, count in counts:
        taken, last = taken + count, value
        if taken >= n:
            break
    kept = hashed if last is None else hashed.where(F.col("_hash") <= last)
    if last is not None and len(tie_break) == 1 and isinstance(df.schema[tie_break[0]].dataType, T.IntegralType):
        kept = _within_last(kept, last, n - (taken - count), tie_break[0])
    return kept.orderBy("_hash", *tie_break).limit(n).drop("_hash")


# Ranges of the tie-breaking column that the last hash value is cut into.
TIE_RANGES = 4096


def _within_last(kept: DataFrame, last: int, wanted: int, tie: str) -> DataFrame:
    """Drops rows of the last hash value beyond those that can be in the sample, by ranges of the tie-breaking column."""
    edge = kept.where(F.col("_hash") == last)
    low, high = edge.agg(F.min(tie).alias("low"), F.max(tie).alias("high")).first()
    if low is None or low == high:
        return kept
    width = (high - low) // TIE_RANGES + 1
    place = F.floor((F.col(tie) - low) / width)
    seen, limit = 0, None
    # At most TIE_RANGES rows.
    for row in sorted(edge.groupBy(place.alias("place")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: (r["place"] is not None, r["place"])):
        seen, limit = seen + row["n"], row["place"]
        if seen >= wanted:
            break
    return kept.where((F.col("_hash") < last) | F.col(tie).isNull() | (place <= F.lit(limit)))


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int = 1) -> DataFrame:
    """First n rows per key; each task keeps n rows of a key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def sample_per_group(df: DataFrame, group: str, n: int, bucket: Column, *tie_break: str) -> DataFrame:
    """Up to n rows per group by hash."""
    return first_rows(df.withColumn("_hash", bucket), [group], ["_hash", *tie_break], n).drop("_hash")


def sample_diverse(df: DataFrame, group: str, member: str, n: int, bucket: Column, *tie_break: str) -> DataFrame:
    """Up to n rows per group, one per member first, the rest filled from repeats.

    A member's row beyond its n-th can never be chosen, so at most n rows of a
    (group, member) pair leave a task.
    """
    order = ["_hash", *tie_break]
    pair = Window.partitionBy(group, member).orderBy(*order)
    ranked = df.withColumn("_hash", bucket).withColumn("_nth", F.row_number().over(pair)).where(F.col("_nth") <= n)
    repeats = ranked.withColumn("_repeat", (F.col("_nth") > 1).cast("int"))
    return first_rows(repeats, [group], ["_repeat", *order], n).drop("_hash", "_nth", "_repeat")


def train_test_flag(df: DataFrame, bucket: Column, test_tenths: int = 2, name: str = "is_test") -> DataFrame:
    """Mark a fixed share of rows by hash; the same row always falls on the same side."""
    return df.withColumn(name, F.pmod(bucket, F.lit(10)) < test_tenths)


def stratified_folds(
    df: DataFrame, label: str, bucket: Column, tie_break: str, k: int = 5, policy: SplitPolicy = DEFAULT_POLICY
) -> DataFrame:
    """Fold 0..k-1 per row, balanced to within one row inside every label.

    Two labels mean two keys holding all rows, hence the numbering that splits
    large keys.
    """
    hashed = df.withColumn("_hash", bucket)
    numbered = prefix.nth_rows(hashed, [label], ["_hash", tie_break], "_nth", policy)
    return numbered.withColumn("fold", ((F.col("_nth") - 1) % k).cast("int")).drop("_hash", "_nth")


def paged_eligible(
    trades: DataFrame, eligible: Column, page_rows: int = PAGE_ROWS, max_pages: int = MAX_PAGES, enough: int = ENOUGH_ROWS
) -> DataFrame:
    """Eligible trades of each market in the pages an early-stopping reader would see.

    Pages run from the newest trade. A page is read while earlier pages held fewer
    eligible trades than wanted; all eligible trades of a read page are kept.
    """
    newest = Window.partitionBy("condition_id").orderBy(F.desc("timestamp"), F.desc("trade_id"))
    pages = Window.partitionBy("condition_id").orderBy("page")
    earlier = pages.rangeBetween(Window.unboundedPreceding, -1)
    return (
        trades.withColumn("_nth", F.row_number().over(newest))
        .where(F.col("_nth") <= page_rows * max_pages)
        .withColumns({"page": F.floor((F.col("_nth") - 1) / page_rows).cast("int"), "_eligible": F.coalesce(eligible, F.lit(False))})
        .withColumn("_seen", F.coalesce(F.sum(F.col("_eligible").cast("int")).over(earlier), F.lit(0)))
        .where(F.col("_eligible") & (F.col("_seen") < enough))
        .drop("_nth", "_eligible", "_seen")
    )


# Bytes of a text that make one number; six stay exact where ranges are cut by floating point.
TEXT_BYTES = 6


def text_position(column: Column, part: int = 0) -> Column:
    """Number that orders like the TEXT_BYTES bytes of a text from its part-th group on."""
    piece = F.substring(column.cast("binary"), TEXT_BYTES * part + 1, TEXT_BYTES)
    return F.conv(F.hex(F.rpad(piece, TEXT_BYTES, b"\x00")), 16, 10).cast("long")


def address_bounds(addresses: DataFrame, ranges: int = ADDRESS_RANGES, policy: SplitPolicy = DEFAULT_POLICY) -> list:
    """Addresses that start each range: every (count // ranges)-th distinct address in order."""
    distinct = addresses.select("address").distinct().withColumn("_all", F.lit(0))
    total = distinct.count()
    if total == 0:
        return []
    order = ["address"]
    if dict(distinct.dtypes)["address"] == "string":
        # As many numbers as the longest text needs, so that texts alike in their first bytes can be told apart too.
        longest = distinct.agg(F.max(F.octet_length("address"))).first()[0] or 0
        order = [f"_at_{part}" for part in range(-(-longest // TEXT_BYTES))]
        distinct = distinct.withColumns({name: text_position(F.col("address"), part) for part, name in enumerate(order)})
        order = [*order, "address"]
    wanted = sorted({i * (total // ranges) + 1 for i in range(ranges)})
    numbered = prefix.nth_rows(distinct, ["_all"], order, "_nth", policy)
    return [row["address"] for row in numbered.where(F.col("_nth").isin(wanted)).orderBy("_nth").collect()]


def with_address_range(trades: DataFrame, bounds: Sequence, name: str = "bucket") -> DataFrame:
    """Number of bounds at or below the address: 0 below the first, then 1 per range."""
    reached = [(F.col("address") >= F.lit(b)).cast("int") for b in bounds]
    return trades.withColumn(name, sum(reached[1:], reached[0]) if reached else F.lit(0))
