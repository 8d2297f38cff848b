"""Parquet layouts that let a scan open less: key ranges as folders, clustered row groups with Bloom filters, replaceable parts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewake.operators import sampling
from tradewake.sources import tables

RANGE = "bucket"
# Rows a lookup table keeps together, as bytes of a row group.
GROUP_BYTES = 8 * 2**20


def write_ranges(trades: DataFrame, path: str, bounds: Sequence, key: str = "address") -> None:
    """One folder per address range, in one shuffle by the key's order.

    A task holds a stretch of keys, so it writes to one folder, or to two at a bound; the number of files is that of the tasks plus the
    bounds. Within files the keys are in order, so their statistics narrow a scan further.
    """
    ranged = sampling.with_address_range(trades, bounds, RANGE)
    tables.write_table(ranged.repartitionByRange(RANGE, key).sortWithinPartitions(RANGE, key), path, partition_by=[RANGE])


def read_ranges(spark: SparkSession, path: str, wanted: Column | None = None) -> DataFrame:
    """Trades of the ranges that meet a condition on ``bucket``; the folders of the others are not opened."""
    table = tables.read_table(spark, path)
    return table if wanted is None else table.where(wanted)


def write_lookup(df: DataFrame, path: str, cluster: str, filtered: Sequence[str], distinct: int) -> None:
    """A table for point lookups: rows in order of one key, Bloom filters of about ``distinct`` values a row group on others."""
    writer = df.repartitionByRange(cluster).sortWithinPartitions(cluster).write.mode("overwrite").option("compression", tables.CODEC)
    writer = writer.option("parquet.block.size", GROUP_BYTES).option("parquet.page.row.count.limit", 10_000)
    for name in filtered:
        writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true").option(f"parquet.bloom.filter.expected.ndv#{name}", distinct)
    writer.parquet(path)


def lookup(spark: SparkSession, path: str, *wanted: Column) -> DataFrame:
    """Rows that meet at least one condition, once each.

    A scan per condition, so that each is pushed to the files by itself: a scan for all of them together could skip a row group only where none
    of the conditions may hold. A row met by an earlier condition is left out of the later scans.
    """
    parts, earlier = [], []
    for condition in wanted:
        part = tables.read_table(spark, path).where(condition)
        if earlier:
            part = part.where(~reduce(Column.__or__, [F.coalesce(c, F.lit(False)) for c in earlier]))
        parts.append(part)
        earlier.append(condition)
    return reduce(DataFrame.unionByName, parts)


def replace_parts(df: DataFrame, path: str, column: str) -> None:
    """Replaces the folders of the values of a column that occur in the rows; all others stay as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", tables.CODEC).partitionBy(column).parquet(path)
