"""Parquet scans and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Fixed value: codec of all written files.
CODEC = "zstd"


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None, schema: T.StructType | None = None) -> DataFrame:
    """Scan one or many parquet files (a path, folder or glob)."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    df = reader.parquet(path)
    return df.select(*columns) if columns else df


def read_database_table(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None,
                        parts: int = 1) -> DataFrame:
    """Read a table of a relational database, in parallel ranges of a numeric key."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if key and bounds:
        reader = (
            reader.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1])
            .option("numPartitions", parts)
        )
    return reader.load()


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    """Write parquet; ``partition_by`` gives one folder per value in a single pass, without a shuffle."""
    writer = df.write.mode(mode).option("compression", CODEC)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
