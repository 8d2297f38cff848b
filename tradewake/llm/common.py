"""Helpers shared by the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Limits of an Arrow batch: long texts make batches of the default size too large.
BATCH_ROWS = 2000
BATCH_BYTES = "8m"

# ASCII white space, as a Java character class.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep the memory of a Python worker independent of how long texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text only, with their declared types; null texts become empty.

    Whatever other columns a table has, under whatever names, is left behind here.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def row_key(column) -> Column:
    """A join key for ids: null ids meet each other, at a number no id uses."""
    return F.coalesce(column.cast("long"), F.lit(-(2**63)))


def sample_per_class(rows: DataFrame, by: str, key: str, n: int) -> DataFrame:
    """The n rows of each class with the smallest hash of the key (all rows of a smaller class).

    A class larger than 2n is first cut to a range of hashes that holds about 2n of its rows, so that
    no task meets a whole class.
    """
    spark = rows.sparkSession
    sizes = {r[by]: r["n"] for r in rows.groupBy(by).agg(F.count("*").alias("n")).collect()}
    # One row per class.
    limits = spark.createDataFrame([(c, min(2**63 - 1, int(2**64 * min(1.0, 2 * n / size)) - 2**63)) for c, size in sizes.items()], f"{by} {rows.schema[by].dataType.simpleString()}, _limit long")
    near = rows.withColumn("_hash", F.xxhash64(key)).join(F.broadcast(limits), by).filter("_hash <= _limit")
    order = Window.partitionBy(by).orderBy("_hash", key)
    return near.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= n).drop("_n", "_hash", "_limit")
