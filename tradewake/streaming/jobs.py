"""Incremental ingest and live scoring as Structured Streaming jobs."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradewake.functions import scalars
from tradewake.operators import windows
from tradewake.operators.models import MISSING
from tradewake.session import cut_lineage
from tradewake.sources import ingest, tables


def read_trade_files(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """New parquet files below a path (or glob) as a stream; the file limit bounds a micro-batch."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def drain(stream: DataFrame, on_batch: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Process everything available, batch by batch, then stop."""
    job = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(on_batch)
        .start()
    )
    job.awaitTermination()


def store_in(sink: str) -> Callable[[DataFrame, int], None]:
    """Write each batch to a folder of its own, so a repeated batch replaces itself."""
    return lambda batch, batch_id: tables.write_table(batch, f"{sink}/batch_id={batch_id}")


# --------------------------------------------------------------------------- ingest


# Key ranges of the stored table; a batch reads only those its keys fall in.
KEY_PARTS = 16


def batch_folder(sink: str, batch_id: int, run: str = "0") -> str:
    return f"{sink}/run={run}/batch_id={batch_id}"


def run_name(checkpoint: str) -> str:
    """Name of the run that a checkpoint belongs to: the same after a restart, another for a new checkpoint."""
    return hashlib.sha256(checkpoint.encode()).hexdigest()[:16]


def stored_rows(spark: SparkSession, sink: str, schema: T.StructType) -> DataFrame:
    """Everything stored so far; empty before the first batch of all."""
    root = spark._jvm.org.apache.hadoop.fs.Path(sink)
    full = T.StructType([*schema.fields, T.StructField("run", T.StringType()), T.StructField("batch_id", T.LongType()), T.StructField("key_part", T.IntegerType())])
    if not root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root):
        return spark.createDataFrame([], full)
    return spark.read.schema(full).parquet(sink)


def ingest_trades(stream: DataFrame, sink: str, checkpoint: str, keys: Sequence[str], event_time: str = "event_time") -> None:
    """Append trades whose key is new, however late they arrive; the first arrival wins.

    A batch keeps one row per key and drops keys stored by any other batch of any run. Nothing rests on
    stream state, so neither a late trade nor a lost or new checkpoint loses rows. A batch
    writes a folder of its own, named after its run, so repeating it after a failure changes nothing.
    Rows with a null in their key equal no others and are all kept.
    """
    run = run_name(checkpoint)
    schema = stream.schema
    names = list(keys)

    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        parted = cut_lineage(batch.withColumn("key_part", F.pmod(F.xxhash64(*names), F.lit(KEY_PARTS)).cast("int")))
        # At most KEY_PARTS rows.
        parts = [r["key_part"] for r in parted.select("key_part").distinct().collect()]
        others = stored_rows(spark, sink, schema).where(F.col("key_part").isin(parts)) if parts else stored_rows(spark, sink, schema)
        others = others.where((F.col("run") != run) | (F.col("batch_id") != batch_id))
        fresh = ingest.new_rows(others, parted, names, [event_time, *[c for c in schema.names if c not in (*names, event_time)]])
        # Rows of a range are brought together, so that a batch leaves few files; a range with very many rows is split.
        tables.write_table(fresh.hint("rebalance", "key_part"), batch_folder(sink, batch_id, run), partition_by=["key_part"])

    drain(stream, store, checkpoint)


def ingested(spark: SparkSession, sink: str) -> DataFrame:
    """The stored table."""
    return spark.read.parquet(sink).drop("run", "batch_id", "key_part")


# --------------------------------------------------------------------------- scoring

LIVE_COLUMNS = (
    "time_since_start", "time_until_end", "hour_of_day", "winrate_prior", "time_since_last_trade", "usd_amount", "price", "direction",
)
GAP = "time_since_last_trade"


def live_features(live: DataFrame, profiles: DataFrame, markets: DataFrame) -> DataFrame:
    """Scoring inputs of new trades, whose gap is known, by joins with profiles and market times; other columns stay."""
    at = F.col("timestamp")
    dates = markets.select(
        "condition_id", scalars.epoch_of(F.col("created_at")).alias("_start"), scalars.epoch_of(F.col("end_date")).alias("_end")
    )
    joined = live.join(profiles.select("address", F.col("win_rate").alias("_win_rate")), "address", "left").join(dates, "condition_id", "left")
    missing = F.lit(MISSING)
    return joined.withColumns({
        "time_since_start": F.coalesce((at - F.col("_start")).cast("double"), missing),
        "time_until_end": F.coalesce((F.col("_end") - at).cast("double"), missing),
        "hour_of_day": scalars.hour_of_day(at).cast("double"),
        "winrate_prior": F.coalesce("_win_rate", missing),
        "direction": scalars.direction_flag(F.col("direction")).cast("double"),
        GAP: F.coalesce(GAP, missing),
    }).drop("_start", "_end", "_win_rate")


def latest(stored: DataFrame) -> DataFrame:
    """The newest version of every stored trade; trades without an id all stay."""
    columns = [c for c in stored.columns if c not in ("version", "run", "batch_id", "key_part")]
    newest = stored.where("trade_id IS NOT NULL").groupBy("trade_id").agg(F.max_by(F.struct(*columns), "version").alias("_row"))
    return newest.select("_row.*").unionByName(stored.where("trade_id IS NULL").select(*columns))


def gaps_and_scores(stream: DataFrame, last_trades: DataFrame, sink: str, checkpoint: str, score: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Store every trade with the seconds since its trader's previous one, falling back to ``last_trade``, and what ``score`` adds.

    A batch takes its traders' earlier trades from the stored table, of which it reads the key ranges it touches, so nothing rests on stream
    state. A late trade gets its own gap and corrects that of the trade that follows it, which is scored and stored again as a
    newer version; whatever the batches, the newest versions are those of one batch with all trades. The windows cut traders with very
    many trades. A batch writes a folder of its own, so repeating it changes nothing. Trades need an address and an id; others have no
    gap and are stored once per arrival.
    """
    run = run_name(checkpoint)
    raw = stream.schema
    kept = T.StructType([*raw.fields, T.StructField(GAP, T.DoubleType()), T.StructField("version", T.LongType())])

    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        parted = cut_lineage(batch.withColumn("key_part", F.pmod(F.xxhash64("address"), F.lit(KEY_PARTS)).cast("int")))
        # At most KEY_PARTS rows.
        parts = [r["key_part"] for r in parted.select("key_part").distinct().collect()]
        others = stored_rows(spark, sink, kept).where((F.col("run") != run) | (F.col("batch_id") != batch_id))
        version = 1 + (others.agg(F.max("version")).first()[0] or 0)
        known = parted.where("address IS NOT NULL AND trade_id IS NOT NULL")
        traders = cut_lineage(known.select("address").distinct())
        earlier = latest(others.where(F.col("key_part").isin(parts)).join(traders, "address", "left_semi").where("trade_id IS NOT NULL"))
        # A trade that arrives again is no news.
        known = known.dropDuplicates(["trade_id"]).join(earlier.select("trade_id"), "trade_id", "left_anti")
        fresh = known.drop("key_part").withColumns({"_was": F.lit(None).cast("double"), "_new": F.lit(True)})
        both = cut_lineage(fresh.unionByName(earlier.withColumnRenamed(GAP, "_was").withColumn("_new", F.lit(False))))
        gapped = windows.time_since_last(both, last_trades).withColumn(GAP, F.col(GAP).cast("double"))
        changed = gapped.where(F.col("_new") | ~F.col("_was").eqNullSafe(F.col(GAP))).drop("_was", "_new")
        loose = parted.where("address IS NULL OR trade_id IS NULL").drop("key_part").withColumn(GAP, F.lit(None).cast("double"))
        found = cut_lineage(changed.select(*raw.names, GAP).unionByName(loose.select(*raw.names, GAP)))
        if score is not None:
            added = score(found.where("trade_id IS NOT NULL").dropDuplicates(["trade_id"]))
            found = found.join(added.select("trade_id", *[c for c in added.columns if c not in found.columns]), "trade_id", "left")
        found = found.withColumns({"version": F.lit(version).cast("long"), "key_part": F.pmod(F.xxhash64("address"), F.lit(KEY_PARTS)).cast("int")})
        tables.write_table(found.hint("rebalance", "key_part"), batch_folder(sink, batch_id, run), partition_by=["key_part"])

    drain(stream, store, checkpoint)


def scored(spark: SparkSession, sink: str) -> DataFrame:
    """The newest version of every trade of a live table."""
    return latest(spark.read.parquet(sink))
