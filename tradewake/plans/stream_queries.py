"""Streaming jobs drained over the event file."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradewake.operators import aggregates
from tradewake.plans.aggregate_queries import labelled_trades
from tradewake.plans.catalog import query
from tradewake.plans.inputs import PROFILE_DATE_CTE, Inputs, trades_view
from tradewake.plans.model_queries import training_rows
from tradewake.plans.segment_queries import past_segments, segment_models, with_category
from tradewake.session import cut_lineage, scratch_path
from tradewake.streaming import jobs


def event_stream(inputs: Inputs):
    schema = inputs.table("events").schema
    return jobs.read_trade_files(inputs.spark, f"{inputs.sf_dir}/event[s].parquet", schema)


@query(
    "stream_ingest_dedupe",
    "SELECT trade_id, address, condition_id, timestamp, price, usd_amount FROM trades",
)
def stream_ingest_dedupe(inputs: Inputs):
    """The file arrives twice, so every trade has a copy to drop."""
    twice = event_stream(inputs).union(event_stream(inputs))
    trades = trades_view(twice, inputs.n_markets).select("trade_id", "address", "condition_id", "timestamp", "price", "usd_amount")
    timed = trades.withColumn("event_time", F.timestamp_seconds("timestamp"))
    sink = scratch_path(inputs.spark, "ingested")
    jobs.ingest_trades(timed, sink, scratch_path(inputs.spark, "ingest-state"), ["trade_id"])
    return jobs.ingested(inputs.spark, sink).drop("event_time")


# Batches that the live trades arrive in.
ARRIVALS = 3


def arriving(inputs: Inputs, job) -> None:
    """Runs a job on the live trades in three batches: by time, but every tenth trade comes a batch late."""
    at = F.unix_timestamp("ts")
    events = inputs.table("events").where(at >= inputs.profile_date)
    last = events.agg(F.max(at)).first()[0] or 0
    slices = F.floor((at - inputs.profile_date) * ARRIVALS / max(last - inputs.profile_date + 1, 1))
    dealt = events.withColumn("_slice", F.least(slices + F.when(F.col("event_id") % 10 == 0, 1).otherwise(0), F.lit(ARRIVALS - 1)))
    folder = scratch_path(inputs.spark, "arrivals")
    for i in range(ARRIVALS):
        dealt.where(F.col("_slice") == i).drop("_slice").write.parquet(f"{folder}/{i}")
        stream = jobs.read_trade_files(inputs.spark, f"{folder}/*", inputs.table("events").schema)
        job(trades_view(stream, inputs.n_markets))


def known_last_trades(inputs: Inputs):
    past = inputs.trades.where(F.col("timestamp") < inputs.profile_date)
    return cut_lineage(past.groupBy("address").agg(F.max("timestamp").alias("last_trade")))


@query("stream_score")
def stream_score(inputs: Inputs):
    """Live trades scored batch by batch with the models of their trader's segment; everything is fitted on the trades before."""
    past = F.col("timestamp") < inputs.profile_date
    categories = past_segments(inputs)
    rows = training_rows(inputs).join(inputs.trades.where(past).select("trade_id"), "trade_id", "left_semi")
    fitted = segment_models(cut_lineage(with_category(rows, categories)), jobs.LIVE_COLUMNS)
    profiles = cut_lineage(aggregates.trader_profile(labelled_trades(inputs).where(past), approximate=False).select("address", "win_rate"))

    def score(trades):
        shown = with_category(jobs.live_features(trades, profiles, inputs.markets), categories)
        return fitted.score(shown).select("trade_id", "category", "probability_new", "prediction", "probability_old", "predictionold")

    sink, state = scratch_path(inputs.spark, "scored"), scratch_path(inputs.spark, "score-state")
    last = known_last_trades(inputs)
    arriving(inputs, lambda stream: jobs.gaps_and_scores(stream, last, sink, state, score))
    return jobs.scored(inputs.spark, sink).select(
        "trade_id", "address", jobs.GAP, "category", "probability_new", "prediction", "probability_old", "predictionold"
    )


@query(
    "stream_time_since_last",
    """SELECT t.trade_id, t.address, CAST(t.timestamp
      - COALESCE(LAG(t.timestamp) OVER (PARTITION BY t.address ORDER BY t.timestamp, t.trade_id), last_trade) AS DOUBLE) AS time_since_last_trade
      FROM trades t LEFT JOIN known k ON t.address = k.address WHERE t.timestamp >= (SELECT since FROM profile_date)""",
    PROFILE_DATE_CTE + ", known AS (SELECT address, MAX(timestamp) AS last_trade FROM trades WHERE timestamp < (SELECT since FROM profile_date) GROUP BY address)",
)
def stream_time_since_last(inputs: Inputs):
    sink, state = scratch_path(inputs.spark, "gaps"), scratch_path(inputs.spark, "gap-state")
    last = known_last_trades(inputs)
    arriving(inputs, lambda stream: jobs.gaps_and_scores(stream, last, sink, state))
    return jobs.scored(inputs.spark, sink).select("trade_id", "address", jobs.GAP)
