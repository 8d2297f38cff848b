"""Streams drained in several batches agree with the batch rules and can be repeated."""

import random

from pyspark.sql import functions as F

from tradewake.session import scratch_path
from tradewake.streaming import jobs

TRADE = "trade_id long, address string, timestamp long, price double"


def write(spark, folder, rows):
    spark.createDataFrame(rows, TRADE).coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder, files=1):
    schema = spark.createDataFrame([], TRADE).schema
    return jobs.read_trade_files(spark, folder, schema, files).withColumn("event_time", F.timestamp_seconds("timestamp"))


def test_copies_are_dropped_within_and_across_runs(spark):
    source, sink, state = (scratch_path(spark, n) for n in ("src", "sink", "state"))
    day = 86400
    write(spark, source, [(1, "a", day, 0.1), (2, "b", day + 5, 0.2), (1, "a", day, 0.1)])
    write(spark, source, [(2, "b", day + 5, 0.2), (3, "a", 20 * day, 0.3)])
    jobs.ingest_trades(stream(spark, source), sink, state, ["trade_id"])
    assert sorted(r["trade_id"] for r in jobs.ingested(spark, sink).collect()) == [1, 2, 3]

    # Nothing new arrives: nothing changes.
    jobs.ingest_trades(stream(spark, source), sink, state, ["trade_id"])
    assert jobs.ingested(spark, sink).count() == 3

    # State has forgotten old keys, or was lost altogether; the stored table has not.
    write(spark, source, [(3, "a", 20 * day, 0.3), (4, "c", 21 * day, 0.4)])
    jobs.ingest_trades(stream(spark, source), sink, state, ["trade_id"])
    assert sorted(r["trade_id"] for r in jobs.ingested(spark, sink).collect()) == [1, 2, 3, 4]


def test_nothing_is_lost(spark):
    """Late new trades, a new checkpoint on an old sink, one key with two times, null keys."""
    source, sink = (scratch_path(spark, n) for n in ("src", "sink"))
    day = 86400
    write(spark, source, [(1, "a", day, 0.1), (None, "n", day, 0.5), (None, "n", day, 0.5)])
    write(spark, source, [(5, "b", 20 * day, 0.2)])
    write(spark, source, [(2, "late", 2 * day, 0.3), (1, "a", 9 * day, 0.9)])
    jobs.ingest_trades(stream(spark, source), sink, scratch_path(spark, "first"), ["trade_id"])
    kept = sorted((r["trade_id"] or 0, r["price"]) for r in jobs.ingested(spark, sink).collect())
    assert kept == [(0, 0.5), (0, 0.5), (1, 0.1), (2, 0.3), (5, 0.2)]

    other = scratch_path(spark, "other")
    write(spark, other, [(7, "z", day, 0.7), (5, "b", 20 * day, 0.2)])
    jobs.ingest_trades(stream(spark, other), sink, scratch_path(spark, "second"), ["trade_id"])
    assert sorted(r["trade_id"] or 0 for r in jobs.ingested(spark, sink).collect()) == [0, 0, 1, 2, 5, 7]


LIVE = "address long, trade_id long, timestamp long"


def drained(spark, last, batches, score=None, sink=None, state=None):
    """Newest versions after the batches, and the number of rows written."""
    source, sink, state = scratch_path(spark, "live"), sink or scratch_path(spark, "gaps"), state or scratch_path(spark, "state")
    for rows in batches:
        spark.createDataFrame(rows, LIVE).coalesce(1).write.mode("append").parquet(source)
        live = jobs.read_trade_files(spark, source, spark.createDataFrame([], LIVE).schema)
        jobs.gaps_and_scores(live, last, sink, state, score)
    return jobs.scored(spark, sink).collect(), spark.read.parquet(sink).count()


def test_gap_is_remembered_across_batches(spark):
    last = spark.createDataFrame([(1, 40)], "address long, last_trade long")
    out, _ = drained(spark, last, [[(1, 10, 100), (1, 11, 130), (2, 12, 100)], [(1, 13, 150), (2, 14, 160)]])
    assert {r["trade_id"]: r[jobs.GAP] for r in out} == {10: 60.0, 11: 30.0, 12: None, 13: 20.0, 14: 60.0}


def test_late_trades_correct_the_next_gap(spark):
    rng = random.Random(9)
    trades = [(rng.choice((1, 1, 1, 2, 3, 4)), i, rng.randint(1000, 1400)) for i in range(120)]
    last = spark.createDataFrame([(1, 500), (4, 990)], "address long, last_trade long")
    mixed = trades[:]
    rng.shuffle(mixed)
    # The second batch repeats part of the first.
    out, written = drained(spark, last, [mixed[:50], mixed[40:90], mixed[90:]], lambda found: found.withColumn("double_gap", F.col(jobs.GAP) * 2))
    want, known = {}, {1: 500, 4: 990}
    for address, trade, at in sorted(trades, key=lambda t: (t[0], t[2], t[1])):
        want[trade] = float(at - known[address]) if address in known else None
        known[address] = at
    assert {r["trade_id"]: r[jobs.GAP] for r in out} == want
    assert all(r["double_gap"] == (None if r[jobs.GAP] is None else 2 * r[jobs.GAP]) for r in out)
    # Only trades whose gap changed were stored again.
    assert len(trades) < written < 2 * len(trades)


def test_another_run_goes_on_from_the_stored_table(spark):
    last = spark.createDataFrame([], "address long, last_trade long")
    sink = scratch_path(spark, "gaps")
    drained(spark, last, [[(1, 1, 100)]], sink=sink)
    out, _ = drained(spark, last, [[(1, 2, 90), (None, 3, 5), (1, None, 6)]], sink=sink)
    assert {r["trade_id"]: r[jobs.GAP] for r in out} == {1: 10.0, 2: None, 3: None, None: None}
