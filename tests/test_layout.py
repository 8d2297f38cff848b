"""Layouts by their effect on scans and files, address ranges of long texts, and the deletion of stages."""

import os
import random

from pyspark.sql import functions as F

from tradewake import session
from tradewake.operators import sampling
from tradewake.session import cut_lineage, scratch_path, stage_scope
from tradewake.sources import layout, tables


def local(path):
    return path.removeprefix("file:")


def files(path):
    return {os.path.join(folder, name) for folder, _, names in os.walk(local(path)) for name in names if name.endswith(".parquet")}


def rows_scanned(df):
    """Rows that the one scan of a frame passes on, after row groups were skipped."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    assert leaves.size() == 1
    return leaves.apply(0).metrics().apply("numOutputRows").value()


def test_ranges_are_folders_and_only_those_asked_for_are_opened(spark):
    trades = spark.range(5000).select(F.col("id").alias("trade_id"), (F.col("id") * 7919 % 997).alias("address"))
    path = scratch_path(spark, "ranges")
    bounds = sampling.address_bounds(trades)
    layout.write_ranges(trades, path, bounds)
    assert {name for name in os.listdir(local(path)) if "=" in name} == {f"bucket={i}" for i in range(1, 6)}
    train = layout.read_ranges(spark, path, F.col("bucket") < sampling.TRAIN_RANGES)
    opened = {r[0].split("bucket=")[1][0] for r in train.select(F.input_file_name()).distinct().collect()}
    assert opened == {str(i) for i in range(1, sampling.TRAIN_RANGES)}
    plan = train._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan
    assert rows_scanned(train) == trades.where(F.col("address") < bounds[sampling.TRAIN_RANGES - 1]).count()
    assert sorted(map(tuple, layout.read_ranges(spark, path).select("trade_id", "address").collect())) == sorted(map(tuple, trades.collect()))


def test_ranges_of_texts_that_share_a_long_prefix(spark):
    rng = random.Random(1)
    texts = sorted({"0x00000000000000" + "".join(rng.choices("0123456789abcdef", k=rng.randint(1, 26))) for _ in range(900)} | {"", "é", "0x"})
    frame = spark.createDataFrame([(t,) for t in texts for _ in range(2)], "address string")
    step = len(texts) // 5
    assert sampling.address_bounds(frame, policy=sampling.prefix.SplitPolicy(target_rows=40)) == [texts[i * step] for i in range(5)]


def test_lookups_skip_row_groups(spark, monkeypatch):
    monkeypatch.setattr(layout, "GROUP_BYTES", 64 * 1024)
    rng = random.Random(2)
    rows = [(i, rng.randint(0, 10**12), i % 500, rng.random()) for i in range(40_000)]
    trades = spark.createDataFrame(rows, "trade_id long, address long, condition_id long, price double")
    path = scratch_path(spark, "lookup")
    layout.write_lookup(trades, path, "condition_id", ["address"], distinct=5000)
    one = rows[1234]
    by_address = layout.lookup(spark, path, F.col("address") == one[1])
    assert [tuple(r) for r in by_address.collect()] == [one] and rows_scanned(by_address) < 0.5 * len(rows)
    by_market = layout.lookup(spark, path, F.col("condition_id") == 77)
    assert by_market.count() == 80 and rows_scanned(by_market) < 0.5 * len(rows)
    plan = by_address._jdf.queryExecution().executedPlan().toString()
    assert f"EqualTo(address,{one[1]})" in plan
    # A row that meets several conditions comes once, nulls in a condition don't lose rows.
    both = layout.lookup(spark, path, F.col("address") == one[1], F.col("condition_id") == one[2], F.lit(None).cast("boolean"), F.col("price") > 0.9)
    assert sorted(r["trade_id"] for r in both.collect()) == sorted(r[0] for r in rows if r[1] == one[1] or r[2] == one[2] or r[3] > 0.9)


def test_one_category_is_replaced_and_the_files_of_others_stay(spark):
    path = scratch_path(spark, "parts")
    table = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(30)], "n long, category string")
    layout.replace_parts(table, path, "category")
    before = files(path)
    layout.replace_parts(spark.createDataFrame([(100, "b")], table.schema), path, "category")
    after = files(path)
    assert {f for f in before if "category=b" not in f} == {f for f in after if "category=b" not in f} and before != after
    assert sorted(r["n"] for r in tables.read_table(spark, path).collect()) == sorted([i for i in range(30) if i % 3 != 1] + [100])


def test_stages_are_deleted(spark, monkeypatch):
    frame = spark.range(10)
    with stage_scope(spark):
        inside = files_of(cut_lineage(frame))
        assert all(map(os.path.exists, inside))
    assert not any(map(os.path.exists, inside))
    monkeypatch.setattr(session, "_SCOPES", [[]])
    outside = files_of(cut_lineage(frame))
    assert all(map(os.path.exists, outside))
    session.delete_stages(spark)
    assert not any(map(os.path.exists, outside)) and session._SCOPES == [[]]


def files_of(df):
    return [local(f.replace("file://", "")) for f in df.inputFiles()]
