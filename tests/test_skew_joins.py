"""With one key holding a third of the rows, joins back to the trades are split at run time."""

import pytest
from pyspark.sql import functions as F

from tradewake.operators import relations, windows
from tradewake.operators.prefix import SplitPolicy
from tradewake.session import cut_lineage

SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k",
}


@pytest.fixture
def small_partitions(spark):
    before = {k: spark.conf.get(k, None) for k in SMALL}
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


@pytest.fixture(scope="module")
def trades(spark):
    rows = spark.range(0, 200_000, 1, 8).selectExpr(
        "id AS trade_id", "IF(id % 3 = 0, 1, id % 997) AS address", "IF(id % 3 = 0, 1, id % 89) AS condition_id",
        "IF(id % 3 = 0, 0, id % 5000) AS timestamp", "id % 2 = 0 AS won", "xxhash64(id) AS payload",
    )
    return cut_lineage(rows)


def ran_split(df) -> bool:
    # The plan of a frame becomes final once that frame is run.
    df.collect()
    return "skew=true" in df._jdf.queryExecution().executedPlan().toString()


def test_pair_counts_are_split(small_partitions, trades):
    assert ran_split(windows.trades_per_user_market(trades))


def test_window_counts_are_split(small_partitions, trades):
    assert ran_split(windows.window_trade_count(trades, policy=SplitPolicy(target_rows=1000)))


def test_busy_markets_are_split(small_partitions, trades):
    assert ran_split(relations.of_busy_markets(trades))


def test_market_join_is_split(small_partitions, trades, spark):
    markets = cut_lineage(spark.range(89).select(F.col("id").alias("condition_id"), F.lit("['1', '0']").alias("outcome_prices")))
    sided = trades.withColumn("nonusdc_side", F.lit("token1"))
    assert ran_split(windows.label_trades(sided, markets))
