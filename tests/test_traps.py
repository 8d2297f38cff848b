"""Hand-computed rows for the places where engines and definitions differ."""

import pytest
from pyspark.sql import functions as F

from tradewake.functions import labels, scalars
from tradewake.operators import aggregates, evaluate, relations, sampling, windows
from tradewake.operators.prefix import DEFAULT_POLICY, SplitPolicy
from tradewake.schemas import to_canonical
from tradewake.sources import ingest, landed


def column(df, expression):
    return [r[0] for r in df.select(expression.alias("x")).collect()]


PRICES = ["['1', '0']", "['0', '1']", '["0", "1"]', "['0.5', '0.5']", "['0.9995', '0.0005']", "['1e-05', '0.9']", None]


@pytest.fixture(scope="module")
def prices(spark):
    return spark.createDataFrame([(i, p) for i, p in enumerate(PRICES)], "i int, p string").orderBy("i")


def test_label_by_prices(prices):
    assert column(prices, labels.won_by_prices(F.lit("token1"), F.col("p"))) == [True, False, False, False, False, True, None]
    assert column(prices, labels.won_by_prices(F.lit("token2"), F.col("p"))) == [False, True, True, True, True, False, None]


def test_label_agrees_with_a_batch_function(prices):
    import pandas as pd

    @F.pandas_udf("boolean")
    def by_batch(side: pd.Series, text: pd.Series) -> pd.Series:
        first = text.str.find("1") == 2
        return ((side == "token1") == first).astype("boolean").where(text.notna(), None)

    for side in ("token1", "token2"):
        expected = column(prices, by_batch(F.lit(side), F.col("p")))
        assert column(prices, labels.won_by_prices(F.lit(side), F.col("p"))) == expected


def test_settled_and_winning_index(prices):
    assert column(prices, labels.is_settled(F.col("p"))) == [True, True, True, False, False, False, None]
    assert column(prices, labels.winning_index_by_threshold(F.col("p"))) == [0, 1, 1, 0, 0, 0, None]


def test_label_by_threshold(prices):
    names = F.lit('["Yes, sure", "No"]')
    assert column(prices, labels.won_by_threshold(F.lit("Yes, sure"), names, F.col("p"))) == [True, False, False, False, True, False, False]
    assert column(prices, labels.won_by_threshold(F.lit("Maybe"), names, F.col("p"))) == [False] * 7


def test_winner_outcome_keeps_commas(prices):
    assert column(prices, labels.winner_outcome(F.lit('["Smith, J", "Jones"]'), F.col("p"))) == ["Smith, J", "Jones", "Jones", None, None, None, None]


def test_unknown_condition_is_zero(spark):
    df = spark.createDataFrame([("a", "a"), ("a", None), (None, None)], "x string, y string")
    assert column(df, scalars.flag(F.col("x") == F.col("y"))) == [1, 0, 0]


def test_buckets_are_right_closed(spark):
    df = spark.createDataFrame([(0.0,), (0.2,), (0.2001,), (0.9,), (1.0,), (1.1,)], "p double")
    assert column(df, scalars.price_bucket(F.col("p"))) == [None, "(0.0, 0.2]", "(0.2, 0.3]", "(0.8, 0.9]", "(0.9, 1.0]", None]
    assert column(df, scalars.price_bucket(F.col("p"), scalars.BUCKET_EDGES_TO_90))[-2] is None


def test_weekdays_and_hours(spark):
    # 2024-01-01 is a Monday.
    df = spark.createDataFrame([(1704067200,), (1704067200 + 6 * 86400 + 3600 * 23,)], "t long")
    assert column(df, scalars.weekday_from_monday_1(F.col("t"))) == [1, 7]
    assert column(df, scalars.weekday_from_monday_0(F.col("t"))) == [0, 6]
    assert column(df, scalars.hour_of_day(F.col("t"))) == [0, 23]


def test_division_by_zero_is_null(spark):
    assert column(spark.range(1), scalars.ratio(F.lit(3), F.lit(0))) == [None]


def test_unreadable_dates_are_null(spark):
    df = spark.createDataFrame([("2024-01-01T00:00:00Z",), ("soon",), (None,)], "t string")
    assert column(df, scalars.epoch_of_text(F.col("t"))) == [1704067200, None, None]


def test_trade_return(spark):
    df = spark.createDataFrame([(1, 0.6), (0, 0.6)], "won int, price double")
    assert column(df, scalars.trade_return(F.col("won"), F.col("price"))) == pytest.approx([0.4 - 0.012, -0.6 - 0.012])


def test_history_peers_and_first_row(spark):
    rows = [(1, "a", 10, 5.0, 0.5, True), (2, "a", 10, 9.0, 0.4, False), (3, "a", 30, 1.0, 0.9, None), (4, "b", 5, 2.0, 0.3, True)]
    df = spark.createDataFrame(rows, "trade_id long, address string, timestamp long, usd_amount double, price double, won boolean")
    out = {r["trade_id"]: r for r in windows.with_trader_ratios(windows.trader_history(df)).collect()}
    # Trades of the same second count towards maxima, not towards sums.
    assert out[1]["cum_max_spent"] == 9.0 and out[1]["lowest_price_yet"] == 0.4
    assert out[1]["cum_spent_prior"] is None and out[1]["winrate"] is None and out[1]["winrate_prior"] is None
    assert (out[2]["cum_trades"], out[2]["cum_spent_prior"], out[2]["prior_wins"], out[2]["time_since_last_trade"]) == (2, 5.0, 1, 0)
    assert out[2]["winrate"] == 0.5 and out[2]["winrate_prior"] == 1.0
    assert out[3]["prior_wins"] == 1 and out[3]["time_since_last_trade"] == 20
    assert out[4]["cum_trades"] == 1


@pytest.mark.parametrize("policy", [DEFAULT_POLICY, SplitPolicy(target_rows=2)])
def test_window_counts(spark, policy):
    rows = [(1, 1, 0), (2, 1, 3600), (3, 1, 3600), (4, 1, 7201), (5, 2, 0)]
    df = spark.createDataFrame(rows, "trade_id long, condition_id long, timestamp long")
    trailing = {r["trade_id"]: r["window_trade_count"] for r in windows.window_trade_count(df, policy=policy).collect()}
    ahead = {r["trade_id"]: r["window_trade_count"] for r in windows.window_trade_count(df, look_ahead=True, policy=policy).collect()}
    assert trailing == {1: 1, 2: 3, 3: 3, 4: 1, 5: 1}
    assert ahead == {1: 4, 2: 4, 3: 4, 4: 1, 5: 1}


def test_gap_may_be_negative(spark):
    live = spark.createDataFrame([("a", 1, 100), ("a", 2, 130), ("b", 3, 50)], "address string, trade_id long, timestamp long")
    last = spark.createDataFrame([("a", 150)], "address string, last_trade long")
    out = {r["trade_id"]: r["time_since_last_trade"] for r in windows.time_since_last(live, last).collect()}
    assert out == {1: -50, 2: 30, 3: None}


def test_recurrence_filter_keeps_three_valued_logic(spark):
    rows = [(1, None, None), (2, None, "x"), (3, "", "x"), (4, "daily", None)]
    df = spark.createDataFrame(rows, "condition_id long, recurrences string, tags string")
    assert [r[0] for r in relations.with_usable_recurrence(df).collect()] == [4]


def test_late_trades_are_cut(spark):
    trades = spark.createDataFrame([(1, "u", 7, 1704067200 - 30, "Yes", 1.0), (2, "u", 7, 1704067200 - 31, "Yes", 1.0)],
                                   "trade_id long, address string, condition_id long, timestamp long, outcome string, usd_amount double")
    day = "2024-01-01T00:00:00Z"
    markets = spark.createDataFrame([(7, 10.0, "Yes", day, day, day, day)],
                                    "condition_id long, volume double, market_outcome string, endDate string, startDate string, updatedAt string, marketCreate string")
    users = spark.createDataFrame([("u", day, 1, 0, 1, 2.0, 3.0)],
                                  "address string, createdAt string, n_markets int, n_trades int, n_wins int, total_price double, total_size double")
    out = relations.clean_trades(trades, markets, users).collect()
    assert [(r["trade_id"], r["won"], r["nmark_ntrades"]) for r in out] == [(2, 1, None)]


def test_missing_union_column_is_null(spark):
    a = spark.createDataFrame([(1, 1, 0)], "id int, prediction int, predictionold int")
    b = spark.createDataFrame([(2, 1)], "id int, prediction int")
    assert [(r["id"], r["predictionold"]) for r in relations.union_all(a, b).orderBy("id").collect()] == [(1, 0), (2, None)]


def test_page_scan_stops_but_keeps_the_page(spark):
    # Newest first: ids 12..1 in pages of 3; even ids are eligible.
    df = spark.createDataFrame([(i, 1, i) for i in range(1, 13)], "trade_id long, condition_id long, timestamp long")
    kept = sampling.paged_eligible(df, F.col("trade_id") % 2 == 0, page_rows=3, max_pages=4, enough=2)
    # Pages 12-10 (two eligible: 12, 10) reach the target, so reading stops there.
    assert sorted(r["trade_id"] for r in kept.collect()) == [10, 12]
    more = sampling.paged_eligible(df, F.col("trade_id") % 2 == 0, page_rows=3, max_pages=2, enough=100)
    assert sorted(r["trade_id"] for r in more.collect()) == [8, 10, 12]


def test_diverse_sample_prefers_new_members(spark):
    rows = [(i, 1, "a") for i in range(10)] + [(10, 1, "b"), (11, 1, "c"), (12, 2, "a")]
    df = spark.createDataFrame(rows, "trade_id long, g long, m string")
    kept = sampling.sample_diverse(df, "g", "m", 4, sampling.key_hash(F.col("trade_id")), "trade_id").collect()
    first = [r["m"] for r in kept if r["g"] == 1]
    assert sorted(first) == ["a", "a", "b", "c"] and len(kept) == 5


def test_folds_are_disjoint_and_balanced(spark):
    df = spark.range(103).select(F.col("id").alias("trade_id"), (F.col("id") % 3 == 0).alias("won"))
    folds = sampling.stratified_folds(df, "won", sampling.key_hash(F.col("trade_id")), "trade_id")
    sizes = folds.groupBy("won", "fold").count().groupBy("won").agg(F.min("count").alias("lo"), F.max("count").alias("hi")).collect()
    assert folds.count() == 103 and all(r["hi"] - r["lo"] <= 1 for r in sizes)


def test_sample_n_is_exact_and_repeatable(spark):
    df = spark.range(5000).withColumnRenamed("id", "trade_id")
    take = lambda frame: sorted(r[0] for r in sampling.sample_n(frame, 700, sampling.text_hash(F.col("trade_id")), "trade_id").collect())
    assert len(take(df)) == 700 and take(df) == take(df.repartition(5))
    assert len(take(df.where("trade_id < 100"))) == 100


def test_insert_keeps_what_is_stored(spark):
    stored = spark.createDataFrame([("x", 1, 0.1)], "trans_hash string, seq long, price double")
    incoming = spark.createDataFrame([("x", 2, 0.2), ("y", 4, 0.4), ("y", 3, 0.3)], "trans_hash string, seq long, price double")
    once = ingest.insert_or_ignore(stored, incoming, ingest.TRADE_KEY, ["seq"])
    assert sorted((r["trans_hash"], r["seq"]) for r in once.collect()) == [("x", 1), ("y", 3)]
    assert ingest.new_rows(once, incoming, ingest.TRADE_KEY, ["seq"]).isEmpty()


def test_older_names_become_canonical(spark):
    rows = [("m9", "w3", "1717200000", "SELL", 0.31, 12.5), ("m9", "w4", "1717203600", "BUY", 0.88, 7.25), ("m2", "w3", "1717290000", "BUY", 0.12, 4.0), ("m2", "w3", None, "BUY", 0.93, 1.5)]
    df = to_canonical(spark.createDataFrame(rows, "conditionId string, wallet string, timestamp string, side string, price double, size double"))
    assert {"condition_id", "address", "direction", "usd_amount"} <= set(df.columns)
    assert df.where("direction = 'BUY' and price > 0.5").count() == 2
    totals = {r["address"]: r["t"] for r in df.groupBy("address").agg(F.sum("usd_amount").alias("t")).collect()}
    assert totals == {"w3": 18.0, "w4": 7.25}


def test_dates_fall_back_past_empty_text(spark):
    json = """{"markets":[{"conditionId":"m","endDate":"","events":[{"startDate":"s1"}],"closedTime":"c","createdAt":"k","tags":[{"label":"a"},{"label":"b"}]}]}"""
    from tradewake import schemas

    events = spark.createDataFrame([(json,)], "j string").select(F.from_json("j", schemas.LANDED_EVENT).alias("e")).select("e.*")
    row = landed.with_tags_and_recurrence(landed.with_market_dates(landed.markets_of(events))).first()
    assert (row["end_date"], row["start_date"], row["tag_labels"], row["recurrence"]) == ("c", "s1", ["a", "b"], "once")


def test_metrics_with_empty_denominators(spark):
    df = spark.createDataFrame([(0, 0), (1, 0)], "won int, predicted int")
    row = evaluate.confusion_metrics(df).first()
    assert (row["precision"], row["recall"], row["f1"], row["accuracy"]) == (0.0, 0.0, 0.0, 0.5)


def test_auc_ties_and_single_class(spark):
    df = spark.createDataFrame([(1, 0, 0.1), (1, 1, 0.1), (1, 0, 0.2), (1, 1, 0.9), (2, 1, 0.3)], "g int, won int, predicted_prob double")
    by = {r["g"]: r["auc"] for r in evaluate.auc(df, ["g"]).collect()}
    assert by == {1: pytest.approx((0.5 + 0 + 1 + 1) / 4), 2: None}
    assert evaluate.mean_auc(df, ["g"]).first()["groups"] == 1
    stretched = df.withColumn("predicted_prob", F.exp(F.col("predicted_prob") * 3))
    assert evaluate.auc(df).first()["auc"] == pytest.approx(evaluate.auc(stretched).first()["auc"])


def test_correlation_skips_incomplete_pairs(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (2.0, 4.0, 1.0), (3.0, 6.0, -1.0), (None, 0.0, 5.0)], "a double, b double, c double")
    out = {(r["a"], r["b"]): r["correlation"] for r in aggregates.correlation_matrix(df, ["a", "b", "c"]).collect()}
    assert out["a", "b"] == pytest.approx(1.0) and out["a", "c"] == pytest.approx(-1.0) and out["b", "b"] == 1.0


def test_approximate_markets_stay_close(spark, sf_dir):
    from tradewake.plans.inputs import Inputs

    i = Inputs(spark, sf_dir)
    labelled = windows.label_trades(i.trades, i.markets)
    exact = aggregates.trader_profile(labelled, approximate=False).select("address", F.col("nMarkets").alias("e"))
    close = aggregates.trader_profile(labelled).select("address", F.col("nMarkets").alias("a"))
    worst = exact.join(close, "address").agg(F.max(F.abs(F.col("a") - F.col("e")) / F.col("e"))).first()[0]
    assert worst < 0.25


def test_whole_ticks_fall_into_their_own_bin(spark):
    ticks = [(i / 100, 10.0, True) for i in range(1, 100)]
    bins = aggregates.price_histogram(spark.createDataFrame(ticks, "price double, usd_amount double, won boolean")).collect()
    assert sorted(r["bin"] for r in bins) == list(range(1, 100)) and all(r["n"] == 1 for r in bins)


def test_null_keys_are_all_kept(spark):
    incoming = spark.createDataFrame([(None, 1), (None, 2), ("a", 3), ("a", 4), ("b", 5)], "trans_hash string, n long")
    stored = spark.createDataFrame([("b", 0), (None, 9)], "trans_hash string, n long")
    after = ingest.insert_or_ignore(stored, incoming, ingest.TRADE_KEY, ["n"])
    assert sorted(r["n"] for r in after.collect()) == [0, 1, 2, 3, 9]
