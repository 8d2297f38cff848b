"""Landed documents fill keyed tables once, whatever lands twice or is incomplete."""

from tradewake import schemas
from tradewake.sources import landed


def documents(spark):
    def market(key, prices):
        return {"conditionId": key, "outcomes": '["Yes", "No"]', "outcomePrices": prices, "volume": 1.0}

    def trade(key, wallet, transaction):
        return {"conditionId": key, "proxyWallet": wallet, "transactionHash": transaction, "price": 0.5, "size": 1.0, "profileImage": ""}

    won, open_ = "['1', '0']", "['0.5', '0.5']"
    events = [{"id": 1, "commentCount": 2, "markets": [market("a", won), market("open", open_), market("idle", won)]}, {"id": 2, "commentCount": 5, "markets": [market("a", won), market("b", won)]}, {"id": 3, "markets": None}]
    pages = [{"page": 1, "trades": [trade("a", "u", "x"), trade("a", "v", "x"), trade("open", "w", "y")]}, {"page": 2, "trades": [trade("a", "gone", None), trade("a", "gone", None), trade("b", "new", "x")]}, {"page": 3, "trades": []}]
    profiles = [{"proxyWallet": w, "createdAt": c, "weightedVolume": 1.0, "error": e} for w, c, e in (("u", "d1", None), ("v", "", None), ("gone", "d1", "deleted"), ("w", "d1", None), ("new", "d2", None), ("new", "d3", None))]
    return [spark.createDataFrame(rows, schema) for rows, schema in ((events, schemas.LANDED_EVENT), (pages, schemas.LANDED_TRADE_PAGE), (profiles, schemas.LANDED_PROFILE))]


def test_gates_and_keys(spark):
    got = landed.new_rows(*documents(spark))
    assert sorted((r.condition_id, r.market_outcome, r.event_comments) for r in got["markets"].collect()) == [("a", "Yes", 2), ("b", "Yes", 5)]
    # The first of a transaction wins; trades without one are all kept.
    assert sorted((r.trans_hash or "", r.address) for r in got["trades"].collect()) == [("", "gone"), ("", "gone"), ("x", "u")]
    assert sorted((r.address, r.createdAt) for r in got["users"].collect()) == [("new", "d2"), ("u", "d1")]
    assert sorted((r.event_id, r.event_comments) for r in got["events"].collect()) == [(1, 2), (2, 5), (3, None)]


def test_landing_again_adds_nothing(spark):
    frames = documents(spark)
    again = landed.new_rows(*frames, landed.new_rows(*frames))
    assert {name: rows.count() for name, rows in again.items()} == {"events": 0, "markets": 0, "trades": 0, "users": 0}


def test_nothing_landed(spark):
    assert all(rows.isEmpty() for rows in landed.new_rows(*[f.limit(0) for f in documents(spark)]).values())
