"""The landing registry: keys, late pages, names without a code, and kinds without a table."""

from __future__ import annotations

import json
from datetime import date

from barloom.sources import landing


def message(fields, items, code=0, more=False):
    return json.dumps({"request_id": "r", "code": code, "msg": "", "data": {"fields": fields, "items": items, "has_more": more}})


def test_all_policies_in_one_pass(spark):
    bar = ["ts_code", "trade_date", "close"]
    landed = spark.createDataFrame([
        ("stock_daily", 2, message(bar, [["A", "20200102", 3.0], ["B", "20200102", "4.5"]])),
        ("stock_daily", 1, message(bar, [["B", "20200102", 9.0], [None, "20200102", 1.0], ["C", "bad", 1.0]])),
        ("stock_daily", 3, message(bar, [["D", "20200102", 1.0]], code=40203)),
        ("index_daily", 1, message(bar, [["A", "20200102", None]])),
        ("income", 1, message(["ts_code", "revenue"], [["A", 1], ["A", 1]])),
        ("weekly", 1, message(bar, [["A", "20200102", 7.0]])),
    ], "kind string, seq long, payload string")
    one = spark.createDataFrame([("A", date(2020, 1, 2), 1.0)], "ts_code string, trade_date date, close double")
    filings = spark.createDataFrame([("A", 1.0)], "ts_code string, revenue double")
    out = landing.land(landed, {"stock_daily": one, "index_daily": one, "income": filings})
    rows = {k: sorted(map(tuple, df.collect()), key=str) for k, df in out.items()}
    day = date(2020, 1, 2)
    assert rows == {"stock_daily": [("A", day, 1.0), ("B", day, 4.5)], "index_daily": [("A", day, None)], "income": [("A", 1.0)] * 3}


def test_codes_by_name(spark):
    landed = spark.createDataFrame([
        ("moneyflow_cnt_ths", 1, message(["ts_code", "name", "trade_date", "net_amount"], [[None, "one", "20200102", 1], [None, "two", "20200102", 2], ["K", "two", "20200102", 3]])),
    ], "kind string, seq long, payload string")
    dim = spark.createDataFrame([("X", "one"), ("Y", "two"), ("Z", "two")], "ts_code string, name string")
    base = spark.createDataFrame([], "ts_code string, trade_date date, name string, net_amount double")
    got = landing.land(landed, {"moneyflow_cnt_ths": base}, dim=dim)["moneyflow_cnt_ths"].collect()
    assert sorted((r["ts_code"], r["net_amount"]) for r in got) == [("K", 3.0), ("X", 1.0)]


def test_unfinished_requests(spark):
    rows = [("k", "a", 1, True), ("k", "a", 2, False), ("k", "b", 1, True), ("m", "a", 1, True), ("m", "a", 2, True)]
    df = spark.createDataFrame([(k, r, p, message(["x"], [[1]], more=m)) for k, r, p, m in rows], "kind string, request string, page int, payload string")
    assert sorted(map(tuple, landing.unfinished(df).collect())) == [("k", "b", 2), ("m", "a", 3)]


def test_every_kind_has_a_key_and_a_policy():
    for spec in landing.LANDINGS.values():
        assert set(spec.keys.split()) <= set(spec.schema.names) and spec.policy in ("keep", "replace", "append", "coalesce_new")
        assert len(spec.schema.names) == len(set(spec.schema.names))
