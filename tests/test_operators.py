"""Ranks, percentiles, upserts, payloads, plans and scores on small hand-made data."""

from __future__ import annotations

import json
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.functions import scalars, vectors
from barloom.operators import blocks, ranking, sequences, universe
from barloom.operators import quality as dq
from barloom.operators.windows import apply_steps
from barloom.operators import momentum, volatility
from barloom.plans import backtest as bt
from barloom.plans import scoring, validation
from barloom.sources import payload, upsert
from barloom.streaming import incremental


@pytest.fixture(scope="module")
def skewed(spark):
    """One group and one value hold most rows."""
    rows = [("hot", 1.0 if i % 3 else float(i), i) for i in range(600)] + [("cold", float(i % 7), 1000 + i) for i in range(50)]
    return spark.createDataFrame(rows, "g string, x double, id int"), rows


def test_row_numbers_cover_hot_groups(skewed):
    df, rows = skewed
    got = {r["id"]: r["rn"] for r in ranking.global_row_number(df, [F.col("x"), F.col("id")]).collect()}
    order = sorted(rows, key=lambda r: (r[1], r[2]))
    assert got == {r[2]: i + 1 for i, r in enumerate(order)}
    per = ranking.grouped_row_number(df, ["g"], [F.col("x"), F.col("id")], total="n").collect()
    for g in ("hot", "cold"):
        want = {r[2]: i + 1 for i, r in enumerate(x for x in order if x[0] == g)}
        assert {r["id"]: r["rn"] for r in per if r["g"] == g} == want
        assert {r["n"] for r in per if r["g"] == g} == {len(want)}


def test_percentiles_match_numpy(skewed):
    df, rows = skewed
    got = {r["g"]: r for r in ranking.exact_percentiles(df, ["g"], "x", {"p": 0.025, "q": 0.5, "r": 0.975}).collect()}
    for g in ("hot", "cold"):
        want = np.quantile([r[1] for r in rows if r[0] == g], [0.025, 0.5, 0.975])
        assert [got[g][k] for k in "pqr"] == pytest.approx(list(want))


def test_average_ranks_match_pandas(skewed):
    import pandas as pd

    df, rows = skewed
    got = {r["x"]: r["k"] for r in ranking.average_ranks(df, [], "x", "k").collect()}
    s = pd.Series([r[1] for r in rows])
    assert got == pytest.approx(dict(zip(s, s.rank(method="average"))))


def test_tie_ranks_match_pandas(spark):
    """A third of the rows on one value, a hot group, nulls and NaN, ties longer than a partition."""
    import pandas as pd

    rng = np.random.default_rng(3)
    rows = [(["hot", "cold", None][int(k)], [0.5, float("nan"), None, float(v)][min(int(m), 3)], i) for i, (k, v, m) in enumerate(zip(rng.choice(3, 6000, p=[0.8, 0.15, 0.05]), rng.integers(0, 900, 6000), rng.choice(4, 6000, p=[0.35, 0.02, 0.03, 0.6])))]
    df = spark.createDataFrame(rows, "g string, x double, i int").repartition(9)
    for group in (["g"], []):
        got = {r["i"]: r["k"] for r in ranking.tie_ranks(df, group, "x", "k").collect()}
        pdf = pd.DataFrame(rows, columns=["g", "x", "i"])
        order = pd.Series([-1.0 if x is None else 1e9 if x != x else x for _, x, _ in rows])
        want = order.groupby(pdf["g"].fillna("-")).rank(method="average") if group else order.rank(method="average")
        assert got == dict(zip(pdf["i"], want))
    assert ranking.tie_ranks(df.limit(0), ["g"], "x", "k").count() == 0


def test_ntile_matches_definition(spark):
    for n in (5, 100, 257):
        df = spark.range(1, n + 1).select(ranking.ntile_from_rank(F.col("id"), F.lit(n), 10).alias("a"), F.expr("ntile(10) over (order by id)").alias("b"))
        assert df.where("a <> b").count() == 0


def test_blocks_give_the_same_rows(spark, bars):
    build = lambda df, key: apply_steps(df, volatility.bollinger_steps(key=key) + momentum.rsi_steps(key=key))
    whole = build(bars, "entity").select("entity", "date", F.round("bb_upper", 8), F.round("rsi_14", 8))
    cut = blocks.in_blocks(bars, build, size=40, overlap=21).select(*["entity", "date"], F.round("bb_upper", 8), F.round("rsi_14", 8))
    assert cut.count() == bars.count() and whole.exceptAll(cut).count() == 0
    with pytest.raises(ValueError):
        blocks.in_blocks(bars, build, size=10, overlap=21)


def test_upsert_policies(spark):
    base = spark.createDataFrame([(1, "a", None), (2, "b", 2.0)], "k int, s string, v double")
    new = spark.createDataFrame([(2, None, 9.0), (3, "c", 3.0)], "k int, s string, v double")
    run = lambda p, cols=None: sorted(tuple(r) for r in upsert.upsert(base, new, ["k"], p, cols).collect())
    assert run("replace") == [(1, "a", None), (2, None, 9.0), (3, "c", 3.0)]
    assert run("keep") == [(1, "a", None), (2, "b", 2.0), (3, "c", 3.0)]
    assert run("update", ["v"]) == [(1, "a", None), (2, "b", 9.0), (3, "c", 3.0)]
    assert run("coalesce_new") == [(1, "a", None), (2, "b", 9.0), (3, "c", 3.0)]
    assert run("coalesce_old") == [(1, "a", None), (2, "b", 2.0), (3, "c", 3.0)]
    merged, counts = upsert.upsert_with_counts(base, new, ["k"])
    assert tuple(counts.first()) == (1, 1) and merged.count() == 3


def test_payload_parsing_and_inference(spark):
    good = {"code": 0, "msg": "", "data": {"fields": ["ts_code", "vol", "note", "pct"], "items": [["A", 1.5, "x", None], ["B", "2", "y", None]], "has_more": False}}
    failed = {"code": 40203, "msg": "limit", "data": None}
    empty = {"code": 0, "msg": "", "data": {"fields": ["ts_code"], "items": [], "has_more": False}}
    df = spark.createDataFrame([(json.dumps(x),) for x in (good, failed, empty)], "payload string")
    rows = payload.parse_payload(df, "ts_code string, vol double, absent double").orderBy("ts_code").collect()
    assert [tuple(r) for r in rows] == [("A", 1.5, None), ("B", 2.0, None)]
    kinds = {f.name: f.dataType.simpleString() for f in payload.infer_payload_schema(df)}
    assert kinds == {"ts_code": "string", "vol": "double", "note": "string", "pct": "double"}


def test_clamp_keeps_null_and_vectors_keep_their_bounds(spark):
    assert spark.range(1).select(scalars.clamp(F.lit(None).cast("double"), -1, 1)).first()[0] is None
    raw = [0.0] * 105
    raw[91], raw[92], raw[93], raw[12] = 0.15, -0.25, 0.3, float("nan")
    v = spark.createDataFrame([(raw,)], "v array<double>").select(vectors.normalize(F.col("v")).alias("n")).first()["n"]
    assert len(v) == vectors.SIZE == 105 and (v[91], v[92], v[93]) == (1.0, -1.0, 1.0) and v[12] == 0.0 and v[104] == 0.0
    assert len(vectors.LAYOUT) == 105 and sum(b - a + 1 for a, b, *_ in vectors.SCALES) == 96
    short = spark.createDataFrame([([1.0] * 104,)], "features array<double>")
    assert vectors.auto_normalize(short).count() == 0


def test_sequences_stay_inside_entities(bars):
    out = sequences.make_sequences(bars, ["close"], 10, drop_last=True)
    per = {r["entity"]: r["count"] for r in out.groupBy("entity").count().collect()}
    have = {r["entity"]: r["count"] for r in bars.groupBy("entity").count().collect()}
    assert per == {k: n - 10 for k, n in have.items()}


def test_split_schedule_and_window_plan():
    plan = universe.split_schedule(date(2024, 8, 31))
    assert len(plan) == 26 and plan[0]["holdout_start"] == date(2024, 2, 29)
    assert (plan[1]["window_end"] - plan[0]["window_end"]).days == 7
    lo, hi = incremental.plan_window(date(2000, 1, 1), date(2024, 1, 1), watermark=date(2023, 12, 1), as_of=date(2023, 12, 15))
    assert (lo, hi) == (date(2021, 11, 11), date(2023, 12, 15))


def test_fetch_plan_stops_after_empty_days(spark):
    cal = spark.createDataFrame([(date(2024, 1, d),) for d in range(1, 31)], "date date")
    got = spark.createDataFrame([(date(2024, 1, d), True) for d in (30, 29, 27, 3)], "date date, has_rows boolean")
    days = [r["date"].day for r in incremental.fetch_plan(cal, got, stop_after=5).orderBy("order").collect()]
    assert days == [30, 29, 28, 27, 26, 25, 24, 23, 22]


def test_schema_and_split_checks(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0)], "entity int, next_week double, next_day_return double")
    found = dq.check_schema(df)
    assert found["suspicious"] == ["next_week"] and "next_3day_return" in found["missing_targets"]
    rows = [(1, date(2024, 1, 1), "train"), (1, date(2024, 1, 2), "val"), (1, date(2024, 1, 3), "test"), (2, date(2024, 2, 1), "train"), (2, date(2024, 1, 2), "val")]
    bad = dq.check_split_order(spark.createDataFrame(rows, "entity int, date date, split string"))
    assert {r["entity"]: r["violates"] for r in bad.collect()} == {1: False, 2: True}


def test_backtest_compounds_by_date(spark):
    rows = [("A", date(2024, 1, 1), "BUY", 9.0, 0.9, 1.0, 2.0, None), ("B", date(2024, 1, 1), "SELL", 8.0, 0.9, -1.0, 1.0, None), ("A", date(2024, 1, 2), "STRONG_BUY", 7.0, 0.9, 1.0, -4.0, None), ("C", date(2024, 1, 3), "BUY", 7.0, 0.9, 1.0, None, None)]
    df = spark.createDataFrame(rows, "entity string, date date, signal_type string, signal_score double, confidence double, predicted_return double, actual_return_1day double, actual_return_3day double")
    p = bt.BacktestParams(initial_capital=1000.0, position_size=0.5, cost=0.001)
    e = bt.equity_curve(df, p).orderBy("date").collect()
    day1 = 1000 * (1 + 0.5 * ((0.02 - 0.002) + (-0.01 - 0.002)))
    day2 = day1 * (1 + 0.5 * (-0.04 - 0.002))
    assert [r["capital"] for r in e] == pytest.approx([day1, day2, day2])
    assert e[1]["drawdown"] == pytest.approx(1 - day2 / day1)
    t = bt.backtest_trades(df, p)
    assert t.count() == 3 and t.agg(F.sum("pnl")).first()[0] == pytest.approx(day2 - 1000)
    m = bt.backtest_metrics(t, bt.equity_curve(df, p), p).first()
    assert m["trades"] == 3 and m["winners"] == 1 and m["days"] == 3


def test_validation_leaves_open_rows_open(spark, bars):
    preds = bars.select("entity", "date", F.lit("v").alias("model_version"), F.lit(True).alias("predicted_direction"), F.lit(1.0).alias("predicted_return"), F.lit(0.9).alias("confidence"))
    out = validation.validate(preds, bars)
    assert out.count() == preds.count() and out.where("actual_return is null").count() == 3
    assert validation.validation_stats(out).first()["validated"] == preds.count() - 3


def test_models(spark, bars):
    from barloom.operators.price import add_labels, add_lag_returns

    df = add_labels(add_lag_returns(bars)).where("next_day_return is not null")
    fit = scoring.fit_base(df, ["return_lag_1", "return_lag_2"], "next_day_return", rounds=2, depth=2)
    out = scoring.predict_base(fit, df, ["return_lag_1", "return_lag_2"])
    assert out.where("base_pred is null").count() == 0
    x = spark.range(200).selectExpr("cast(id as double) a", "cast(id * id % 17 as double) b").withColumn("y", F.col("a") * 2 - F.col("b") * 3 + 5)
    w = scoring.fit_fusion(x, "a", "b", "y").first()
    assert (w["weight_a"], w["weight_b"], w["intercept"]) == pytest.approx((2, -3, 5)) and w["mse"] == pytest.approx(0, abs=1e-6)
    bad = lambda v: np.full((len(v), 1), np.inf)
    seqs = sequences.make_sequences(bars, ["close"], 5)
    assert scoring.score_sequences(seqs, bad).where("pred_1day <> 0").count() == 0


def test_checkpoint_dir_follows_the_session(spark):
    from barloom.session import ensure_checkpoint_dir

    assert ensure_checkpoint_dir(spark) == ensure_checkpoint_dir(spark)


def test_roster_has_no_cap(spark):
    """All predictions of the newest date, however many there are; a cap only where one is asked for."""
    from barloom.plans.validation import roster

    preds = spark.range(250).selectExpr("id as entity", "date '2001-01-02' as date", "cast(id % 7 as double) as confidence")
    old = spark.range(5).selectExpr("id as entity", "date '2001-01-01' as date", "9d as confidence")
    rows = roster(preds.unionByName(old)).collect()
    assert len(rows) == 250 and rows[0]["confidence"] == 6
    assert roster(preds, n=10).count() == 10


def test_movers_of_every_date(spark):
    from barloom.plans.validation import movers

    df = spark.range(60).selectExpr("id as entity", "date_add(date '2001-01-01', cast(id % 3 as int)) as date", "cast(id as double) as close_pct")
    rows = movers(df, n=2).collect()
    assert len(rows) == 12 and {r["entity"] for r in rows if r["side"] == "best"} == set(range(54, 60))


def test_all_slots_normalises_each_volume_once(spark):
    """Bars of equal volume are counted before their vectors are made."""
    from barloom.catalog import queries

    plan = queries()["normalized_all_slots"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.split("\n")
    made = next(i for i, x in enumerate(lines) if "Generate posexplode" in x)
    assert any("Aggregate [volume" in x for x in lines[made:])
