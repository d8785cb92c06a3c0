"""Feature operators against row loops, edge cases and the no-look-ahead property."""

from __future__ import annotations

from collections import defaultdict
from datetime import date

import pytest
from pyspark.sql import functions as F

from barloom.operators import adjust, context, momentum, pattern, price, trend, volatility, volume
from barloom.operators.windows import apply_steps, factors
from barloom.plans.features import bar_steps
from conftest import BAR, flat_bar, walk


def series(rows):
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[0], r[1])):
        out[r[0]].append(r)
    return out


def by_row(df, *cols):
    return {(r["entity"], r["date"]): tuple(r[c] for c in cols) for r in df.collect()}


def close_to(a, b):
    return (a is None and b is None) or a == pytest.approx(b, rel=1e-9, abs=1e-9)


def test_factorisation():
    for n in range(1, 300):
        f = factors(n)
        if f is not None:
            p = 1
            for x in f:
                p *= x
            assert p == n
    assert factors(17 * 3) is None
    assert sum(factors(260)) <= 22


def test_ema_and_macd_against_a_fold(bars):
    got = by_row(trend.add_macd(trend.add_ema(bars, (5, 17, 60))), "ema_5", "ema_17", "ema_60", "macd_line")

    def ema(closes, p):
        if len(closes) < p:
            return None
        part = closes[-p:]
        e = sum(part) / p
        for x in part:
            e = (x - e) * 2 / (p + 1) + e
        return e

    for e, rows in series(walk()).items():
        closes = []
        for r in rows:
            closes.append(r[5])
            want = [ema(closes, p) for p in (5, 17, 60)]
            fast, slow = ema(closes, 12), ema(closes, 26)
            want.append(None if slow is None else fast - slow)
            assert all(close_to(a, b) for a, b in zip(got[(e, r[1])], want))


def test_rsi_williams_range_against_loops(bars):
    df = volatility.add_range_position(momentum.add_williams_r(momentum.add_rsi(bars)))
    got = by_row(df, "rsi_14", "williams_r_14", "price_position_52w")
    for e, rows in series(walk()).items():
        for i, r in enumerate(rows):
            rsi = None
            if i >= 14:
                moves = [rows[j][5] - rows[j - 1][5] for j in range(i - 13, i + 1)]
                up, down = sum(m for m in moves if m > 0), -sum(m for m in moves if m < 0)
                rsi = 100.0 if down == 0 else 100 - 100 / (1 + up / down)
            wr = None
            if i >= 13:
                hi, lo = max(x[3] for x in rows[i - 13 : i + 1]), min(x[4] for x in rows[i - 13 : i + 1])
                wr = -100 * (hi - r[5]) / (hi - lo)
            pos = None
            if i >= 251:
                hi, lo = max(x[3] for x in rows[i - 251 : i + 1]), min(x[4] for x in rows[i - 251 : i + 1])
                pos = (r[5] - lo) / (hi - lo)
            assert all(close_to(a, b) for a, b in zip(got[(e, r[1])], (rsi, wr, pos)))


def test_streaks_break_on_equal_closes(spark):
    closes = [10, 11, 12, 12, 11, 10, 9, 10]
    df = spark.createDataFrame([flat_bar("A", i, float(x)) for i, x in enumerate(closes)], BAR)
    df = pattern.add_streak(pattern.add_streak(df), "capped", "down", 2)
    rows = df.orderBy("date").collect()
    assert [r["consecutive_days"] for r in rows] == [None, 1, 2, 0, -1, -2, -3, 1]
    assert [r["capped"] for r in rows] == [None, 1, 2, -1, -2, -2, -2, 1]


def test_flat_bars_and_zero_volume(spark):
    df = spark.createDataFrame([flat_bar("A", i, 10.0, 0.0) for i in range(30)], BAR)
    out = price.add_intraday(volume.add_cmf(volume.add_vwap_distance(volume.add_volume_features(df))))
    out = momentum.add_kdj(momentum.add_williams_r(volatility.add_bollinger(trend.add_adx(out))))
    last = out.orderBy(F.desc("date")).first()
    assert last["close_position_in_range"] is None and last["volume_ratio"] is None
    assert last["cmf_20"] == 0 and last["vwap_distance_pct"] == 0 and last["adx_14"] == 0
    assert last["bb_percent_b"] == 0.5 and last["bb_upper"] == last["bb_middle"] == last["bb_lower"] == 10
    assert last["williams_r_14"] == -50 and last["kdj_k"] is None


def test_bollinger_invariants(bars):
    df = volatility.add_bollinger(trend.add_sma(bars)).where(F.col("bb_middle").isNotNull())
    bad = df.where((F.col("bb_lower") > F.col("bb_middle")) | (F.col("bb_middle") > F.col("bb_upper")) | (F.abs(F.col("bb_middle") - F.col("sma_20")) > 1e-9))
    assert bad.count() == 0 and df.count() > 0


def test_back_adjust_scales_earlier_rows(spark):
    rows = [("A", date(2021, 1, d), 10.0, 10.0, 10.0, p, q, 1.0) for d, p, q in ((1, 10.0, 10.0), (2, 10.0, 10.0), (3, 5.0, 5.0), (4, 5.0, 5.0))]
    df = spark.createDataFrame(rows, "entity string, date date, open double, high double, low double, close double, pre_close double, volume double")
    ref = [r["close"] for r in adjust.back_adjust(df).orderBy("date").collect()]
    book = [r["close"] for r in adjust.back_adjust(df, inclusive=False).orderBy("date").collect()]
    assert ref == [5.0, 5.0, 2.5, 5.0]
    assert book == [5.0, 5.0, 5.0, 5.0]
    assert [r["entity"] for r in adjust.needs_adjust(df, F.lit("2021-01-05").cast("date")).collect()] == ["A"]


def test_changing_the_future_changes_no_earlier_feature(spark):
    rows = walk(("A", "B"), 290)
    cut = date(2020, 9, 1)
    bent = [r if r[1] <= cut else (*r[:2], *[x * 3 for x in r[2:6]], r[6] + 9, r[7]) for r in rows]
    steps = lambda: bar_steps(labels=False)
    a, b = (apply_steps(spark.createDataFrame(x, BAR), steps()).where(F.col("date") <= cut) for x in (rows, bent))
    assert a.exceptAll(b).count() == 0 and a.count() > 0


def test_bar_features_need_one_exchange_by_entity(spark, bars):
    plan = apply_steps(bars, bar_steps())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(entity") == 1
    assert plan.count("Sort [entity") == 1
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert 3 <= plan.count("- Window [") <= 7


def test_group_context_is_strictly_prior(spark, bars):
    dim = spark.createDataFrame([("A", "x"), ("B", "x"), ("C", "y")], "entity string, industry string")
    series = context.group_series(price.add_returns(bars).withColumnRenamed("close_pct", "pct_chg"), dim)
    rows = bars.join(dim, "entity")
    out = context.add_group_context(rows, series, ref_date="ref_date")
    assert out.count() == rows.count()
    assert out.where(F.col("ref_date") >= F.col("date")).count() == 0
    first = out.where(F.col("date") == "2020-01-01").collect()
    assert all(r["industry_avg_return"] is None for r in first)


def test_recursive_macd_and_calendar_text(spark, bars):
    out = trend.add_macd_recursive(bars.select("entity", "date", "close")).where("entity = 'A'").orderBy("date").collect()
    fast = slow = sig = None
    for r in out:
        x = r["close"]
        fast = x if fast is None else fast + (x - fast) * 2 / 13
        slow = x if slow is None else slow + (x - slow) * 2 / 27
        line = fast - slow
        sig = line if sig is None else sig + (line - sig) * 0.2
        assert close_to(r["macd"], line) and close_to(r["macd_ema_signal"], sig)
    df = price.add_calendar(spark.createDataFrame([("20240101",), ("bad",)], "date string")).orderBy("date").collect()
    assert (df[0]["weekday"], df[0]["week_no"], df[0]["quarter"]) == (0, 1, 1) and df[1]["month"] is None


def test_returns_after_a_close_of_zero(spark):
    from barloom.operators.price import add_returns

    rows = [flat_bar("A", 0, 5.0), flat_bar("A", 1, 0.0), flat_bar("A", 2, 5.0), flat_bar("B", 0, 0.0)]
    got = [r["close_pct"] for r in add_returns(spark.createDataFrame(rows, BAR)).orderBy("entity", "date").collect()]
    assert got[:3] == [0.0, -100.0, float("inf")] and got[3] != got[3]  # as floating point divides
