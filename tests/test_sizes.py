"""What keeps the work in proportion to the input: who moves rows, and how often."""

from __future__ import annotations

import os
import re
from datetime import date, timedelta

from pyspark.sql import functions as F

import barloom.catalog  # noqa: F401 registers the queries
from barloom.catalog.base import queries
from barloom.functions.scalars import round_to
from barloom.operators import momentum, trend, volatility, volume, windows
from barloom.plans import features, increment
from barloom.session import parts_of, settle_by
from barloom.sources.panel import write_panel

from conftest import DATA


def plan_of(df) -> str:
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def test_stored_bars_stay_where_they_are(spark, bars):
    """Context is brought to bars that lie by entity; none of them is shuffled for it, nor for any window (F1)."""
    stored = settle_by(bars, "entity", "date")
    dim = spark.sql("SELECT * FROM VALUES ('A', 'x'), ('B', 'x'), ('C', 'y') AS t(entity, industry)")
    days = [date(2020, 1, 1) + timedelta(days=i) for i in range(300)]
    index = spark.createDataFrame([(k, d, 1.0, 0.5) for k in features.INDEX_CODES for d in days], "code string, date date, close double, pct_chg double")
    made = features.build_features(stored, dim, index, momentum_index="chinext")
    plan = plan_of(made)
    assert "Exchange hashpartitioning(entity" not in plan and "Exchange hashpartitioning(prev_date" not in plan
    assert made.count() == bars.groupBy("entity").count().agg(F.sum(F.col("count") - 59)).first()[0]


def test_rounding_is_half_up_as_before(spark):
    """Doubles are rounded by arithmetic on doubles, ties away from zero, as through their decimal text."""
    values = [0.0, -0.0, 0.5, -0.5, 1.5, 2.5, -2.5, 0.49999999999999994, -0.49999999999999994, 4503599627370495.5, -4503599627370495.5, 9007199254740993.0, 1e300, -1e19, 1.005, 123.4565, float("inf"), float("-inf"), float("nan"), None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (0, 2, 6):
        scale = float(10**digits)
        got = df.select(round_to("x", digits).alias("a"), (F.round(F.col("x") * scale) / scale).alias("b")).collect()
        assert [repr(r.a) for r in got] == [repr(r.b) for r in got]
        assert "round(" not in plan_of(df.select(round_to("x", digits)))


def test_one_state_is_the_last_of_all_states(spark, bars, tmp_path):
    """The state of the year before comes from one pass over the bars, not from a state for every year (F2)."""
    panel, every, one = (str(tmp_path / n) for n in ("panel", "every", "one"))
    extra = bars.withColumn("date", F.expr("date + 365"))
    write_panel(bars.unionByName(extra.where("date > DATE'2020-12-31'")), panel)
    increment.write_states(spark, panel, every, tail=50)
    increment.write_state_before(spark, panel, one, date(2021, 3, 1), tail=50)
    read = lambda p: spark.read.parquet(p).where("year = 2020").orderBy("entity").collect()
    assert [f for f in os.listdir(one) if f.startswith("year")] == ["year=2020"]
    for a, b in zip(read(every), read(one), strict=True):
        assert (a.entity, a.seen, a.last_date, a.tail) == (b.entity, b.seen, b.last_date, b.tail)
        assert abs(a.obv - b.obv) < 1e-9 and abs(a.asi - b.asi) < 1e-9


def test_partitions_follow_the_rows(spark):
    """A task's share of the rows has a bound, whatever the session's number of partitions."""
    assert parts_of(spark, 10) == spark.sparkContext.defaultParallelism
    assert parts_of(spark, 200_000_001) == 401


def test_versions_are_made_once(spark):
    """Repeats of predictions come from one reading of the lines, and what is done by key moves no row again."""
    for name in ("copies_per_key", "duplicate_keys", "dedup_last"):
        plan = plan_of(queries()[name](spark, DATA))
        assert plan.count("FileScan parquet") == 1 and plan.count("Exchange hashpartitioning") == 2, name


def test_signals_read_the_lines_once(spark):
    """Predictions, indicators and valuation are made of one set of stored bars and meet without a shuffle of them."""
    for name in ("signal_context", "signal_summary", "readjusted"):
        plan = plan_of(queries()[name](spark, DATA))
        assert "l_shipdate" not in plan and plan.count("Exchange hashpartitioning(entity#") <= 3, name


def test_trees_read_stored_rows(spark):
    """What the trees are fitted on and applied to is made once."""
    assert "FileScan parquet" not in plan_of(queries()["boosted_base_facts"](spark, DATA))


def test_landing_parses_one_kind(spark, monkeypatch):
    """A landing query parses no payload of a kind that it does not return."""
    from barloom.catalog import ingest

    seen, land = [], ingest.landing.land
    monkeypatch.setattr(ingest.landing, "land", lambda landed, tables, *rest: seen.append(set(tables)) or land(landed, tables, *rest))
    queries()["landing_replace"](spark, DATA)
    assert seen == [{"index_daily"}]


def test_label_is_sorted_once_for_all_features(spark, monkeypatch):
    """Ranks of many features against one label, ties, gaps, NaN and a value with half of all rows included, store no row of a feature (F8)."""
    import numpy as np
    import pandas as pd

    from barloom.operators import quality, ranking

    rng = np.random.default_rng(3)
    n = 30_000
    y = np.where(rng.random(n) < 0.5, 0.25, rng.normal(size=n).round(2))
    x = {"plain": rng.normal(size=n) + y, "few": rng.integers(0, 3, n).astype(float), "hot": np.where(rng.random(n) < 0.6, -0.0, y), "zero": np.where(rng.random(n) < 0.5, 0.0, -0.0) + (y > 0.25)}
    x["gaps"] = np.where((rng.random(n) < 0.3) | (y == 0.25), None, x["plain"])
    table = pd.DataFrame(x).astype(float).assign(y=y)
    df = spark.createDataFrame(table).select("y", *[F.when(~F.isnan(k), F.col(k)).alias(k) for k in x])
    stored, settle = [], ranking.settle
    monkeypatch.setattr(ranking, "settle", lambda d: stored.append(settle(d)) or stored[-1])
    monkeypatch.setattr(quality, "settle", ranking.settle)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")
    try:
        got = {r.feature: r for r in quality.feature_label_corr(df, list(x), "y").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert max(d.count() for d in stored) == n
    for k in x:
        pair = table[[k, "y"]].dropna()
        want = pair[k].rank().corr(pair["y"].rank())
        assert got[k].n == len(pair) and abs(got[k].spearman - want) < 1e-9, k


def test_blocks_read_stored_rows(spark):
    """Rows that go into blocks are made once, and lie by entity and period where they are counted and numbered."""
    for name in ("features_in_blocks", "volume_in_blocks"):
        plan = plan_of(queries()[name](spark, DATA))
        assert "FileScan parquet" not in plan and "Exchange hashpartitioning(entity#" in plan, name


def test_short_windows_are_lags_not_sliding_frames(spark):
    """a sliding frame folds its rows again at every row; only the deviation of 20 closes is one."""
    shown = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        plan = plan_of(queries()["feature_table_on_the_fly"](spark, DATA))
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", shown)
    nodes = [line for line in plan.splitlines() if "- Window [" in line]
    frames = [x for line in nodes for x in re.findall(r"(\w+)\([^()]*\) windowspecdefinition\([^()]*specifiedwindowframe\(RowFrame, -\d+, currentrow", line)]
    assert len(nodes) == 2 and len(frames) <= 1
    assert plan.count("Exchange hashpartitioning(entity") == 1 and plan.count("Sort [entity") == 1


def test_short_windows_skip_nulls_as_frames_do(spark, bars):
    day = F.dayofyear("date")
    holes = {"close": day % 11 == 3, "high": day % 13 == 5, "low": day % 17 == 6, "volume": day.between(40, 47)}
    bars = bars.withColumns({n: F.when(~at, F.col(n)) for n, at in holes.items()})
    steps = windows.merge(
        trend.sma_steps((5, 20)), volume.volume_vs_mean_steps(), momentum.kdj_steps(), volatility.atr_steps(),
        windows.extreme_steps({"top": ("high", "max", 60), "bottom": ("low", "min", 60)}),
    )
    steps[1] |= {"kdj_low": F.col("_kdj_low"), "mean_volume": F.col("_vm")}
    got = windows.apply_steps(bars, steps)
    move = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("p")), F.abs(F.col("low") - F.col("p")))
    want = bars.withColumn("p", windows.lagged("close")).withColumn("tr", F.when(F.col("p").isNotNull(), move)).select(
        "entity", "date",
        *[windows.warm(n, F.avg("close").over(windows.trailing(n))).alias(f"sma_{n}") for n in (5, 20)],
        windows.warm(5, F.avg("volume").over(windows.trailing(5))).alias("mean_volume"), F.min("low").over(windows.trailing(9)).alias("kdj_low"),
        windows.warm(15, F.avg("tr").over(windows.trailing(14))).alias("atr"),
        F.max("high").over(windows.trailing(60)).alias("top"), F.min("low").over(windows.trailing(60)).alias("bottom"),
    )
    assert got.select(want.columns).exceptAll(want).count() == 0 and got.count() == want.count()


def test_long_methods_fall_back_where_no_limit_is_set(spark):
    name, kept = "spark.sql.codegen.hugeMethodLimit", spark.conf.get("spark.sql.codegen.hugeMethodLimit")
    try:
        for given, after in (("65535", "8000"), ("5000", "5000")):
            spark.conf.set(name, given)
            queries()["feature_table_on_the_fly"](spark, DATA)
            assert spark.conf.get(name) == after
    finally:
        spark.conf.set(name, kept)
