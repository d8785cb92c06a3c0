"""Incremental feature runs, recurrences, expanding medians and date-pruned reads."""

from __future__ import annotations

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.catalog import REGISTRY
from barloom.operators import context, recurrence, trend
from barloom.plans import increment
from barloom.plans.features import build_features
from barloom.session import settle
from barloom.sources import panel
from barloom.sources.tables import Tables
from conftest import BAR, DATA, walk


def rows_of(df):
    return {(r["entity"], r["date"]): r.asDict() for r in df.collect()}


def same(got, want):
    assert got.keys() == want.keys()
    for k, r in want.items():
        assert got[k].keys() == r.keys()
        for n, x in r.items():
            y = got[k][n]
            assert y == x or (isinstance(x, float) and y == pytest.approx(x, rel=1e-7, abs=1e-7)), (k, n)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """900 days of three entities, one of which ends early, as a panel with its states."""
    rows = [r for r in walk(days=900) if not (r[0] == "C" and r[1] > date(2021, 3, 1))]
    bars = spark.createDataFrame(rows, BAR)
    at = tmp_path_factory.mktemp("panel")
    panel.write_panel(bars, f"{at}/bars")
    increment.write_states(spark, f"{at}/bars", f"{at}/states")
    return bars, str(at)


def test_increment_equals_the_tail_of_the_full_table(spark, stored):
    bars, at = stored
    dim = spark.createDataFrame([("A", "x"), ("B", "x"), ("C", "y")], "entity string, industry string")
    full = build_features(bars, dim).where("date >= '2022-02-10'")
    rows = increment.rows_since(spark, f"{at}/bars", f"{at}/states", date(2022, 2, 10))
    same(rows_of(increment.features_since(rows, date(2022, 2, 10), dim=dim)), rows_of(full))
    # the first year has no state before it
    rows = increment.rows_since(spark, f"{at}/bars", f"{at}/states", date(2020, 11, 1))
    same(rows_of(increment.features_since(rows, date(2020, 11, 1), dim=dim)), rows_of(build_features(bars, dim).where("date >= '2020-11-01'")))


def test_increment_reads_two_years_and_merges_open_labels(spark, stored):
    bars, at = stored
    first = date(2022, 1, 1)
    rows = increment.rows_since(spark, f"{at}/bars", f"{at}/states", first)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "year" in plan and plan.count("PartitionFilters: [") >= 2 and "PartitionFilters: []" not in plan
    assert ">= 2022" in plan and "= 2021" in plan
    # the table as it was before the last year, then the run that adds that year
    old = build_features(bars.where(F.col("date") < F.lit(first)))
    panel.write_panel(old, f"{at}/features")
    before = {f.name for f in (stored_files(at, 2020))}
    fresh = increment.features_since(rows, first, open_rows=3)
    increment.merge_tail(f"{at}/features", settle(fresh), spark)
    same(rows_of(spark.read.parquet(f"{at}/features").drop("year")), rows_of(build_features(bars)))
    assert {f.name for f in stored_files(at, 2020)} == before


def stored_files(at, year):
    from pathlib import Path

    return list(Path(f"{at}/features/year={year}").glob("*.parquet"))


def test_states_go_on_from_the_year_before(spark, stored, tmp_path):
    bars, at = stored
    once = {r["entity"]: r for r in increment.roll_state(bars).collect()}
    last = {r["entity"]: r for r in spark.read.parquet(f"{at}/states").where("year = 2022").collect()}
    assert once.keys() == last.keys()
    for e, r in once.items():
        assert r["seen"] == last[e]["seen"] and r["tail"] == last[e]["tail"] and len(r["tail"]) <= increment.TAIL
        assert r["obv"] == last[e]["obv"] and r["asi"] == pytest.approx(last[e]["asi"], rel=1e-9)
    increment.write_states(spark, f"{at}/bars", f"{at}/states", since=2022)
    again = {r["entity"]: r for r in spark.read.parquet(f"{at}/states").where("year = 2022").collect()}
    assert again == last


def test_overwrite_leaves_no_stale_year(spark, stored, tmp_path):
    bars, _ = stored
    path = str(tmp_path / "p")
    panel.write_panel(bars, path)
    panel.write_panel(bars.where("year(date) = 2021"), path)
    assert {r["year"] for r in spark.read.parquet(path).select("year").distinct().collect()} == {2021}
    panel.write_panel(bars, path)
    panel.replace_years(bars.where("year(date) = 2021").withColumn("close", F.lit(1.0)), path)
    got = spark.read.parquet(path)
    assert got.where("year = 2021 and close != 1").count() == 0 and got.count() == bars.count()


def test_recurrences_match_a_loop(spark):
    rng = np.random.default_rng(1)
    rows = [(e, date(2020, 1, 1) + timedelta(days=i), float(a) if i % 13 else None, float(b)) for e, n in (("hot", 700), ("cold", 5), ("one", 1)) for i, (a, b) in enumerate(zip(rng.uniform(-1, 1, n), rng.normal(size=n)))]
    df = spark.createDataFrame(rows, "entity string, date date, a double, b double")
    for size in (4, 64, 1024):
        got = rows_of(recurrence.linear_recurrences(df, {"x": (F.col("a"), F.col("b"))}, {"y": (F.lit(0.5), F.col("x"))}, size=size))
        for e in ("hot", "cold", "one"):
            x = y = 0.0
            for r in (r for r in rows if r[0] == e):
                x = x if r[2] is None else r[2] * x + r[3]
                y = 0.5 * y + x
                assert got[e, r[1]]["x"] == pytest.approx(x, abs=1e-9) and got[e, r[1]]["y"] == pytest.approx(y, abs=1e-9)
    plan = recurrence.linear_recurrences(df, {"x": (F.col("a"), F.col("b"))}, size=16)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_recursive_macd_matches_pandas(spark, bars):
    got = rows_of(trend.add_macd_recursive(bars))
    pdf = bars.toPandas().sort_values(["entity", "date"])
    for e, part in pdf.groupby("entity"):
        ema = lambda s, p: s.ewm(alpha=2 / (p + 1), adjust=False).mean()
        line = ema(part["close"], 12) - ema(part["close"], 26)
        for d, m, s in zip(part["date"], line, ema(line, 9)):
            assert got[e, d]["macd"] == pytest.approx(m, abs=1e-9) and got[e, d]["macd_ema_signal"] == pytest.approx(s, abs=1e-9)


def test_expanding_median_matches_numpy():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 3, 50, 400):
        x = rng.integers(0, 20, n).astype(float)
        x[rng.random(n) < 0.1] = np.nan
        want = [np.nan if np.isnan(x[: i + 1]).all() else np.nanmedian(x[: i + 1]) for i in range(n)]
        np.testing.assert_array_equal(context.expanding_median(x), want)


REPORTS = [n for n in REGISTRY if n.startswith("report_") and n not in ("report_trading", "report_prediction_overview", "report_best_labels", "report_rising_constituents")]


@pytest.mark.parametrize("name", REPORTS)
def test_reports_read_from_a_lower_date_on(spark, name):
    plan = REGISTRY[name].run(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.split("\n") if "lineitem" in x and "FileScan" in x]
    assert all("GreaterThanOrEqual(l_shipdate" in x for x in scans), scans


def test_returns_of_entities_without_a_near_bar(spark, tmp_path):
    """An entity's bar before the first date may lie before all lines that were read."""
    t = Tables(spark, DATA)
    newest = t.recent(0).as_of
    lines = t.table("lineitem")
    one = lines.where(F.col("l_shipdate").cast("date") == F.lit(newest)).select("l_suppkey").first()[0]
    near = (F.col("l_suppkey") == one) & (F.col("l_shipdate").cast("date") < F.lit(newest)) & (F.col("l_shipdate").cast("date") > F.lit(newest - timedelta(days=900)))
    for n in ("supplier", "nation", "region"):
        t.table(n).write.parquet(f"{tmp_path}/{n}.parquet")
    lines.where(~near).write.parquet(f"{tmp_path}/lineitem.parquet")
    cut = Tables(spark, str(tmp_path))
    at = F.lit(newest)
    want = {(r["entity"], round(r["pct_chg"], 9)) for r in cut.returns().where(F.col("date") == at).collect()}
    got = {(r["entity"], round(r["pct_chg"], 9)) for r in cut.recent(0).returns().collect()}
    assert got == want and one in {e for e, _ in got}
    assert cut.newest_features() is None and Tables(spark, DATA).newest_features() is not None
