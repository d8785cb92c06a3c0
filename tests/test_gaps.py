"""Bucketed readjustment, the second composition, sequence arrays, narrow global orders and small reports."""

from __future__ import annotations

from datetime import date
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import adjust, aggregates, quality, ranking, universe
from barloom.plans import backtest, features, scoring, signals
from barloom.sources import panel


def test_readjust_rewrites_only_buckets_with_breaks(spark, bars, tmp_path):
    raw = bars.withColumn("_p", F.lag("close").over(adjust.ordered("entity", "date"))).withColumn("pre_close", F.coalesce("_p", "open")).drop("_p")
    raw = raw.withColumn("pre_close", F.when((F.col("entity") == "B") & (F.col("date") == "2020-10-20"), F.col("pre_close") * 0.9).otherwise(F.col("pre_close")))
    path = str(tmp_path / "adjusted")
    columns = ["entity", "date", "open", "high", "low", "close", "volume", "adj_factor"]
    old = adjust.back_adjust(raw.withColumn("pre_close", F.lag("close").over(adjust.ordered("entity", "date")))).select(*columns)
    panel.write_bucketed(old, path)
    files = {f: f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")}
    home = {r["entity"]: r["b"] for r in bars.select("entity", panel.bucket_of().alias("b")).distinct().collect()}
    assert adjust.readjust_stored(raw, path, F.lit(date(2020, 10, 24))) == [home["B"]]
    want = {(r["entity"], r["date"], r["close"]) for r in adjust.back_adjust(raw).collect()}
    assert {(r["entity"], r["date"], r["close"]) for r in spark.read.parquet(path).collect()} == want
    same = [f for f in files if f"bucket={home['B']}" not in str(f).split("/")]
    assert same and all(f.stat().st_mtime_ns == files[f] for f in same)
    assert adjust.readjust_stored(raw, path, F.lit(date(2020, 12, 31)), days=2) == []


def test_on_the_fly_features_are_never_null(bars):
    flat = bars.where("entity = 'A'").withColumns({n: F.lit(5.0) for n in ("open", "high", "low", "close")}).withColumns({"volume": F.lit(0.0), "entity": F.lit("F")})
    rows = features.features_on_the_fly(bars.unionByName(flat)).collect()
    assert rows and all(x is not None for r in rows for x in r)
    r = next(r for r in rows if r["entity"] == "F")
    assert (r["williams_r_14"], r["adx_14"], r["price_position_52w"], r["asi"]) == (-50.0, 25.0, 0.5, 0.0)


def test_sequences_reach_the_model_as_arrays(spark):
    rows = [(i, [[float(i + k), float(k)] for k in range(4)]) for i in range(7)]
    df = spark.createDataFrame(rows, "entity int, seq array<array<double>>").repartition(3)
    got = {r["entity"]: (r["a"], r["b"]) for r in scoring.score_sequences(df, lambda x: np.stack([x[:, -1, 0], x[:, :, 1].sum(1) / 0.0], 1), ("a", "b")).collect()}
    assert got == {i: (float(i + 3), 0.0) for i in range(7)}
    with pytest.raises(Exception, match="differ in length"):
        scoring.score_sequences(df.unionByName(spark.createDataFrame([(9, [[1.0, 2.0]])], df.schema)).coalesce(1), lambda x: x[:, 0, 0], ("a",)).collect()


def test_global_orders_store_few_columns(spark, monkeypatch):
    kept = []
    for m in (ranking,):
        monkeypatch.setattr(m, "settle", lambda df, f=ranking.settle: kept.append(df.columns) or f(df))
    wide = spark.range(50).select(F.col("id").alias("entity"), F.lit("2020-01-01").alias("date"), (F.col("id") * 1.0).alias("p"), (F.col("id") % 7 - 3.0).alias("t"), *[F.lit(1).alias(f"x{i}") for i in range(20)])
    assert aggregates.topk_stats(wide, "p", "t", (0.1, 1.0), ["entity"]).count() == 2
    out = universe.permute_column(wide, "t")
    assert out.columns == wide.columns and sorted(r["t"] for r in out.collect()) == sorted(r["t"] for r in wide.collect())
    assert kept and all(len(c) <= 6 for c in kept)


def test_profit_factor_without_losses(spark):
    def metrics(pnl):
        trades = spark.createDataFrame([(p, p > 0) for p in pnl], "pnl double, is_winner boolean")
        equity = spark.createDataFrame([(date(2020, 1, 1), 1.0, 0.0, 0.01), (date(2020, 1, 2), 1.1, 0.0, 0.02)], "date date, capital double, drawdown double, day_return double")
        return backtest.backtest_metrics(trades, equity).first()["profit_factor"]

    assert metrics([2.0, 1.0]) == float("inf") and metrics([0.0]) == 0.0 and metrics([3.0, -2.0]) == 1.5


def test_picks_missing_columns_and_eligibility(spark):
    rows = [(f"e{i}", date(2020, 1, 1), k, float(s)) for i, (k, s) in enumerate([("BUY", 5), ("SELL", 9), ("STRONG_BUY", 7), ("BUY", 6)])]
    df = spark.createDataFrame(rows, "entity string, date date, signal_type string, signal_score double")
    assert [r["entity"] for r in signals.top_picks(df, 2).collect()] == ["e2", "e3"]
    gaps = spark.createDataFrame([(1, None, None), (2, None, 1), (3, 4, None)], "a int, b int, c int")
    assert [(r["column"], r["nulls"]) for r in quality.most_missing(gaps, n=5).collect()] == [("b", 2), ("c", 2)]
    bars = spark.createDataFrame([("x", date(2020, 5, 1), 3.0), ("y", date(2019, 5, 1), 3.0), ("z", date(2020, 5, 1), 3.0)], "entity string, date date, close double")
    dim = spark.createDataFrame([("x", "a", date(2010, 1, 1)), ("y", "b", date(2010, 1, 1)), ("z", "c", date(2019, 1, 1))], "entity string, name string, list_date date")
    day = lambda d: F.lit(d).cast("date")
    able = lambda **kw: sorted(r["entity"] for r in universe.eligible_entities(bars, dim, **kw).collect())
    assert able() == ["x", "y", "z"] and able(start=day("2020-01-01")) == ["x", "z"] and able(start=day("2020-01-01"), years=5) == ["x"]
    assert able(start=day("2019-01-01"), end=day("2019-12-31")) == ["y"]
