"""Trailing values from Arrow batches: the same as windows give, of narrow rows, whatever the batches."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

import barloom.catalog  # noqa: F401 registers the queries
from barloom.catalog.base import queries
from barloom.operators import trailing
from barloom.operators.trailing import Trail, trailing_values
from barloom.operators.windows import apply_steps, row_no
from barloom.plans.features import bar_steps, build_features

from conftest import DATA


def holed(bars):
    day = F.dayofyear("date")
    holes = {"close": day % 23 == 3, "high": day % 29 == 5, "low": day % 31 == 6, "volume": day.between(100, 131)}
    return bars.withColumns({n: F.when(~at, F.col(n)) for n, at in holes.items()})


def same(got, want, skip=()):
    columns = [n for n in want.columns if n not in ("entity", "date", *skip)]
    left, right = ({(r.entity, r.date): r for r in df.select("entity", "date", *columns).collect()} for df in (got, want))
    assert left.keys() == right.keys() and left
    for k, r in right.items():
        for n in columns:
            a, b = left[k][n], r[n]
            assert (a is None) == (b is None) and (a is None or a == b or abs(a - b) <= 1e-9 * max(1.0, abs(b))), (k, n, a, b)


def test_the_feature_table_gives_what_the_single_features_give(spark, bars, monkeypatch):
    """all values over earlier rows, gaps included, with entities cut over batches and many to an array."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        for rows in (bars, holed(bars), bars.where("entity <> 'B' OR date < '2020-01-09'")):
            same(build_features(rows, min_rows=1), apply_steps(rows, bar_steps()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_short_entities_and_places_ahead(spark):
    rows = spark.createDataFrame([("A", 1, 1.0), ("B", 1, 2.0), ("B", 2, None), ("B", 3, 4.0), ("C", 1, 5.0), ("C", 2, 5.0)], "entity string, date int, x double")
    wanted = {
        "two": Trail("mean", "x", 2), "next": Trail("value", "x", 1, -1), "sum": Trail("total", "x"), "run": Trail("run", "x"),
        "old": Trail("max", "x", 2, 1), "long": Trail("ema", "x", 260), "ago": Trail("ago_max", "x", 2), "below": Trail("share_below", "x", 2),
    }
    made = trailing_values(rows.withColumn("n", row_no()), wanted, "n").orderBy("entity", "date").collect()
    assert [r.two for r in made] == [None, None, 2.0, 4.0, None, 5.0]
    assert [r.next for r in made] == [None, None, 4.0, None, 5.0, None]
    assert [r.sum for r in made] == [1.0, 2.0, 2.0, 6.0, 5.0, 10.0] and [r.run for r in made] == [1, 1, 1, 1, 1, 2]
    assert [r.old for r in made] == [None, None, None, 2.0, None, None] and all(r.long is None for r in made)
    assert [r.ago for r in made] == [None, None, 1, 0, None, 0] and [r.below for r in made] == [None, None, 0, 0.5, None, 0]


def windows_by_entity(spark, name) -> tuple[list[str], str]:
    shown = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "2000")
    try:
        plan = queries()[name](spark, DATA)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", shown)
    return [line for line in plan.splitlines() if "- Window [" in line and "windowspecdefinition(entity" in line], plan


def test_windows_of_the_feature_table_carry_narrow_rows(spark):
    """no window keeps a frame of earlier rows, and none has more than a few lags to write into its rows."""
    windows, plan = windows_by_entity(spark, "feature_table")
    assert len(windows) == 1 and windows[0].count("lag(") <= 12
    assert not re.search(r"stddev_pop|collect_list", windows[0]) and plan.count("MapInArrow") == 1


def test_the_increment_gets_only_its_own_rows_back(spark):
    """carried bars serve the values of the newest year and go no further; what is wide is made of that year's rows."""
    windows, plan = windows_by_entity(spark, "feature_table_increment")
    assert len(windows) == 1 and windows[0].count("lag(") <= 12 and plan.count("MapInArrow") == 1
    above = plan.split("MapInArrow")[0]
    assert "Filter" not in above and "Join" not in above


def test_pieces_hold_whole_entities(monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(trailing, "CELLS", 50)
    row = np.concatenate([np.arange(1, n + 1) for n in (3, 40, 1, 1, 1, 90, 2)])
    batches = [pa.RecordBatch.from_arrays([pa.array(x)], ["n"]) for x in np.array_split(row, 9)]
    pieces = [p.column("n").to_numpy() for t in trailing._entities(iter(batches), "n") for p in trailing._pieces(t, {"x": Trail("sum", "n", 5)}, "n")]
    assert (np.concatenate(pieces) == row).all() and all(p[0] == 1 for p in pieces) and len(pieces) > 2
