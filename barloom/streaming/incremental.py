"""Watermarks, run windows, warm-up and gap planning (INC-01..05)."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.windows import row_no

c = F.col


def next_start(facts: DataFrame, dim: DataFrame | None = None, ts: str = "date") -> DataFrame:
    """The day after the newest stored date, else the earliest listing date (one row)."""
    top = facts.agg(F.date_add(F.max(ts), 1).alias("_next"))
    if dim is None:
        return top.select(c("_next").alias("next_start"))
    first = dim.agg(F.min("list_date")).scalar()
    return top.select(F.coalesce("_next", first).alias("next_start"))


def next_start_per(facts: DataFrame, key: str = "entity", ts: str = "date") -> DataFrame:
    return facts.groupBy(key).agg(F.date_add(F.max(ts), 1).alias("next_start"))


def plan_window(
    first: date, last: date, watermark: date | None = None, start: date | None = None, end: date | None = None,
    history_years: int | None = None, as_of: date | None = None, lookback_days: int = 750,
) -> tuple[date, date]:
    """Dates to recompute.

    From ``lookback_days`` before the watermark (the whole history without one), not before the history cap
    of 365 days a year, replaced by explicit bounds, and never past ``as_of``.
    """
    as_of = as_of or last
    lo = max(first, watermark - timedelta(days=lookback_days)) if watermark else first
    if history_years:
        lo = max(lo, as_of - timedelta(days=365 * history_years))
    lo, hi = start or lo, min(end or last, as_of)
    return min(lo, hi), hi


def with_warmup(
    bars: DataFrame, build: Callable[[DataFrame], DataFrame], min_date: Column, days: int = 400, min_rows: int = 60,
    key: str = "entity", ts: str = "date",
) -> DataFrame:
    """Read ``days`` more history than is emitted; emit rows from ``min_date`` on that have ``min_rows`` rows
    of history in what was read."""
    history = bars.where(c(ts) >= F.date_sub(min_date, days)).withColumn("_seen", row_no(key, ts))
    return build(history).where((c(ts) >= min_date) & (c("_seen") >= min_rows)).drop("_seen")


def open_days(calendar: DataFrame, start: Column | None = None, end: Column | None = None, day: str = "cal_date") -> DataFrame:
    """Trading days; the flag may be a number or text."""
    out = calendar.where(c("is_open").cast("string").try_cast("int") == 1)
    if start is not None:
        out = out.where(c(day) >= start)
    if end is not None:
        out = out.where(c(day) <= end)
    return out


def missing_dates(calendar: DataFrame, facts: DataFrame, day: str = "date", ts: str = "date") -> DataFrame:
    """Trading days without facts."""
    have = facts.select(c(ts).alias(day)).distinct()
    return calendar.join(have, day, "left_anti")


def fetch_plan(calendar: DataFrame, answers: DataFrame, stop_after: int = 15, day: str = "date") -> DataFrame:
    """Days to fetch, newest first, ending with the ``stop_after``-th empty day in a row.

    ``answers`` says per day whether the vendor had rows (``has_rows``).  The window runs over the calendar.
    """
    w = Window.orderBy(c(day).desc())
    days = calendar.join(answers, day, "left").withColumn("has_rows", F.coalesce("has_rows", F.lit(False)))
    numbered = days.withColumn("order", F.row_number().over(w))
    hit = F.last(F.when(c("has_rows"), c("order")), ignorenulls=True).over(
        w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    runs = numbered.withColumn("empty_run", c("order") - F.coalesce(hit, F.lit(0)))
    stopped = F.coalesce(
        F.max(F.when(c("empty_run") >= stop_after, 1).otherwise(0)).over(
            w.rowsBetween(Window.unboundedPreceding, -1)
        ),
        F.lit(0),
    )
    return runs.withColumn("_stopped", stopped).where(c("_stopped") == 0).select(day, "order", "has_rows", "empty_run")
