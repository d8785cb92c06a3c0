"""Incremental runs of the feature table (FP-01, INC-03).

Beside a panel stored by year lies a state table, also by year: what a run needs of an entity's history as of the end of
that year.  It holds the last ``TAIL`` bars of each entity, which fill every window, and the totals of OBV and ASI up to
the first of them.  A run from some date reads the state of the year before and the bars of the years from then on;
both reads are bounded by partition pruning, so its cost follows the new rows and not the history.  The state of a year
comes from the state of the year before and the bars of the year alone.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.operators.volume import contributions
from barloom.plans.features import build_features
from barloom.session import settle
from barloom.sources.panel import read_panel, replace_years

c = F.col

TAIL = 320  # rows; the longest look-back is 260, and the rows whose labels are still open need theirs as well
BASES = ("_base_obv", "_base_asi")


def carried_bars(state: DataFrame, key: str = "entity") -> DataFrame:
    """The bars that a state carries."""
    return state.select(key, F.explode("tail").alias("_b")).select(key, "_b.*")


def roll_state(bars: DataFrame, state: DataFrame | None = None, tail: int = TAIL, origin=None, key: str = "entity", ts: str = "date") -> DataFrame:
    """The state after ``bars``, which all lie behind ``state``: entity, last_date, seen, obv, asi, tail (bars by date).

    ``obv`` and ``asi`` are the totals up to and including the first bar of the tail; ``seen``: bars before it.  Entities
    without new bars keep what they have.
    """
    rows = bars if state is None else carried_bars(state, key).select(*bars.columns).unionByName(bars)
    place = F.row_number().over(Window.partitionBy(key).orderBy(c(ts).desc()))
    rows = contributions(rows, origin, key, ts).withColumn("_place", place)
    old = c("_place") >= tail
    bar = F.struct(ts, *[n for n in bars.columns if n not in (key, ts)])
    fresh = rows.groupBy(key).agg(
        F.max(ts).alias("last_date"),
        F.count_if(c("_place") > tail).alias("_seen"),
        F.sum(F.when(old, c("_signed")).otherwise(0.0)).alias("_obv"),
        F.sum(F.when(old, c("_asi_core")).otherwise(0.0)).alias("_asi"),
        F.sort_array(F.collect_list(F.when(c("_place") <= tail, bar))).alias("tail"),  # at most ``tail`` bars
    )
    if state is not None:
        fresh = fresh.join(state.select(key, "seen", "obv", "asi"), key, "left")
    had = (lambda n: F.coalesce(c(n), F.lit(0))) if state is not None else (lambda n: F.lit(0))
    return fresh.select(key, "last_date", *[(had(n) + c(f"_{n}")).alias(n) for n in ("seen", "obv", "asi")], "tail")


def write_states(spark: SparkSession, panel: str, states: str, since: int | None = None, tail: int = TAIL, origin=None, key: str = "entity", ts: str = "date") -> None:
    """State tables of all years of a stored panel, or of those from ``since`` on where the year before is there."""
    years = sorted(r["year"] for r in spark.read.parquet(panel).select("year").distinct().collect())
    last = None
    if since is not None and years and years[0] < since:
        last = spark.read.parquet(states).where(c("year") == since - 1).drop("year")
        years = [y for y in years if y >= since]
    for y in range(years[0], years[-1] + 1) if years else ():
        bars = read_panel(spark, panel, date(y, 1, 1), date(y, 12, 31), key=key, ts=ts).drop("year")
        path = f"{states.rstrip('/')}/year={y}"
        roll_state(bars, last, tail, origin, key, ts).write.mode("overwrite").parquet(path)
        last = spark.read.parquet(path)


def write_state_before(spark: SparkSession, panel: str, states: str, min_date: date, tail: int = TAIL, origin=None, key: str = "entity", ts: str = "date") -> None:
    """The one state that a run from ``min_date`` on needs, that of the year before, from all bars up to its end at once.

    It is what :func:`write_states` has for that year, without the states of the years before it.  A panel that begins
    with the year of ``min_date`` needs no state; an empty one is written, so that there is something to read.
    """
    bars = read_panel(spark, panel, end=date(min_date.year - 1, 12, 31), key=key, ts=ts).drop("year")
    roll_state(bars, None, tail, origin, key, ts).write.mode("overwrite").parquet(f"{states.rstrip('/')}/year={min_date.year - 1}")


def rows_since(spark: SparkSession, panel: str, states: str, min_date: date, key: str = "entity", ts: str = "date") -> DataFrame:
    """Bars from which every feature at or after ``min_date`` can be computed, with the totals before them."""
    new = read_panel(spark, panel, date(min_date.year, 1, 1), key=key, ts=ts).drop("year")
    if not any(r["year"] < min_date.year for r in spark.read.parquet(states).select("year").distinct().collect()):
        return new.withColumns({n: F.lit(0.0) for n in BASES})
    state = spark.read.parquet(states).where(c("year") == min_date.year - 1).drop("year")
    rows = carried_bars(state, key).select(*new.columns).unionByName(new)
    return rows.join(state.select(key, c("obv").alias(BASES[0]), c("asi").alias(BASES[1])), key, "left").fillna(0.0, list(BASES))


def features_since(rows: DataFrame, min_date: date, open_rows: int = 0, key: str = "entity", ts: str = "date", **context) -> DataFrame:
    """The rows of the feature table from ``min_date`` on, from what ``rows_since`` gave.

    ``open_rows`` adds as many rows before that date for each entity: those whose labels new bars may have filled.
    ``context``: as for :func:`build_features`; its tables need to reach back a month before ``min_date``.
    """
    at = F.lit(min_date)
    if open_rows:
        newer = F.row_number().over(Window.partitionBy(key).orderBy((c(ts) >= at).cast("int"), c(ts).desc()))
        rows = rows.withColumn("_wanted", (c(ts) >= at) | (newer <= open_rows))
        return build_features(rows, bases=BASES, key=key, ts=ts, **context).where("_wanted").drop("_wanted")
    return build_features(rows, bases=BASES, min_date=at, key=key, ts=ts, **context)


def merge_tail(features: str, fresh: DataFrame, spark: SparkSession, key: str = "entity", ts: str = "date") -> None:
    """Put ``fresh`` rows (stored, not read from ``features``) into a feature table stored by year.

    Only the years that ``fresh`` has rows of are read and rewritten; rows with a key of ``fresh`` are replaced.
    """
    years = [r["y"] for r in fresh.select(F.year(ts).alias("y")).distinct().collect()]
    kept = spark.read.parquet(features).where(c("year").isin(years)).drop("year").join(fresh.select(key, ts), [key, ts], "left_anti")
    replace_years(settle(kept.unionByName(fresh)), features, key, ts)
