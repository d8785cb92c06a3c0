"""Back-adjustment of raw bars (ADJ-01..04)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.scalars import round_to
from barloom.operators.windows import Key, Steps, apply_steps, before, lagged, ordered, ratio
from barloom.session import settle
from barloom.sources.panel import BUCKETS, bucket_of, read_buckets, write_bucketed

EPS = 1e-4


def ratio_steps(key: Key = "entity", ts: str = "date") -> Steps:
    return [
        {"_prev_close": lagged("close", 1, key, ts)},
        {
            "adj_ratio": F.when(
                F.abs(F.col("pre_close") - F.col("_prev_close")) > EPS,
                ratio(F.col("pre_close"), F.col("_prev_close")),
            ).otherwise(F.lit(1.0))
        },
    ]


def add_adj_ratio(bars: DataFrame, key: Key = "entity", ts: str = "date") -> DataFrame:
    """``adj_ratio``: pre_close / previous close on an ex-date, else 1 (also on the first row)."""
    return apply_steps(bars, ratio_steps(key, ts))


def back_adjust(bars: DataFrame, inclusive: bool = True, key: Key = "entity", ts: str = "date") -> DataFrame:
    """Scale open/high/low/close by ``adj_factor`` = final cumulative ratio / cumulative ratio so far.

    ``inclusive=True`` leaves the row's own ratio out of "so far", so an ex-date row is scaled by its own
    ratio as well (the behaviour to match); ``inclusive=False`` is the textbook form that scales earlier
    rows only.  Rows with a missing price or volume still carry their ratio but are dropped from the output.
    """
    # Ordered over the whole entity: the product must multiply in the order of the running one.
    every = ordered(key, ts).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    effective = F.when(F.abs(F.col("adj_ratio") - 1) > EPS, F.col("adj_ratio")).otherwise(F.lit(1.0))
    so_far = F.coalesce(F.product("_eff").over(before(key, ts)), F.lit(1.0))
    if not inclusive:
        so_far = so_far * F.col("_eff")
    df = apply_steps(
        add_adj_ratio(bars, key, ts),
        [{"_eff": effective}, {"adj_factor": ratio(F.product("_eff").over(every), so_far)}],
    )
    df = df.dropna(subset=["open", "high", "low", "close", "volume"])
    return df.withColumns({c: round_to(F.col(c) * F.col("adj_factor"), 2) for c in ("open", "high", "low", "close")})


def needs_adjust(bars: DataFrame, as_of: Column, days: int = 7, key: Key = "entity", ts: str = "date") -> DataFrame:
    """Entities with a pre_close break in the last ``days`` days before ``as_of``."""
    broken = bars.withColumn("_prev_close", lagged("close", 1, key, ts)).where(
        (F.col(ts) >= F.date_sub(as_of, days)) & (F.abs(F.col("pre_close") - F.col("_prev_close")) > EPS)
    )
    return broken.select(*([key] if isinstance(key, str) else key)).distinct()


def readjust(raw: DataFrame, adjusted: DataFrame, as_of: Column, days: int = 7, key: str = "entity") -> DataFrame:
    """Recompute only the entities that broke recently and keep the stored rows of all others."""
    stale = needs_adjust(raw, as_of, days, key)
    fresh = back_adjust(raw.join(stale, key, "left_semi"), key=key).select(*adjusted.columns)
    return adjusted.join(stale, key, "left_anti").unionByName(fresh)


def readjust_stored(
    raw: DataFrame, path: str, as_of: Column, days: int = 7, buckets: int = BUCKETS, key: str = "entity", ts: str = "date"
) -> list[int]:
    """Bring a stored adjusted panel (``write_bucketed``) up to date after breaks; returns the buckets that were rewritten.

    Only the buckets of entities that broke are read and rewritten; the files of all other entities stay as they are.
    """
    stale = settle(needs_adjust(raw, as_of, days, key))
    touched = sorted(r["b"] for r in stale.select(bucket_of(key, buckets).alias("b")).distinct().collect())  # at most ``buckets``
    if touched:
        stored = read_buckets(raw.sparkSession, path, touched)
        fresh = back_adjust(raw.join(stale, key, "left_semi"), key=key, ts=ts).select(*stored.columns)
        merged = settle(stored.join(stale, key, "left_anti").unionByName(fresh))
        write_bucketed(merged, path, buckets, key, ts, replace=True)
    return touched


def testing_rows(bars: DataFrame, factor: DataFrame, keys=("entity", "date")) -> DataFrame:
    """Raw bars as decimals with the vendor's factor, 1.0 where the vendor has none."""
    price, big, small = "decimal(10,2)", "decimal(20,4)", "decimal(10,4)"
    return bars.join(factor, list(keys), "left").select(
        *keys,
        *[round_to(c, 2).cast(price).alias(c) for c in ("open", "high", "low", "close")],
        F.col("volume").cast("decimal(20,2)").alias("volume"),
        F.col("amount").cast(big).alias("amount"),
        F.coalesce(F.col("adj_factor"), F.lit(1.0)).cast(small).alias("adj_factor"),
    )
