"""Universe filters, selection, splits and samples (FLT-*, SEL-*, SPL-*, SMP-*, SET-01)."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.scalars import in_band, is_special_name, contains_any, marked_name, segment
from barloom.operators.joins import latest_per
from barloom.operators.ranking import global_row_number, grouped_row_number, ntile_from_rank, shuffled_order
from barloom.operators.windows import names, ordered

c = F.col

HALF_PREFIXES = ("60", "00")
WHOLE_PREFIXES = ("30", "68", "9")


def filter_universe(
    dim: DataFrame,
    bars: DataFrame | None = None,
    exclude_st: bool = True,
    min_age_years: int = 0,
    start: Column | None = None,
    industries: str | None = None,
    cap_band: tuple[float | None, float | None] | None = None,
    key: str = "entity",
) -> DataFrame:
    """Listed entities that have bars, a name without the ST mark, enough age, and the wanted industry and size."""
    out = dim.where(c(key).isNotNull())
    if exclude_st:
        out = out.where(~marked_name(c("name")))
    if min_age_years and start is not None:
        out = out.where(c("list_date") <= F.add_months(start, -12 * min_age_years))
    if industries:
        out = out.where(contains_any(c("industry"), F.lit(industries)))
    if cap_band:
        out = out.where(in_band(c("total_mv"), *cap_band))
    if bars is not None:
        out = out.join(bars.select(key), key, "left_semi")
    return out


def complete_rows(df: DataFrame, required: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(required))


def latest_slice(df: DataFrame, ts: str = "date") -> DataFrame:
    """Rows of the newest date, found by an uncorrelated scalar subquery."""
    return df.where(c(ts) == df.agg(F.max(ts)).scalar())


def guard_future(df: DataFrame, as_of: Column, ts: str = "date") -> tuple[DataFrame, DataFrame]:
    """Rows up to ``as_of`` and a one-row count of what was dropped."""
    late = c(ts) > as_of
    return df.where(~late), df.agg(F.count_if(late).alias("dropped"))


def drop_forward_cols(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return df.select([n for n in df.columns if not n.startswith("next_") or n in keep])


def split_columns(df: DataFrame, labels: Sequence[str], keys=("entity", "date")) -> tuple[DataFrame, DataFrame]:
    """Features and labels as two frames that share the key."""
    features = [n for n in df.columns if n not in labels]
    return df.select(*features), df.select(*keys, *labels)


# ------------------------------------------------------------------------------------------- selection


def liquidity_rank(bars: DataFrame, eligible: DataFrame, since: Column, key: str = "entity", ts: str = "date") -> DataFrame:
    """Mean amount since a date and its percentile bucket (1 = most traded) among eligible entities."""
    recent = bars.where(c(ts) >= since).groupBy(key).agg(F.avg("amount").alias("avg_amount"))
    recent = recent.join(eligible.select(key), key, "left_semi").withColumn("avg_amount", F.coalesce("avg_amount", F.lit(0.0)))
    ranked = global_row_number(recent, [c("avg_amount").desc(), c(key)])
    n = recent.agg(F.count(F.lit(1))).scalar()
    return ranked.withColumn("pct_rank", ntile_from_rank(c("rn"), n, 100)).drop("rn")


def eligible_entities(
    bars: DataFrame, dim: DataFrame, min_close: float = 2.0, key: str = "entity", ts: str = "date",
    start: Column | None = None, end: Column | None = None, years: int | None = None,
) -> DataFrame:
    """Names without the ST mark whose latest close reaches the floor.

    With ``start`` (and ``end``) they also need a bar in that range, with ``years`` a listing that many years before
    ``start``.
    """
    if start is not None:
        inside = bars.where(c(ts) >= start)
        inside = inside if end is None else inside.where(c(ts) <= end)
        dim = dim.join(inside.select(key).distinct(), key, "left_semi")
        if years is not None:
            dim = dim.where(c("list_date") <= F.add_months(start, -12 * years))
    last = latest_per(bars.select(key, ts, "close"), key, ts).where(c("close") >= min_close)
    return dim.where(~is_special_name(c("name"))).join(last.select(key), key, "left_semi")


def stratified_half(df: DataFrame, strata: Sequence[str], key: str = "entity", seed: int = 42) -> DataFrame:
    """A reproducible random ceil(n/2) of each stratum."""
    numbered = grouped_row_number(
        df.withColumn("_u", shuffled_order(key, seed=seed)), strata, [c("_u"), c(key)], "rn", "n"
    )
    return numbered.where(c("rn") <= F.ceil(c("n") / 2)).drop("_u", "rn", "n")


def select_liquid(
    bars: DataFrame, dim: DataFrame, since: Column, pct: int = 30, floor: float | None = None,
    floor_since: Column | None = None, code: str = "code", seed: int = 42, key: str = "entity", ts: str = "date",
    start: Column | None = None, end: Column | None = None, years: int | None = None,
) -> DataFrame:
    """Union of the most traded entities, half of two code prefixes and all of three others, with no repeats.

    ``start``, ``end``, ``years``: what else makes an entity eligible, see ``eligible_entities``.
    """
    able = eligible_entities(bars, dim, key=key, ts=ts, start=start, end=end, years=years).select(key, code)
    liquid = liquidity_rank(bars, able, since, key, ts).where(c("pct_rank") <= pct).select(key)
    if floor is not None:
        heavy = (
            bars.where(c(ts) >= floor_since).groupBy(key).agg(F.coalesce(F.sum("amount"), F.lit(0.0)).alias("_a"))
        ).where(c("_a") >= floor)
        liquid = liquid.join(heavy.select(key), key, "left_semi")
    tagged = able.withColumn("stratum", segment(c(code), HALF_PREFIXES)).where(c("stratum").isNotNull())
    half = stratified_half(tagged, ["stratum"], key, seed).select(key)
    whole = able.where(segment(c(code), WHOLE_PREFIXES).isNotNull()).select(key)
    return liquid.union(half).union(whole).distinct()


def exclusion_counts(bars: DataFrame, dim: DataFrame, start: Column, min_close: float = 2.0, years: int = 5, key: str = "entity", ts: str = "date") -> DataFrame:
    """Why listed entities drop out, in one pass over one row per entity."""
    span = bars.groupBy(key).agg(
        F.max_by("close", ts).alias("_last"), F.min(ts).alias("_first"), F.count_if(c(ts) >= start).alias("_in_range")
    )
    d = dim.join(span, key)
    old = c("list_date") <= F.add_months(start, -12 * years)
    listed = c("list_date") <= start
    priced, named, present = c("_last") < min_close, is_special_name(c("name")), c("_in_range") > 0
    return d.agg(
        F.count_if(listed & present).alias("candidates"),
        F.count_if(listed & present & priced).alias("by_price"),
        F.count_if(old & present & named).alias("by_name"),
        F.count_if(old & present & named & priced).alias("by_both"),
        F.count_if(listed & (c("_first") > F.add_months(start, -12 * years))).alias("short_history"),
    )


def prefix_coverage(df: DataFrame, code: str = "code", prefixes: Sequence[str] = HALF_PREFIXES + WHOLE_PREFIXES) -> DataFrame:
    return df.groupBy(segment(c(code), prefixes).alias("prefix")).agg(F.count(F.lit(1)).alias("entities"))


# ---------------------------------------------------------------------------------------------- splits


def split_by_cutoff(df: DataFrame, cutoff: Column, ts: str = "date") -> DataFrame:
    return df.withColumn("split", F.when(c(ts) <= cutoff, "train").otherwise("test"))


def split_by_windows(df: DataFrame, train_end: str, windows: Sequence[tuple[str, str]], ts: str = "date") -> DataFrame:
    """train up to a date, val_1..val_N by window (the first that fits), test after the last, else 'gap'."""
    name = F.when(c(ts) <= F.lit(train_end).cast("date"), "train")
    for i, (lo, hi) in enumerate(windows, 1):
        name = name.when(c(ts).between(F.lit(lo).cast("date"), F.lit(hi).cast("date")), f"val_{i}")
    last = windows[-1][1] if windows else train_end
    return df.withColumn("split", name.when(c(ts) > F.lit(last).cast("date"), "test").otherwise("gap"))


def split_by_ranges(df: DataFrame, ranges: dict[str, tuple[str, str]], ts: str = "date") -> DataFrame:
    """Named date ranges; rows outside all of them are dropped."""
    name = F.lit(None).cast("string")
    for split, (lo, hi) in ranges.items():
        name = F.when(c(ts).between(F.lit(lo).cast("date"), F.lit(hi).cast("date")), split).otherwise(name)
    return df.withColumn("split", name).where(c("split").isNotNull())


def split_proportional(df: DataFrame, val: float = 0.2, test: float = 0.1, key: str = "entity", ts: str = "date") -> DataFrame:
    """Per entity in time order: the last 10 % test, the 20 % before validation; under 3 rows all train."""
    w = ordered(key, ts)
    n = F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return (
        df.withColumns({"_n": n, "_r": F.row_number().over(w)})
        .withColumns({"_t": F.round(c("_n") * test), "_v": F.round(c("_n") * val)})
        .withColumn(
            "split",
            F.when((c("_n") < 3) | (c("_r") <= c("_n") - c("_v") - c("_t")), "train")
            .when(c("_r") <= c("_n") - c("_t"), "val")
            .otherwise("test"),
        )
        .drop("_n", "_r", "_t", "_v")
    )


def _months_back(d: date, months: int) -> date:
    y, m = divmod(d.year * 12 + d.month - 1 - months, 12)
    last = [31, 29 if y % 4 == 0 and (y % 100 or y % 400 == 0) else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31][m]
    return date(y, m + 1, min(d.day, last))


def split_schedule(
    as_of: date, window_years: int = 3, val_months: int = 6, holdout_months: int = 6, step_days: int = 7, steps: int = 26
) -> list[dict]:
    """The sliding windows before a hold-out that ends at ``as_of`` (driver-side: one entry per step)."""
    hold = _months_back(as_of, holdout_months)
    first = hold - timedelta(days=step_days * steps)
    out = []
    for i in range(steps):
        end = first + timedelta(days=i * step_days)
        out.append(
            {
                "step": i, "train_start": _months_back(end, 12 * window_years), "val_start": _months_back(end, val_months),
                "window_end": end, "holdout_start": hold, "holdout_end": as_of,
            }
        )
    return out


def assign_schedule(df: DataFrame, schedule: Sequence[dict], ts: str = "date") -> DataFrame:
    """Row counts of every step's train, validation and hold-out ranges.

    Steps are a literal array of fixed length; counts are taken per date first, so the range match runs over
    the calendar instead of the panel.
    """
    per_date = df.groupBy(ts).agg(F.count(F.lit(1)).alias("n"))
    rows = [
        F.struct(
            F.lit(s["step"]).alias("step"),
            *[F.lit(s[k]).alias(k) for k in ("train_start", "val_start", "window_end", "holdout_start", "holdout_end")],
        )
        for s in schedule
    ]
    each = per_date.withColumn("s", F.explode(F.array(*rows))).select(ts, "n", "s.*")
    part = (
        F.when((c(ts) >= c("train_start")) & (c(ts) < c("val_start")), "train")
        .when((c(ts) >= c("val_start")) & (c(ts) <= c("window_end")), "val")
        .when((c(ts) > c("holdout_start")) & (c(ts) <= c("holdout_end")), "holdout")
    )
    return each.withColumn("split", part).where(c("split").isNotNull()).groupBy("step", "split").agg(F.sum("n").alias("rows"))


# --------------------------------------------------------------------------------------------- samples


def sample_n(df: DataFrame, n: int, keys: Sequence[str] = ("entity", "date"), seed: int = 42) -> DataFrame:
    """n rows in a reproducible random order (a top-n by digest; no full sort)."""
    return df.withColumn("_u", shuffled_order(*keys, seed=seed)).orderBy("_u", *keys).limit(n).drop("_u")


def top_entities(df: DataFrame, n: int, min_rows: int, key: str = "entity") -> DataFrame:
    """All rows of the n entities with the longest history of at least ``min_rows`` rows."""
    long = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(c("_n") >= min_rows)
    chosen = long.orderBy(c("_n").desc(), key).limit(n)
    return df.join(chosen.select(key), key, "left_semi")


def permute_column(df: DataFrame, col: str, keys: Sequence[str] = ("entity", "date"), seed: int = 42) -> DataFrame:
    """Shuffle one column over the whole table: the i-th row by key gets the value of the i-th row by digest.

    Only keys and the column are ordered and stored; the other columns are joined to them by key (keys are unique).
    """
    natural = global_row_number(df.select(*keys), [c(k) for k in keys], "_i")
    mixed = global_row_number(
        df.select(*keys, col).withColumn("_u", shuffled_order(*keys, seed=seed)), [c("_u"), *[c(k) for k in keys]], "_i"
    )
    out = natural.join(mixed.select("_i", col), "_i").drop("_i")
    rest = [n for n in df.columns if n not in (*keys, col)]
    return (out.join(df.select(*keys, *rest), list(keys)) if rest else out).select(*df.columns)


def page(df: DataFrame, order: str | Sequence[str], offset: int, limit: int) -> DataFrame:
    return df.orderBy(*names(order)).offset(offset).limit(limit)
