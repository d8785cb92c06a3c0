"""Index, industry, flow and valuation context (F-33..37, F-39, F-40, F-43..47, AG-06)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.operators.joins import asof_join, lookup
from barloom.operators.windows import (
    Key, Steps, apply_steps, extreme_steps, lagged, ordered, ratio, row_no, running, trailing, warm,
)

c = F.col

VALUATION_COLUMNS = (
    "turnover_rate", "turnover_rate_f", "pe", "pe_ttm", "pb", "ps", "ps_ttm", "dv_ratio", "dv_ttm",
    "total_share", "float_share", "free_share", "total_mv", "circ_mv",
)


def index_series(index_bars: DataFrame, code: str = "code", ts: str = "date") -> DataFrame:
    """pct_chg and the distance of the close from its 5- and 20-row means (over the rows there are)."""

    def versus(n: int):
        mean = F.avg("close").over(trailing(n, code, ts))
        return F.when(F.abs(mean) > 1e-6, ratio(c("close") - mean, mean) * 100)

    return index_bars.withColumns({"vs_ma5_pct": versus(5), "vs_ma20_pct": versus(20)}).select(
        code, ts, "pct_chg", "vs_ma5_pct", "vs_ma20_pct"
    )


def pivot_series(series: DataFrame, codes: Sequence[str], cols: Sequence[str], code: str = "code", ts: str = "date") -> DataFrame:
    """One row per date with ``{code}_{col}`` columns; a known code list needs no discovery pass."""
    return series.where(c(code).isin(list(codes))).groupBy(ts).agg(
        *[F.max(F.when(c(code) == k, c(v))).alias(f"{k}_{v}") for k in codes for v in cols]
    )


def add_index_context(
    df: DataFrame, index_bars: DataFrame, codes: Sequence[str], lag: int = 1, key: str = "entity", ts: str = "date"
) -> DataFrame:
    """Index and FX features as known at the entity's previous trading date.

    Each series is carried forward to the dates asked for (a holiday of the reference market takes its last
    value); ``lag=0`` uses the same day.  Columns are ``{code}_pct_chg``, ``{code}_vs_ma5_pct``,
    ``{code}_vs_ma20_pct`` and ``{code}_ref_date`` for look-ahead checks.
    """
    cols = ("pct_chg", "vs_ma5_pct", "vs_ma20_pct")
    series = index_series(index_bars)
    at = lagged(ts, lag, key, ts) if lag else c(ts)
    df = df.withColumn("_at", at)
    asked = df.select(c("_at")).where(c("_at").isNotNull()).distinct()
    # One lookup line per (code, asked date): bounded by codes x calendar.
    lines = asked.withColumn("code", F.explode(F.array(*[F.lit(k) for k in codes])))
    solved = asof_join(lines, series, "code", cols, ts=ts, left_ts="_at", ref_date="ref_date")
    wide = pivot_series(solved, codes, [*cols, "ref_date"], ts="_at")
    return df.join(wide, "_at", "left").drop("_at").select(
        *[n for n in df.columns if n != "_at"], *[f"{k}_{v}" for k in codes for v in [*cols, "ref_date"]]
    )


def expanding_median(values: np.ndarray) -> np.ndarray:
    """Median of the values up to each place, missing ones left out: O(n log n) for n values.

    Each value is replaced by its rank in the whole series, and the bits of the wanted order statistic are found from
    the highest down, for all prefixes at once: at each bit the ranks are dealt to two halves in their order (a wavelet
    matrix), and running counts of the zeros tell in which half the statistic of each prefix lies.
    """
    known = np.flatnonzero(~np.isnan(values))
    out = np.full(len(values), np.nan)
    n = len(known)
    if not n:
        return out
    order = np.argsort(values[known], kind="stable")
    ranks = np.empty(n, np.int64)
    ranks[order] = np.arange(n)
    ends = np.arange(1, n + 1)
    wanted = np.concatenate([(ends - 1) // 2, ends // 2])  # both middle values
    first, end = np.zeros(2 * n, np.int64), np.concatenate([ends, ends])
    found = np.zeros(2 * n, np.int64)
    for bit in range(max(1, (n - 1).bit_length()) - 1, -1, -1):
        high = (ranks >> bit & 1).astype(bool)
        zeros = np.concatenate([[0], np.cumsum(~high)])
        low_first, low_end = zeros[first], zeros[end]
        right = wanted >= low_end - low_first
        wanted = np.where(right, wanted - (low_end - low_first), wanted)
        found |= right.astype(np.int64) << bit
        first, end = np.where(right, zeros[-1] + first - low_first, low_first), np.where(right, zeros[-1] + end - low_end, low_end)
        ranks = np.concatenate([ranks[~high], ranks[high]])
    middle = values[known][order][found]
    made = np.where(middle[:n] == middle[n:], middle[:n], middle[:n] + (middle[n:] - middle[:n]) * 0.5)
    # places between known values repeat the one before
    at = np.searchsorted(known, np.arange(len(values)), "right") - 1
    return np.where(at >= 0, made[np.maximum(at, 0)], np.nan)


def add_expanding_median(df: DataFrame, value: str = "close", out: str = "close_median", key: str = "code", ts: str = "date") -> DataFrame:
    """The median of a series' values up to and including each row; a series (one row per date) is one group."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(ts)
        made = expanding_median(table.column(value).cast(pa.float64()).to_numpy())
        return table.append_column(out, pa.array(made, pa.float64(), from_pandas=True))

    return df.groupBy(key).applyInArrow(run, schema)


def index_stats(index_bars: DataFrame, code: str = "code", ts: str = "date") -> DataFrame:
    """Same-day index features with warm-up fallback plus expanding statistics of the close.

    Before 5 / 20 rows the mean is the close itself.  Same-day values can leak for markets that close later
    than the entity's own; :func:`add_index_context` is the default.
    """
    w = running(code, ts)
    row = row_no(code, ts)
    prev = lagged("close", 1, code, ts)

    def versus(n: int):
        mean = F.when(row >= n, F.avg("close").over(trailing(n, code, ts))).otherwise(c("close"))
        return ratio(c("close") - mean, mean) * 100

    return add_expanding_median(index_bars.select(code, ts, c("close").cast("double")), key=code, ts=ts).select(
        code, ts, "close",
        F.coalesce(ratio(c("close") - prev, prev) * 100, F.lit(0.0)).alias("pct_chg"),
        versus(5).alias("vs_ma5_pct"),
        versus(20).alias("vs_ma20_pct"),
        F.avg("close").over(w).alias("close_mean"),
        F.stddev_samp("close").over(w).alias("close_stddev"),
        F.min("close").over(w).alias("close_min"),
        F.max("close").over(w).alias("close_max"),
        "close_median",
    )


def group_series(bars: DataFrame, dim: DataFrame, group: str = "industry", key: str = "entity", ts: str = "date") -> DataFrame:
    """Daily mean return per group and its 5-row mean: aggregate first, then a window over the small result."""
    daily = (
        bars.join(dim.select(key, group), key)
        .where(c(group).isNotNull())
        .groupBy(group, ts)
        .agg(F.avg("pct_chg").alias("avg_return"))
    )
    return daily.withColumn("avg_5d", F.avg("avg_return").over(trailing(5, group, ts)))


def series_of(facts: DataFrame, group: str = "industry", ts: str = "date") -> DataFrame:
    """``group_series`` from sums and counts (``sum_pct``, ``n_pct``) of each group, or of parts of it, and date."""
    daily = facts.where(c(group).isNotNull()).groupBy(group, ts).agg(ratio(F.sum("sum_pct"), F.sum("n_pct")).alias("avg_return"))
    return daily.withColumn("avg_5d", F.avg("avg_return").over(trailing(5, group, ts)))


def add_group_context(
    df: DataFrame, series: DataFrame, group: str = "industry", ts: str = "date", ref_date: str | None = None,
    asked: DataFrame | None = None, small: bool = False,
) -> DataFrame:
    """industry_avg_return and industry_momentum_5d of the last date strictly before the row's date."""
    renamed = series.select(
        group, ts,
        F.coalesce("avg_return", F.lit(0.0)).alias("industry_avg_return"),
        F.coalesce("avg_5d", F.lit(0.0)).alias("industry_momentum_5d"),
    )
    return asof_join(
        df, renamed, group, ("industry_avg_return", "industry_momentum_5d"), ts=ts, strict=True,
        ref_date=ref_date, asked=asked, small=small,
    )


def add_vs_group(df: DataFrame) -> DataFrame:
    """stock_vs_industry: own move minus the industry's."""
    return df.withColumn("stock_vs_industry", c("close_pct") - c("industry_avg_return"))


def add_group_vs_market(
    df: DataFrame, col: str = "price_momentum_5", out: str = "sector_momentum_vs_market",
    group: str = "industry", ts: str = "date",
) -> DataFrame:
    """Group mean minus market mean of a column on each date."""
    return df.drop(out).join(group_edge(df, col, out, group, ts), [group, ts], "left")


def group_edge(df: DataFrame, col: str, out: str = "sector_momentum_vs_market", group: str = "industry", ts: str = "date") -> DataFrame:
    """(group, date, ``out``): the group's mean of a column minus the market's.

    Both means come from one aggregate per (group, date); the market mean is the sum of the group sums, so
    the feature table is scanned once for the statistics.
    """
    return _edge(df.groupBy(group, ts).agg(F.sum(col).alias("_s"), F.count(col).alias("_n")), out, group, ts)


def edge_of(facts: DataFrame, out: str = "sector_momentum_vs_market", group: str = "industry", ts: str = "date") -> DataFrame:
    """``group_edge`` from sums and counts (``sum_momentum``, ``n_momentum``) of each group, or of parts of it, and date."""
    return _edge(facts.groupBy(group, ts).agg(F.sum("sum_momentum").alias("_s"), F.sum("n_momentum").alias("_n")), out, group, ts)


def _edge(parts: DataFrame, out: str, group: str, ts: str) -> DataFrame:
    market = parts.groupBy(ts).agg(ratio(F.sum("_s"), F.sum("_n")).alias("_market"))
    return (
        parts.where(c(group).isNotNull())
        .join(market, ts)
        .select(group, ts, (ratio(c("_s"), c("_n")) - c("_market")).alias(out))
    )


def flow_steps(key: Key = "entity", ts: Key = "date") -> Steps:
    clamp = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ratio(c("net_mf_amount"), c("volume"))))
    mean5 = F.avg("net_mf_vol").over(trailing(5, key, ts))
    return [
        {
            "smart_money_ratio": F.when(c("net_mf_amount").isNotNull() & (c("volume") > 0), clamp),
            "large_order_flow": F.when(row_no(key, ts) >= 5, mean5).otherwise(c("net_mf_vol")),
        }
    ]


def add_flows(df: DataFrame, flows: DataFrame, key: str = "entity", ts: str = "date") -> DataFrame:
    """Same-day net flows, their ratio to volume clamped to ±1, and the 5-row mean flow."""
    return apply_steps(lookup(df, flows, [key, ts], ["net_mf_vol", "net_mf_amount"]), flow_steps(key, ts))


def add_valuation(
    df: DataFrame, valuation: DataFrame, cols: Sequence[str] = VALUATION_COLUMNS, key: str = "entity", ts: str = "date"
) -> DataFrame:
    """Same-day valuation columns; a missing dividend yield is 0."""
    out = lookup(df, valuation, [key, ts], cols)
    return out.withColumn("dv_ttm", F.coalesce("dv_ttm", F.lit(0.0))) if "dv_ttm" in cols else out


def position_positive_steps(
    col: str = "pe_ttm", out: str = "pe_percentile_52w", n: int = 252, min_count: int = 10,
    key: Key = "entity", ts: Key = "date",
) -> Steps:
    pos = f"_pos_{out}"
    low, high = f"_lo_{out}", f"_hi_{out}"
    value = F.when(
        (c("_pp_row") >= n) & (c(col) > 0) & (c("_pp_n") > min_count) & (c(high) > c(low)),
        ratio(c(col) - c(low), c(high) - c(low)),
    ).otherwise(F.lit(0.0))
    positive = F.when(c(col) > 0, c(col))
    return [
        {pos: positive, "_pp_row": row_no(key, ts), "_pp_seen": F.count(positive).over(running(key, ts))},
        {"_pp_n": c("_pp_seen") - F.coalesce(F.lag("_pp_seen", n).over(ordered(key, ts)), F.lit(0))},
        *extreme_steps({low: (pos, "min", n), high: (pos, "max", n)}, key, ts),
        {out: value},
    ]


def add_position_positive(
    df: DataFrame, col: str = "pe_ttm", out: str = "pe_percentile_52w", n: int = 252, min_count: int = 10,
    key: Key = "entity", ts: Key = "date",
) -> DataFrame:
    """Min-max place of a positive value among the positive values of the last n rows.

    0 for a non-positive value, before n rows, with at most ``min_count`` positive values or without spread.
    """
    return apply_steps(df, position_positive_steps(col, out, n, min_count, key, ts))


def add_rolling_corr(
    df: DataFrame, other: DataFrame, n: int = 20, a: str = "close", b: str = "close", key: str = "entity", ts: str = "date"
) -> DataFrame:
    """Correlation of the entity's and a reference series' last n joint rows (0 when either is flat), and the
    difference of their percent returns; null on dates that the reference lacks."""
    ref = other.select(ts, F.col(b).alias("_other"))
    joined = df.join(ref, ts, "left").withColumn("_joint", c("_other").isNotNull())
    key = (key, "_joint")  # rows without a partner have windows of their own
    w = trailing(n, key, ts)
    flat = (F.stddev_pop(a).over(w) == 0) | (F.stddev_pop("_other").over(w) == 0)
    own = ratio(c(a) - lagged(a, 1, key, ts), lagged(a, 1, key, ts)) * 100
    ref_move = ratio(c("_other") - lagged("_other", 1, key, ts), lagged("_other", 1, key, ts)) * 100
    return apply_steps(
        joined,
        [
            {
                "_flat": flat,
                "_row": row_no(key, ts),
                "_corr": F.corr(a, "_other").over(w),
                "_own": own,
                "_ref_move": ref_move,
            },
            {
                "rolling_corr": F.when(~c("_joint"), None).when(c("_row") < n, 0.0).when(c("_flat"), 0.0).otherwise(c("_corr")),
                "relative_return": F.when(c("_joint"), c("_own") - c("_ref_move")),
            },
        ],
    ).drop("_other", "_joint")
