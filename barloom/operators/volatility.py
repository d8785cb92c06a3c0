"""Bollinger bands, ATR, volatility, range position, volatility regime (F-11, F-12, F-21, F-22, F-38, F-42)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.trend import true_ranges
from barloom.operators.windows import (
    ROW, Key, Steps, apply_steps, extreme_steps, from_row, lagged, mean, near, near_lags, ratio, row_no, share_below_steps,
    trailing, warm,
)

c = F.col


def bollinger_steps(n: int = 20, k: float = 2.0, relative: bool = False, key: Key = "entity", ts: Key = "date") -> Steps:
    mid, sd = c("_bb_mid"), c("_bb_sd")
    upper, lower = mid + sd * k, mid - sd * k
    width = F.when(mid != 0, ratio(upper - lower, mid)).otherwise(F.lit(0.0))
    inside = F.when(upper != lower, ratio(c("close") - lower, upper - lower)).otherwise(F.lit(0.5))
    away = (lambda x: ratio(x - c("close"), c("close")) * 100) if relative else (lambda x: x)
    return [
        {**near_lags(n, "close", key=key, ts=ts), "_bb_dev": F.stddev_pop("close").over(trailing(n, key, ts))},
        {"_bb_mid": from_row(n, mean(near("close", n))), "_bb_sd": from_row(n, c("_bb_dev"))},
        {
            "bb_upper": away(upper),
            "bb_middle": away(mid),
            "bb_lower": away(lower),
            "bb_bandwidth": F.when(mid.isNotNull(), width if relative else width * 100),
            "bb_percent_b": F.when(mid.isNotNull(), inside),
        },
    ]


def add_bollinger(df: DataFrame, n: int = 20, k: float = 2.0, relative: bool = False, key: Key = "entity", ts: Key = "date") -> DataFrame:
    """Bands from the population deviation; bandwidth in percent of the middle, %B 0.5 on a flat band.

    ``relative=True``: bands as percent distance from the close and bandwidth as a fraction.
    """
    return apply_steps(df, bollinger_steps(n, k, relative, key, ts))


def atr_steps(n: int = 14, relative: bool = False, key: Key = "entity", ts: Key = "date") -> Steps:
    value = ratio(c("_atr"), c("close")) * 100 if relative else c("_atr")
    return [
        near_lags(n + 1, "high", "low", "close", key=key, ts=ts),
        {"_atr": mean(true_ranges(n))},
        {"atr_pct" if relative else "atr": from_row(n + 1, value)},
    ]


def add_atr(df: DataFrame, n: int = 14, relative: bool = False, key: Key = "entity", ts: Key = "date") -> DataFrame:
    """Mean true range over n moves; null before n+1 rows.  ``relative=True`` gives percent of the close."""
    return apply_steps(df, atr_steps(n, relative, key, ts))


def volatility_steps(
    columns: dict[str, int] | None = None, basis: str = "level", key: Key = "entity", ts: Key = "date"
) -> Steps:
    wanted = columns or {"volatility_5": 5, "volatility_20": 20, "hist_volatility_20": 20}
    if basis == "level":
        return [
            {name: warm(n, F.stddev_pop("close").over(trailing(n, key, ts)), key, ts) for name, n in wanted.items()}
        ]
    move = ratio(c("close"), c("_close_1")) - 1
    out = {
        name: F.when(c("_vol_row") >= n + 1, F.sqrt(F.avg("_sq").over(trailing(n, key, ts))))
        for name, n in wanted.items()
    }
    return [
        {"_close_1": lagged("close", 1, key, ts), "_vol_row": row_no(key, ts)},
        {"_sq": move * move},
        out,
    ]


def add_volatility(df: DataFrame, columns: dict[str, int] | None = None, basis: str = "level", key: Key = "entity", ts: Key = "date") -> DataFrame:
    """Population deviation of price levels, or (``basis='return'``) the root mean square daily return."""
    return apply_steps(df, volatility_steps(columns, basis, key, ts))


def range_position_steps(n: int = 252, partial: bool = False, key: Key = "entity", ts: Key = "date") -> Steps:
    high, low = c("_rp_high"), c("_rp_low")
    span = high - low
    full = c(ROW) >= n
    where = ratio(c("close") - low, span)
    if partial:
        position = F.when((c(ROW) >= 2) & (span > 0), where).otherwise(F.lit(0.5))
    else:
        position = F.when(full & (F.abs(span) > 1e-6), where)
    return extreme_steps({"_rp_high": ("high", "max", n), "_rp_low": ("low", "min", n)}, key, ts) + [
        {
            "price_position_52w": position,
            "price_vs_52w_high": F.when(full & (high > 0) & (c("close") > 0), ratio(c("close") - high, high)),
        },
    ]


def add_range_position(df: DataFrame, n: int = 252, partial: bool = False, key: Key = "entity", ts: Key = "date") -> DataFrame:
    """Place of the close in the n-row high-low range and its distance from the n-row high.

    ``partial=True`` allows short windows (from 2 rows on) and gives 0.5 on a flat one.
    """
    return apply_steps(df, range_position_steps(n, partial, key, ts))


def vol_regime_steps(n: int = 60, threshold: float = 0.8, key: Key = "entity", ts: Key = "date") -> Steps:
    sd = F.coalesce(warm(n, F.stddev_pop("close").over(trailing(n, key, ts)), key, ts), F.lit(0.0))
    return [
        {"_sd": sd, "_vr_row": row_no(key, ts)},
        *share_below_steps("_sd", "_share", n, key, ts),
        {"vol_percentile": F.when(c("_vr_row") >= n, c("_share"))},
        {"high_vol_regime": F.when(c("vol_percentile").isNotNull(), (c("vol_percentile") > threshold).cast("int"))},
    ]


def add_vol_regime(df: DataFrame, n: int = 60, threshold: float = 0.8, key: Key = "entity", ts: Key = "date") -> DataFrame:
    """Share of the last n rows whose n-row deviation lies below today's, and a flag above the threshold."""
    return apply_steps(df, vol_regime_steps(n, threshold, key, ts))
