"""Oscillators: RSI, KDJ, Williams %R, MFI (F-09, F-10, F-27, F-28)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.windows import Key, Steps, apply_steps, from_row, lagged, mean, near, near_lags, ratio, row_no, trailing

c = F.col


def rsi_steps(n: int = 14, key: Key = "entity", ts: Key = "date") -> Steps:
    moves = list(zip(near("close", n), near("close", n, 1), strict=True))
    return [
        near_lags(n + 1, "close", key=key, ts=ts),
        {
            "_gain": mean([F.when(prev.isNotNull(), F.greatest(x - prev, F.lit(0.0))) for x, prev in moves]),
            "_loss": mean([F.when(prev.isNotNull(), F.greatest(prev - x, F.lit(0.0))) for x, prev in moves]),
        },
        {
            f"rsi_{n}": from_row(
                n + 1,
                F.when(c("_loss") == 0, F.lit(100.0)).otherwise(
                    100 - ratio(F.lit(100.0), 1 + ratio(c("_gain"), c("_loss")))
                ),
            )
        },
    ]


def add_rsi(df: DataFrame, n: int = 14, key: Key = "entity", ts: Key = "date") -> DataFrame:
    """Simple-average RSI over n changes: 100 without a loss, null before n+1 rows."""
    return apply_steps(df, rsi_steps(n, key, ts))


def kdj_steps(n: int = 9, weight: float | None = None, key: Key = "entity", ts: Key = "date") -> Steps:
    # One smoothing step from the neutral 50: K = a*RSV + (1-a)*50, D likewise from K.
    a = 2.0 / (n + 1.0) if weight is None else weight
    low, high = c("_kdj_low"), c("_kdj_high")
    rsv = ratio(c("close") - low, high - low) * 100
    k = rsv * a + 50 * (1 - a)
    return [
        near_lags(n, "high", "low", key=key, ts=ts),
        {"_kdj_low": F.least(*near("low", n)), "_kdj_high": F.greatest(*near("high", n))},
        {"kdj_k": from_row(n, k)},
        {"kdj_d": c("kdj_k") * a + 50 * (1 - a)},
        {"kdj_j": 3 * c("kdj_k") - 2 * c("kdj_d")},
    ]


def add_kdj(df: DataFrame, n: int = 9, weight: float | None = None, key: Key = "entity", ts: Key = "date") -> DataFrame:
    """K, D, J from the n-row high-low range; null on a flat range.  ``weight=0.33`` is the variant."""
    return apply_steps(df, kdj_steps(n, weight, key, ts))


def williams_steps(n: int = 14, scale: str = "negative", key: Key = "entity", ts: Key = "date") -> Steps:
    high, low = c("_wr_high"), c("_wr_low")
    part = ratio(high - c("close"), high - low)
    value = part * (-100 if scale == "negative" else 100)
    flat = F.lit(-50.0 if scale == "negative" else 50.0)
    return [
        near_lags(n, "high", "low", key=key, ts=ts),
        {"_wr_high": F.greatest(*near("high", n)), "_wr_low": F.least(*near("low", n))},
        {f"williams_r_{n}": from_row(n, F.when(high > low, value).otherwise(flat))},
    ]


def add_williams_r(df: DataFrame, n: int = 14, scale: str = "negative", key: Key = "entity", ts: Key = "date") -> DataFrame:
    """-100..0 (0 at the high), -50 on a flat range; ``scale='positive'`` is the 0..100 variant."""
    return apply_steps(df, williams_steps(n, scale, key, ts))


def mfi_steps(n: int = 14, key: Key = "entity", ts: Key = "date") -> Steps:
    w = trailing(n, key, ts)
    tp = (c("high") + c("low") + c("close")) / 3
    flow = c("_tp") * c("volume")
    up = F.sum(F.when(c("_tp") > c("_tp_1"), flow).otherwise(F.lit(0.0))).over(w)
    down = F.sum(F.when(c("_tp") < c("_tp_1"), flow).otherwise(F.lit(0.0))).over(w)
    value = F.when(F.abs(c("_mf_down")) < 1e-12, F.lit(100.0)).otherwise(
        100 - ratio(F.lit(100.0), 1 + ratio(c("_mf_up"), c("_mf_down")))
    )
    return [
        {"_tp": tp},
        {"_tp_1": lagged("_tp", 1, key, ts)},
        {"_mf_up": up, "_mf_down": down, "_mf_row": row_no(key, ts)},
        {f"mfi_{n}": F.when(c("_mf_row") >= n + 1, value).otherwise(F.lit(50.0))},
    ]


def add_mfi(df: DataFrame, n: int = 14, key: Key = "entity", ts: Key = "date") -> DataFrame:
    """Money flow index from the typical price: 50 before n+1 rows, 100 without a down flow."""
    return apply_steps(df, mfi_steps(n, key, ts))
