"""Volume features and accumulations (F-13..15, F-19, F-20, F-25, F-26, F-41)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.windows import (
    Key, Steps, apply_steps, from_row, lagged, mean, near, near_lags, ordered, preceding, ratio, row_no, running, trailing,
)

c = F.col


def since(value: Column, origin, ts: str) -> Column:
    """Drop contributions up to an explicit start date, so the sums do not depend on the rows fetched."""
    return value if origin is None else F.when(c(ts) > F.lit(origin), value).otherwise(F.lit(0.0))


def _based(total: Column, base: str | None) -> Column:
    """A running total carried on from the rows before those that were read."""
    return total if base is None else F.coalesce(c(base), F.lit(0.0)) + total


def asi_steps(origin=None, key: Key = "entity", ts: str = "date", base: str | None = None) -> Steps:
    pc, po = c("_close_1"), c("_open_1")
    a, b, d = F.abs(c("high") - pc), F.abs(c("low") - pc), F.abs(pc - po)
    span = F.abs(c("high") - c("low"))
    quarter = d * 0.25
    r = (
        F.when((a >= b) & (a >= span), a - b * 0.5 + quarter)
        .when((b >= a) & (b >= span), b - a * 0.5 + quarter)
        .otherwise(span + quarter)
    )
    swing = (c("close") - pc) + (c("close") - c("open")) * 0.5 + (pc - po) * 0.25
    # The limit move is the same for every term of a row's sum, so it factors out.
    core = F.coalesce(ratio(swing * 50, c("_asi_r")) * F.greatest(a, b), F.lit(0.0))
    total = F.sum(since(c("_asi_core"), origin, ts)).over(running(key, ts))
    return [
        {"_close_1": lagged("close", 1, key, ts), "_open_1": lagged("open", 1, key, ts), "_acc_row": row_no(key, ts)},
        {"_asi_r": r},
        {"_asi_core": core},
        {"asi": asi_of(total, base)},
    ]


def asi_of(total: Column, base: str | None = None) -> Column:
    """The index from the running total of ``_asi_core``."""
    return F.when(c("_acc_row") >= 2, F.coalesce(ratio(_based(total, base), c("close") * 0.1), F.lit(0.0)))


def add_asi(df: DataFrame, origin=None, key: Key = "entity", ts: str = "date") -> DataFrame:
    """Accumulated swing index from ``origin`` on, with a limit move of 10 % of the current close."""
    return apply_steps(df, asi_steps(origin, key, ts))


def obv_steps(origin=None, key: Key = "entity", ts: str = "date", base: str | None = None) -> Steps:
    signed = F.coalesce(F.signum(c("close") - c("_close_1")) * c("volume"), F.lit(0.0))
    return [
        {"_close_1": lagged("close", 1, key, ts), "_acc_row": row_no(key, ts)},
        {"_signed": signed},
        {"obv": obv_of(F.sum(since(c("_signed"), origin, ts)).over(running(key, ts)), base)},
    ]


def obv_of(total: Column, base: str | None = None) -> Column:
    """The volume from the running total of ``_signed``."""
    return F.when(c("_acc_row") >= 2, _based(total, base))


def contributions(df: DataFrame, origin=None, key: Key = "entity", ts: str = "date") -> DataFrame:
    """``df`` with what each row adds to the running totals of OBV (``_signed``) and ASI (``_asi_core``)."""
    kept = df.columns
    for obv, asi in zip([*obv_steps(origin, key, ts)[:2], {}], asi_steps(origin, key, ts)[:3], strict=True):
        df = df.withColumns({**obv, **asi})
    return df.select(*kept, *[since(c(n), origin, ts).alias(n) for n in ("_signed", "_asi_core")])


def add_obv(df: DataFrame, origin=None, key: Key = "entity", ts: str = "date") -> DataFrame:
    """Volume accumulated with the sign of the close-to-close move, from ``origin`` on."""
    return apply_steps(df, obv_steps(origin, key, ts))


def volume_steps(key: Key = "entity", ts: Key = "date") -> Steps:
    v = c("volume")
    mean5 = F.avg("volume").over(trailing(5, key, ts))
    return [
        {
            "_v_mean5": mean5,
            "_v_prev5": F.avg("volume").over(preceding(5, key, ts)),
            "_v_lag5": lagged("volume", 5, key, ts),
            "_v_row": row_no(key, ts),
            # Short histories still divide by 5 in the acceleration's own ratio.
            "_v_sum5": F.sum("volume").over(trailing(5, key, ts)) / 5,
        },
        {
            "volume_ratio": F.when((c("_v_row") >= 5) & (c("_v_mean5") > 0), ratio(v, c("_v_mean5"))),
            "volume_roc_5": F.when((c("_v_row") >= 6) & (F.abs(c("_v_lag5")) > 1e-6), ratio(v, c("_v_lag5")) - 1),
            "volume_spike": F.when(c("_v_row") >= 6, v > c("_v_prev5") * 2),
            "_v_own": F.when((v > 0) & (c("_v_sum5") > 0), ratio(v, c("_v_sum5"))),
        },
        {
            "_v_past": F.avg("_v_own").over(ordered(key, ts).rowsBetween(-10, -5))
        },
        {
            "volume_accel_5d": F.when(
                (c("_v_row") >= 11) & c("_v_past").isNotNull(),
                F.when(
                    c("_v_past") > 0,
                    ratio(F.coalesce(c("volume_ratio"), F.lit(1.0)) - c("_v_past"), c("_v_past")),
                ).otherwise(F.lit(0.0)),
            )
        },
    ]


def add_volume_features(df: DataFrame, key: Key = "entity", ts: Key = "date") -> DataFrame:
    """volume_ratio, volume_roc_5, volume_spike and volume_accel_5d."""
    return apply_steps(df, volume_steps(key, ts))


def volume_vs_mean_steps(n: int = 5, key: Key = "entity", ts: Key = "date") -> Steps:
    return [
        near_lags(n, "volume", key=key, ts=ts),
        {"_vm": from_row(n, mean(near("volume", n)))},
        {"volume_roc_mean": ratio(c("volume") - c("_vm"), c("_vm"))},
        {"volume_spike_mean": c("volume_roc_mean") > 2},
    ]


def add_volume_vs_mean(df: DataFrame, n: int = 5, key: Key = "entity", ts: Key = "date") -> DataFrame:
    """The variant that measures volume against its n-row mean and calls three times the mean a spike."""
    return apply_steps(df, volume_vs_mean_steps(n, key, ts))


def vwap_steps(n: int = 20, key: Key = "entity", ts: Key = "date") -> Steps:
    w = trailing(n, key, ts)
    tp = (c("high") + c("low") + c("close")) / 3
    vwap = F.when(c("_vw_vol") > 0, ratio(c("_vw_pv"), c("_vw_vol"))).otherwise(c("close"))
    return [
        {"_vw_pv": F.sum(tp * c("volume")).over(w), "_vw_vol": F.sum("volume").over(w), "_vw_row": row_no(key, ts)},
        {
            "vwap_distance_pct": F.when(
                (c("_vw_row") >= n) & (F.abs(c("close")) > 1e-6), ratio(c("close") - vwap, c("close")) * 100
            )
        },
    ]


def add_vwap_distance(df: DataFrame, n: int = 20, key: Key = "entity", ts: Key = "date") -> DataFrame:
    """Distance of the close from the n-row volume-weighted typical price, in percent of the close."""
    return apply_steps(df, vwap_steps(n, key, ts))


def flow_of_bar() -> Column:
    """The volume with the sign and share of where in its range a bar closes; null without a range."""
    span = c("high") - c("low")
    return F.when(span > 0, ratio((c("close") - c("low")) - (c("high") - c("close")), span) * c("volume"))


def cmf_steps(n: int = 20, key: Key = "entity", ts: Key = "date") -> Steps:
    w = trailing(n, key, ts)
    return [
        {
            "_mfv": F.coalesce(F.sum(flow_of_bar()).over(w), F.lit(0.0)),
            "_cmf_vol": F.sum("volume").over(w),
            "_cmf_row": row_no(key, ts),
        },
        {f"cmf_{n}": F.when(c("_cmf_row") >= n, F.coalesce(ratio(c("_mfv"), c("_cmf_vol")), F.lit(0.0)))},
    ]


def add_cmf(df: DataFrame, n: int = 20, key: Key = "entity", ts: Key = "date") -> DataFrame:
    """Money-flow volume over volume; a bar without range adds volume only."""
    return apply_steps(df, cmf_steps(n, key, ts))
