"""The 105-slot feature vector: layout, packing, normalisation (VEC-01..04, VEC-07)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.scalars import clamp, finite_or_zero

# Slot order and the value of a missing feature.  Three leading category slots and three
# trailing spare slots are constant 0.
LAYOUT: list[tuple[str | None, float]] = [
    (None, 0.0), (None, 0.0), (None, 0.0),
    ("volume", 0.0), ("amount", 0.0),
    ("month", 1.0), ("weekday", 0.0), ("quarter", 1.0), ("week_no", 0.0),
    ("open_pct", 0.0), ("high_pct", 0.0), ("low_pct", 0.0), ("close_pct", 0.0),
    ("high_from_open_pct", 0.0), ("low_from_open_pct", 0.0), ("close_from_open_pct", 0.0),
    ("intraday_range_pct", 0.0), ("close_position_in_range", 0.5),
    ("ema_5", 0.0), ("ema_10", 0.0), ("ema_20", 0.0), ("ema_30", 0.0), ("ema_60", 0.0),
    ("sma_5", 0.0), ("sma_10", 0.0), ("sma_20", 0.0),
    ("macd_line", 0.0), ("macd_signal", 0.0), ("macd_histogram", 0.0),
    ("macd_weekly_line", 0.0), ("macd_weekly_signal", 0.0), ("macd_monthly_line", 0.0), ("macd_monthly_signal", 0.0),
    ("rsi_14", 50.0), ("kdj_k", 50.0), ("kdj_d", 50.0), ("kdj_j", 50.0),
    ("bb_upper", 0.0), ("bb_middle", 0.0), ("bb_lower", 0.0), ("bb_bandwidth", 0.0), ("bb_percent_b", 0.5),
    ("atr", 0.0), ("volatility_5", 0.0), ("volatility_20", 0.0), ("asi", 0.0), ("obv", 0.0), ("volume_ratio", 1.0),
    ("price_momentum_5", 0.0), ("price_momentum_10", 0.0), ("price_momentum_20", 0.0), ("price_position_52w", 0.5),
    ("body_size", 0.0), ("upper_shadow", 0.0), ("lower_shadow", 0.0),
    ("trend_strength", 0.0), ("adx_14", 25.0), ("vwap_distance_pct", 0.0), ("cmf_20", 0.0), (None, 50.0),
    ("williams_r_14", -50.0), ("aroon_up_25", 50.0), ("aroon_down_25", 50.0),
    ("return_lag_1", 0.0), ("return_lag_2", 0.0), ("return_lag_3", 0.0),
    ("overnight_gap", 0.0), ("gap_pct", 0.0),
    ("volume_roc_5", 0.0), ("volume_spike", 0.0),
    ("price_roc_5", 0.0), ("price_roc_10", 0.0), ("price_roc_20", 0.0), ("hist_volatility_20", 0.0),
    ("is_doji", 0.0), ("is_hammer", 0.0), ("is_shooting_star", 0.0), ("consecutive_days", 0.0),
    ("index_csi300_pct_chg", 0.0), ("index_csi300_vs_ma5_pct", 0.0), ("index_csi300_vs_ma20_pct", 0.0),
    ("index_xin9_pct_chg", 0.0), ("index_xin9_vs_ma5_pct", 0.0), ("index_xin9_vs_ma20_pct", 0.0),
    ("index_chinext_pct_chg", 0.0), ("index_chinext_vs_ma5_pct", 0.0), ("index_chinext_vs_ma20_pct", 0.0),
    ("index_hsi_pct_chg", 0.0), ("index_hsi_vs_ma5_pct", 0.0), ("index_hsi_vs_ma20_pct", 0.0),
    ("fx_usdcnh_pct_chg", 0.0), ("fx_usdcnh_vs_ma5_pct", 0.0), ("fx_usdcnh_vs_ma20_pct", 0.0),
    ("net_mf_vol", 0.0), ("net_mf_amount", 0.0), ("smart_money_ratio", 0.0), ("large_order_flow", 0.0),
    ("industry_avg_return", 0.0), ("stock_vs_industry", 0.0), ("industry_momentum_5d", 0.0),
    ("vol_percentile", 0.5), ("high_vol_regime", 0.0),
    (None, 0.0), (None, 0.0), (None, 0.0),
]

SIZE = len(LAYOUT)
PCT_SCALE, PCT_LIMIT, ATANH_GUARD = 3.0, 15.0, 0.999

# How each slot range is scaled, (first, last, kind, parameters).  Slots 96 and up are zeroed.
SCALES: list[tuple[int, int, str, tuple[float, ...]]] = [
    (0, 2, "span", (0, 100, 0, 100)),
    (3, 4, "log", (20,)),
    (5, 5, "divide", (12,)),
    (6, 6, "divide", (7,)),
    (7, 7, "divide", (4,)),
    (8, 8, "divide", (53,)),
    (9, 15, "pct", ()),
    (16, 16, "span", (0, 20, 0, 20)),
    (17, 17, "span", (0, 1, 0, 1)),
    (18, 25, "pct", ()),
    (26, 32, "span", (-1, 1, 0, 1)),
    (33, 33, "divide", (100,)),
    (34, 35, "span", (0, 100, 0, 100)),
    (36, 36, "span", (-20, 120, 20, 140)),
    (37, 39, "pct", ()),
    (40, 41, "span", (0, 1, 0, 1)),
    (42, 42, "span", (0, 10, 0, 10)),
    (43, 44, "span", (0, 1, 0, 1)),
    (45, 45, "asi", ()),
    (46, 46, "obv", ()),
    (47, 47, "span", (0, 10, 0, 10)),
    (48, 48, "span", (-0.2, 0.2, 0, 0.2)),
    (49, 49, "span", (-0.3, 0.3, 0, 0.3)),
    (50, 50, "span", (-0.5, 0.5, 0, 0.5)),
    (51, 51, "span", (0, 1, 0, 1)),
    (52, 52, "pct", ()),
    (53, 54, "span", (0, 10, 0, 10)),
    (55, 55, "span", (-1, 1, 0, 1)),
    (56, 56, "span", (0, 100, 0, 100)),
    (57, 57, "pct", ()),
    (58, 58, "span", (-1, 1, 0, 1)),
    (59, 59, "span", (0, 100, 0, 100)),
    (60, 60, "span", (-100, 0, 100, 100)),
    (61, 62, "span", (0, 100, 0, 100)),
    (63, 65, "span", (-0.1, 0.1, 0, 0.1)),
    (66, 67, "pct", ()),
    (68, 68, "span", (-5, 5, 0, 5)),
    (69, 69, "keep", ()),
    (70, 70, "span", (-0.2, 0.2, 0, 0.2)),
    (71, 71, "span", (-0.3, 0.3, 0, 0.3)),
    (72, 72, "span", (-0.5, 0.5, 0, 0.5)),
    (73, 73, "span", (0, 1, 0, 1)),
    (74, 76, "keep", ()),
    (77, 86, "pct", ()),
    (87, 88, "signed_log", (20,)),
    (89, 89, "span", (-1, 1, 0, 1)),
    (90, 90, "signed_log", (20,)),
    (91, 91, "span", (-0.1, 0.1, 0, 0.1)),
    (92, 93, "span", (-0.2, 0.2, 0, 0.2)),
    (94, 94, "span", (0, 1, 0, 1)),
    (95, 95, "keep", ()),
]


def normalize_pct(x: Column) -> Column:
    return F.tanh(x / PCT_SCALE)


def denormalize_pct(x: Column) -> Column:
    """Inverse of the soft scale, guarded at ±0.999 and clamped to ±15."""
    return clamp(F.atanh(clamp(x, -ATANH_GUARD, ATANH_GUARD)) * PCT_SCALE, -PCT_LIMIT, PCT_LIMIT)


def _signed_log(x: Column, scale: float) -> Column:
    sign = F.when(x < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    return F.ln(F.greatest(F.abs(x), F.lit(1.0))) / scale * sign


def bound(x: Column, low: float, high: float) -> Column:
    """Clamp of a value known not to be null."""
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))


def scale_slot(x: Column, kind: str, p: Sequence[float]) -> Column:
    if kind == "span":
        low, high, shift, width = p
        return (bound(x, low, high) + float(shift)) / float(width)
    if kind == "divide":
        return x / float(p[0])
    if kind == "pct":
        return normalize_pct(x)
    if kind == "log":
        return bound(F.ln(F.greatest(x, F.lit(1.0))), -10, 30) / float(p[0])
    if kind == "signed_log":
        return _signed_log(x, float(p[0]))
    if kind == "obv":
        return F.when(F.abs(x) < 1, F.lit(0.0)).otherwise(bound(_signed_log(x, 20.0), -1, 1))
    if kind == "asi":
        return bound(x, -2000, 12000) / 14000.0 + 0.14
    return x


def pack_vector(df: DataFrame, layout=LAYOUT, out: str = "features") -> DataFrame:
    """One array from named columns; columns the frame lacks take their default."""
    have = set(df.columns)
    slots = [
        F.coalesce(F.col(n).cast("double"), F.lit(d)) if n in have else F.lit(d) for n, d in layout
    ]
    return df.withColumn(out, F.array(*slots))


def normalize(col: Column) -> Column:
    """Every slot scaled by its rule; non-finite input counts as 0, slots from 96 on become 0.

    Arrays of the layout's size are built slot by slot, in generated code.  Others go through one ``transform``, which
    Spark interprets: there the slot number walks a balanced tree of conditions to its rule.  ``col`` should be a column, not
    an expression, since each slot reads it.
    """
    slots = [F.lit(0.0)] * SIZE
    for first, last, kind, p in SCALES:
        for i in range(first, last + 1):
            slots[i] = scale_slot(finite_or_zero(F.get(col, F.lit(i))), kind, p)
    other = F.transform(col, lambda x, i: _by_slot(finite_or_zero(x), i, SCALES))
    return F.when(F.size(col) == SIZE, F.array(*slots)).otherwise(other)


def _by_slot(x: Column, i: Column, rules: list) -> Column:
    if len(rules) == 1:
        first, last, kind, p = rules[0]
        scaled = scale_slot(x, kind, p)
        return F.when(i <= last, scaled).otherwise(F.lit(0.0)) if last == SCALES[-1][1] else scaled
    half = len(rules) // 2
    return F.when(i < rules[half][0], _by_slot(x, i, rules[:half])).otherwise(_by_slot(x, i, rules[half:]))


def auto_normalize(df: DataFrame, col: str = "features") -> DataFrame:
    """Normalise only rows that look raw (slot 12 or 33 beyond ±1.5); drop rows of another length."""
    sized = df.where(F.size(col) == SIZE)
    x = F.col(col)
    raw = (F.abs(x[12]) > 1.5) | (F.abs(x[33]) > 1.5)
    return sized.withColumn(col, F.when(raw, normalize(x)).otherwise(x))


def fit_scaler(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean and population deviation of each column (null counts as 0), in one row."""
    aggs = []
    for n in cols:
        x = F.coalesce(F.col(n).cast("double"), F.lit(0.0))
        aggs += [F.avg(x).alias(f"{n}_mean"), F.stddev_pop(x).alias(f"{n}_std")]
    return df.agg(*aggs)


def apply_scaler(df: DataFrame, stats: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x - mean) / deviation, a zero deviation counting as 1.  The one-row statistics are a scalar subquery."""
    s = stats.select(F.struct(*stats.columns).alias("s")).scalar()
    out = {}
    for n in cols:
        x = F.coalesce(F.col(n).cast("double"), F.lit(0.0))
        sd = F.col("_s")[f"{n}_std"]
        out[f"{n}_z"] = (x - F.col("_s")[f"{n}_mean"]) / F.when(sd == 0, F.lit(1.0)).otherwise(sd)
    return df.withColumn("_s", s).withColumns(out).drop("_s")
