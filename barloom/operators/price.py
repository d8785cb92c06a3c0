"""Calendar, return, gap and candle features (F-01..04, F-16..19, F-23, F-49, F-51) and labels (L-01, L-02)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.windows import Key, Steps, apply_steps, float_ratio, lagged, ordered, ratio

c = F.col


def calendar_columns(date: Column) -> dict[str, Column]:
    return {
        "month": F.month(date),
        "weekday": F.weekday(date),
        "quarter": F.quarter(date),
        "week_no": F.weekofyear(date),
    }


def add_calendar(df: DataFrame, ts: str = "date") -> DataFrame:
    """month, weekday (0 = Monday), quarter, ISO week; null when a text date cannot be parsed."""
    date = c(ts)
    if dict(df.dtypes)[ts] == "string":
        date = F.to_date(F.try_to_timestamp(date, F.lit("yyyyMMdd")))
    return df.withColumns(calendar_columns(date))


def _prev_close(key: Key, ts: Key) -> dict[str, Column]:
    return {"_close_1": lagged("close", 1, key, ts)}


def return_steps(key: Key = "entity", ts: Key = "date") -> Steps:
    base = F.coalesce(c("_close_1"), c("open"))
    pct = {f"{x}_pct": float_ratio(c(x) - base, base) * 100 for x in ("open", "high", "low", "close")}
    return [_prev_close(key, ts), pct]


def add_returns(df: DataFrame, key: Key = "entity", ts: Key = "date") -> DataFrame:
    """open/high/low/close as percent of the previous close (of the own open on the first row); infinite after a close of zero."""
    return apply_steps(df, return_steps(key, ts))


def intraday_columns(position: str = "percent", range_base: str = "open") -> dict[str, Column]:
    span = c("high") - c("low")
    cols = {f"{x}_from_open_pct": ratio(c(x) - c("open"), c("open")) * 100 for x in ("high", "low", "close")}
    cols["intraday_range_pct"] = ratio(span, c(range_base)) * 100
    where = ratio(c("close") - c("low"), span)
    cols["close_position_in_range"] = (
        F.when(F.abs(span) > 1e-6, where * 100)
        if position == "percent"
        else F.when(span > 0, where).otherwise(F.lit(0.5))
    )
    return cols


def add_intraday(df: DataFrame, position: str = "percent", range_base: str = "open") -> DataFrame:
    """Moves against the open, the day's range and where the close lies in it.

    ``position='unit'`` gives 0..1 with 0.5 on flat bars; ``range_base='low'`` divides the range by the low.
    """
    return df.withColumns(intraday_columns(position, range_base))


def gap_steps(key: Key = "entity", ts: Key = "date") -> Steps:
    gap = ratio(c("open") - c("_close_1"), c("_close_1")) * 100
    return [_prev_close(key, ts), {"overnight_gap": gap, "gap_pct": gap}]


def add_gaps(df: DataFrame, key: Key = "entity", ts: Key = "date") -> DataFrame:
    return apply_steps(df, gap_steps(key, ts))


def candle_size_columns(unit: str = "abs") -> dict[str, Column]:
    o, h, l, cl = c("open"), c("high"), c("low"), c("close")
    sizes = {
        "body_size": F.abs(cl - o),
        "upper_shadow": h - F.greatest(cl, o),
        "lower_shadow": F.least(cl, o) - l,
    }
    if unit == "pct":
        sizes = {k: ratio(v, o) * 100 for k, v in sizes.items()}
    return sizes


def add_candle_sizes(df: DataFrame, unit: str = "abs") -> DataFrame:
    """Body and shadows in price units, or in percent of the open."""
    return df.withColumns(candle_size_columns(unit))


def momentum_steps(
    periods=(5, 10, 20), prefixes=("price_momentum_", "price_roc_"), key: Key = "entity", ts: Key = "date"
) -> Steps:
    lags = {f"_close_{n}": lagged("close", n, key, ts) for n in periods}
    return [lags, {f"{p}{n}": ratio(c("close"), c(f"_close_{n}")) - 1 for n in periods for p in prefixes}]


def add_momentum(df: DataFrame, periods=(5, 10, 20), key: Key = "entity", ts: Key = "date") -> DataFrame:
    """close / close n rows ago - 1, under both of its names."""
    return apply_steps(df, momentum_steps(periods, key=key, ts=ts))


def lag_return_steps(lags=(1, 2, 3), key: Key = "entity", ts: Key = "date") -> Steps:
    return momentum_steps(lags, ("return_lag_",), key, ts)


def add_lag_returns(df: DataFrame, lags=(1, 2, 3), key: Key = "entity", ts: Key = "date") -> DataFrame:
    """return_lag_k: the return over the last k rows (cumulative, not the k-th previous daily return)."""
    return apply_steps(df, lag_return_steps(lags, key, ts))


def add_trend_return(df: DataFrame, n: int = 20, key: Key = "entity", ts: Key = "date") -> DataFrame:
    """trend_return: return from the oldest to the newest close of the last n rows, clamped to ±1."""
    first = lagged("close", n - 1, key, ts)
    move = ratio(c("close") - c("_first"), c("_first"))
    clamped = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), move))
    return apply_steps(
        df,
        [{"_first": first, "_enough": lagged("close", n, key, ts).isNotNull()},
         {"trend_return": F.when(c("_enough"), clamped).otherwise(F.lit(0.0))}],
    )


def daily_return(current: Column, previous: Column) -> Column:
    """Percent change, 0 when the previous value is 0."""
    return F.when(previous == 0, F.lit(0.0)).otherwise(ratio(current - previous, previous) * 100)


def quarter_of_month(month: Column) -> Column:
    """1..4, and 1 for a month outside 1..12."""
    return F.when(month.between(1, 12), F.ceil(month / 3)).otherwise(F.lit(1))


def label_steps(horizons: dict[int, float], key: Key = "entity", ts: Key = "date") -> Steps:
    ahead = {f"_ahead_{h}": F.lead("close", h).over(ordered(key, ts)) for h in horizons}
    out: dict[str, Column] = {}
    for h, band in horizons.items():
        name = "next_day" if h == 1 else f"next_{h}day"
        r = F.when(F.abs(c("close")) > 1e-8, ratio(c(f"_ahead_{h}"), c("close")) - 1)
        out[f"{name}_return"] = r
        out[f"{name}_direction"] = F.when(r > band, 1).when(r < -band, -1).when(r.isNotNull(), 0)
    return [ahead, out]


def add_labels(
    df: DataFrame, horizons: dict[int, float] | None = None, key: Key = "entity", ts: Key = "date"
) -> DataFrame:
    """Forward returns and their direction; inside the dead band the direction is 0."""
    return apply_steps(df, label_steps(horizons or {1: 0.002, 3: 0.005}, key, ts))


def residual_label(df: DataFrame, pred: str, target: str = "next_day_return") -> DataFrame:
    """What a base prediction leaves unexplained, and its sign."""
    r = c(target) - c(pred)
    return df.withColumns({"residual": r, "residual_direction": F.signum(r).cast("int")})
