"""Moving averages, MACD, ADX and Aroon (F-05..08, F-24, F-29, F-48, F-50)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.recurrence import linear_recurrences, smoothing
from barloom.operators.windows import (
    Key,
    Steps,
    apply_steps,
    geometric_sum_steps,
    from_row,
    lagged,
    mean,
    merge,
    names,
    near,
    near_lags,
    ordered,
    ratio,
    total,
)

c = F.col


def _alpha(p: int) -> float:
    return 2.0 / (p + 1.0)


def _ema_parts(p: int, rows: int, seed: str, key: Key, ts: Key) -> tuple[dict[str, tuple[float, int]], dict, Column]:
    """Kernels, extra lags and the closed form of an EMA of period ``p`` restarted on the last ``rows`` rows.

    seed='sma'   start from the mean of those rows, then fold all of them;
    seed='first' start from the oldest of them, then fold the rest.
    """
    a = _alpha(p)
    q = 1.0 - a
    kernel = f"_k{p}_{rows}"
    if seed == "sma":
        sums = {kernel: (q, rows), f"_s{rows}": (1.0, rows)}
        value = c(kernel) * a + c(f"_s{rows}") / rows * (q**rows)
        return sums, {}, value
    sums = {kernel: (q, rows)}
    oldest = f"_close_{rows - 1}"
    return sums, {oldest: lagged("close", rows - 1, key, ts)}, c(kernel) * a + c(oldest) * (q**rows)


def ema_steps(
    periods=(5, 10, 20, 30, 60), seed: str = "sma", relative: bool = False, key: Key = "entity", ts: Key = "date"
) -> Steps:
    kernels: dict[str, tuple[float, int]] = {}
    lags: dict[str, Column] = {}
    out: dict[str, Column] = {}
    for p in periods:
        k, extra, value = _ema_parts(p, p, seed, key, ts)
        kernels |= k
        lags |= extra
        out[f"ema_{p}"] = ratio(value - c("close"), c("close")) * 100 if relative else value
    steps = geometric_sum_steps("close", kernels, key, ts)
    return merge(steps, [lags]) + [out]


def add_ema(
    df: DataFrame, periods=(5, 10, 20, 30, 60), seed: str = "sma", relative: bool = False,
    key: Key = "entity", ts: Key = "date",
) -> DataFrame:
    """Finite EMA: restarted on every row from the last p closes, so it is a fixed weighting of p rows.

    ``seed='first'`` starts from the oldest close; ``relative=True`` gives percent distance from the close.
    """
    return apply_steps(df, ema_steps(periods, seed, relative, key, ts))


def sma_steps(periods=(5, 10, 20), relative: bool = False, key: Key = "entity", ts: Key = "date") -> Steps:
    out = {}
    for n in periods:
        level = mean(near("close", n))
        if relative:
            level = ratio(level - c("close"), c("close")) * 100
        out[f"sma_{n}"] = from_row(n, level)
    return [near_lags(max(periods), "close", key=key, ts=ts), out]


def add_sma(df: DataFrame, periods=(5, 10, 20), relative: bool = False, key: Key = "entity", ts: Key = "date") -> DataFrame:
    return apply_steps(df, sma_steps(periods, relative, key, ts))


def macd_steps(
    fast: int, slow: int, prefix: str = "macd", signal: float = 0.85, histogram: bool = True,
    seed: str = "sma", relative: bool = False, key: Key = "entity", ts: Key = "date",
) -> Steps:
    # With seed='first' both averages restart on the slow window; otherwise each on its own.
    fast_rows = slow if seed == "first" else fast
    kf, lf, vf = _ema_parts(fast, fast_rows, seed, key, ts)
    ks, ls, vs = _ema_parts(slow, slow, seed, key, ts)
    line = vf - vs
    if relative:
        line = ratio(line, c("close"))
    out = {f"{prefix}_line": line, f"{prefix}_signal": line * signal}
    if histogram:
        out[f"{prefix}_histogram"] = line - line * signal
    return merge(geometric_sum_steps("close", kf | ks, key, ts), [lf | ls]) + [out]


def add_macd(
    df: DataFrame, fast: int = 12, slow: int = 26, prefix: str = "macd", signal: float = 0.85,
    seed: str = "sma", relative: bool = False, key: Key = "entity", ts: Key = "date",
) -> DataFrame:
    """MACD line from finite EMAs; the signal is a fixed share of the line (0.85, or 0.9 in the variant)."""
    return apply_steps(df, macd_steps(fast, slow, prefix, signal, True, seed, relative, key, ts))


def long_macd_steps(key: Key = "entity", ts: Key = "date") -> Steps:
    return merge(
        macd_steps(60, 130, "macd_weekly", histogram=False, key=key, ts=ts),
        macd_steps(126, 260, "macd_monthly", histogram=False, key=key, ts=ts),
    )


def add_long_macd(df: DataFrame, key: Key = "entity", ts: Key = "date") -> DataFrame:
    """Weekly (60, 130) and monthly (126, 260) MACD; null before the slow window is full."""
    return apply_steps(df, long_macd_steps(key, ts))


def add_macd_recursive(
    df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, key: str = "entity", ts: str = "date"
) -> DataFrame:
    """MACD whose averages and signal carry their state through the whole series.

    The averages are linear recurrences, so they are prefix scans of affine maps and need no fold; the entity may be of
    any length.  A null close leaves the averages as they are.
    """
    out = linear_recurrences(
        df,
        {"_fast": smoothing(c("close"), fast), "_slow": smoothing(c("close"), slow)},
        {"macd_ema_signal": smoothing(c("_fast") - c("_slow"), signal)},
        key=key, ts=ts,
    )
    line = c("_fast") - c("_slow")
    return out.select(*df.columns, line.alias("macd"), "macd_ema_signal", (line - c("macd_ema_signal")).alias("macd_ema_hist"))


def apply_vector_indicator(
    df: DataFrame, fold: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], out_schema: str, key: str = "entity", ts: str = "date"
) -> DataFrame:
    """Run a user's indicator over the columns of each entity, as arrays in time order.

    ``fold`` gets one array per column and returns one per new column of ``out_schema``.  An entity is one group; a linear
    recurrence goes over entities of any length (``linear_recurrences``).
    """
    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", " + out_schema

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(ts)
        made = fold({n: table.column(n).to_numpy() for n in table.column_names})
        for n, values in made.items():
            table = table.append_column(n, pa.array(values))
        return table

    return df.groupBy(key).applyInArrow(run, schema)


def apply_indicator(df: DataFrame, indicator, out_schema: str, key: str = "entity", ts: str = "date") -> DataFrame:
    """Run a user's stateful indicator over each entity's ordered rows.

    ``indicator()`` makes a fresh object per entity whose ``next(row: dict) -> dict`` returns the new columns.
    """
    schema = ", ".join(f"{n} {t}" for n, t in df.dtypes) + ", " + out_schema

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ts).reset_index(drop=True)
        state = indicator()
        made = pd.DataFrame([state.next(r) for r in pdf.to_dict("records")])
        return pd.concat([pdf, made], axis=1)

    return df.groupBy(key).applyInPandas(fold, schema)


def true_ranges(n: int) -> list[Column]:
    """True range of the last n moves, the newest first; null without a close before."""
    bars = zip(near("high", n), near("low", n), near("close", n, 1), strict=True)
    return [F.when(prev.isNotNull(), F.greatest(h - l, F.abs(h - prev), F.abs(l - prev))) for h, l, prev in bars]


def adx_steps(n: int = 14, dominance: bool = True, key: Key = "entity", ts: Key = "date") -> Steps:
    highs, lows = near("high", n + 1), near("low", n + 1)
    plus, minus = [], []
    for k, prev in enumerate(near("close", n, 1)):
        up, down = highs[k] - highs[k + 1], lows[k + 1] - lows[k]
        if dominance:
            a, b = F.when((up > down) & (up > 0), up), F.when((down > up) & (down > 0), down)
        else:
            a, b = F.greatest(up, F.lit(0.0)), F.greatest(down, F.lit(0.0))
        plus.append(F.when(prev.isNotNull(), a))
        minus.append(F.when(prev.isNotNull(), b))
    p, m = ratio(c("_pdm"), c("_tr_n")) * 100, ratio(c("_mdm"), c("_tr_n")) * 100
    dx = ratio(F.abs(p - m), p + m) * 100
    neutral = F.lit(0.0 if dominance else 25.0)
    return [
        near_lags(n + 1, "high", "low", "close", key=key, ts=ts),
        {"_pdm": total(plus), "_mdm": total(minus), "_tr_n": total(true_ranges(n))},
        {f"adx_{n}": from_row(n + 1, F.coalesce(dx, neutral))},
    ]


def add_adx(df: DataFrame, n: int = 14, dominance: bool = True, key: Key = "entity", ts: Key = "date") -> DataFrame:
    """Directional index over the last n moves (the trailing window, not the head of the history)."""
    return apply_steps(df, adx_steps(n, dominance, key, ts))


def aroon_steps(n: int = 25, ties: str = "newest", key: Key = "entity", ts: Key = "date") -> Steps:
    def score(column: str, extreme: str) -> Column:
        ago = list(enumerate(near(column, n)))
        at = F.coalesce(*[F.when(v == c(extreme), F.lit(k)) for k, v in (ago if ties == "newest" else reversed(ago))])
        return from_row(n, (n - at) / F.lit(float(n)) * 100)

    return [
        near_lags(n, "high", "low", key=key, ts=ts),
        {"_ar_high": F.greatest(*near("high", n)), "_ar_low": F.least(*near("low", n))},
        {f"aroon_up_{n}": score("high", "_ar_high"), f"aroon_down_{n}": score("low", "_ar_low")},
    ]


def add_aroon(df: DataFrame, n: int = 25, ties: str = "newest", key: Key = "entity", ts: Key = "date") -> DataFrame:
    """Rows since the latest highest high / lowest low of the last n rows, as 0..100."""
    return apply_steps(df, aroon_steps(n, ties, key, ts))
