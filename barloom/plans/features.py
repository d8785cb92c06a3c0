"""The wide feature table (FP-01)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators import context, momentum, pattern, price, trend, volatility, volume
from barloom.operators.joins import asof_join, lookup
from barloom.operators.trailing import Trail, trailing_values
from barloom.operators.windows import ROW, Key, Steps, apply_steps, lagged, merge, near, row_no, total
from barloom.session import settle

c = F.col

INDEX_CODES = ("csi300", "chinext", "xin9", "hsi", "usdcnh")


def bar_steps(key: Key = "entity", ts: str = "date", origin=None, labels: bool = True, bases: tuple[str, str] | None = None) -> Steps:
    """Every feature that needs bars only, as one set of stages (one Exchange, one Sort).

    ``bases`` names columns with the totals of OBV and ASI before the rows at hand.
    """
    obv_base, asi_base = bases or (None, None)
    parts = [
        price.return_steps(key, ts),
        price.gap_steps(key, ts),
        price.momentum_steps(key=key, ts=ts),
        price.lag_return_steps(key=key, ts=ts),
        trend.ema_steps(key=key, ts=ts),
        trend.sma_steps(key=key, ts=ts),
        trend.macd_steps(12, 26, key=key, ts=ts),
        trend.long_macd_steps(key, ts),
        trend.adx_steps(key=key, ts=ts),
        trend.aroon_steps(key=key, ts=ts),
        momentum.rsi_steps(key=key, ts=ts),
        momentum.kdj_steps(key=key, ts=ts),
        momentum.williams_steps(key=key, ts=ts),
        volatility.bollinger_steps(key=key, ts=ts),
        volatility.atr_steps(key=key, ts=ts),
        volatility.volatility_steps(key=key, ts=ts),
        volatility.range_position_steps(key=key, ts=ts),
        volatility.vol_regime_steps(key=key, ts=ts),
        volume.asi_steps(origin, key, ts, asi_base),
        volume.obv_steps(origin, key, ts, obv_base),
        volume.volume_steps(key, ts),
        volume.vwap_steps(key=key, ts=ts),
        volume.cmf_steps(key=key, ts=ts),
        pattern.streak_steps(key=key, ts=ts),
        pattern.streak_steps("consecutive_up_days", "down", 19, key, ts),
    ]
    if labels:
        parts.append(price.label_steps({1: 0.002, 3: 0.005}, key, ts))
    return merge(*parts)


# What the features of ``bar_steps`` take from the rows before, by the names that their formulas use.
TRAILS = {
    **{f"_close_{n}": Trail("value", "close", 1, n) for n in (2, 3, 5, 10, 20)},
    **{f"_ema_{n}": Trail("ema", "close", n) for n in (5, 10, 12, 20, 26, 30, 60, 126, 130, 260)},
    **{f"_mean_{n}": Trail("mean", "close", n) for n in (5, 10, 20)},
    **{f"_sd_{n}": Trail("stddev", "close", n) for n in (5, 20, 60)},
    "_share": Trail("share_below", "_sd_60", 60),
    "_pdm": Trail("sum", "_plus", 14), "_mdm": Trail("sum", "_minus", 14), "_tr_n": Trail("sum", "_range", 14), "_atr": Trail("mean", "_range", 14),
    "_gain": Trail("mean", "_up", 14), "_loss": Trail("mean", "_down", 14),
    "_ago_high": Trail("ago_max", "high", 25), "_ago_low": Trail("ago_min", "low", 25),
    "_kdj_high": Trail("max", "high", 9), "_kdj_low": Trail("min", "low", 9),
    "_wr_high": Trail("max", "high", 14), "_wr_low": Trail("min", "low", 14),
    "_rp_high": Trail("max", "high", 252), "_rp_low": Trail("min", "low", 252),
    "_v_mean5": Trail("mean", "volume", 5), "_v_prev5": Trail("mean", "volume", 5, 1), "_v_lag5": Trail("value", "volume", 1, 5),
    "_v_past": Trail("mean", "_v_own", 6, 5),
    "_vw_pv": Trail("sum_known", "_pv", 20), "_vw_vol": Trail("sum_known", "volume", 20), "_mfv": Trail("sum", "_flow", 20),
    "_obv": Trail("total", "_signed"), "_asi": Trail("total", "_asi_core"),
    "_len_consecutive_days": Trail("run", "_sign_consecutive_days"), "_len_consecutive_up_days": Trail("run", "_sign_consecutive_up_days"),
}
AHEAD = {f"_ahead_{n}": Trail("value", "close", 1, -n) for n in (1, 3)}
FLOW_TRAILS = {"_flow_5": Trail("mean", "net_mf_vol", 5)}
POSITION_TRAILS = {
    "_pp_n": Trail("count", "_pos_pe_percentile_52w", 252),
    "_lo_pe_percentile_52w": Trail("min", "_pos_pe_percentile_52w", 252), "_hi_pe_percentile_52w": Trail("max", "_pos_pe_percentile_52w", 252),
}


def _before(key: Key, ts: str, origin) -> Steps:
    """What the trailing values are taken of: sizes and moves of single rows against the row before."""
    prev = c("_close_1")
    up, down = c("high") - c("_high_1"), c("_low_1") - c("low")
    asi, obv = volume.asi_steps(origin, key, ts), volume.obv_steps(origin, key, ts)
    streaks = [pattern.streak_steps(key=key, ts=ts), pattern.streak_steps("consecutive_up_days", "down", 19, key, ts)]
    sum5 = total(near("volume", 5)) / 5
    return [
        {
            **{f"_{n}_1": lagged(n, 1, key, ts) for n in ("open", "high", "low", "close")},
            **{f"_volume_{k}": lagged("volume", k, key, ts) for k in range(1, 5)}, ROW: row_no(key, ts),
        },
        {
            "_plus": F.when(prev.isNotNull() & (up > down) & (up > 0), up), "_minus": F.when(prev.isNotNull() & (down > up) & (down > 0), down),
            "_range": trend.true_ranges(1)[0],
            "_up": F.when(prev.isNotNull(), F.greatest(c("close") - prev, F.lit(0.0))), "_down": F.when(prev.isNotNull(), F.greatest(prev - c("close"), F.lit(0.0))),
            "_v_own": F.when((c("volume") > 0) & (sum5 > 0), c("volume") / sum5),
            "_pv": (c("high") + c("low") + c("close")) / 3 * c("volume"), "_flow": volume.flow_of_bar(),
            **asi[1], **obv[1], **streaks[0][1], **streaks[1][1],
        },
        asi[2],
        {n: volume.since(c(n), origin, ts) for n in ("_signed", "_asi_core")},
    ]


def _after(key: Key, ts: str, labels: bool, bases: tuple[str, str] | None) -> Steps:
    """The features' formulas over the trailing values."""
    obv_base, asi_base = bases or (None, None)
    line = lambda name, fast, slow: {f"{name}_line": c(f"_ema_{fast}") - c(f"_ema_{slow}"), f"{name}_signal": (c(f"_ema_{fast}") - c(f"_ema_{slow}")) * 0.85}
    vol = volume.volume_steps(key, ts)
    last = lambda steps, k=1: steps[-k]
    first = {
        **{n: c(ROW) for n in ("_acc_row", "_v_row", "_vw_row", "_cmf_row", "_vr_row", "_pp_row")}, "_bb_mid": c("_mean_20"), "_bb_sd": c("_sd_20"),
        "_cmf_vol": c("_vw_vol"),
    }
    second = {
        **last(price.return_steps(key, ts)), **last(price.gap_steps(key, ts)), **last(price.momentum_steps(key=key, ts=ts)),
        **last(price.lag_return_steps(key=key, ts=ts)),
        **{f"ema_{n}": c(f"_ema_{n}") for n in (5, 10, 20, 30, 60)}, **{f"sma_{n}": c(f"_mean_{n}") for n in (5, 10, 20)},
        **line("macd", 12, 26), "macd_histogram": c("_ema_12") - c("_ema_26") - (c("_ema_12") - c("_ema_26")) * 0.85,
        **line("macd_weekly", 60, 130), **line("macd_monthly", 126, 260),
        **last(trend.adx_steps(key=key, ts=ts)), **{f"aroon_{k}_25": (25 - c(f"_ago_{v}")) / F.lit(25.0) * 100 for k, v in (("up", "high"), ("down", "low"))},
        **last(momentum.rsi_steps(key=key, ts=ts)), **last(momentum.kdj_steps(key=key, ts=ts), 3), **last(momentum.williams_steps(key=key, ts=ts)),
        **last(volatility.bollinger_steps(key=key, ts=ts)), **last(volatility.atr_steps(key=key, ts=ts)),
        "volatility_5": c("_sd_5"), "volatility_20": c("_sd_20"), "hist_volatility_20": c("_sd_20"),
        **last(volatility.range_position_steps(key=key, ts=ts)), **last(volatility.vol_regime_steps(key=key, ts=ts), 2),
        "asi": volume.asi_of(c("_asi"), asi_base), "obv": volume.obv_of(c("_obv"), obv_base), **{n: x for n, x in vol[1].items() if n != "_v_own"},
        **last(volume.vwap_steps(key=key, ts=ts)), **last(volume.cmf_steps(key=key, ts=ts)),
        **last(pattern.streak_steps(key=key, ts=ts)), **last(pattern.streak_steps("consecutive_up_days", "down", 19, key, ts)),
        **(last(price.label_steps({1: 0.002, 3: 0.005}, key, ts)) if labels else {}),
    }
    return [first, second, {**last(vol), **last(momentum.kdj_steps(key=key, ts=ts), 2), **last(volatility.vol_regime_steps(key=key, ts=ts))}, last(momentum.kdj_steps(key=key, ts=ts))]


def row_columns(ts: str = "date") -> dict[str, Column]:
    """Features of a single row."""
    return {
        **price.calendar_columns(c(ts)),
        **price.intraday_columns(),
        **price.candle_size_columns(),
        **pattern.pattern_columns(),
    }


def build_features(
    bars: DataFrame,
    dim: DataFrame | None = None,
    index_bars: DataFrame | None = None,
    valuation: DataFrame | None = None,
    flows: DataFrame | None = None,
    index_codes: Sequence[str] = INDEX_CODES,
    momentum_index: str | None = None,
    min_rows: int = 60,
    min_date: Column | None = None,
    origin=None,
    key: str = "entity",
    ts: str = "date",
    bases: tuple[str, str] | None = None,
    peers: DataFrame | None = None,
    facts: DataFrame | None = None,
    late: dict[str, Column] | None = None,
) -> DataFrame:
    """All features and labels per (entity, date), from the 60th row of an entity on.

    One shuffle by entity serves every value over earlier rows: narrow bars are numbered and get the row before them in
    one window, and their trailing values come from ``trailing_values``, which gives the wanted rows back.  What is joined
    by entity, or by entity and date, comes before that.  Index and industry series have one
    row per code or industry and date, whatever the number of entities, and go to every task afterwards: wide rows are never
    shuffled, and bars that lie by entity already (``settle_by``) are not moved at all.  Each context is
    optional; bars that carry flow or valuation columns themselves need no such table.  ``min_date`` cuts the result;
    a run that reads only what those rows need is :func:`barloom.plans.increment.features_since`.
    ``peers``: the bars that industry statistics are taken from, where ``bars`` holds only some of the entities.
    ``facts``: those statistics of ``bars`` (``group_facts``), where they are there already.
    ``late``: columns that are made of a single row's columns in the end.
    """
    df, given = bars, set(bars.columns)
    if dim is not None:
        df = lookup(df, dim.select(key, "industry", *[n for n in ("act_ent_type",) if n in dim.columns]), [key])
    if flows is not None:
        df = lookup(df, flows, [key, ts], ["net_mf_vol", "net_mf_amount"])
    cols = [n for n in context.VALUATION_COLUMNS if n in (bars if valuation is None else valuation).columns]
    if valuation is not None and cols:
        df = lookup(df, valuation, [key, ts], cols)
    brought = df.columns
    before, wanted, after = _before(key, ts, origin), {**TRAILS, **AHEAD}, _after(key, ts, True, bases)
    if {"net_mf_vol", "net_mf_amount"} <= set(df.columns):
        wanted |= FLOW_TRAILS
        after[1] |= {**context.flow_steps(key, ts)[0], "large_order_flow": F.when(c(ROW) >= 5, c("_flow_5")).otherwise(c("net_mf_vol"))}
    if "pe_ttm" in cols:
        position = context.position_positive_steps(key=key, ts=ts)
        wanted |= POSITION_TRAILS
        before[1] |= {n: x for n, x in position[0].items() if n.startswith("_pos_")}
        after[1] |= position[-1]
    if index_bars is not None:
        before[0]["prev_date"] = lagged(ts, 1, key, ts)
    for stage in before:
        df = df.withColumns(stage)
    used = {ROW, "prev_date", "_close_1", "_sign_consecutive_days", "_sign_consecutive_up_days"}
    made = [n for n in df.columns if n not in brought and n not in used]
    # Context comes to the narrow rows by broadcast, which leaves them where they lie and in their order.
    if index_bars is not None:
        df = add_index_columns(df, index_bars, index_codes, bars.select(ts) if facts is None else facts.select(ts), ts)
    if dim is not None:
        if facts is None:
            facts = settle(group_facts(bars if peers is None else peers, dim, ("industry",), key, ts))
        # Every (industry, date) of the bars, without the joins made so far.
        asked = facts if peers is None else bars.select(key, ts).join(dim.select(key, "industry"), key)
        df = context.add_group_context(df, context.series_of(facts, ts=ts), ts=ts, asked=asked.select("industry", ts), small=True)
        df = lookup(df, F.broadcast(context.edge_of(facts, ts=ts)), ["industry", ts])
    ready = c(ROW) >= min_rows
    if min_date is not None:
        ready = ready & (c(ts) >= min_date)
    out = trailing_values(df.withColumn("_ready", F.coalesce(ready, F.lit(False))), wanted, ROW, "_ready", (*made, "_sd_60"))
    if index_bars is not None and momentum_index:
        out = out.withColumn("industry_momentum", c(f"index_{momentum_index}_pct_chg"))
    if "act_ent_type" in out.columns:
        out = out.withColumn("act_ent_type", F.coalesce("act_ent_type", F.lit("UNKNOWN")))
    for stage in after:
        out = out.withColumns(stage)
    out = out.withColumns({**(late or {}), **row_columns(ts), "trend_strength": c("adx_14")})
    if "dv_ttm" in cols or "dv_ttm" in (late or {}):
        out = out.withColumn("dv_ttm", F.coalesce("dv_ttm", F.lit(0.0)))
    out = out.drop(*[n for n in out.columns if n.startswith("_") and n not in given], *(bases or ()))
    return context.add_vs_group(out) if dim is not None else out


def group_facts(bars: DataFrame, dim: DataFrame, by: Sequence[str] = ("industry",), key: str = "entity", ts: str = "date") -> DataFrame:
    """Sums and counts per group and date of close, of pct_chg (the vendor's column if there is one, else the close-to-close
    return) and of the 5-row momentum: one pass over the bars for every series of a group."""
    steps = price.momentum_steps((5,), ("_momentum_",), key, ts)
    given = "pct_chg" in bars.columns
    rows = bars.select(key, ts, "close", *(["pct_chg"] if given else ["open", "high", "low"]))
    for stage in steps if given else merge(price.return_steps(key, ts), steps):
        rows = rows.withColumns(stage)
    rows = rows.select(key, ts, "close", c("pct_chg" if given else "close_pct").alias("pct"), c("_momentum_5").alias("momentum"))
    sums = [f(n).alias(f"{k}_{n}") for n in ("close", "pct", "momentum") for k, f in (("sum", F.sum), ("n", F.count))]
    return rows.join(dim.select(key, *by), key).groupBy(*by, ts).agg(*sums)


def add_index_columns(df: DataFrame, index_bars: DataFrame, codes: Sequence[str], dates: DataFrame, ts: str = "date") -> DataFrame:
    """Index context looked up at the ``prev_date`` computed with the other windows; ``dates`` covers those."""
    cols = ("pct_chg", "vs_ma5_pct", "vs_ma20_pct")
    series = context.index_series(index_bars)
    asked = dates.select(c(ts).alias("_at")).distinct()
    lines = asked.withColumn("code", F.explode(F.array(*[F.lit(k) for k in codes])))
    solved = asof_join(lines, series, "code", cols, ts=ts, left_ts="_at", ref_date=None)
    wide = context.pivot_series(solved, codes, cols, ts="_at")
    named = [c(f"{k}_{v}").alias(f"{'fx' if k == 'usdcnh' else 'index'}_{k}_{v}") for k in codes for v in cols]
    return df.join(F.broadcast(wide.select(c("_at").alias("prev_date"), *named)), "prev_date", "left").drop("prev_date")


# What a feature reads where its history is missing; all others read 0.
NEUTRAL = {"rsi_14": 50.0, "kdj_k": 50.0, "kdj_d": 50.0, "kdj_j": 50.0, "volume_ratio": 1.0, "williams_r_14": -50.0, "adx_14": 25.0, "price_position_52w": 0.5}
PLACEHOLDERS = ("asi", "net_mf_vol", "net_mf_amount", "smart_money_ratio", "large_order_flow", "industry_avg_return", "stock_vs_industry", "industry_momentum_5d")


def variant_steps(key: Key = "entity", ts: str = "date") -> Steps:
    """The second composition's forms: averages and MACD seeded with the oldest close and relative to the close, partial
    52-week ranges, ADX without the dominance test, Aroon with the oldest of ties, volume against its mean."""
    return merge(
        price.return_steps(key, ts),
        price.gap_steps(key, ts),
        price.momentum_steps(key=key, ts=ts),
        price.lag_return_steps(key=key, ts=ts),
        trend.ema_steps(seed="first", relative=True, key=key, ts=ts),
        trend.sma_steps(relative=True, key=key, ts=ts),
        trend.macd_steps(12, 26, signal=0.9, seed="first", relative=True, key=key, ts=ts),
        trend.adx_steps(dominance=False, key=key, ts=ts),
        trend.aroon_steps(ties="oldest", key=key, ts=ts),
        momentum.rsi_steps(key=key, ts=ts),
        momentum.kdj_steps(key=key, ts=ts),
        momentum.williams_steps(key=key, ts=ts),
        volatility.bollinger_steps(relative=True, key=key, ts=ts),
        volatility.atr_steps(relative=True, key=key, ts=ts),
        volatility.volatility_steps(key=key, ts=ts),
        volatility.range_position_steps(partial=True, key=key, ts=ts),
        volume.volume_steps(key, ts),
        volume.volume_vs_mean_steps(key=key, ts=ts),
        volume.vwap_steps(key=key, ts=ts),
        volume.cmf_steps(key=key, ts=ts),
        pattern.streak_steps(key=key, ts=ts),
    )


def features_on_the_fly(bars: DataFrame, min_rows: int = 60, key: str = "entity", ts: str = "date") -> DataFrame:
    """Features from bars alone, in the forms of ``variant_steps``, from the 60th row of an entity on.

    Nothing is null: a feature without enough history, or without spread to measure, reads its neutral constant
    (``NEUTRAL``, else 0), and features that need other tables are 0.  One Exchange and one Sort serve all windows.
    """
    steps = merge(variant_steps(key, ts), [{"_row": row_no(key, ts)}])
    steps.append({"ready": c("_row") >= min_rows})
    out = apply_steps(bars, steps).where("ready").drop("ready").withColumns(row_columns(ts))
    made = [n for n in out.columns if n not in bars.columns]
    kinds = dict(out.dtypes)
    numbers = {n: F.coalesce(c(n), F.lit(NEUTRAL.get(n, 0.0)).cast(kinds[n])) for n in made if kinds[n] not in ("boolean", "string")}
    flags = {n: F.coalesce(c(n), F.lit(False)) for n in made if kinds[n] == "boolean"}
    return out.withColumns({**numbers, **flags, **{n: F.lit(0.0) for n in PLACEHOLDERS}})
