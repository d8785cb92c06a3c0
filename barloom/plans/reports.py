"""Sector, flow and signal reports (RP-01..20).  ``as_of`` is a parameter everywhere: a literal date prunes
files, a scalar subquery follows the data.

Sector tables hold one row per (code, date): name, pct_change, up_num, down_num, turnover_rate, total_mv,
leading, leading_code, leading_pct (or limit_up_num and vol_ratio for the second vendor).
Amounts are shown in units of ``unit``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.scalars import round_to
from barloom.operators.aggregates import top_n
from barloom.operators.universe import latest_slice
from barloom.operators.windows import latest_rows, preceding, ratio

c = F.col


def newest(df: DataFrame, ts: str = "date") -> Column:
    """The newest date of a table as a scalar subquery."""
    return df.agg(F.max(ts)).scalar()


def _since(df: DataFrame, as_of: Column, days: int) -> DataFrame:
    return df.where(c("date") >= F.date_sub(as_of, days))


def _within(as_of: Column, first: int, last: int = 0) -> Column:
    return c("date").between(F.date_sub(as_of, first), F.date_sub(as_of, last))


def _on(df: DataFrame, as_of: Column | None) -> DataFrame:
    """Rows of a date, or of the table's newest one."""
    return latest_slice(df) if as_of is None else df.where(c("date") == as_of)


def _top(df: DataFrame, n: int, *order) -> DataFrame:
    return df.orderBy(*order).limit(n)


# --------------------------------------------------------------------------------------------- flows


def top_inflow(flows: DataFrame, as_of: Column, limit: int = 20, unit: float = 1e8, min_days: int = 3) -> DataFrame:
    """Net inflow summed over 5 days, for codes with at least 3 days of data."""
    w = c("date") >= F.date_sub(as_of, 4)
    agg = _since(flows, as_of, 10).groupBy("code", "name").agg(
        F.sum(F.when(w, c("net_amount"))).alias("net_5d"),
        F.sum(F.when(w, c("pct_change"))).alias("_sum"),
        F.avg(F.when(w, c("pct_change"))).alias("_avg"),
        F.count_if(w).alias("_n"),
    )
    best = _top(agg.where(c("_n") >= min_days), limit, c("net_5d").desc_nulls_last(), "code")
    return best.select(
        "code", "name", round_to(c("net_5d") / unit, 2).alias("net_5d"),
        round_to("_sum", 2).alias("pct_sum_5d"), round_to("_avg", 2).alias("pct_avg_5d"),
    )


def accelerating_inflow(flows: DataFrame, as_of: Column, limit: int = 20, unit: float = 1e8, span: int = 3) -> DataFrame:
    """Last ``span`` days against the ``span`` days before."""
    agg = _since(flows, as_of, 4 * span).groupBy("code", "name").agg(
        F.sum(F.when(_within(as_of, span - 1), c("net_amount"))).alias("last"),
        F.sum(F.when(_within(as_of, 2 * span - 1, span), c("net_amount"))).alias("prev"),
    )
    gain = c("last") - F.coalesce("prev", F.lit(0.0))
    best = _top(agg.where((c("last") > 0) & (gain > 0)), limit, gain.desc(), "code")
    return best.select(
        "code", "name", round_to(c("last") / unit, 2).alias("net_last"), round_to(c("prev") / unit, 2).alias("net_prev"),
        round_to(gain / unit, 2).alias("acceleration"),
    )


def strong_day(flows: DataFrame, limit: int = 20, unit: float = 1e8, min_pct: float = 1.5, as_of: Column | None = None) -> DataFrame:
    """Codes up with a net inflow on the newest date."""
    rows = _on(flows, as_of).where((c("pct_change") > min_pct) & (c("net_amount") > 0))
    best = _top(rows, limit, c("net_amount").desc(), c("pct_change").desc(), "code")
    return best.select(
        "code", "name", "lead_stock", "close_price", round_to("pct_change", 2).alias("pct_change"),
        round_to(c("net_amount") / unit, 2).alias("net_amount"),
    )


def consistent_inflow(flows: DataFrame, as_of: Column, limit: int = 20, unit: float = 1e8, min_days: int = 3) -> DataFrame:
    agg = _since(flows, as_of, 7).groupBy("code", "name").agg(
        F.count(F.lit(1)).alias("days"), F.count_if(c("net_amount") > 0).alias("pos_days"), F.sum("net_amount").alias("_net")
    )
    best = _top(agg.where((c("days") >= min_days) & (c("pos_days") >= min_days)), limit, c("_net").desc(), "code")
    return best.select("code", "name", "pos_days", "days", round_to(c("_net") / unit, 2).alias("net_sum"))


def industry_inflow(flows: DataFrame, limit: int = 20, unit: float = 1e8, as_of: Column | None = None) -> DataFrame:
    best = _top(_on(flows, as_of), limit, c("net_amount").desc_nulls_last(), "code")
    return best.select(
        "code", "name", *[round_to(c(n) / unit, 2).alias(n) for n in ("net_amount", "net_buy_amount", "net_sell_amount")]
    )


def entity_inflow(flows: DataFrame, limit: int = 30, unit: float = 1e8, vol_unit: float = 1e6, as_of: Column | None = None) -> DataFrame:
    rows = _on(flows, as_of).where(c("net_mf_amount").isNotNull())
    return _top(rows, limit, c("net_mf_amount").desc(), "entity").select(
        "entity", round_to(c("net_mf_amount") / unit, 2).alias("net_amount"), round_to(c("net_mf_vol") / vol_unit, 2).alias("net_vol")
    )


# ------------------------------------------------------------------------------------------- reversal

# Fixed values.  (column, value if null, limit, weight): points grow below the limit.
BELOW = [
    ("rsi_14", 50, 35, 1.2), ("kdj_j", 50, 20, 0.6), ("williams_r_14", -50, -80, 0.15), ("bb_percent_b", 0.5, 0.10, 50),
    ("price_position_52w", 0.5, 0.20, 40), ("close_position_in_range", 50, 20, 0.2),
]
# (column, weight): points for the size of a negative value.
NEGATIVE = [
    ("return_lag_1", 50), ("return_lag_2", 30), ("return_lag_3", 20), ("price_roc_5", 20), ("price_roc_10", 15),
    ("price_roc_20", 10), ("price_momentum_5", 15), ("price_momentum_10", 10), ("price_momentum_20", 8),
    ("trend_strength", 5), ("macd_histogram", 5),
]
# (column, limit, points): points when above the limit.
ABOVE = [
    ("adx_14", 25, 2), ("vol_percentile", 0.80, 5), ("volume_ratio", 1.2, 3), ("volume_roc_5", 0, 2), ("cmf_20", 0, 2),
    ("dv_ratio", 0, 1), ("turnover_rate", 0.5, 1),
]
# (left, right, points): points when left exceeds right.
OVER = [("macd_line", "macd_signal", 2), ("ema_5", "ema_10", 1), ("sma_5", "sma_10", 1)]
# (column, cap): the value itself, up to the cap, when positive.
CAPPED = [("atr", 5), ("hist_volatility_20", 5)]
FLAGS = [("volume_spike", 3), ("is_hammer", 6), ("is_doji", 3), ("is_shooting_star", -2)]
# (column, limit, weight): points inside [0, limit].
CHEAP = [("pe_ttm", 25, 0.2), ("pb", 2, 2), ("ps", 2, 1)]
# (column, points above -1, points otherwise)
MARKET = [("index_csi300_pct_chg", 1, -2), ("index_chinext_pct_chg", 1, -1), ("index_xin9_pct_chg", 1, -1)]


def reversal_score() -> Column:
    """Sum of oversold, momentum, trend, volatility, volume, candle, valuation and market points.

    A missing valuation leaves the score unknown, so such rows drop out at the threshold.
    """
    orz = lambda n, d=0: F.coalesce(c(n), F.lit(d).cast("double"))
    zero = F.lit(0.0)
    terms = [F.when(orz(n, d) < lim, (F.lit(float(lim)) - c(n)) * float(w)).otherwise(zero) for n, d, lim, w in BELOW]
    terms += [F.when(orz(n) < 0, F.abs(n) * float(w)).otherwise(zero) for n, w in NEGATIVE]
    terms += [F.when(orz(n) > lim, float(p)).otherwise(zero) for n, lim, p in ABOVE]
    terms += [F.when(orz(a) > orz(b), float(p)).otherwise(zero) for a, b, p in OVER]
    terms += [F.when(orz(n) > 0, F.least(F.lit(float(cap)), c(n))).otherwise(zero) for n, cap in CAPPED]
    terms += [F.when(c(n).cast("boolean"), float(p)).otherwise(zero) for n, p in FLAGS]
    terms += [F.when(orz(n).between(0, lim), (F.lit(float(lim)) - c(n)) * float(w)).otherwise(zero) for n, lim, w in CHEAP]
    terms += [F.when(orz(n) > -1, float(a)).otherwise(float(b)) for n, a, b in MARKET]
    terms.append(F.when(c("high_vol_regime") == 1, 3.0).otherwise(zero))
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def reversal_candidates(feats: DataFrame, limit: int = 50, min_score: float = 20.0, as_of: Column | None = None) -> DataFrame:
    """Highest reversal scores of the newest date among rows not already up and not overbought."""
    rows = _on(feats, as_of).where(
        (F.coalesce("close_pct", F.lit(0.0)) < 8) & (F.coalesce("rsi_14", F.lit(50.0)) < 55)
    )
    scored = rows.withColumn("_score", reversal_score()).where(c("_score") >= min_score)
    pattern = F.when(c("is_hammer"), "HAMMER").when(c("is_doji"), "DOJI").when(c("is_shooting_star"), "SHOOTING_STAR").otherwise("")
    r2 = lambda n, a: round_to(n, 2).alias(a)
    return _top(scored, limit, c("_score").desc(), "entity").select(
        "entity", "industry", "date", r2("_score", "score"), r2("rsi_14", "rsi"), r2("kdj_j", "kdj_j"),
        r2("bb_percent_b", "percent_b"), c("consecutive_days").alias("streak"), r2("price_position_52w", "pos_52w"),
        r2("pe_ttm", "pe_ttm"), r2("pb", "pb"), r2("volume_ratio", "vol_ratio"), pattern.alias("pattern"), r2("cmf_20", "cmf"),
        r2("index_csi300_pct_chg", "csi300"), r2("index_chinext_pct_chg", "chinext"), r2("index_xin9_pct_chg", "xin9"),
    )


# -------------------------------------------------------------------------------------------- sectors


def _recent(sectors: DataFrame, as_of: Column, days: int, n: int) -> DataFrame:
    return latest_rows(_since(sectors, as_of, days), n, "code")


def sector_momentum(sectors: DataFrame, as_of: Column, limit: int = 20, unit: float = 1e8, days: int = 5, within: int = 10) -> DataFrame:
    """Return over the last 5 sector days, for sectors that have all of them."""
    agg = _recent(sectors, as_of, within, days).groupBy("code", "name").agg(
        F.count(F.lit(1)).alias("_n"), F.avg("pct_change").alias("_avg"), F.sum("pct_change").alias("_sum"),
        F.avg("up_num").alias("_up"), F.avg("down_num").alias("_down"), F.avg("turnover_rate").alias("_turn"),
        F.max("total_mv").alias("_mv"),
    )
    best = _top(agg.where(c("_n") == days), limit, c("_sum").desc(), "code")
    return best.select(
        "code", "name", round_to("_avg", 2).alias("avg_pct_change"), round_to("_sum", 2).alias("total_return"),
        round_to("_up", 0).alias("avg_up"), round_to("_down", 0).alias("avg_down"), round_to("_turn", 2).alias("avg_turnover"),
        round_to(c("_mv") / unit, 2).alias("latest_mv"),
    )


def sector_acceleration(sectors: DataFrame, as_of: Column, limit: int = 20, min_net_up: float = 5, within: int = 10) -> DataFrame:
    """The last 3 sector days against the 3 before."""
    net = c("up_num") - c("down_num")
    agg = _recent(sectors, as_of, within, 6).groupBy("code", "name").agg(
        F.avg(F.when(c("rn") <= 3, c("pct_change"))).alias("_now"),
        F.avg(F.when(c("rn") > 3, c("pct_change"))).alias("_before"),
        F.avg(F.when(c("rn") <= 3, net)).alias("_net"),
        F.max(F.when(c("rn") == 1, c("pct_change"))).alias("_last"),
    )
    gain = c("_now") - c("_before")
    best = _top(agg.where((gain > 0) & (c("_now") > 0) & (c("_net") > min_net_up)), limit, gain.desc(), "code")
    return best.select(
        "code", "name", round_to("_last", 2).alias("today_pct"), round_to("_now", 2).alias("avg_recent"),
        round_to("_before", 2).alias("avg_prev"), round_to(gain, 2).alias("acceleration"), round_to("_net", 0).alias("net_up"),
    )


def strong_leaders(sectors: DataFrame, limit: int = 20, min_leading: float = 3.0, as_of: Column | None = None) -> DataFrame:
    """Rising sectors of the newest date with a strong leading member."""
    rows = _on(sectors, as_of).where(
        (c("leading_pct") > min_leading) & (c("pct_change") > 0) & (c("up_num") > c("down_num"))
    )
    share = ratio(c("up_num") * 100.0, (c("up_num") + c("down_num")).cast("double"))
    return _top(rows, limit, c("leading_pct").desc(), c("pct_change").desc(), "code").select(
        "code", "name", "pct_change", "leading_code", "leading_pct", "up_num", "down_num",
        round_to(share, 1).alias("pct_up"), "turnover_rate",
    )


def most_rising(sectors: DataFrame, limit: int = 20, as_of: Column | None = None) -> DataFrame:
    """Sectors of the newest date by share of rising members (the second vendor's form)."""
    share = ratio(c("up_num") * 100.0, (c("up_num") + c("down_num")).cast("double"))
    rows = _on(sectors, as_of).where((c("pct_change") > 0) & (c("up_num") > c("down_num")))
    return _top(rows, limit, c("up_num").desc(), c("pct_change").desc(), "code").select(
        "code", "name", round_to("pct_change", 2).alias("pct_change"), "up_num", "down_num", "limit_up_num",
        round_to(share, 1).alias("pct_up"), "turnover_rate", "vol_ratio",
    )


def volume_breakout(
    sectors: DataFrame, as_of: Column, limit: int = 20, factor: float = 1.5, within: int = 30, extra: Sequence[str] = ()
) -> DataFrame:
    """Newest day's turnover against the mean of the 20 sector days before it; ``extra`` shows further columns (the second
    vendor's ``vol_ratio``)."""
    mean = F.avg("turnover_rate").over(preceding(20, "code"))
    rows = latest_rows(_since(sectors, as_of, within).withColumn("_mean", mean), 1, "code").where(
        (c("pct_change") > 0) & (c("turnover_rate") > c("_mean") * factor)
    )
    times = ratio(c("turnover_rate"), c("_mean"))
    return _top(rows, limit, times.desc(), c("pct_change").desc(), "code").select(
        "code", "name", round_to("pct_change", 2).alias("pct_change"), round_to("turnover_rate", 2).alias("today_turnover"),
        round_to("_mean", 2).alias("avg_turnover_20d"), round_to(times, 2).alias("turnover_vs_avg"), *[round_to(n, 2).alias(n) for n in extra],
    )


def consistent_winners(sectors: DataFrame, as_of: Column, limit: int = 20, min_days: int = 8, share: float = 0.6, within: int = 15) -> DataFrame:
    """Sectors that rose on at least 60 % of their last 10 days."""
    up = F.count_if(c("pct_change") > 0)
    agg = _recent(sectors, as_of, within, 10).groupBy("code", "name").agg(
        F.count(F.lit(1)).alias("trading_days"), up.alias("positive_days"),
        F.avg("pct_change").alias("_avg"), F.sum("pct_change").alias("_sum"),
    )
    rate = c("positive_days") / c("trading_days")
    best = _top(agg.where((c("trading_days") >= min_days) & (rate >= share)), limit, rate.desc(), c("_sum").desc(), "code")
    return best.select(
        "code", "name", "trading_days", "positive_days", round_to(rate * 100, 1).alias("win_rate_pct"),
        round_to("_avg", 2).alias("avg_daily_change"), round_to("_sum", 2).alias("cumulative_return"),
    )


# Weight of (5-day return, last day, net risers), then of the vendor's own terms.
WEIGHTS_LEADING = {"base": (2, 3, 0.1), "leading_pct": (1, 0), "turnover": 5}
WEIGHTS_LIMIT_UP = {"base": (2, 3, 0.1), "limit_up_num": (2, 0), "vol_ratio": (2, 1), "turnover": 5}


def sector_composite(sectors: DataFrame, as_of: Column, weights: dict = WEIGHTS_LEADING, limit: int = 30, within: int = 10) -> DataFrame:
    """Weighted score of momentum, breadth, turnover and the vendor's extra columns."""
    extra = [k for k in weights if k not in ("base", "turnover")]
    agg = _recent(sectors, as_of, within, 5).groupBy("code", "name").agg(
        F.sum("pct_change").alias("_sum"), F.avg("turnover_rate").alias("_turn"),
        F.avg(c("up_num") - c("down_num")).alias("_net"),
        F.max(F.when(c("rn") == 1, c("pct_change"))).alias("_last"),
        *[F.max(F.when(c("rn") == 1, c(k))).alias(f"_{k}") for k in extra],
    )
    a, b, n = weights["base"]
    score = c("_sum") * a + c("_last") * b + c("_net") * n + (c("_turn") - 1.0) * weights["turnover"]
    for k in extra:
        w, missing = weights[k]
        score = score + F.coalesce(c(f"_{k}").cast("double"), F.lit(float(missing))) * w
    best = _top(agg.where((c("_sum") > 0) & (c("_net") > 0)).withColumn("_score", score), limit, c("_score").desc(), "code")
    return best.select(
        "code", "name", round_to("_last", 2).alias("today_pct"), round_to("_sum", 2).alias("return_5d"),
        round_to("_turn", 2).alias("avg_turnover"), round_to("_net", 0).alias("avg_net_up"),
        *[round_to(f"_{k}", 2).alias(k) for k in extra], round_to("_score", 2).alias("composite_score"),
    )


def rising_constituents(
    sectors: DataFrame, members: DataFrame, bars: DataFrame, top: int = 10, min_pct: float = 2.0, vol_unit: float = 1e6,
    as_of: Column | None = None,
) -> DataFrame:
    """Rising members of the strongest sectors, each member with its own newest bar."""
    strong = _on(sectors, as_of).where((c("pct_change") > min_pct) & (c("up_num") > c("down_num")))
    best = _top(strong, top, c("pct_change").desc(), "code").select("code")
    mine = members.join(best, "code", "left_semi")
    last = top_n(bars.join(mine.select("entity"), "entity", "left_semi"), "entity", [c("date").desc()], 1)
    return mine.join(last, "entity").where(c("pct_chg") > 0).select(
        "code", "entity", "name", round_to("pct_chg", 2).alias("pct_change"), round_to("close", 2).alias("close_price"),
        round_to(c("volume") / vol_unit, 6).alias("vol_millions"),
    )


# --------------------------------------------------------------------------------------------- market


def market_sentiment(feats: DataFrame, date: Column) -> DataFrame:
    """Means over all entities on one date."""
    return feats.where(c("date") == date).agg(
        F.count(F.lit(1)).alias("stocks"),
        round_to(F.avg("close_pct"), 4).alias("avg_close"),
        round_to(F.avg("price_momentum_5"), 4).alias("avg_momentum"),
        round_to(F.avg("rsi_14"), 2).alias("avg_rsi"),
        round_to(F.avg("volume_ratio"), 4).alias("avg_vol_ratio"),
        round_to(F.avg("index_csi300_pct_chg"), 4).alias("csi300_chg"),
    )


def momentum_leaders(feats: DataFrame, date: Column, bullish: bool = True, limit: int = 20) -> DataFrame:
    order = c("price_momentum_5").desc() if bullish else c("price_momentum_5").asc()
    rows = feats.where((c("date") == date) & c("price_momentum_5").isNotNull())
    return _top(rows, limit, order, "entity").select(
        "entity", round_to("close_pct", 2).alias("close_pct"), round_to("price_momentum_5", 4).alias("momentum_5d"),
        round_to("volume_ratio", 2).alias("vol_ratio"), round_to("ema_5", 2).alias("ema_5"), round_to("rsi_14", 1).alias("rsi"),
    )


def trading_report(preds: DataFrame, dim: DataFrame, date: Column, min_confidence: float = 0.6, limit: int = 50) -> DataFrame:
    """Confident predictions of a date by size of the predicted return."""
    rows = preds.where((c("date") == date) & (c("confidence") >= min_confidence)).join(
        dim.select("entity", "name", "industry"), "entity", "left"
    )
    best = _top(rows, limit, F.abs("predicted_return").desc(), c("confidence").desc(), "entity")
    return best.select(
        "entity", "name", "industry", "predicted_return", "confidence",
        F.when(c("predicted_direction"), "BUY").otherwise("SELL").alias("signal"), "date", "model_version",
    )


def prediction_overview(preds: DataFrame) -> DataFrame:
    return preds.agg(
        F.max("date").alias("latest_date"), F.count(F.lit(1)).alias("predictions"),
        F.count_distinct("entity").alias("entities"), F.avg("confidence").alias("avg_confidence"),
    )


def best_label_rows(feats: DataFrame, limit: int = 50) -> DataFrame:
    """Each entity's row with the highest next-day return (then volume), and the best of those."""
    order = [c("next_day_return").desc(), c("volume").desc(), c("date")]
    rows = feats.where(c("next_day_return").isNotNull())
    best = top_n(rows, "entity", order, 1)
    return best.orderBy(c("next_day_return").desc(), c("volume").desc(), "entity").limit(limit).select(
        "entity", "date", "volume", "ema_5", "rsi_14", "bb_bandwidth", "next_day_return"
    )
