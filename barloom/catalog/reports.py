"""Reports and the wide feature table."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from barloom.catalog.base import REGISTRY, over, query
from barloom.catalog.features import LABELS
from barloom.operators.price import add_labels
from barloom.catalog.ingest import scratch
from barloom.plans import features as ft
from barloom.plans import increment as inc
from barloom.plans import reports as rp
from barloom.operators.context import VALUATION_COLUMNS
from barloom.session import settle, settle_by
from barloom.sources import panel

c = F.col
W = over()
KEYS = ["entity", "date"]

# ------------------------------------------------------------------------------------ feature table

_F4 = {f"ema_{n}" for n in (5, 10, 20, 30, 60)} | {f"sma_{n}" for n in (5, 10, 20)} | {
    "macd_line", "macd_signal", "macd_histogram", "macd_weekly_line", "macd_weekly_signal", "macd_monthly_line", "macd_monthly_signal",
    "bb_upper", "bb_middle", "bb_lower", "atr", "volatility_5", "volatility_20", "hist_volatility_20", "total_mv", "circ_mv", "net_mf_amount",
}

# Query -> the columns of the table its SQL gives, each over bars.
_COLUMNS: dict[str, list[str]] = {
    "calendar_features": ["month", "weekday", "quarter", "week_no"],
    "close_returns": ["open_pct", "high_pct", "low_pct", "close_pct"],
    "intraday_moves": ["high_from_open_pct", "low_from_open_pct", "close_from_open_pct", "intraday_range_pct", "close_position_in_range"],
    "opening_gaps": ["overnight_gap", "gap_pct"],
    "candle_sizes": ["body_size", "upper_shadow", "lower_shadow"],
    "momentum": [f"{p}{n}" for n in (5, 10, 20) for p in ("price_momentum_", "price_roc_")],
    "lag_returns": ["return_lag_1", "return_lag_2", "return_lag_3"],
    "ema": [f"ema_{n}" for n in (5, 10, 20, 30, 60)],
    "sma": ["sma_5", "sma_10", "sma_20"],
    "macd": ["macd_line", "macd_signal", "macd_histogram"],
    "macd_long": ["macd_weekly_line", "macd_weekly_signal", "macd_monthly_line", "macd_monthly_signal"],
    "rsi": ["rsi_14"],
    "kdj": ["kdj_k", "kdj_d", "kdj_j"],
    "williams_r": ["williams_r_14"],
    "bollinger": ["bb_upper", "bb_middle", "bb_lower", "bb_bandwidth", "bb_percent_b"],
    "atr": ["atr"],
    "volatility": ["volatility_5", "volatility_20", "hist_volatility_20"],
    "year_range": ["price_position_52w", "price_vs_52w_high"],
    "volatility_regime": ["vol_percentile", "high_vol_regime"],
    "adx": ["adx_14"],
    "aroon": ["aroon_up_25", "aroon_down_25"],
    "candle_patterns": ["is_doji", "is_hammer", "is_shooting_star"],
    "asi": ["asi"],
    "obv": ["obv"],
    "volume_features": ["volume_ratio", "volume_roc_5", "volume_spike", "volume_accel_5d"],
    "vwap_distance": ["vwap_distance_pct"],
    "cmf": ["cmf_20"],
    "flow_features": ["net_mf_vol", "net_mf_amount", "smart_money_ratio", "large_order_flow"],
    "valuation_features": list(VALUATION_COLUMNS),
    "valuation_position": ["pe_percentile_52w"],
    "labels": ["next_day_return", "next_day_direction", "next_3day_return", "next_3day_direction"],
    "industry_context": ["industry", "industry_avg_return", "industry_momentum_5d", "stock_vs_industry"],
    "industry_momentum": ["industry_momentum"],
    "sector_vs_market": ["sector_momentum_vs_market"],
    "index_context": [f"{k}_{v}" for k in ft.INDEX_CODES for v in ("pct_chg", "vs_ma5_pct", "vs_ma20_pct")],
}


def _index_name(n: str) -> str:
    code = n.split("_")[0]
    return (("fx_" if code == "usdcnh" else "index_") + n) if code in ft.INDEX_CODES else n


def _kind(n: str) -> str:
    if n in ("industry", "act_ent_type"):
        return ":s"
    if n == "asi":
        return ":f2"
    if n.startswith("is_") or n.endswith("direction") or n in ("high_vol_regime", "volume_spike", "consecutive_days", "consecutive_up_days"):
        return ":f0"
    if n in ("month", "weekday", "quarter", "week_no"):
        return ":i"
    return ":f4" if n in _F4 else ""


_NAMES = [_index_name(n) for cols in _COLUMNS.values() for n in cols] + ["consecutive_days", "consecutive_up_days", "trend_strength", "act_ent_type"]
FEATURE_OUT = "entity:i date:d volume amount:f4 " + " ".join(n + _kind(n) for n in _NAMES)


def _feature_sql() -> str:
    picks, joins = [], []
    for i, (name, cols) in enumerate(_COLUMNS.items()):
        body = REGISTRY[name].body.replace("rbars", "bars")
        joins.append(f"JOIN ({body}) p{i} ON p{i}.entity = b.entity AND p{i}.date = b.date")
        picks += [f"p{i}.{n} AS {_index_name(n)}" for n in cols]
    for view, name in (("streak", "consecutive_days"), ("streak_capped", "consecutive_up_days")):
        body = REGISTRY[view].body.replace("ubars", "bars")
        joins.append(f"JOIN ({body}) {view} ON {view}.entity = b.entity AND {view}.date = b.date")
        picks.append(f"{view}.streak AS {name}")
    return f"""SELECT b.entity, b.date, b.volume, b.amount, {', '.join(picks)}, adx_14 AS trend_strength, coalesce(o.act_ent_type, 'UNKNOWN') AS act_ent_type
 FROM (SELECT *, row_number() {W} AS rn FROM bars) b JOIN dim o ON o.entity = b.entity {' '.join(joins)} WHERE b.rn >= 60"""


FEATURE_VIEWS = "bars prevs rets dim idx flows val"


def feature_rows(t):
    """The table from stored bars: they are aggregated once with flows and valuation, laid out by entity and date, and
    then serve the windows (no further shuffle or sort) and every context series."""
    t = t.with_stored_bars()
    return ft.build_features(t.narrow_rows(), t.members(), **series_of(t))


def series_of(t) -> dict:
    """Index bars and the statistics of industries, from one pass over the bars, for ``build_features``."""
    facts = settle(ft.group_facts(t.bars(), t.places().withColumnRenamed("n_name", "industry"), ("industry", "r_regionkey")))
    return {"index_bars": t.index_of(facts), "facts": facts, "momentum_index": "chinext", "late": t.value_columns()}


@query("feature_table", FEATURE_OUT, "FP-01 and all of F-*, L-*", FEATURE_VIEWS, _feature_sql())
def _(t):
    return feature_rows(t)


# The second composition: variant query -> (column of it, name in the composition, neutral constant).
_VARIANTS: dict[str, list[tuple[str, str, float]]] = {
    "ema_relative": [("ema_5", "ema_5", 0), ("ema_20", "ema_20", 0)],
    "sma_relative": [("sma_5", "sma_5", 0), ("sma_20", "sma_20", 0)],
    "macd_relative": [("macd_line", "macd_line", 0), ("macd_signal", "macd_signal", 0), ("macd_histogram", "macd_histogram", 0)],
    "bollinger_relative": [("bb_upper", "bb_upper", 0), ("bb_lower", "bb_lower", 0), ("bb_bandwidth", "bb_bandwidth", 0)],
    "atr_relative": [("atr_pct", "atr_pct", 0)],
    "year_range_partial": [("price_position_52w", "price_position_52w", 0.5)],
    "adx_plain": [("adx_14", "adx_14", 25)],
    "aroon_oldest": [("aroon_up_25", "aroon_up_25", 0), ("aroon_down_25", "aroon_down_25", 0)],
    "volume_vs_mean": [("volume_roc_mean", "volume_roc_mean", 0)],
    "rsi": [("rsi_14", "rsi_14", 50)],
    "kdj": [("kdj_k", "kdj_k", 50), ("kdj_d", "kdj_d", 50), ("kdj_j", "kdj_j", 50)],
    "williams_r": [("williams_r_14", "williams_r_14", -50)],
    "momentum": [("price_momentum_20", "price_momentum_20", 0), ("price_roc_5", "price_roc_5", 0)],
}


def _variant_sql() -> str:
    joins = [f"JOIN ({REGISTRY[n].body.replace('rbars', 'bars').replace('ubars', 'bars')}) {n} ON {n}.entity = b.entity AND {n}.date = b.date" for n in _VARIANTS]
    picks = [f"coalesce({n}.{x}, {neutral}) AS {name}" for n, cols in _VARIANTS.items() for x, name, neutral in cols]
    return f"SELECT b.entity, b.date, {', '.join(picks)}, 0 AS asi, 0 AS net_mf_amount FROM (SELECT *, row_number() {W} AS rn FROM bars) b {' '.join(joins)} WHERE b.rn >= 60"


@query("feature_table_on_the_fly", "entity:i date:d " + " ".join(name for cols in _VARIANTS.values() for _, name, _ in cols) + " asi net_mf_amount", "FP-02 F-50", "bars", _variant_sql())
def _(t):
    return ft.features_on_the_fly(t.bars())


@query("feature_table_increment", FEATURE_OUT, "FP-01 INC-03", FEATURE_VIEWS,
       f"SELECT * FROM ({_feature_sql()}) WHERE date >= (SELECT date_trunc('year', max(date)) FROM lines)")
def _(t):
    """The newest year's rows from a stored panel: that year's bars and the state of the year before are read."""
    panel_path, states = scratch(t.spark, "panel"), scratch(t.spark, "states")
    # What a row's valuation is made of is stored; the columns themselves are made of the rows that are read.
    panel.write_panel(t.daily().drop("buy_amount", "sell_amount"), panel_path)
    first = t.table("lineitem").agg(F.trunc(F.max(c("l_shipdate").cast("date")), "year")).first()[0]
    inc.write_state_before(t.spark, panel_path, states, first)
    rows = settle_by(inc.rows_since(t.spark, panel_path, states, first), "entity", "date", t.table("lineitem").count())
    t = t.on(rows)
    return inc.features_since(t.narrow_rows(), first, dim=t.members(), **series_of(t))


# --------------------------------------------------------------------------------------- flow reports

U = 10_000.0
_ASOF = "(SELECT max(date) FROM lines)"


@query("report_top_inflow", "code:s name:s net_5d:f2 pct_sum_5d:f2 pct_avg_5d:f2", "RP-01", "sflows",
       f"""SELECT code, name, n5 / 1e4 AS net_5d, s5 AS pct_sum_5d, a5 AS pct_avg_5d FROM (
 SELECT code, name, sum(CASE WHEN date >= {_ASOF} - 4 THEN net_amount END) AS n5, sum(CASE WHEN date >= {_ASOF} - 4 THEN pct_change END) AS s5,
  avg(CASE WHEN date >= {_ASOF} - 4 THEN pct_change END) AS a5, count(*) FILTER (WHERE date >= {_ASOF} - 4) AS k FROM sflows WHERE date >= {_ASOF} - 10 GROUP BY code, name)
 WHERE k >= 2 ORDER BY n5 DESC, code LIMIT 20""")
def _(t):
    t = t.recent(10)
    return rp.top_inflow(t.sector_flows(), F.lit(t.as_of), unit=U, min_days=2)


@query("report_accelerating_inflow", "code:s name:s net_last:f2 net_prev:f2 acceleration:f2", "RP-02", "sflows",
       f"""SELECT code, name, a / 1e4 AS net_last, b / 1e4 AS net_prev, (a - coalesce(b, 0)) / 1e4 AS acceleration FROM (
 SELECT code, name, sum(CASE WHEN date >= {_ASOF} - 2 THEN net_amount END) AS a, sum(CASE WHEN date BETWEEN {_ASOF} - 5 AND {_ASOF} - 3 THEN net_amount END) AS b
 FROM sflows WHERE date >= {_ASOF} - 12 GROUP BY code, name) WHERE a > 0 AND a > coalesce(b, 0) ORDER BY a - coalesce(b, 0) DESC, code LIMIT 20""")
def _(t):
    t = t.recent(12)
    return rp.accelerating_inflow(t.sector_flows(), F.lit(t.as_of), unit=U)


@query("report_strong_day", "code:s name:s lead_stock:i close_price:f3 pct_change:f2 net_amount:f2", "RP-03", "sflows",
       f"""SELECT code, name, lead_stock, close_price, pct_change, net_amount / 1e4 AS net_amount FROM sflows WHERE date = {_ASOF} AND pct_change > 1.5 AND net_amount > 0
 ORDER BY sflows.net_amount DESC, pct_change DESC, code LIMIT 20""")
def _(t):
    t = t.recent(0)
    return rp.strong_day(t.sector_flows(), unit=U, as_of=F.lit(t.as_of))


@query("report_consistent_inflow", "code:s name:s pos_days:i days:i net_sum:f2", "RP-04", "sflows",
       f"""SELECT code, name, pos_days, days, s / 1e4 AS net_sum FROM (SELECT code, name, count(*) AS days, count_if(net_amount > 0) AS pos_days, sum(net_amount) AS s
 FROM sflows WHERE date >= {_ASOF} - 7 GROUP BY code, name) WHERE days >= 3 AND pos_days >= 3 ORDER BY s DESC, code LIMIT 20""")
def _(t):
    t = t.recent(7)
    return rp.consistent_inflow(t.sector_flows(), F.lit(t.as_of), unit=U)


@query("report_industry_inflow", "code:s name:s net_amount:f2 net_buy_amount:f2 net_sell_amount:f2", "RP-05 RP-06", "sflows",
       f"""SELECT code, name, net_amount / 1e4 AS net_amount, net_buy_amount / 1e4 AS net_buy_amount, net_sell_amount / 1e4 AS net_sell_amount FROM sflows
 WHERE date = {_ASOF} ORDER BY sflows.net_amount DESC, code LIMIT 20""")
def _(t):
    t = t.recent(0)
    return rp.industry_inflow(t.sector_flows(), unit=U, as_of=F.lit(t.as_of))


@query("report_entity_inflow", "entity:i net_amount:f2 net_vol:f2", "RP-07", "flows",
       "SELECT entity, net_mf_amount / 1e4 AS net_amount, net_mf_vol AS net_vol FROM flows WHERE date = (SELECT max(date) FROM flows) ORDER BY net_mf_amount DESC, entity LIMIT 30")
def _(t):
    t = t.recent(0, warm=0)
    return rp.entity_inflow(t.flows(), unit=U, vol_unit=1.0, as_of=F.lit(t.as_of))


# ------------------------------------------------------------------------------------------- reversal

# One row per rule: column, kind, default, limit, points.  under/over/negative/capped/flag read a null as the default, cheap
# makes the score unknown, market gives its points or takes as many as its limit says.
_RULES = """('rsi_14','under',50,35,1.2),('kdj_j','under',50,20,0.6),('williams_r_14','under',-50,-80,0.15),('bb_percent_b','under',0.5,0.1,50),
 ('price_position_52w','under',0.5,0.2,40),('close_position_in_range','under',50,20,0.2),
 ('return_lag_1','negative',0,0,50),('return_lag_2','negative',0,0,30),('return_lag_3','negative',0,0,20),('price_roc_5','negative',0,0,20),('price_roc_10','negative',0,0,15),
 ('price_roc_20','negative',0,0,10),('price_momentum_5','negative',0,0,15),('price_momentum_10','negative',0,0,10),('price_momentum_20','negative',0,0,8),
 ('trend_strength','negative',0,0,5),('macd_histogram','negative',0,0,5),
 ('adx_14','over',0,25,2),('vol_percentile','over',0,0.8,5),('volume_ratio','over',0,1.2,3),('volume_roc_5','over',0,0,2),('cmf_20','over',0,0,2),('dv_ratio','over',0,0,1),
 ('turnover_rate','over',0,0.5,1),('macd_gap','over',0,0,2),('ema_gap','over',0,0,1),('sma_gap','over',0,0,1),
 ('atr','capped',0,5,1),('hist_volatility_20','capped',0,5,1),
 ('spike','flag',0,1,3),('hammer','flag',0,1,6),('doji','flag',0,1,3),('shooting','flag',0,1,-2),('regime','flag',0,1,3),
 ('pe_ttm','cheap',0,25,0.2),('pb','cheap',0,2,2),('ps','cheap',0,2,1),
 ('index_csi300_pct_chg','market',0,2,1),('index_chinext_pct_chg','market',0,1,1),('index_xin9_pct_chg','market',0,1,1)"""
_POINTS = """CASE kind WHEN 'under' THEN CASE WHEN coalesce(x, missing) < lim THEN (lim - x) * points ELSE 0 END WHEN 'negative' THEN CASE WHEN coalesce(x, 0) < 0 THEN -x * points ELSE 0 END
 WHEN 'over' THEN CASE WHEN coalesce(x, missing) > lim THEN points ELSE 0 END WHEN 'capped' THEN CASE WHEN coalesce(x, 0) > 0 THEN least(lim, x) ELSE 0 END
 WHEN 'flag' THEN CASE WHEN x = 1 THEN points ELSE 0 END WHEN 'cheap' THEN CASE WHEN coalesce(x, 0) BETWEEN 0 AND lim THEN (lim - x) * points ELSE 0 END
 WHEN 'market' THEN CASE WHEN coalesce(x, 0) > -1 THEN points ELSE -lim END END"""


def _score_sql() -> str:
    """(entity, score) of the newest date's rows: the rules joined with the unpivoted features and summed."""
    plain = [n for n in re.findall(r"\('(\w+)'", _RULES) if n not in ("macd_gap", "ema_gap", "sma_gap", "spike", "hammer", "doji", "shooting", "regime")]
    made = [f"CAST({n} AS DOUBLE) AS {n}" for n in plain]
    made += [f"coalesce({a}, 0) - coalesce({b}, 0) AS {n}" for n, a, b in (("macd_gap", "macd_line", "macd_signal"), ("ema_gap", "ema_5", "ema_10"), ("sma_gap", "sma_5", "sma_10"))]
    flags = (("spike", "volume_spike"), ("hammer", "is_hammer"), ("doji", "is_doji"), ("shooting", "is_shooting_star"), ("regime", "high_vol_regime"))
    made += [f"CAST({b} AS DOUBLE) AS {n}" for n, b in flags]
    names = [x.rpartition(" AS ")[2] for x in made]
    return f"""SELECT entity, CASE WHEN count(p) = count(*) THEN sum(p) END AS score FROM (
 SELECT entity, {_POINTS} AS p FROM (FROM (SELECT entity, {', '.join(made)} FROM newest) UNPIVOT INCLUDE NULLS (x FOR col IN ({', '.join(names)})))
 JOIN (VALUES {_RULES}) r(col, kind, missing, lim, points) USING (col)) GROUP BY entity"""


@query("report_reversal",
       "entity:i industry:s date:d score:f2 rsi:f2 kdj_j:f2 percent_b:f2 streak:f0 pos_52w:f2 pe_ttm:f2 pb:f2 vol_ratio:f2 pattern:s cmf:f2 csi300:f2 chinext:f2 xin9:f2",
       "RP-08", FEATURE_VIEWS,
       f"""WITH f AS ({_feature_sql()}), newest AS (SELECT * FROM f WHERE date = (SELECT max(date) FROM f) AND coalesce(close_pct, 0) < 8 AND coalesce(rsi_14, 50) < 55),
 s AS (SELECT * FROM newest JOIN ({_score_sql()}) USING (entity))
 SELECT entity, industry, date, score, rsi_14 AS rsi, kdj_j, bb_percent_b AS percent_b, consecutive_days AS streak, price_position_52w AS pos_52w, pe_ttm, pb, volume_ratio AS vol_ratio,
 CASE WHEN is_hammer THEN 'HAMMER' WHEN is_doji THEN 'DOJI' WHEN is_shooting_star THEN 'SHOOTING_STAR' ELSE '' END AS pattern, cmf_20 AS cmf,
 index_csi300_pct_chg AS csi300, index_chinext_pct_chg AS chinext, index_xin9_pct_chg AS xin9 FROM s WHERE score >= 20 ORDER BY s.score DESC, entity LIMIT 50""")
def _(t):
    feats, as_of = newest_features(t)
    return rp.reversal_candidates(feats, as_of=as_of)


# --------------------------------------------------------------------------------------------- sectors

_SEC = "(SELECT max(date) FROM lines)"


def _recent(days: int) -> str:
    return f"(SELECT *, row_number() OVER (PARTITION BY code ORDER BY date DESC) AS rn FROM sectors WHERE date >= {_SEC} - {days})"


@query("report_sector_momentum", "code:s name:s avg_pct_change:f2 total_return:f2 avg_up:f0 avg_down:f0 avg_turnover:f2 latest_mv:f2", "RP-09 WIN-01 AG-04", "sectors",
       f"""SELECT code, name, avg(pct_change) AS avg_pct_change, sum(pct_change) AS total_return, avg(up_num) AS avg_up, avg(down_num) AS avg_down, avg(turnover_rate) AS avg_turnover, max(total_mv) / 1e4 AS latest_mv
 FROM {_recent(10)} WHERE rn <= 5 GROUP BY code, name HAVING count(*) = 5 ORDER BY sum(pct_change) DESC, code LIMIT 20""")
def _(t):
    t = t.recent(10)
    return rp.sector_momentum(t.sectors(), F.lit(t.as_of), unit=U)


@query("report_sector_acceleration", "code:s name:s today_pct:f2 avg_recent:f2 avg_prev:f2 acceleration:f2 net_up:f0", "RP-10", "sectors",
       f"""SELECT code, name, t AS today_pct, a AS avg_recent, b AS avg_prev, a - b AS acceleration, n AS net_up FROM (
 SELECT code, name, avg(CASE WHEN rn <= 3 THEN pct_change END) AS a, avg(CASE WHEN rn BETWEEN 4 AND 6 THEN pct_change END) AS b, avg(CASE WHEN rn <= 3 THEN up_num - down_num END) AS n,
  max(CASE WHEN rn = 1 THEN pct_change END) AS t FROM {_recent(10)} WHERE rn <= 6 GROUP BY code, name) WHERE a > b AND a > 0 AND n > 0 ORDER BY a - b DESC, code LIMIT 20""")
def _(t):
    t = t.recent(10)
    return rp.sector_acceleration(t.sectors(), F.lit(t.as_of), min_net_up=0)


@query("report_strong_leaders", "code:s name:s pct_change:f4 leading_code:i leading_pct:f4 up_num:i down_num:i pct_up:f1 turnover_rate", "RP-11 JN-05", "sectors",
       f"""SELECT *, up_num * 100.0 / nullif(up_num + down_num, 0) AS pct_up FROM sectors WHERE date = {_SEC} AND leading_pct > 3 AND pct_change > 0 AND up_num > down_num
 ORDER BY leading_pct DESC, pct_change DESC, code LIMIT 20""")
def _(t):
    t = t.recent(0)
    return rp.strong_leaders(t.sectors(), as_of=F.lit(t.as_of))


@query("report_most_rising", "code:s name:s pct_change:f2 up_num:i down_num:i limit_up_num:i pct_up:f1 turnover_rate vol_ratio", "RP-11", "sectors",
       f"""SELECT *, up_num * 100.0 / nullif(up_num + down_num, 0) AS pct_up FROM sectors WHERE date = {_SEC} AND pct_change > 0 AND up_num > down_num
 ORDER BY up_num DESC, pct_change DESC, code LIMIT 20""")
def _(t):
    t = t.recent(0)
    return rp.most_rising(t.sectors(), as_of=F.lit(t.as_of))


_BREAKOUT = f"""SELECT code, name, pct_change, round(turnover_rate, 2) AS today_turnover, round(m, 2) AS avg_turnover_20d, round(turnover_rate / nullif(m, 0), 2) AS turnover_vs_avg,
 round(vol_ratio, 2) AS vol_ratio FROM (
 SELECT *, avg(turnover_rate) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS m, row_number() OVER (PARTITION BY code ORDER BY date DESC) AS rn
 FROM sectors WHERE date >= {_SEC} - 30) WHERE rn = 1 AND pct_change > 0 AND turnover_rate > m * 1.5 ORDER BY turnover_rate / m DESC, pct_change DESC, code LIMIT 20"""


@query("report_volume_breakout", "code:s name:s pct_change:f2 today_turnover:f2 avg_turnover_20d:f3 turnover_vs_avg:f3", "RP-12 WIN-05", "sectors", _BREAKOUT)
def _(t):
    t = t.recent(30)
    return rp.volume_breakout(t.sectors(), F.lit(t.as_of))


@query("report_volume_breakout_ratio", "code:s name:s pct_change:f2 today_turnover:f2 avg_turnover_20d:f3 turnover_vs_avg:f3 vol_ratio:f2", "RP-12", "sectors", _BREAKOUT)
def _(t):
    t = t.recent(30)
    return rp.volume_breakout(t.sectors(), F.lit(t.as_of), extra=("vol_ratio",))


@query("report_consistent_winners", "code:s name:s trading_days:i positive_days:i win_rate_pct:f1 avg_daily_change:f2 cumulative_return:f2", "RP-13 AG-04", "sectors",
       f"""SELECT code, name, count(*) AS trading_days, count_if(pct_change > 0) AS positive_days, count_if(pct_change > 0) / count(*) * 100 AS win_rate_pct, avg(pct_change) AS avg_daily_change, sum(pct_change) AS cumulative_return
 FROM {_recent(15)} WHERE rn <= 10 GROUP BY code, name HAVING count(*) >= 8 AND count_if(pct_change > 0) / count(*) >= 0.5 ORDER BY count_if(pct_change > 0) / count(*) DESC, sum(pct_change) DESC, code LIMIT 20""")
def _(t):
    t = t.recent(15)
    return rp.consistent_winners(t.sectors(), F.lit(t.as_of), share=0.5)


_STATS = f"""SELECT code, name, sum(pct_change) AS s, avg(turnover_rate) AS tr, avg(up_num - down_num) AS n, max(CASE WHEN rn = 1 THEN pct_change END) AS l, max(CASE WHEN rn = 1 THEN leading_pct END) AS lp,
 max(CASE WHEN rn = 1 THEN limit_up_num END) AS lu, max(CASE WHEN rn = 1 THEN vol_ratio END) AS vr FROM {_recent(10)} WHERE rn <= 5 GROUP BY code, name"""


@query("report_sector_composite", "code:s name:s today_pct:f2 return_5d:f2 avg_turnover:f2 avg_net_up:f0 leading_pct:f2 composite_score:f2", "RP-14", "sectors",
       f"""SELECT code, name, l AS today_pct, s AS return_5d, tr AS avg_turnover, n AS avg_net_up, lp AS leading_pct, x AS composite_score FROM (
 SELECT *, s * 2 + l * 3 + n * 0.1 + coalesce(lp, 0) + (tr - 1) * 5 AS x FROM ({_STATS})) WHERE s > 0 AND n > 0 ORDER BY x DESC, code LIMIT 30""")
def _(t):
    t = t.recent(10)
    return rp.sector_composite(t.sectors(), F.lit(t.as_of))


@query("report_sector_composite_limit_up", "code:s name:s today_pct:f2 return_5d:f2 avg_turnover:f2 avg_net_up:f0 limit_up_num:f0 vol_ratio:f2 composite_score:f2", "RP-14", "sectors",
       f"""SELECT code, name, l AS today_pct, s AS return_5d, tr AS avg_turnover, n AS avg_net_up, lu AS limit_up_num, vr AS vol_ratio, x AS composite_score FROM (
 SELECT *, s * 2 + l * 3 + n * 0.1 + coalesce(lu, 0) * 2 + (tr - 1) * 5 + coalesce(vr, 1) * 2 AS x FROM ({_STATS})) WHERE s > 0 AND n > 0 ORDER BY x DESC, code LIMIT 30""")
def _(t):
    t = t.recent(10)
    return rp.sector_composite(t.sectors(), F.lit(t.as_of), rp.WEIGHTS_LIMIT_UP)


@query("report_rising_constituents", "code:s entity:i name:s pct_change:f2 close_price:f3 vol_millions:f6", "RP-15 JN-13", "sectors rets dim",
       f"""WITH b AS (SELECT code FROM sectors WHERE date = {_SEC} AND pct_change > 2 AND up_num > down_num ORDER BY pct_change DESC, code LIMIT 10)
 SELECT d.industry AS code, r.entity, d.name, pct_chg AS pct_change, round(close, 2) AS close_price, volume / 1e6 AS vol_millions FROM dim d JOIN b ON b.code = d.industry JOIN (
 SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date DESC) AS rn FROM rets) r ON r.entity = d.entity AND rn = 1 WHERE pct_chg > 0""")
def _(t):
    members = t.members().select(c("industry").alias("code"), "entity", "name")
    now = t.recent(0)
    return rp.rising_constituents(now.sectors(), members, t.newest_returns(), as_of=F.lit(now.as_of))


# ---------------------------------------------------------------------------------------------- market

_DAY = "(SELECT max(date) FROM bars)"


def newest_features(t):
    """(features of the newest date, the date): only entities with a bar on it have their history read."""
    found = t.newest_features()
    if found is None:
        return feature_rows(t), t.newest_day()
    rows, near = found
    as_of = F.lit(near.as_of)
    return ft.build_features(rows, t.members(), near.index_bars(), momentum_index="chinext", min_date=as_of, peers=near.bars()), as_of


@query("report_market_sentiment", "stocks:i avg_close:f4 avg_momentum:f4 avg_rsi:f2 avg_vol_ratio:f4 csi300_chg:f4", "RP-16", FEATURE_VIEWS,
       f"""SELECT count(*) AS stocks, avg(close_pct) AS avg_close, avg(price_momentum_5) AS avg_momentum, avg(rsi_14) AS avg_rsi, avg(volume_ratio) AS avg_vol_ratio, avg(index_csi300_pct_chg) AS csi300_chg
 FROM ({_feature_sql()}) WHERE date = {_DAY}""")
def _(t):
    return rp.market_sentiment(*newest_features(t))


def _leaders_sql(order: str) -> str:
    return f"""SELECT entity, close_pct, price_momentum_5 AS momentum_5d, volume_ratio AS vol_ratio, ema_5, rsi_14 AS rsi FROM ({_feature_sql()}) WHERE date = {_DAY} AND price_momentum_5 IS NOT NULL
 ORDER BY price_momentum_5 {order}, entity LIMIT 20"""


_LEADERS = "entity:i close_pct:f2 momentum_5d:f4 vol_ratio:f2 ema_5:f2 rsi:f1"


@query("report_bullish", _LEADERS, "RP-17 SRT-01", FEATURE_VIEWS, _leaders_sql("DESC"))
def _(t):
    return rp.momentum_leaders(*newest_features(t))


@query("report_bearish", _LEADERS, "RP-17 SRT-01", FEATURE_VIEWS, _leaders_sql("ASC"))
def _(t):
    return rp.momentum_leaders(*newest_features(t), bullish=False)


@query("report_trading", "entity:i name:s industry:s predicted_return confidence signal:s date:d model_version:s", "RP-18 SRT-02 SNK-03", "preds dim",
       f"""SELECT p.*, d.name, d.industry, CASE WHEN predicted_direction THEN 'BUY' ELSE 'SELL' END AS signal FROM preds p LEFT JOIN dim d ON d.entity = p.entity
 WHERE date = (SELECT max(date) FROM preds) AND confidence >= 0.3 ORDER BY abs(predicted_return) DESC, confidence DESC, p.entity LIMIT 50""")
def _(t):
    return rp.trading_report(t.preds(), t.dim(), t.preds().agg(F.max("date")).scalar(), 0.3)


@query("report_prediction_overview", "latest_date:d predictions:i entities:i avg_confidence", "RP-19 AG-02", "preds",
       "SELECT max(date) AS latest_date, count(*) AS predictions, count(DISTINCT entity) AS entities, avg(confidence) AS avg_confidence FROM preds")
def _(t):
    return rp.prediction_overview(t.preds())


@query("report_best_labels", "entity:i date:d volume ema_5:f3 rsi_14 bb_bandwidth next_day_return", "RP-20 SRT-05", FEATURE_VIEWS,
       f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY next_day_return DESC, volume DESC, date) AS k FROM ({_feature_sql()}) WHERE next_day_return IS NOT NULL)
 WHERE k = 1 ORDER BY next_day_return DESC, volume DESC, entity LIMIT 50""")
def _(t):
    return rp.best_label_rows(feature_rows(t))


@query("labels_by_volume", "entity:i date:d next_day_return rank:i", "SRT-03", "bars",
       f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY volume DESC, entity) AS rank FROM ({LABELS})) WHERE rank <= 2")
def _(t):
    from barloom.operators.aggregates import top_n

    return top_n(add_labels(t.bars()), "date", [c("volume").desc(), c("entity")], 2)


