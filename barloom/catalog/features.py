"""Feature operators over the panel views."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from barloom.catalog.base import BY, DAYNO, REGISTRY, full, over, query
from barloom.operators import adjust, context, momentum, pattern, price, trend, volatility, volume
from barloom.operators.recurrence import linear_recurrences
from barloom.session import ensure_checkpoint_dir
from barloom.sources import panel
from barloom.sources.tables import day_number

c = F.col
W = over()
KEYS = ["entity", "date"]


def nz(a: str, b: str) -> str:
    """SQL division, null on zero."""
    return f"(({a}) / nullif({b}, 0))"


# ----------------------------------------------------------------------------------------- adjustment

_RATIO = "CASE WHEN abs(pre_close - lag(close) OVER (PARTITION BY entity ORDER BY date)) > 1e-4 THEN pre_close / lag(close) OVER (PARTITION BY entity ORDER BY date) ELSE 1.0 END"


@query("adjustment_ratio", "entity:i date:d close:f4 pre_close:f4 adj_ratio", "ADJ-01 WIN-02", "raw",
       f"SELECT *, {_RATIO} AS adj_ratio FROM raw")
def _(t):
    return adjust.add_adj_ratio(t.raw())


def _adjusted(frame: str) -> str:
    x = lambda n: f"round({n} * adj_factor * 100) / 100 AS {n}"
    # A fold keeps the order of the multiplications; a factor of exactly 1 must leave prices alone.
    fold = lambda end: f"list_reduce(list(eff) OVER ({BY} ROWS BETWEEN UNBOUNDED PRECEDING AND {end}), lambda a, b: a * b)"
    return f"""SELECT entity, date, adj_factor, {', '.join(x(n) for n in ('open', 'high', 'low', 'close'))}, volume FROM (
 SELECT *, {fold('UNBOUNDED FOLLOWING')} / coalesce({fold(frame)}, 1) AS adj_factor FROM (
  SELECT *, CASE WHEN abs(r - 1) > 1e-4 THEN r ELSE CAST(1 AS DOUBLE) END AS eff FROM (SELECT *, {_RATIO} AS r FROM raw)))"""


@query("back_adjust", "entity:i date:d adj_factor open:f2 high:f2 low:f2 close:f2 volume", "ADJ-02 WIN-08 FLT-10", "raw",
       _adjusted("1 PRECEDING"))
def _(t):
    return adjust.back_adjust(t.raw())


@query("back_adjust_textbook", "entity:i date:d adj_factor open:f2 high:f2 low:f2 close:f2 volume", "ADJ-02", "raw",
       _adjusted("CURRENT ROW"))
def _(t):
    return adjust.back_adjust(t.raw(), inclusive=False)


@query("needs_adjust", "entity:i", "ADJ-03", "raw",
       """SELECT DISTINCT entity FROM (SELECT *, lag(close) OVER (PARTITION BY entity ORDER BY date) AS p FROM raw)
 WHERE date >= (SELECT max(date) FROM raw) - 400 AND abs(pre_close - p) > 1e-4""")
def _(t):
    raw = t.raw()
    return adjust.needs_adjust(raw, raw.agg(F.max("date")).scalar(), days=400)


@query("readjusted", "entity:i date:d close:f2 volume", "ADJ-03 UPS-08", "raw",
       f"""SELECT a.entity, a.date, a.close + CASE WHEN n.entity IS NULL THEN 1 ELSE 0 END AS close, a.volume FROM ({_adjusted("1 PRECEDING")}) a LEFT JOIN (
 {REGISTRY["needs_adjust"].body}) n ON n.entity = a.entity""")
def _(t):
    """A stored panel whose closes are all off by one: entities with a recent break are computed anew, the others stay."""
    raw, path = t.with_stored_bars("open", "high", "low", "close", "volume").raw(), f"{ensure_checkpoint_dir(t.spark).rstrip('/')}/adjusted-{uuid.uuid4().hex}"
    panel.write_bucketed(adjust.back_adjust(raw).select(*KEYS, "open", "high", "low", "close", "volume", "adj_factor").withColumn("close", c("close") + 1), path)
    adjust.readjust_stored(raw, path, t.newest_day(), days=400)
    return t.spark.read.parquet(path)


@query("testing_rows", "entity:i date:d open:f2 high:f2 low:f2 close:f2 volume:f2 amount:f4 adj_factor:f4", "ADJ-04", "bars",
       f"""SELECT b.entity, b.date, CAST(round(open, 2) AS DECIMAL(10,2)) AS open, CAST(round(high, 2) AS DECIMAL(10,2)) AS high,
 CAST(round(low, 2) AS DECIMAL(10,2)) AS low, CAST(round(close, 2) AS DECIMAL(10,2)) AS close, CAST(volume AS DECIMAL(20,2)) AS volume,
 CAST(amount AS DECIMAL(20,4)) AS amount, CAST(coalesce(f, 1.0) AS DECIMAL(10,4)) AS adj_factor
 FROM bars b LEFT JOIN (SELECT entity, date, 1 + ({DAYNO} % 7) / 100.0 AS f FROM bars WHERE {DAYNO} % 3 = 0) x
 ON x.entity = b.entity AND x.date = b.date""")
def _(t):
    bars = t.bars()
    vendor = bars.where(day_number(c("date")) % 3 == 0).select(
        "entity", "date", (1 + (day_number(c("date")) % 7) / 100).alias("adj_factor")
    )
    return adjust.testing_rows(bars, vendor)


# -------------------------------------------------------------------------------- single-row and lags


@query("calendar_features", "entity:i date:d month:i weekday:i quarter:i week_no:i", "F-01", "bars",
       "SELECT *, month(date) AS month, isodow(date) - 1 AS weekday, quarter(date) AS quarter, weekofyear(date) AS week_no FROM bars")
def _(t):
    return price.add_calendar(t.bars())


@query("close_returns", "entity:i date:d open_pct high_pct low_pct close_pct", "F-02", "bars",
       f"""SELECT entity, date, (open - b) / b * 100 AS open_pct, (high - b) / b * 100 AS high_pct, (low - b) / b * 100 AS low_pct,
 (close - b) / b * 100 AS close_pct FROM (SELECT *, coalesce(lag(close) {W}, open) AS b FROM bars)""")
def _(t):
    return price.add_returns(t.bars())


@query("intraday_moves", "entity:s date:d high_from_open_pct low_from_open_pct close_from_open_pct intraday_range_pct close_position_in_range",
       "F-03 F-04", "rbars",
       """SELECT entity, date, (high - open) / open * 100 AS high_from_open_pct, (low - open) / open * 100 AS low_from_open_pct,
 (close - open) / open * 100 AS close_from_open_pct, (high - low) / open * 100 AS intraday_range_pct,
 CASE WHEN abs(high - low) > 1e-6 THEN (close - low) / (high - low) * 100 END AS close_position_in_range FROM rbars""")
def _(t):
    return price.add_intraday(t.region_bars())


@query("intraday_moves_unit", "entity:s date:d intraday_range_pct close_position_in_range", "F-03 F-04", "rbars",
       """SELECT entity, date, (high - low) / low * 100 AS intraday_range_pct,
 CASE WHEN high - low > 0 THEN (close - low) / (high - low) ELSE 0.5 END AS close_position_in_range FROM rbars""")
def _(t):
    return price.add_intraday(t.region_bars(), position="unit", range_base="low")


@query("opening_gaps", "entity:i date:d overnight_gap gap_pct", "F-18", "bars",
       f"SELECT entity, date, (open - p) / p * 100 AS overnight_gap, (open - p) / p * 100 AS gap_pct FROM (SELECT *, lag(close) {W} AS p FROM bars)")
def _(t):
    return price.add_gaps(t.bars())


@query("candle_sizes", "entity:s date:d body_size upper_shadow lower_shadow body_pct", "F-23", "rbars",
       """SELECT entity, date, abs(close - open) AS body_size, high - greatest(close, open) AS upper_shadow,
 least(close, open) - low AS lower_shadow, abs(close - open) / open * 100 AS body_pct FROM rbars""")
def _(t):
    df = price.add_candle_sizes(t.region_bars())
    return df.withColumn("body_pct", price.candle_size_columns("pct")["body_size"])


@query("momentum", "entity:i date:d price_momentum_5 price_momentum_10 price_momentum_20 price_roc_5 price_roc_10 price_roc_20", "F-16", "bars",
       "SELECT entity, date, " + ", ".join(f"close / lag(close, {n}) {W} - 1 AS {p}{n}" for n in (5, 10, 20) for p in ("price_momentum_", "price_roc_")) + " FROM bars")
def _(t):
    return price.add_momentum(t.bars())


@query("lag_returns", "entity:i date:d return_lag_1 return_lag_2 return_lag_3", "F-17", "bars",
       "SELECT entity, date, " + ", ".join(f"close / lag(close, {n}) {W} - 1 AS return_lag_{n}" for n in (1, 2, 3)) + " FROM bars")
def _(t):
    return price.add_lag_returns(t.bars())


@query("trend_return", "entity:i date:d trend_return", "F-49", "bars",
       f"""SELECT entity, date, CASE WHEN lag(close, 20) {W} IS NULL THEN 0 ELSE
 greatest(-1.0, least(1.0, (close - lag(close, 19) {W}) / lag(close, 19) {W})) END AS trend_return FROM bars""")
def _(t):
    return price.add_trend_return(t.bars())


@query("guarded_return", "entity:i date:d daily_return quarter:i", "F-51", "ubars",
       f"""SELECT entity, date, CASE WHEN p = 0 THEN 0 ELSE (close - p) / p * 100 END AS daily_return, (month(date) - 1) // 3 + 1 AS quarter
 FROM (SELECT *, lag(close) {W} AS p FROM ubars)""")
def _(t):
    df = t.user_bars().withColumn("p", F.lag("close", 1).over(trend.ordered()))
    return df.withColumns({"daily_return": price.daily_return(c("close"), c("p")), "quarter": price.quarter_of_month(F.month("date"))})


# ------------------------------------------------------------------------------------ moving averages


def ema_sql(p: int, rows: int | None = None, seed: str = "sma") -> str:
    n = rows or p
    a = f"(2.0 / {p + 1}.0)"
    items = f"list(close) {over(n)}"
    start = f"list_prepend(list_avg({items}), {items})" if seed == "sma" else items
    return full(f"list_reduce({start}, lambda e, x: (x - e) * CAST({a} AS DOUBLE) + e)", n)


@query("ema", "entity:i date:d ema_5:f4 ema_10:f4 ema_20:f4 ema_30:f4 ema_60:f4", "F-05 WIN-12", "bars",
       "SELECT entity, date, " + ", ".join(f"{ema_sql(p)} AS ema_{p}" for p in (5, 10, 20, 30, 60)) + " FROM bars")
def _(t):
    return trend.add_ema(t.bars())


@query("ema_relative", "entity:i date:d ema_5 ema_20", "F-05 F-50", "bars",
       "SELECT entity, date, " + ", ".join(f"({ema_sql(p, seed='first')} - close) / close * 100 AS ema_{p}" for p in (5, 20)) + " FROM bars")
def _(t):
    return trend.add_ema(t.bars(), (5, 20), seed="first", relative=True)


@query("sma", "entity:i date:d sma_5:f4 sma_10:f4 sma_20:f4", "F-06 WIN-04", "bars",
       "SELECT entity, date, " + ", ".join(f"{full(f'avg(close) {over(n)}', n)} AS sma_{n}" for n in (5, 10, 20)) + " FROM bars")
def _(t):
    return trend.add_sma(t.bars())


@query("sma_relative", "entity:i date:d sma_5 sma_20", "F-50", "bars",
       "SELECT entity, date, " + ", ".join(f"{full(f'(avg(close) {over(n)} - close) / close * 100', n)} AS sma_{n}" for n in (5, 20)) + " FROM bars")
def _(t):
    return trend.add_sma(t.bars(), (5, 20), relative=True)


def macd_sql(fast: int, slow: int, view: str = "bars") -> str:
    return f"SELECT entity, date, close, {full('f', slow)} - s AS line FROM (SELECT *, {ema_sql(fast)} AS f, {ema_sql(slow)} AS s FROM {view})"


@query("macd", "entity:i date:d macd_line:f4 macd_signal:f4 macd_histogram:f4", "F-07", "bars",
       f"SELECT *, line AS macd_line, line * 0.85 AS macd_signal, line - line * 0.85 AS macd_histogram FROM ({macd_sql(12, 26)})")
def _(t):
    return trend.add_macd(t.bars())


@query("macd_relative", "entity:i date:d macd_line macd_signal macd_histogram", "F-07", "bars",
       f"""SELECT *, line AS macd_line, line * 0.9 AS macd_signal, line - line * 0.9 AS macd_histogram FROM (
 SELECT entity, date, ({ema_sql(12, 26, 'first')} - {ema_sql(26, 26, 'first')}) / close AS line FROM bars)""")
def _(t):
    return trend.add_macd(t.bars(), signal=0.9, seed="first", relative=True)


@query("macd_long", "entity:i date:d macd_weekly_line:f4 macd_weekly_signal:f4 macd_monthly_line:f4 macd_monthly_signal:f4", "F-08", "bars",
       f"""SELECT w.entity, w.date, w.line AS macd_weekly_line, w.line * 0.85 AS macd_weekly_signal,
 m.line AS macd_monthly_line, m.line * 0.85 AS macd_monthly_signal
 FROM ({macd_sql(60, 130)}) w JOIN ({macd_sql(126, 260)}) m ON w.entity = m.entity AND w.date = m.date""")
def _(t):
    return trend.add_long_macd(t.bars())


def _fold_sql(col: str, p: int) -> str:
    return f"list_reduce(list({col}) OVER ({BY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), lambda e, x: (x - e) * CAST(2.0 / {p + 1}.0 AS DOUBLE) + e)"


@query("macd_recursive", "entity:i date:d macd:f4 macd_ema_signal:f4 macd_ema_hist:f4", "F-48", "bars",
       f"""SELECT *, macd - macd_ema_signal AS macd_ema_hist FROM (SELECT *, {_fold_sql('macd', 9)} AS macd_ema_signal FROM (
 SELECT entity, date, {_fold_sql('close', 12)} - {_fold_sql('close', 26)} AS macd FROM bars))""")
def _(t):
    return trend.add_macd_recursive(t.bars().select("entity", "date", "close"))


class Smoother:
    """A stateful indicator: exponential smoothing that starts at the first close."""

    def __init__(self):
        self.level = None

    def next(self, row: dict) -> dict:
        x = row["close"]
        self.level = x if self.level is None else self.level + (x - self.level) * 0.1372
        return {"level": self.level}


@query("indicator_fold", "entity:i date:d level:f4", "UDF surface (stateful iterator)", "bars",
       f"""SELECT entity, date, list_reduce(list(close) OVER ({BY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
 lambda e, x: e + (x - e) * CAST(0.1372 AS DOUBLE)) AS level FROM bars""")
def _(t):
    return trend.apply_indicator(t.bars().select("entity", "date", "close"), Smoother, "level double")


@query("indicator_vectors", "entity:i date:d level:f4", "UDF surface (vector form)", "bars", REGISTRY["indicator_fold"].body)
def _(t):
    """The same smoothing as a fold over arrays of a whole entity."""

    def fold(columns: dict) -> dict:
        level, out = None, []
        for x in columns["close"].tolist():
            level = x if level is None else level + (x - level) * 0.1372
            out.append(level)
        return {"level": out}

    return trend.apply_vector_indicator(t.bars().select("entity", "date", "close"), fold, "level double")


@query("indicator_scan", "entity:i date:d level:f4", "UDF surface (linear recurrence)", "bars", REGISTRY["indicator_fold"].body)
def _(t):
    """The same smoothing as a prefix scan of affine maps: for entities of any length."""
    first = c("_row") == 1
    level = (F.when(first, 0.0).otherwise(1 - 0.1372), F.when(first, c("close")).otherwise(c("close") * 0.1372))
    return linear_recurrences(t.bars().select("entity", "date", "close"), {"level": level})


# ---------------------------------------------------------------------------------------- oscillators


@query("rsi", "entity:i date:d rsi_14", "F-09", "bars",
       f"""SELECT entity, date, {full("CASE WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END", 15)} AS rsi_14 FROM (
 SELECT *, avg(greatest(d, 0)) {over(14)} AS g, avg(greatest(-d, 0)) {over(14)} AS l FROM (
  SELECT *, close - lag(close) {W} AS d FROM bars))""".replace("avg(greatest(d, 0))", "avg(CASE WHEN d IS NOT NULL THEN greatest(d, 0) END)").replace("avg(greatest(-d, 0))", "avg(CASE WHEN d IS NOT NULL THEN greatest(-d, 0) END)"))
def _(t):
    return momentum.add_rsi(t.bars())


def kdj_sql(a: str, n: int = 9) -> str:
    return f"""SELECT *, 3 * kdj_k - 2 * kdj_d AS kdj_j FROM (SELECT *, kdj_k * {a} + 50 * (1 - {a}) AS kdj_d FROM (
 SELECT entity, date, {full(f"(close - lo) / nullif(hi - lo, 0) * 100 * {a} + 50 * (1 - {a})", n)} AS kdj_k FROM (
  SELECT *, min(low) {over(n)} AS lo, max(high) {over(n)} AS hi FROM bars)))"""


@query("kdj", "entity:i date:d kdj_k kdj_d kdj_j", "F-10", "bars", kdj_sql("0.2"))
def _(t):
    return momentum.add_kdj(t.bars())


@query("kdj_third", "entity:i date:d kdj_k kdj_d kdj_j", "F-10", "bars", kdj_sql("0.33"))
def _(t):
    return momentum.add_kdj(t.bars(), weight=0.33)


@query("williams_r", "entity:i date:d williams_r_14", "F-28", "bars",
       f"""SELECT entity, date, {full("CASE WHEN hi > lo THEN -100 * (hi - close) / (hi - lo) ELSE -50 END", 14)} AS williams_r_14 FROM (
 SELECT *, min(low) {over(14)} AS lo, max(high) {over(14)} AS hi FROM bars)""")
def _(t):
    return momentum.add_williams_r(t.bars())


@query("mfi", "entity:s date:d mfi_14", "F-27", "rbars",
       f"""SELECT entity, date, CASE WHEN row_number() {W} >= 15 THEN
 CASE WHEN abs(dn) < 1e-12 THEN 100 ELSE 100 - 100 / (1 + up / dn) END ELSE 50 END AS mfi_14 FROM (
 SELECT *, sum(CASE WHEN tp > p THEN tp * volume ELSE 0 END) {over(14)} AS up, sum(CASE WHEN tp < p THEN tp * volume ELSE 0 END) {over(14)} AS dn FROM (
  SELECT *, lag(tp) {W} AS p FROM (SELECT *, (high + low + close) / 3 AS tp FROM rbars)))""")
def _(t):
    return momentum.add_mfi(t.region_bars())


# ----------------------------------------------------------------------------------------- volatility


@query("bollinger", "entity:i date:d bb_upper:f4 bb_middle:f4 bb_lower:f4 bb_bandwidth bb_percent_b", "F-11", "bars",
       f"""SELECT entity, date, u AS bb_upper, m AS bb_middle, l AS bb_lower, CASE WHEN m <> 0 THEN (u - l) / m * 100 ELSE m END AS bb_bandwidth,
 CASE WHEN m IS NULL THEN NULL WHEN u <> l THEN (close - l) / (u - l) ELSE 0.5 END AS bb_percent_b FROM (
 SELECT *, m + 2 * s AS u, m - 2 * s AS l FROM (
  SELECT *, {full(f'avg(close) {over(20)}', 20)} AS m, stddev_pop(close) {over(20)} AS s FROM bars))""")
def _(t):
    return volatility.add_bollinger(t.bars())


@query("bollinger_relative", "entity:i date:d bb_upper bb_middle bb_lower bb_bandwidth", "F-11 F-50", "bars",
       f"""SELECT entity, date, (m + 2 * s - close) / close * 100 AS bb_upper, (m - close) / close * 100 AS bb_middle,
 (m - 2 * s - close) / close * 100 AS bb_lower, 4 * s / m AS bb_bandwidth FROM (
  SELECT *, {full(f'avg(close) {over(20)}', 20)} AS m, stddev_pop(close) {over(20)} AS s FROM bars)""")
def _(t):
    return volatility.add_bollinger(t.bars(), relative=True)


_TR = "greatest(high - low, abs(high - p), abs(low - p))"


def atr_sql(value: str, name: str) -> str:
    return f"""SELECT entity, date, {full(value, 15)} AS {name} FROM (SELECT *, avg(tr) {over(14)} AS a FROM (
 SELECT *, CASE WHEN p IS NOT NULL THEN {_TR} END AS tr FROM (SELECT *, lag(close) {W} AS p FROM rbars)))"""


@query("atr", "entity:s date:d atr:f4", "F-12", "rbars", atr_sql("a", "atr"))
def _(t):
    return volatility.add_atr(t.region_bars())


@query("atr_relative", "entity:s date:d atr_pct", "F-12 F-50", "rbars", atr_sql("a / close * 100", "atr_pct"))
def _(t):
    return volatility.add_atr(t.region_bars(), relative=True)


@query("volatility", "entity:i date:d volatility_5:f4 volatility_20:f4 hist_volatility_20:f4", "F-21", "bars",
       "SELECT entity, date, " + ", ".join(f"{full(f'stddev_pop(close) {over(n)}', n)} AS {k}" for k, n in
                                           (("volatility_5", 5), ("volatility_20", 20), ("hist_volatility_20", 20))) + " FROM bars")
def _(t):
    return volatility.add_volatility(t.bars())


@query("volatility_returns", "entity:i date:d volatility_20", "F-21", "bars",
       f"""SELECT entity, date, {full(f'sqrt(avg(r * r) {over(20)})', 21)} AS volatility_20 FROM (
 SELECT *, close / lag(close) {W} - 1 AS r FROM bars)""")
def _(t):
    return volatility.add_volatility(t.bars(), {"volatility_20": 20}, basis="return")


@query("year_range", "entity:i date:d price_position_52w price_vs_52w_high", "F-22 F-42 WIN-11", "bars",
       f"""SELECT entity, date, {full("CASE WHEN abs(hi - lo) > 1e-6 THEN (close - lo) / (hi - lo) END", 252)} AS price_position_52w,
 {full("CASE WHEN hi > 0 AND close > 0 THEN (close - hi) / hi END", 252)} AS price_vs_52w_high FROM (
 SELECT *, max(high) {over(252)} AS hi, min(low) {over(252)} AS lo FROM bars)""")
def _(t):
    return volatility.add_range_position(t.bars())


@query("year_range_partial", "entity:i date:d price_position_52w", "F-22", "bars",
       f"""SELECT entity, date, CASE WHEN row_number() {W} >= 2 AND hi > lo THEN (close - lo) / (hi - lo) ELSE 0.5 END AS price_position_52w FROM (
 SELECT *, max(high) {over(252)} AS hi, min(low) {over(252)} AS lo FROM bars)""")
def _(t):
    return volatility.add_range_position(t.bars(), partial=True)


@query("volatility_regime", "entity:i date:d vol_percentile high_vol_regime:f0", "F-38 WIN-10", "bars",
       f"""SELECT *, CASE WHEN vol_percentile IS NOT NULL THEN CAST(vol_percentile > 0.8 AS INTEGER) END AS high_vol_regime FROM (
 SELECT entity, date, {full(f"len(list_filter(list(sd) {over(60)}, lambda v: v < sd)) / 60.0", 60)} AS vol_percentile FROM (
  SELECT *, coalesce({full(f'stddev_pop(close) {over(60)}', 60)}, 0) AS sd FROM bars))""")
def _(t):
    return volatility.add_vol_regime(t.bars())


# -------------------------------------------------------------------------------- trend and patterns


def adx_sql(plus: str, minus: str, neutral: str) -> str:
    return f"""SELECT entity, date, {full(f"coalesce(abs(dip - dim) / nullif(dip + dim, 0) * 100, {neutral})", 15)} AS adx_14 FROM (
 SELECT *, 100 * sp / nullif(st, 0) AS dip, 100 * sm / nullif(st, 0) AS dim FROM (
  SELECT *, sum(pdm) {over(14)} AS sp, sum(mdm) {over(14)} AS sm, sum(tr) {over(14)} AS st FROM (
   SELECT *, CASE WHEN p IS NOT NULL THEN {plus} END AS pdm, CASE WHEN p IS NOT NULL THEN {minus} END AS mdm,
    CASE WHEN p IS NOT NULL THEN {_TR} END AS tr FROM (
    SELECT *, high - lag(high) {W} AS up, lag(low) {W} - low AS dn, lag(close) {W} AS p FROM rbars))))"""


@query("adx", "entity:s date:d adx_14", "F-24", "rbars",
       adx_sql("CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END", "CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END", "0"))
def _(t):
    return trend.add_adx(t.region_bars())


@query("adx_plain", "entity:s date:d adx_14", "F-24", "rbars", adx_sql("greatest(up, 0)", "greatest(dn, 0)", "25"))
def _(t):
    return trend.add_adx(t.region_bars(), dominance=False)


def aroon_sql(view: str, high_pick: str, low_pick: str) -> str:
    return f"""SELECT entity, date, {full("(25 - (rn - h)) / 25.0 * 100", 25)} AS aroon_up_25, {full("(25 - (rn - l)) / 25.0 * 100", 25)} AS aroon_down_25
 FROM (SELECT *, {high_pick} AS h, {low_pick} AS l FROM (
  SELECT *, list(struct_pack(v := high, p := rn)) {over(25)} AS hs, list(struct_pack(v := low, p := rn)) {over(25)} AS ls,
   max(high) {over(25)} AS hi, min(low) {over(25)} AS lo FROM (SELECT *, row_number() {W} AS rn FROM {view})))"""


_HI = "{}(list_transform(list_filter(hs, lambda x: x.v = hi), lambda x: x.p))"
_LO = "{}(list_transform(list_filter(ls, lambda x: x.v = lo), lambda x: x.p))"


@query("aroon", "entity:i date:d aroon_up_25 aroon_down_25", "F-29", "bars", aroon_sql("bars", _HI.format("list_max"), _LO.format("list_max")))
def _(t):
    return trend.add_aroon(t.bars())


@query("aroon_oldest", "entity:i date:d aroon_up_25 aroon_down_25", "F-29", "ubars", aroon_sql("ubars", _HI.format("list_min"), _LO.format("list_min")))
def _(t):
    return trend.add_aroon(t.user_bars(), ties="oldest")


@query("candle_patterns", "entity:s date:d is_doji:b is_hammer:b is_shooting_star:b", "F-30", "rbars",
       """SELECT entity, date, CASE WHEN high - low > 0 THEN abs(close - open) / (high - low) < 0.1 ELSE FALSE END AS is_doji,
 abs(close - open) > 0 AND least(open, close) - low > 2 * abs(close - open) AND high - greatest(open, close) < abs(close - open) AS is_hammer,
 abs(close - open) > 0 AND high - greatest(open, close) > 2 * abs(close - open) AND least(open, close) - low < abs(close - open) AS is_shooting_star
 FROM rbars""")
def _(t):
    return pattern.add_candle_patterns(t.region_bars())


def streak_sql(view: str, sign: str, length: str = "n") -> str:
    return f"""SELECT entity, date, s * {length} AS streak FROM (
 SELECT *, row_number() OVER (PARTITION BY entity, g ORDER BY date) AS n FROM (
  SELECT *, sum(CASE WHEN s IS DISTINCT FROM ps THEN 1 ELSE 0 END) {W} AS g FROM (
   SELECT *, lag(s) {W} AS ps FROM (SELECT *, {sign} AS s FROM (SELECT *, close - lag(close) {W} AS d FROM {view})))))"""


@query("streak", "entity:i date:d streak:f0", "F-31 WIN-09", "ubars", streak_sql("ubars", "sign(d)"))
def _(t):
    return pattern.add_streak(t.user_bars(), "streak")


@query("streak_capped", "entity:i date:d streak:f0", "F-32", "bars",
       streak_sql("bars", "CASE WHEN d > 0 THEN 1 WHEN d <= 0 THEN -1 END", "least(n, 19)"))
def _(t):
    return pattern.add_streak(t.bars(), "streak", flat="down", cap=19)


# --------------------------------------------------------------------------------------------- volume


@query("asi", "entity:s date:d asi:f3", "F-13", "rbars",
       f"""SELECT entity, date, CASE WHEN pc IS NOT NULL THEN sum(core) {W} / (0.1 * close) END AS asi FROM (
 SELECT *, CASE WHEN pc IS NULL OR r = 0 THEN 0 ELSE 50 * ((close - pc) + 0.5 * (close - open) + 0.25 * (pc - po)) / r * greatest(a, b) END AS core FROM (
  SELECT *, CASE WHEN a >= b AND a >= k THEN a - 0.5 * b + 0.25 * d WHEN b >= a AND b >= k THEN b - 0.5 * a + 0.25 * d ELSE k + 0.25 * d END AS r FROM (
   SELECT *, abs(high - pc) AS a, abs(low - pc) AS b, high - low AS k, abs(pc - po) AS d FROM (
    SELECT *, lag(close) {W} AS pc, lag(open) {W} AS po FROM rbars))))""")
def _(t):
    return volume.add_asi(t.region_bars())


@query("obv", "entity:i date:d obv", "F-14", "bars",
       f"""SELECT entity, date, CASE WHEN p IS NOT NULL THEN sum(CASE WHEN close > p THEN volume WHEN close < p THEN -volume ELSE 0 END) {W} END AS obv
 FROM (SELECT *, lag(close) {W} AS p FROM bars)""")
def _(t):
    return volume.add_obv(t.bars())


@query("obv_from_origin", "entity:i date:d obv", "F-14", "bars",
       f"""SELECT entity, date, CASE WHEN p IS NOT NULL THEN sum(CASE WHEN date <= DATE '1998-01-01' THEN 0 WHEN close > p THEN volume WHEN close < p THEN -volume ELSE 0 END) {W} END AS obv
 FROM (SELECT *, lag(close) {W} AS p FROM bars)""")
def _(t):
    from datetime import date

    return volume.add_obv(t.bars(), origin=date(1998, 1, 1))


@query("volume_features", "entity:i date:d volume_ratio volume_roc_5 volume_spike:f0 volume_accel_5d", "F-15 F-19 F-20 F-41 WIN-05", "bars",
       f"""SELECT entity, date, volume_ratio, volume_roc_5, volume_spike,
 CASE WHEN rn >= 11 AND past IS NOT NULL THEN CASE WHEN past > 0 THEN (coalesce(volume_ratio, 1) - past) / past ELSE 0 END END AS volume_accel_5d FROM (
 SELECT *, avg(own) OVER ({BY} ROWS BETWEEN 10 PRECEDING AND 5 PRECEDING) AS past FROM (
  SELECT *, CASE WHEN rn >= 5 AND m5 > 0 THEN volume / m5 END AS volume_ratio,
   CASE WHEN rn >= 6 AND abs(v5) > 1e-6 THEN volume / v5 - 1 END AS volume_roc_5,
   CASE WHEN rn >= 6 THEN volume > 2 * prev5 END AS volume_spike,
   CASE WHEN volume > 0 AND s5 > 0 THEN volume / (s5 / 5) END AS own FROM (
    SELECT *, row_number() {W} AS rn, avg(volume) {over(5)} AS m5, sum(volume) {over(5)} AS s5, lag(volume, 5) {W} AS v5,
     avg(volume) OVER ({BY} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS prev5 FROM bars)))""")
def _(t):
    return volume.add_volume_features(t.bars())


@query("volume_vs_mean", "entity:i date:d volume_roc_mean volume_spike_mean:f0", "F-19 F-20", "bars",
       f"""SELECT entity, date, r AS volume_roc_mean, r > 2 AS volume_spike_mean FROM (
 SELECT *, {full(f'(volume - avg(volume) {over(5)}) / avg(volume) {over(5)}', 5)} AS r FROM bars)""")
def _(t):
    return volume.add_volume_vs_mean(t.bars())


@query("vwap_distance", "entity:s date:d vwap_distance_pct", "F-25", "rbars",
       f"""SELECT entity, date, {full("(close - coalesce(pv / nullif(v, 0), close)) / close * 100", 20)} AS vwap_distance_pct FROM (
 SELECT *, sum((high + low + close) / 3 * volume) {over(20)} AS pv, sum(volume) {over(20)} AS v FROM rbars)""")
def _(t):
    return volume.add_vwap_distance(t.region_bars())


@query("cmf", "entity:s date:d cmf_20", "F-26", "rbars",
       f"""SELECT entity, date, {full("coalesce(f / nullif(v, 0), 0)", 20)} AS cmf_20 FROM (
 SELECT *, sum(CASE WHEN high > low THEN ((close - low) - (high - close)) / (high - low) * volume ELSE 0 END) {over(20)} AS f,
  sum(volume) {over(20)} AS v FROM rbars)""")
def _(t):
    return volume.add_cmf(t.region_bars())


# -------------------------------------------------------------------------------------------- context

_CODES = ("csi300", "chinext", "xin9", "hsi", "usdcnh")
_IDX = """SELECT *, CASE WHEN abs(m5) > 1e-6 THEN (close - m5) / m5 * 100 END AS vs5, CASE WHEN abs(m20) > 1e-6 THEN (close - m20) / m20 * 100 END AS vs20
 FROM (SELECT *, avg(close) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS m5,
 avg(close) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS m20 FROM idx)"""


def index_context_sql(at: str, codes=_CODES, view: str = "idx") -> str:
    picks, joins = [], []
    for k in codes:
        picks.append(f"{k}.pct_chg AS {k}_pct_chg, {k}.vs5 AS {k}_vs_ma5_pct, {k}.vs20 AS {k}_vs_ma20_pct, {k}.date AS {k}_ref_date")
        joins.append(f"ASOF LEFT JOIN (SELECT * FROM ix WHERE code = '{k}') {k} ON b.at >= {k}.date")
    return f"""WITH ix AS ({_IDX.replace('FROM idx', f'FROM {view}')}), b AS (SELECT entity, date, {at} AS at FROM bars)
 SELECT b.entity, b.date, {', '.join(picks)} FROM b {' '.join(joins)}"""


_INDEX_OUT = " ".join(f"{k}_pct_chg {k}_vs_ma5_pct {k}_vs_ma20_pct {k}_ref_date:d" for k in _CODES)


@query("index_context", f"entity:i date:d {_INDEX_OUT}", "F-33 JN-07 JN-14 WIN-04", "bars idx", index_context_sql(f"lag(date) {W}"))
def _(t):
    return context.add_index_context(t.bars(), t.index_bars(), _CODES)


@query("index_context_same_day", "entity:i date:d csi300_pct_chg csi300_vs_ma5_pct csi300_vs_ma20_pct csi300_ref_date:d", "F-33 F-34", "bars idx",
       index_context_sql("date", ("csi300",)))
def _(t):
    return context.add_index_context(t.bars(), t.index_bars(), ("csi300",), lag=0)


@query("industry_momentum", "entity:i date:d industry_momentum", "F-35", "bars idx",
       f"SELECT entity, date, chinext_pct_chg AS industry_momentum FROM ({index_context_sql(f'lag(date) {W}', ('chinext',))})")
def _(t):
    return context.add_index_context(t.bars(), t.index_bars(), ("chinext",)).withColumn("industry_momentum", c("chinext_pct_chg"))


@query("index_stats", "code:s date:d pct_chg vs_ma5_pct vs_ma20_pct close_mean:f4 close_stddev:f4 close_min:f4 close_max:f4 close_median:f4", "F-34 AG-06", "idx",
       """SELECT code, date, coalesce((close - p) / p * 100, 0) AS pct_chg, (close - m5) / m5 * 100 AS vs_ma5_pct, (close - m20) / m20 * 100 AS vs_ma20_pct,
 close_mean, close_stddev, close_min, close_max, close_median FROM (
 SELECT code, date, close, lag(close) OVER w AS p,
  CASE WHEN row_number() OVER w >= 5 THEN avg(close) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) ELSE close END AS m5,
  CASE WHEN row_number() OVER w >= 20 THEN avg(close) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) ELSE close END AS m20,
  avg(close) OVER r AS close_mean, stddev_samp(close) OVER r AS close_stddev, min(close) OVER r AS close_min, max(close) OVER r AS close_max,
  quantile_cont(close, 0.5) OVER r AS close_median FROM idx
  WINDOW w AS (PARTITION BY code ORDER BY date), r AS (PARTITION BY code ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""")
def _(t):
    return context.index_stats(t.index_bars())


GROUP_SERIES = """SELECT industry, date, avg_return, avg(avg_return) OVER (PARTITION BY industry ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS avg_5d
 FROM (SELECT industry, date, avg(pct_chg) AS avg_return FROM rets JOIN dim USING (entity) GROUP BY industry, date)"""


@query("industry_series", "industry:s date:d avg_return avg_5d", "F-36 AG-07", "rets dim", GROUP_SERIES)
def _(t):
    return context.group_series(t.returns(), t.dim())


_GROUP_CTX = f"""SELECT b.entity, b.date, b.industry, b.close_pct, s.avg_return AS industry_avg_return, s.avg_5d AS industry_momentum_5d, s.date AS ref_date,
 b.close_pct - s.avg_return AS stock_vs_industry FROM (
 SELECT entity, date, industry, (close - coalesce(prev, open)) / coalesce(prev, open) * 100 AS close_pct FROM prevs JOIN dim USING (entity)) b
 ASOF LEFT JOIN ({GROUP_SERIES}) s ON s.industry = b.industry AND b.date > s.date"""


@query("industry_context", "entity:i date:d industry:s industry_avg_return industry_momentum_5d stock_vs_industry ref_date:d", "F-36 F-37 JN-08", "prevs rets dim", _GROUP_CTX)
def _(t):
    df = price.add_returns(t.bars()).join(t.dim().select("entity", "industry"), "entity")
    series = context.group_series(t.returns(), t.dim())
    return context.add_vs_group(context.add_group_context(df, series, ref_date="ref_date"))


@query("sector_vs_market", "entity:i date:d industry:s sector_momentum_vs_market", "F-40", "bars dim",
       f"""WITH f AS (SELECT entity, date, industry, close / lag(close, 5) {W} - 1 AS m FROM bars JOIN dim USING (entity))
 SELECT f.entity, f.date, f.industry, s.x - k.x AS sector_momentum_vs_market FROM f
 JOIN (SELECT industry, date, avg(m) AS x FROM f GROUP BY industry, date) s ON s.industry = f.industry AND s.date = f.date
 JOIN (SELECT date, avg(m) AS x FROM f GROUP BY date) k ON k.date = f.date""")
def _(t):
    df = price.add_momentum(t.bars(), (5,)).join(t.dim().select("entity", "industry"), "entity")
    return context.add_group_vs_market(df)


@query("flow_features", "entity:i date:d net_mf_vol net_mf_amount:f4 smart_money_ratio large_order_flow", "F-43 F-44 F-45 JN-06", "bars flows",
       f"""SELECT b.entity, b.date, net_mf_vol, net_mf_amount,
 CASE WHEN net_mf_amount IS NOT NULL AND volume > 0 THEN greatest(-1.0, least(1.0, net_mf_amount / volume)) END AS smart_money_ratio,
 CASE WHEN row_number() OVER (PARTITION BY b.entity ORDER BY b.date) >= 5 THEN avg(net_mf_vol) OVER (PARTITION BY b.entity ORDER BY b.date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) ELSE net_mf_vol END AS large_order_flow
 FROM bars b LEFT JOIN flows f ON f.entity = b.entity AND f.date = b.date""")
def _(t):
    return context.add_flows(t.bars(), t.flows())


_VAL = " ".join(context.VALUATION_COLUMNS)


@query("valuation_features", f"entity:i date:d {_VAL}", "F-46 JN-06", "bars val",
       "SELECT b.entity, b.date, " + ", ".join("coalesce(v.dv_ttm, 0) AS dv_ttm" if n == "dv_ttm" else f"v.{n}" for n in context.VALUATION_COLUMNS)
       + " FROM bars b LEFT JOIN val v ON v.entity = b.entity AND v.date = b.date")
def _(t):
    return context.add_valuation(t.bars(), t.valuation())


@query("valuation_position", "entity:i date:d pe_percentile_52w", "F-39 WIN-11", "bars val",
       f"""SELECT entity, date, CASE WHEN rn >= 252 AND pe_ttm > 0 AND n > 10 AND hi > lo THEN (pe_ttm - lo) / (hi - lo) ELSE 0 END AS pe_percentile_52w FROM (
 SELECT *, row_number() {W} AS rn, count(p) {over(252)} AS n, min(p) {over(252)} AS lo, max(p) {over(252)} AS hi FROM (
  SELECT b.entity, b.date, v.pe_ttm, CASE WHEN v.pe_ttm > 0 THEN v.pe_ttm END AS p FROM bars b LEFT JOIN val v ON v.entity = b.entity AND v.date = b.date))""")
def _(t):
    return context.add_position_positive(context.add_valuation(t.bars(), t.valuation(), ("pe_ttm",)))


_JOINT = "PARTITION BY entity, x IS NULL ORDER BY date"


@query("rolling_corr", "entity:i date:d rolling_corr relative_return", "F-47", "bars idx",
       f"""SELECT entity, date, CASE WHEN x IS NULL THEN NULL WHEN rn < 20 OR sa = 0 OR sb = 0 THEN 0 ELSE r END AS rolling_corr, CASE WHEN x IS NOT NULL THEN ra - rb END AS relative_return FROM (
 SELECT entity, date, x, row_number() {over(by=_JOINT)} AS rn, stddev_pop(close) {over(20, _JOINT)} AS sa, stddev_pop(x) {over(20, _JOINT)} AS sb, corr(close, x) {over(20, _JOINT)} AS r,
  (close - lag(close) {over(by=_JOINT)}) / lag(close) {over(by=_JOINT)} * 100 AS ra, (x - lag(x) {over(by=_JOINT)}) / lag(x) {over(by=_JOINT)} * 100 AS rb FROM (
  SELECT b.entity, b.date, b.close, i.close AS x FROM bars b LEFT JOIN idx i ON i.date = b.date AND i.code = 'csi300'))""")
def _(t):
    return context.add_rolling_corr(t.bars(), t.index_bars().where(c("code") == "csi300"))


# --------------------------------------------------------------------------------------------- labels


def label_sql(h: int, band: float) -> str:
    r = f"lead(close, {h}) {W} / close - 1"
    n = "next_day" if h == 1 else f"next_{h}day"
    return f"{r} AS {n}_return, CASE WHEN {r} > {band} THEN 1 WHEN {r} < -{band} THEN -1 WHEN {r} IS NOT NULL THEN 0 END AS {n}_direction"


LABELS = f"SELECT *, {label_sql(1, 0.002)}, {label_sql(3, 0.005)} FROM bars"


@query("labels", "entity:i date:d next_day_return next_day_direction:f0 next_3day_return next_3day_direction:f0", "L-01 L-02 WIN-03", "bars", LABELS)
def _(t):
    return price.add_labels(t.bars())


@query("residual_label", "entity:i date:d residual residual_direction:f0", "L-04", "bars",
       f"""SELECT entity, date, next_day_return - p AS residual, sign(next_day_return - p) AS residual_direction FROM (
 SELECT *, lag(next_day_return) {W} AS p FROM ({LABELS}))""")
def _(t):
    df = price.add_labels(t.bars()).withColumn("p", F.lag("next_day_return", 1).over(trend.ordered()))
    return price.residual_label(df, "p")


# --------------------------------------------------------------------------------------------- blocks


def _joined(*names: str) -> str:
    from barloom.catalog.base import REGISTRY

    first, *rest = names
    joins = " ".join(f"JOIN ({REGISTRY[n].body}) {n} ON {n}.entity = z.entity AND {n}.date = z.date" for n in rest)
    return f"SELECT * FROM ({REGISTRY[first].body}) z {joins}".replace("SELECT *", "SELECT z.entity, z.date, * EXCLUDE (entity, date)", 1)


@query("features_in_blocks", "entity:i date:d ema_60:f4 bb_percent_b rsi_14 price_momentum_20 next_3day_return", "F-05 F-09 F-11 F-16 L-02 (long entities)", "bars",
       _joined("ema", "bollinger", "rsi", "momentum", "labels"))
def _(t):
    """The same features from windows of at most 164 rows: blocks of 100 with 61 rows of overlap."""
    from barloom.operators.blocks import in_blocks
    from barloom.operators.windows import apply_steps, merge

    def build(df, key):
        return apply_steps(
            df,
            merge(
                trend.ema_steps((60,), key=key), volatility.bollinger_steps(key=key), momentum.rsi_steps(key=key),
                price.momentum_steps((20,), key=key), price.label_steps({3: 0.005}, key=key),
            ),
        )

    return in_blocks(t.bars().select("entity", "date", "close"), build, size=100, overlap=61, ahead=3, rows=t.table("lineitem").count())


@query("volume_in_blocks", "entity:i date:d cum_volume", "F-14 WIN-08 (long entities)", "bars",
       f"SELECT entity, date, sum(volume) OVER ({BY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_volume FROM bars")
def _(t):
    from barloom.operators.blocks import running_sum_in_blocks

    return running_sum_in_blocks(t.bars().select("entity", "date", "volume"), "volume", "cum_volume", size=100, rows=t.table("lineitem").count())
