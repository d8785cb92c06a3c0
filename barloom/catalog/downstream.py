"""Scores, signals, validation and backtest."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from barloom.catalog.base import BY, DAYNO, add_view, full, over, query
from barloom.catalog.features import LABELS
from barloom.operators.price import add_labels, add_lag_returns, add_momentum, add_returns
from barloom.operators.sequences import make_sequences
from barloom.operators.trend import add_macd
from barloom.operators.momentum import add_rsi
from barloom.operators.trend import add_adx
from barloom.operators.volatility import add_bollinger
from barloom.operators.volume import add_volume_features
from barloom.plans import backtest as bt
from barloom.plans import scoring as so
from barloom.plans import signals as sg
from barloom.plans import validation as va
from barloom.functions import vectors as vec
from barloom.catalog.features import ema_sql, _TR
from barloom.session import settle
from barloom.sources.tables import day_number

c = F.col
W = over()
KEYS = ["entity", "date"]

# --------------------------------------------------------------------------------------------- scores

_RSI_SQL = f"""{full("CASE WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END", 15)}"""
add_view("ind0", "prevs", "SELECT *, close - prev AS d, high - lag(high) OVER w AS up, lag(low) OVER w - low AS dn FROM prevs WINDOW w AS (PARTITION BY entity ORDER BY date)")
add_view(
    "ind", "ind0",
    f"""SELECT entity, date, close, volume, (close - coalesce(prev, open)) / coalesce(prev, open) * 100 AS close_pct, {_RSI_SQL} AS rsi_14,
 {full('(f - s) - (f - s) * 0.85', 26)} AS macd_histogram, {full('CASE WHEN sd = 0 THEN 0.5 ELSE (close - (m - 2 * sd)) / (4 * sd) END', 20)} AS bb_percent_b,
 {full('volume / m5', 5)} AS volume_ratio, close / c5 - 1 AS price_momentum_5,
 {full('coalesce(abs(100 * sp / nullif(st, 0) - 100 * sm / nullif(st, 0)) / nullif(100 * sp / nullif(st, 0) + 100 * sm / nullif(st, 0), 0) * 100, 0)', 15)} AS adx_14 FROM (
 SELECT *, avg(CASE WHEN d IS NOT NULL THEN greatest(d, 0) END) {over(14)} AS g, avg(CASE WHEN d IS NOT NULL THEN greatest(-d, 0) END) {over(14)} AS l,
  {ema_sql(12)} AS f, {ema_sql(26)} AS s, avg(close) {over(20)} AS m, stddev_pop(close) {over(20)} AS sd, avg(volume) {over(5)} AS m5, lag(close, 5) {W} AS c5,
  sum(CASE WHEN d IS NOT NULL AND up > dn AND up > 0 THEN up ELSE 0 END) {over(14)} AS sp, sum(CASE WHEN d IS NOT NULL AND dn > up AND dn > 0 THEN dn ELSE 0 END) {over(14)} AS sm,
  sum(CASE WHEN d IS NOT NULL THEN {_TR.replace('p)', 'prev)')} END) {over(14)} AS st FROM ind0)""",
)


def indicators(t, bars=None):
    df = add_momentum(add_returns(t.bars() if bars is None else bars), (5,), key="entity")
    return add_adx(add_volume_features(add_bollinger(add_macd(add_rsi(df)))))


@query("rule_scores", "entity:i date:d pred_return direction:i confidence", "SC-01", "ind",
       """SELECT *, CASE WHEN pred_return > 0.2 THEN 1 WHEN pred_return < -0.2 THEN -1 ELSE 0 END AS direction FROM (
 SELECT entity, date, greatest(-3, least(3, CASE WHEN mv < -2 AND rsi < 30 THEN 0.5 WHEN mv > 2 AND rsi > 70 THEN -0.5 ELSE 0 END + m * 0.5)) AS pred_return,
  CASE WHEN rsi < 20 OR rsi > 80 THEN 0.8 ELSE 0.4 END * 0.9 AS confidence FROM (
  SELECT entity, date, greatest(-15, least(15, atanh(greatest(-0.999, least(0.999, tanh(close_pct / 3)))) * 3)) AS mv, coalesce(rsi_14, 50) AS rsi,
   greatest(-0.2, least(0.2, coalesce(price_momentum_5, 0))) AS m FROM ind))""")
def _(t):
    df = vec.pack_vector(add_momentum(add_rsi(add_returns(t.bars())), (5,)).select(*KEYS, "close_pct", "rsi_14", "price_momentum_5"))
    return so.score_by_rule(df.withColumn("features", vec.normalize(c("features"))))


def linear_model(x: np.ndarray) -> np.ndarray:
    """Weighted sums of the first column: late steps count more for 1 day, all alike for 3 days."""
    r = x[:, :, 0]
    return np.stack([r @ np.arange(1, r.shape[1] + 1) / 100.0, r.sum(axis=1)], axis=1)


@query("sequence_scores", "entity:i date:d pred_1day pred_3day", "SC-02 UDF surface", "bars",
       f"""SELECT entity, date, greatest(-15, least(15, list_sum(list_transform(s, lambda v, i: v * i)) / 100)) AS pred_1day, greatest(-15, least(15, list_sum(s))) AS pred_3day FROM (
 SELECT *, list(coalesce(r, 0)) OVER ({BY} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS s FROM (SELECT *, close / lag(close) {W} - 1 AS r FROM bars)) WHERE len(s) = 30""")
def _(t):
    seqs = make_sequences(add_lag_returns(t.bars(), (1,)), ["return_lag_1"], 30)
    return so.score_sequences(seqs, linear_model, ("pred_1day", "pred_3day"))


def boosted_rows(t):
    from barloom.operators.price import residual_label

    feats = ["return_lag_1", "return_lag_2", "return_lag_3", "volume"]
    # Fitting and applying the trees read the rows many times: they are made once.
    df = settle(add_labels(add_lag_returns(t.bars())).select(*KEYS, *feats, "next_day_return").where(c("next_day_return").isNotNull()))
    model = so.fit_base(df, feats, "next_day_return", rounds=5, depth=3, fit_until="1998-01-01")
    return residual_label(so.predict_base(model, df, feats), "base_pred")


@query("boosted_base", "entity:i date:d next_day_return base_pred residual", "SC-03 L-04")
def _(t):
    """Gradient-boosted trees fitted on one half of the calendar and applied to all rows (no SQL form)."""
    return boosted_rows(t)


@query("boosted_base_facts", "entity:i date:d next_day_return adds_up:b bounded:b", "SC-03 L-04", "bars",
       f"SELECT entity, date, next_day_return, true AS adds_up, true AS bounded FROM ({LABELS}) WHERE next_day_return IS NOT NULL")
def _(t):
    """What must hold for each prediction of the trees: the residual is what is missing to the label, and no prediction lies
    further from the mean than the sum of the boosting steps can reach (shrunken steps within twice the labels' range)."""
    rows = boosted_rows(t)
    y, base = c("next_day_return"), c("base_pred")
    span = rows.agg(F.struct(F.min(y).alias("lo"), F.max(y).alias("hi"))).scalar()
    room = c("_s.hi") - c("_s.lo")
    rows = rows.withColumn("_s", span)
    return rows.withColumns({"adds_up": F.abs(base + c("residual") - y) < 1e-9, "bounded": (base >= c("_s.lo") - room) & (base <= c("_s.hi") + room)})


_FUSE = f"""SELECT predicted_return AS a, CASE WHEN {DAYNO.replace('date', 'l.date')} % 2 = 0 THEN volume ELSE predicted_return / 3 END AS b, next_day_return AS y
 FROM preds p JOIN ({LABELS}) l ON l.entity = p.entity AND l.date = p.date WHERE next_day_return IS NOT NULL"""


def _fusion_rows(t):
    df = t.preds().join(add_labels(t.bars()).select(*KEYS, "volume", "next_day_return"), KEYS).where(c("next_day_return").isNotNull())
    other = F.when(day_number(c("date")) % 2 == 0, c("volume")).otherwise(c("predicted_return") / 3)
    return df.select(*KEYS, c("predicted_return").alias("a"), other.alias("b"), c("next_day_return").alias("y"))


_WEIGHTS = f"""SELECT n, wa AS weight_a, wb AS weight_b, my - wa * ma - wb * mb AS intercept, vyy - wa * vay - wb * vby AS mse FROM (
 SELECT *, (vay * vbb - vby * vab) / (vaa * vbb - vab * vab) AS wa, (vby * vaa - vay * vab) / (vaa * vbb - vab * vab) AS wb FROM (
  SELECT count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, var_pop(a) AS vaa, var_pop(b) AS vbb, var_pop(y) AS vyy, covar_pop(a, b) AS vab, covar_pop(a, y) AS vay, covar_pop(b, y) AS vby
  FROM ({_FUSE})))"""


@query("fusion_weights", "n:i weight_a weight_b intercept mse", "SC-04 JN-16", "bars preds", _WEIGHTS)
def _(t):
    return so.fit_fusion(_fusion_rows(t), "a", "b", "y")


@query("fused_predictions", "entity:i date:d fused", "SC-04", "bars preds",
       f"SELECT p.entity, p.date, weight_a * p.a + weight_b * p.b + intercept AS fused FROM ({_FUSE.replace('SELECT predicted', 'SELECT p.entity, p.date, predicted')}) p CROSS JOIN ({_WEIGHTS}) w")
def _(t):
    df = _fusion_rows(t)
    return so.fuse(df, so.fit_fusion(df, "a", "b", "y"), "a", "b")


# -------------------------------------------------------------------------------------------- signals

_CTX = """SELECT p.*, d.name, d.industry, i.rsi_14, i.macd_histogram, i.bb_percent_b, i.volume_ratio, i.price_momentum_5, i.adx_14, v.total_mv, v.pe_ttm, v.pb
 FROM preds p LEFT JOIN dim d ON d.entity = p.entity LEFT JOIN ind i ON i.entity = p.entity AND i.date = p.date LEFT JOIN val v ON v.entity = p.entity AND v.date = p.date"""
add_view("ctx", "preds dim ind val", _CTX)


def _context(t):
    t = t.with_stored_bars("open", "high", "low", "close", "volume", "disc")
    return sg.signal_context(t.preds(), t.dim(), indicators(t, t.bars_with_value()))


@query("signal_context", "entity:i date:d industry:s predicted_return confidence rsi_14 macd_histogram:f4 bb_percent_b volume_ratio price_momentum_5 adx_14 total_mv:f4 pe_ttm pb",
       "SG-01 JN-02", "ctx", "SELECT * FROM ctx")
def _(t):
    return _context(t)


def _points(rules: str) -> str:
    return f"CASE {rules} ELSE 0 END"


_BUY = f"({_points('WHEN rsi_14 < 30 THEN 2 WHEN rsi_14 < 40 THEN 1')} + {_points('WHEN macd_histogram > 0 THEN 1')} + {_points('WHEN bb_percent_b < 0.2 THEN 1')})"
_SELL = f"({_points('WHEN rsi_14 > 70 THEN 2 WHEN rsi_14 > 60 THEN 1')} + {_points('WHEN macd_histogram < 0 THEN 1')} + {_points('WHEN bb_percent_b > 0.8 THEN 1')})"


def _type_sql(ret: str) -> str:
    return f"""CASE WHEN {ret} >= 1.0 AND confidence >= 0.7 AND {_BUY} >= 2 THEN 'STRONG_BUY' WHEN {ret} >= 0.5 AND confidence >= 0.6 THEN 'BUY'
 WHEN {ret} <= -1.0 AND confidence >= 0.7 AND {_SELL} >= 2 THEN 'STRONG_SELL' WHEN {ret} <= -0.5 AND confidence >= 0.6 THEN 'SELL' ELSE 'HOLD' END"""


def _signals_sql(ret: str = "predicted_return", where: str = "true") -> str:
    tech = f"""CASE WHEN signal_type LIKE '%BUY' AND rsi_14 < 40 THEN (40 - rsi_14) * 0.5 WHEN signal_type LIKE '%SELL' AND rsi_14 > 60 THEN (rsi_14 - 60) * 0.5 ELSE 0 END
 + CASE WHEN (signal_type LIKE '%BUY' AND macd_histogram > 0) OR (signal_type LIKE '%SELL' AND macd_histogram < 0) THEN 5 ELSE 0 END
 + CASE WHEN volume_ratio > 1.5 THEN 10 WHEN volume_ratio > 1 THEN 5 ELSE 0 END + CASE WHEN adx_14 > 25 THEN (adx_14 - 25) * 0.2 ELSE 0 END"""
    return f"""SELECT *, greatest(0, least(100, abs({ret}) * 10 * 0.3 + confidence * 100 * 0.5 + ({tech}) * 0.2)) AS signal_score FROM (
 SELECT *, {_type_sql(ret)} AS signal_type FROM ctx WHERE confidence >= 0.6 AND NOT coalesce(contains(name, 'ST'), false) AND (volume_ratio IS NULL OR volume_ratio >= 0.2) AND {where}) WHERE signal_type <> 'HOLD'"""


_P = sg.SignalParams(min_volume_ratio=0.2)
_SIGNAL_OUT = "entity:i date:d signal_type:s signal_score"


@query("signal_types", "entity:i date:d signal_type:s", "SG-02", "ctx", f"SELECT *, {_type_sql('predicted_return')} AS signal_type FROM ctx")
def _(t):
    from barloom.functions.scores import signal_type

    kind = signal_type(c("predicted_return"), c("confidence"), c("rsi_14"), c("macd_histogram"), c("bb_percent_b"))
    return _context(t).withColumn("signal_type", kind)


@query("signals", _SIGNAL_OUT, "SG-03 SG-04", "ctx", _signals_sql())
def _(t):
    return sg.score_signals(_context(t), _P)


@query("signals_filtered", _SIGNAL_OUT, "SG-04 FLT-07 FLT-08", "ctx",
       _signals_sql("coalesce(predicted_3day_return, predicted_return)", "coalesce(contains(industry, '_1'), false) AND (total_mv IS NULL OR total_mv BETWEEN 5000 AND 500000)"))
def _(t):
    p = sg.SignalParams(min_volume_ratio=0.2, industries="_1", min_cap=0.5, max_cap=50.0, use_3day=True)
    return sg.score_signals(_context(t), p)


@query("stored_signals", _SIGNAL_OUT, "SG-05", "ctx", f"SELECT * FROM ({_signals_sql()}) WHERE signal_type = 'STRONG_BUY' ORDER BY signal_score DESC, entity, date LIMIT 20")
def _(t):
    return sg.stored_signals(sg.score_signals(_context(t), _P), 20, "STRONG_BUY")


@query("signal_summary", "signals:i strong_buy:i buy:i sell:i strong_sell:i mean_buy_return mean_sell_return mean_confidence mean_score", "SG-06", "ctx",
       f"""SELECT count(*) AS signals, count_if(signal_type = 'STRONG_BUY') AS strong_buy, count_if(signal_type = 'BUY') AS buy, count_if(signal_type = 'SELL') AS sell, count_if(signal_type = 'STRONG_SELL') AS strong_sell,
 avg(CASE WHEN signal_type LIKE '%BUY' THEN predicted_return END) AS mean_buy_return, avg(CASE WHEN signal_type LIKE '%SELL' THEN predicted_return END) AS mean_sell_return,
 avg(confidence) AS mean_confidence, avg(signal_score) AS mean_score FROM ({_signals_sql()})""")
def _(t):
    return sg.signal_summary(sg.score_signals(_context(t), _P))


@query("signal_top_picks", "entity:i date:d name:s signal_type:s predicted_return confidence signal_score", "SG-06", "ctx",
       f"SELECT * FROM ({_signals_sql()}) WHERE signal_type LIKE '%BUY' ORDER BY signal_score DESC, entity, date LIMIT 5")
def _(t):
    return sg.top_picks(sg.score_signals(_context(t), _P))


add_view(
    "direct", "preds",
    """SELECT * FROM (SELECT *, CASE WHEN predicted_return >= 1.0 AND confidence >= 0.7 THEN 'STRONG_BUY' WHEN predicted_return >= 0.5 AND confidence >= 0.6 THEN 'BUY'
 WHEN predicted_return <= -1.0 AND confidence >= 0.7 THEN 'STRONG_SELL' WHEN predicted_return <= -0.5 AND confidence >= 0.6 THEN 'SELL' ELSE 'HOLD' END AS signal_type,
 abs(predicted_return) * 10 + confidence * 50 AS signal_score FROM preds WHERE confidence >= 0.6) WHERE signal_type <> 'HOLD'""",
)


@query("direct_signals", _SIGNAL_OUT, "SG-07", "direct", "SELECT * FROM direct")
def _(t):
    return sg.signals_from_predictions(t.preds())


@query("direct_signals_long", _SIGNAL_OUT, "SG-07", "direct", "SELECT * FROM direct WHERE predicted_return > 0")
def _(t):
    return sg.signals_from_predictions(t.preds(), long_only=True)


# ----------------------------------------------------------------------------------------- validation

add_view(
    "validated", "bars preds",
    f"""SELECT p.*, actual_return, actual_direction, predicted_direction = actual_direction AS prediction_correct FROM preds p LEFT JOIN (
 SELECT entity, date, (n - close) / close * 100 AS actual_return, n > close AS actual_direction FROM (SELECT *, lead(close) {W} AS n FROM bars) WHERE n IS NOT NULL) a
 ON a.entity = p.entity AND a.date = p.date""",
)


def validated(t):
    return va.validate(t.preds(), t.bars())


@query("validated_1day", "entity:i date:d model_version:s actual_return actual_direction:f0 prediction_correct:f0", "VAL-01 VAL-03 JN-11", "validated", "SELECT * FROM validated")
def _(t):
    return validated(t)


@query("validated_3day", "entity:i date:d actual_3day_return actual_3day_direction:f0 prediction_3day_correct:f0", "VAL-02 JN-10", "bars preds",
       f"""SELECT p.entity, p.date, (n - close) / close * 100 AS actual_3day_return, n > close AS actual_3day_direction, predicted_3day_direction = (n > close) AS prediction_3day_correct
 FROM preds p LEFT JOIN (SELECT *, lead(close, 3) {W} AS n FROM bars) a ON a.entity = p.entity AND a.date = p.date AND n IS NOT NULL""")
def _(t):
    return va.validate(t.preds(), t.bars(), horizon=3)


@query("validated_pending", "entity:i date:d actual_return actual_direction:f0 prediction_correct:f0", "VAL-03 UPS-09", "validated",
       f"""SELECT entity, date, CASE WHEN {DAYNO} % 2 = 0 THEN 1.5 ELSE actual_return END AS actual_return, CASE WHEN {DAYNO} % 2 = 0 THEN true ELSE actual_direction END AS actual_direction,
 CASE WHEN {DAYNO} % 2 = 0 THEN predicted_direction ELSE prediction_correct END AS prediction_correct FROM validated""")
def _(t):
    """Half of the rows were judged before and keep their values."""
    done = day_number(c("date")) % 2 == 0
    p = t.preds().withColumns(
        {"actual_return": F.when(done, 1.5), "actual_direction": F.when(done, True), "prediction_correct": F.when(done, c("predicted_direction"))}
    )
    return va.validate(p, t.bars(), pending_only=True)


@query("validation_stats", "validated:i correct:i incorrect:i accuracy_pct avg_predicted avg_actual:f4 mae:f4 bias:f4 high_total:i high_correct:i", "VAL-04", "validated",
       """SELECT count(*) AS validated, count_if(prediction_correct) AS correct, count_if(NOT prediction_correct) AS incorrect, avg(CAST(prediction_correct AS INTEGER)) * 100 AS accuracy_pct,
 avg(predicted_return) AS avg_predicted, avg(actual_return) AS avg_actual, avg(abs(predicted_return - actual_return)) AS mae, avg(predicted_return - actual_return) AS bias,
 count_if(confidence > 0.7) AS high_total, count_if(confidence > 0.7 AND prediction_correct) AS high_correct FROM validated WHERE actual_return IS NOT NULL""")
def _(t):
    return va.validation_stats(validated(t))


@query("calibration", "bucket:i total:i correct:i accuracy_pct", "VAL-05", "validated",
       """SELECT least(floor(confidence * 10), 9) AS bucket, count(*) AS total, count_if(prediction_correct) AS correct, avg(CAST(prediction_correct AS INTEGER)) * 100 AS accuracy_pct
 FROM validated WHERE actual_return IS NOT NULL GROUP BY 1""")
def _(t):
    return va.calibration(validated(t))


@query("regression_metrics", "n:i mse:f2 rmse:f4 mae:f4 direction_accuracy", "VAL-06", "validated",
       """SELECT count(*) AS n, avg(e * e) AS mse, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae, avg(CAST((predicted_return > 0) = (actual_return > 0) AS INTEGER)) AS direction_accuracy
 FROM (SELECT *, predicted_return - actual_return AS e FROM validated WHERE actual_return IS NOT NULL)""")
def _(t):
    return va.regression_metrics(validated(t))


@query("label_distribution", "date:d n:i mean std min max up_pct down_pct flat_pct", "VAL-08", "bars",
       f"""SELECT date, count(*) AS n, avg(r) AS mean, stddev_pop(r) AS std, min(r) AS min, max(r) AS max, avg(CAST(r > 0 AS INTEGER)) * 100 AS up_pct, avg(CAST(r < 0 AS INTEGER)) * 100 AS down_pct,
 avg(CAST(r = 0 AS INTEGER)) * 100 AS flat_pct FROM (SELECT date, next_day_return AS r FROM ({LABELS})) WHERE r IS NOT NULL GROUP BY date""")
def _(t):
    return va.label_distribution(add_labels(t.bars()))


@query("movers", "date:d side:s entity:i close_pct:f4", "VAL-08 SRT-06", "rets",
       """WITH d AS (SELECT entity, date, pct_chg AS close_pct FROM rets)
 SELECT * FROM (SELECT 'best' AS side, *, row_number() OVER (PARTITION BY date ORDER BY close_pct DESC, entity) AS n FROM d) WHERE n <= 5
 UNION ALL SELECT * FROM (SELECT 'worst' AS side, *, row_number() OVER (PARTITION BY date ORDER BY close_pct, entity) AS n FROM d) WHERE n <= 5""")
def _(t):
    return va.movers(t.returns().withColumnRenamed("pct_chg", "close_pct"))


@query("directional_accuracy", "total:i correct:i accuracy_pct:f2", "VAL-09 AG-12", "validated",
       """SELECT count(*) AS total, count_if(predicted_return * actual_return > 0) AS correct, count_if(predicted_return * actual_return > 0) * 100.0 / count(*) AS accuracy_pct
 FROM validated WHERE date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'""")
def _(t):
    return va.directional_accuracy(validated(t).where(c("date").between("1998-01-01", "1998-12-31")), "predicted_return", "actual_return")


@query("price_errors", "n:i close_mae:f2 close_rmse:f2 direction_accuracy high_conf_accuracy high_conf_share min_confidence max_confidence", "VAL-10", "validated bars",
       """SELECT count(*) AS n, avg(abs(g)) AS close_mae, sqrt(avg(g * g)) AS close_rmse, avg(CAST(ok AS INTEGER)) AS direction_accuracy, avg(CASE WHEN confidence >= 0.7 THEN CAST(ok AS INTEGER) END) AS high_conf_accuracy,
 avg(CAST(confidence >= 0.7 AS INTEGER)) AS high_conf_share, min(confidence) AS min_confidence, max(confidence) AS max_confidence FROM (
 SELECT confidence, close * (1 + predicted_return / 100) - close * (1 + actual_return / 100) AS g, (predicted_return > 0) = (actual_return > 0) AS ok
 FROM validated v JOIN bars b ON b.entity = v.entity AND b.date = v.date WHERE actual_return IS NOT NULL)""")
def _(t):
    df = validated(t).join(t.bars().select(*KEYS, "close"), KEYS)
    return va.price_errors(df, "close", "predicted_return", "actual_return", "confidence")


@query("prediction_roster", "entity:i date:d confidence predicted_return", "VAL-11", "preds", "SELECT * FROM preds WHERE date = (SELECT max(date) FROM preds) ")
def _(t):
    return va.roster(t.preds())


@query("prediction_history", "entity:i date:d predicted_return", "VAL-11", "preds", "SELECT * FROM preds WHERE entity = 3 ORDER BY date DESC LIMIT 100")
def _(t):
    return va.history(t.preds(), 3)


# ------------------------------------------------------------------------------------------- backtest

_BT = bt.BacktestParams(max_positions=5, return_unit=1.0, position_size=0.001)
add_view(
    "sigret", "direct bars",
    f"""SELECT d.*, next_day_return AS actual_return_1day, next_3day_return AS actual_return_3day FROM direct d
 LEFT JOIN ({LABELS}) l ON l.entity = d.entity AND l.date = d.date""",
)
add_view(
    "slots", "sigret",
    """SELECT *, CASE WHEN signal_type LIKE '%BUY' THEN 1 ELSE -1 END * coalesce(actual_return_1day, 0) - 0.002 AS gain, actual_return_1day IS NULL AS skip FROM (
 SELECT *, row_number() OVER (PARTITION BY date ORDER BY signal_score DESC, entity) AS rn FROM sigret) WHERE rn <= 5""",
)
add_view(
    "equity", "slots",
    """SELECT *, coalesce(lag(capital) OVER (ORDER BY date), 1000000) AS start_capital, greatest(max(capital) OVER (ORDER BY date), 1000000) AS peak FROM (
 SELECT date, positions, day_return, product(1 + day_return) OVER (ORDER BY date) * 1000000 AS capital FROM (
  SELECT date, count(*) AS positions, coalesce(sum(CASE WHEN NOT skip THEN gain END), 0) * 0.001 AS day_return FROM slots GROUP BY date))""",
)
add_view(
    "trades", "slots equity",
    "SELECT s.*, coalesce(actual_return_1day, 0) AS actual_return, start_capital * 0.001 * gain AS pnl FROM slots s JOIN equity e ON e.date = s.date WHERE NOT skip",
)


def _signals_with_returns(t):
    labels = add_labels(t.bars()).select(*KEYS, c("next_day_return").alias("actual_return_1day"), c("next_3day_return").alias("actual_return_3day"))
    return sg.signals_from_predictions(t.preds()).join(labels, KEYS, "left")




@query("backtest_trades", "entity:i date:d signal_type:s actual_return pnl:f3 is_winner:b", "BT-01 SRT-03", "trades", "SELECT *, pnl > 0 AS is_winner FROM trades")
def _(t):
    return bt.backtest_trades(_signals_with_returns(t), _BT)


@query("equity_curve", "date:d positions:i capital:f2 cumulative_return peak:f2 drawdown", "BT-02 BT-03 WIN-08", "equity",
       "SELECT *, (capital / 1000000 - 1) * 100 AS cumulative_return, (peak - capital) / peak AS drawdown FROM equity")
def _(t):
    return bt.equity_curve(_signals_with_returns(t), _BT)


def _metrics_sql(basis: str) -> str:
    return f"""SELECT *, CASE WHEN sharpe >= 2 AND max_drawdown_pct < 10 THEN 'EXCELLENT' WHEN sharpe >= 1.5 AND max_drawdown_pct < 15 THEN 'GOOD' WHEN sharpe >= 1 AND max_drawdown_pct < 20 THEN 'MODERATE'
 WHEN sharpe >= 0.5 THEN 'FAIR' ELSE 'POOR' END AS rating FROM (
 SELECT n AS trades, w AS winners, n - w AS losers, w * 100.0 / n AS win_rate_pct, won / w AS avg_win, lost / (n - w) AS avg_loss, CASE WHEN lost > 0 THEN won / lost WHEN won > 0 THEN 'inf'::DOUBLE ELSE 0 END AS profit_factor,
  (k / 1000000 - 1) * 100 AS total_return_pct, (pow(k / 1000000, 250.0 / days) - 1) * 100 AS annual_return_pct, m * sqrt(250) / sd AS sharpe, dd * 100 AS max_drawdown_pct, days FROM
 (SELECT count(*) AS n, count_if(pnl > 0) AS w, sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END) AS won, sum(CASE WHEN pnl < 0 THEN -pnl ELSE 0 END) AS lost FROM trades) CROSS JOIN
 (SELECT count(*) AS days, last(capital ORDER BY date) AS k, max((peak - capital) / peak) AS dd, avg({basis}) AS m, stddev_samp({basis}) AS sd FROM equity))"""


_METRICS = "trades:i winners:i losers:i win_rate_pct avg_win:f3 avg_loss:f3 profit_factor total_return_pct:f4 annual_return_pct:f4 sharpe max_drawdown_pct days:i rating:s"


@query("backtest_metrics", _METRICS, "BT-04 BT-06", "trades equity", _metrics_sql("day_return"))
def _(t):
    s = _signals_with_returns(t)
    return bt.backtest_metrics(bt.backtest_trades(s, _BT), bt.equity_curve(s, _BT), _BT)


@query("backtest_metrics_cumulative", _METRICS, "BT-04", "trades equity", _metrics_sql("capital / 1000000 - 1"))
def _(t):
    from dataclasses import replace

    s, p = _signals_with_returns(t), replace(_BT, sharpe_basis="cumulative")
    return bt.backtest_metrics(bt.backtest_trades(s, p), bt.equity_curve(s, p), p)


@query("backtest_by_side", "side:s trades:i pnl:f2 winners:i direction_pct", "BT-05", "trades",
       """SELECT side, count(*) AS trades, sum(pnl) AS pnl, count_if(pnl > 0) AS winners, count_if(abs(actual_return) > 0.001 AND CASE WHEN side = 'buy' THEN actual_return > 0 ELSE actual_return < 0 END) * 100.0 / count_if(abs(actual_return) > 0.001) AS direction_pct
 FROM (SELECT *, CASE WHEN signal_type LIKE '%BUY' THEN 'buy' ELSE 'sell' END AS side FROM trades) GROUP BY side""")
def _(t):
    return bt.by_side(bt.backtest_trades(_signals_with_returns(t), _BT))


@query("extreme_trades", "side:s entity:i date:d pnl:f3", "BT-05 SRT-06", "trades",
       "SELECT * FROM (SELECT 'best' AS side, * FROM trades ORDER BY pnl DESC, date, entity LIMIT 5) UNION ALL SELECT * FROM (SELECT 'worst' AS side, * FROM trades ORDER BY pnl, date, entity LIMIT 5)")
def _(t):
    return bt.extreme_trades(bt.backtest_trades(_signals_with_returns(t), _BT))


@query("last_equity", "date:d capital:f2", "BT-05", "equity", "SELECT * FROM equity ORDER BY date DESC LIMIT 10")
def _(t):
    return bt.last_equity(bt.equity_curve(_signals_with_returns(t), _BT))


@query("attached_actuals", "entity:i date:d signal_type:s actual_return_1day signal_correct_1day:f0", "BT-07 UPS-09", "direct trades",
       """SELECT d.entity, d.date, d.signal_type, t.actual_return AS actual_return_1day, CASE WHEN t.actual_return IS NOT NULL THEN CASE WHEN d.signal_type LIKE '%BUY' THEN 1 ELSE -1 END * t.actual_return > 0 END AS signal_correct_1day
 FROM direct d LEFT JOIN trades t ON t.entity = d.entity AND t.date = d.date""")
def _(t):
    stored = sg.signals_from_predictions(t.preds()).withColumn("actual_return_1day", F.lit(None).cast("double"))
    return bt.attach_actuals(stored, bt.backtest_trades(_signals_with_returns(t), _BT))
