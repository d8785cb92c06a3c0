"""Predictions to signals (SG-01..07)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.scalars import contains_any, in_band
from barloom.functions.scores import direct_signal, side, signal_score, signal_type

c = F.col

TECHNICAL = ("rsi_14", "macd_histogram", "bb_percent_b", "volume_ratio", "price_momentum_5", "adx_14")
VALUE = ("total_mv", "pe_ttm", "pb")


@dataclass(frozen=True)
class SignalParams:
    min_confidence: float = 0.6
    min_buy: float = 0.5
    max_sell: float = -0.5
    min_volume_ratio: float = 0.0
    exclude_st: bool = True
    industries: str | None = None
    min_cap: float | None = None
    max_cap: float | None = None
    use_3day: bool = False


def signal_context(preds: DataFrame, dim: DataFrame, feats: DataFrame) -> DataFrame:
    """Predictions with the entity's name and industry and the same day's indicators (left joins)."""
    cols = [n for n in (*TECHNICAL, *VALUE) if n in feats.columns]
    return preds.join(dim.select("entity", "name", "industry"), "entity", "left").join(
        feats.select("entity", "date", *cols), ["entity", "date"], "left"
    )


def score_signals(context: DataFrame, p: SignalParams = SignalParams()) -> DataFrame:
    """Filter, type and score; HOLD rows go.  Unsorted: order by score where it is read."""
    df = context.where(c("confidence") >= p.min_confidence)
    if p.exclude_st:
        df = df.where(~F.coalesce(F.contains(c("name"), F.lit("ST")), F.lit(False)))
    df = df.where(c("volume_ratio").isNull() | (c("volume_ratio") >= p.min_volume_ratio))
    if p.industries:
        df = df.where(contains_any(c("industry"), F.lit(p.industries)))
    if p.min_cap is not None or p.max_cap is not None:
        df = df.where(in_band(c("total_mv"), p.min_cap, p.max_cap))
    ret = c("predicted_return")
    if p.use_3day:
        ret = F.coalesce("predicted_3day_return", ret)
    kind = signal_type(ret, c("confidence"), c("rsi_14"), c("macd_histogram"), c("bb_percent_b"), p.min_buy, p.max_sell)
    score = signal_score(
        c("signal_type"), ret, c("confidence"), c("rsi_14"), c("macd_histogram"), c("volume_ratio"), c("adx_14")
    )
    return df.withColumn("signal_type", kind).where(c("signal_type") != "HOLD").withColumn("signal_score", score)


def generate_signals(preds: DataFrame, dim: DataFrame, feats: DataFrame, params: SignalParams = SignalParams()) -> DataFrame:
    return score_signals(signal_context(preds, dim, feats), params)


def stored_signals(signals: DataFrame, n: int, kind: str | None = None) -> DataFrame:
    rows = signals if kind is None else signals.where(c("signal_type") == kind)
    return rows.orderBy(c("signal_score").desc_nulls_last(), "entity", "date").limit(n)


def signal_summary(signals: DataFrame) -> DataFrame:
    """Counts by type, mean predicted return of each side, mean confidence and score."""
    kinds = ("STRONG_BUY", "BUY", "SELL", "STRONG_SELL")
    s = side(c("signal_type"))
    return signals.agg(
        F.count(F.lit(1)).alias("signals"),
        *[F.count_if(c("signal_type") == k).alias(k.lower()) for k in kinds],
        F.avg(F.when(s > 0, c("predicted_return"))).alias("mean_buy_return"),
        F.avg(F.when(s < 0, c("predicted_return"))).alias("mean_sell_return"),
        F.avg("confidence").alias("mean_confidence"),
        F.avg("signal_score").alias("mean_score"),
    )


def top_picks(signals: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` best buys of a run by score."""
    return stored_signals(signals.where(side(c("signal_type")) > 0), n)


def signals_from_predictions(preds: DataFrame, min_confidence: float = 0.6, long_only: bool = False) -> DataFrame:
    df = preds.where(c("predicted_return").isNotNull() & (c("confidence") >= min_confidence))
    if long_only:
        df = df.where(c("predicted_return") > 0)
    return (
        df.withColumns(
            {
                "signal_type": direct_signal(c("predicted_return"), c("confidence")),
                "signal_score": F.abs("predicted_return") * 10 + c("confidence") * 50,
            }
        )
        .where(c("signal_type") != "HOLD")
    )
