"""Rule scores and signals as column expressions (SC-01, SG-02, SG-03, BT-06)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barloom.functions.scalars import clamp
from barloom.functions.vectors import denormalize_pct


def rule_score(v: Column) -> Column:
    """Reversal (±0.5 on an oversold fall / overbought rise) plus half the momentum, clamped to ±3."""
    move, rsi, momentum = denormalize_pct(v[12]), v[33] * 100, v[48] * 0.2
    reversal = (
        F.when((move < -2) & (rsi < 30), 0.5).when((move > 2) & (rsi > 70), -0.5).otherwise(0.0)
    )
    return clamp(reversal + momentum * 0.5, -3, 3)


def rule_direction(score: Column, band: float = 0.2) -> Column:
    return F.when(score > band, 1).when(score < -band, -1).otherwise(0)


def rule_confidence(v: Column) -> Column:
    """Higher at RSI extremes, lower in a volatile regime (slot 100)."""
    rsi = v[33] * 100
    extreme = F.when((rsi < 20) | (rsi > 80), 0.8).otherwise(0.4)
    calm = F.when(v[100] > 0.7, 0.6).otherwise(0.9)
    return clamp(extreme * calm, 0, 1)


def _points(*rules: tuple[Column, int]) -> Column:
    """Value of the first rule that holds, else 0 (a null input holds for none)."""
    out = F
    for cond, value in rules:
        out = out.when(cond, value)
    return out.otherwise(0)


def signal_type(
    ret: Column, confidence: Column, rsi: Column, macd_hist: Column, percent_b: Column,
    min_buy: float = 0.5, max_sell: float = -0.5,
) -> Column:
    """STRONG_BUY / BUY / STRONG_SELL / SELL / HOLD from a predicted return and technical points."""
    buy = (
        _points((rsi < 30, 2), (rsi < 40, 1)) + _points((macd_hist > 0, 1)) + _points((percent_b < 0.2, 1))
    )
    sell = (
        _points((rsi > 70, 2), (rsi > 60, 1)) + _points((macd_hist < 0, 1)) + _points((percent_b > 0.8, 1))
    )
    return (
        F.when((ret >= min_buy * 2) & (confidence >= 0.7) & (buy >= 2), "STRONG_BUY")
        .when((ret >= min_buy) & (confidence >= 0.6), "BUY")
        .when((ret <= max_sell * 2) & (confidence >= 0.7) & (sell >= 2), "STRONG_SELL")
        .when((ret <= max_sell) & (confidence >= 0.6), "SELL")
        .otherwise("HOLD")
    )


def signal_score(
    kind: Column, ret: Column, confidence: Column, rsi: Column, macd_hist: Column, volume_ratio: Column, adx: Column
) -> Column:
    """0..100 from return size (30 %), confidence (50 %) and technical agreement (20 %)."""
    long, short = kind.isin("STRONG_BUY", "BUY"), kind.isin("STRONG_SELL", "SELL")
    zero = F.lit(0.0)
    by_rsi = F.when(long & (rsi < 40), (40 - rsi) * 0.5).when(short & (rsi > 60), (rsi - 60) * 0.5).otherwise(zero)
    by_macd = F.when((long & (macd_hist > 0)) | (short & (macd_hist < 0)), 5.0).otherwise(zero)
    by_volume = F.when(volume_ratio > 1.5, 10.0).when(volume_ratio > 1.0, 5.0).otherwise(zero)
    by_trend = F.when(adx > 25, (adx - 25) * 0.2).otherwise(zero)
    technical = by_rsi + by_macd + by_volume + by_trend
    return clamp(F.abs(ret) * 10 * 0.3 + confidence * 100 * 0.5 + technical * 0.2, 0, 100)


def direct_signal(ret: Column, confidence: Column) -> Column:
    """Signal straight from a prediction, without technical points."""
    return (
        F.when((ret >= 1.0) & (confidence >= 0.7), "STRONG_BUY")
        .when((ret >= 0.5) & (confidence >= 0.6), "BUY")
        .when((ret <= -1.0) & (confidence >= 0.7), "STRONG_SELL")
        .when((ret <= -0.5) & (confidence >= 0.6), "SELL")
        .otherwise("HOLD")
    )


def side(kind: Column) -> Column:
    """+1 for buys, -1 for sells, else 0."""
    return F.when(kind.isin("STRONG_BUY", "BUY"), 1.0).when(kind.isin("STRONG_SELL", "SELL"), -1.0).otherwise(0.0)


def risk_rating(sharpe: Column, max_drawdown_pct: Column) -> Column:
    return (
        F.when((sharpe >= 2.0) & (max_drawdown_pct < 10), "EXCELLENT")
        .when((sharpe >= 1.5) & (max_drawdown_pct < 15), "GOOD")
        .when((sharpe >= 1.0) & (max_drawdown_pct < 20), "MODERATE")
        .when(sharpe >= 0.5, "FAIR")
        .otherwise("POOR")
    )
