"""Daily top-n portfolio simulation as sums and running products (BT-01..07)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barloom.functions.scores import risk_rating, side
from barloom.operators.aggregates import best_and_worst, top_n
from barloom.operators.windows import ratio
from barloom.sources.upsert import update_from

c = F.col


@dataclass(frozen=True)
class BacktestParams:
    initial_capital: float = 1_000_000.0
    position_size: float = 0.1
    max_positions: int = 10
    cost: float = 0.001
    use_3day: bool = False
    return_unit: float = 100.0  # 100: returns are percents; 1: fractions
    sharpe_basis: str = "daily"  # or 'cumulative'


def _dates() -> WindowSpec:
    """One row per date goes in: this window covers the calendar, never the panel."""
    return Window.orderBy("date")


def _so_far() -> WindowSpec:
    return _dates().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _slots(signals: DataFrame, p: BacktestParams) -> DataFrame:
    """The best-scored signals of each date, with the return each would earn per unit of position."""
    chosen = top_n(signals, "date", [c("signal_score").desc_nulls_last(), c("entity")], p.max_positions)
    ret = c("actual_return_3day") if p.use_3day else c("actual_return_1day")
    actual = F.coalesce(ret, F.lit(0.0))
    skipped = (F.abs(actual) < 1e-10) & c("actual_return_1day").isNull()
    return chosen.withColumns({"actual_return": actual, "_skip": skipped}).withColumn(
        "_gain", side(c("signal_type")) * c("actual_return") / p.return_unit - 2 * p.cost
    )


def equity_curve(signals: DataFrame, p: BacktestParams = BacktestParams()) -> DataFrame:
    """Capital after each date (compounded), cumulative percent return, running peak and drawdown."""
    daily = _slots(signals, p).groupBy("date").agg(
        F.count(F.lit(1)).alias("positions"),
        (F.coalesce(F.sum(F.when(~c("_skip"), c("_gain"))), F.lit(0.0)) * p.position_size).alias("day_return"),
    )
    capital = F.product(c("day_return") + 1).over(_so_far()) * p.initial_capital
    return (
        daily.withColumn("capital", capital)
        .withColumn("start_capital", F.coalesce(F.lag("capital", 1).over(_dates()), F.lit(p.initial_capital)))
        .withColumn("peak", F.greatest(F.max("capital").over(_so_far()), F.lit(p.initial_capital)))
        .withColumns(
            {
                "drawdown": ratio(c("peak") - c("capital"), c("peak")),
                "cumulative_return": (c("capital") / p.initial_capital - 1) * 100,
            }
        )
    )


def backtest_trades(signals: DataFrame, p: BacktestParams = BacktestParams()) -> DataFrame:
    """One row per executed trade with its profit on the capital of its date."""
    start = equity_curve(signals, p).select("date", "start_capital")
    return (
        _slots(signals, p)
        .where(~c("_skip"))
        .join(start, "date")
        .withColumn("pnl", c("start_capital") * p.position_size * c("_gain"))
        .withColumn("is_winner", c("pnl") > 0)
        .drop("_skip", "_gain", "rank", "start_capital")
    )


def backtest_metrics(trades: DataFrame, equity: DataFrame, p: BacktestParams = BacktestParams()) -> DataFrame:
    """Return, annualised return, Sharpe, drawdown, win rate, mean win and loss, profit factor (one row)."""
    t = trades.agg(
        F.count(F.lit(1)).alias("trades"),
        F.count_if("is_winner").alias("winners"),
        F.coalesce(F.sum(F.when(c("pnl") > 0, c("pnl"))), F.lit(0.0)).alias("_won"),
        F.coalesce(F.sum(F.when(c("pnl") < 0, -c("pnl"))), F.lit(0.0)).alias("_lost"),
    )
    basis = c("day_return") if p.sharpe_basis == "daily" else c("capital") / p.initial_capital - 1
    e = equity.agg(
        F.count(F.lit(1)).alias("days"),
        F.max_by("capital", "date").alias("final_capital"),
        (F.max("drawdown") * 100).alias("max_drawdown_pct"),
        F.avg(basis).alias("_mean"),
        F.stddev_samp(basis).alias("_sd"),
    )
    packed = e.select(F.struct(*e.columns)).scalar()
    growth = c("final_capital") / p.initial_capital
    return (
        t.withColumn("_e", packed)
        .select("*", "_e.*")
        .select(
            "trades",
            "winners",
            (c("trades") - c("winners")).alias("losers"),
            F.coalesce(ratio(c("winners") * 100.0, c("trades")), F.lit(0.0)).alias("win_rate_pct"),
            F.coalesce(ratio(c("_won"), c("winners").cast("double")), F.lit(0.0)).alias("avg_win"),
            F.coalesce(ratio(c("_lost"), (c("trades") - c("winners")).cast("double")), F.lit(0.0)).alias("avg_loss"),
            F.when(c("_lost") > 0, c("_won") / c("_lost")).when(c("_won") > 0, float("inf")).otherwise(0.0).alias("profit_factor"),
            ((growth - 1) * 100).alias("total_return_pct"),
            ((F.pow(growth, F.lit(250.0) / c("days")) - 1) * 100).alias("annual_return_pct"),
            F.coalesce(ratio(c("_mean") * (250.0**0.5), c("_sd")), F.lit(0.0)).alias("sharpe"),
            "max_drawdown_pct",
            "days",
            "final_capital",
        )
        .withColumn("rating", risk_rating(c("sharpe"), c("max_drawdown_pct")))
    )


def by_side(trades: DataFrame) -> DataFrame:
    """Trades, profit, winners and accuracy of direction (moves over 0.001 only) of buys and sells."""
    real = F.abs("actual_return") > 0.001
    right = F.when(c("side") == "buy", c("actual_return") > 0).otherwise(c("actual_return") < 0)
    return (
        trades.withColumn("side", F.when(side(c("signal_type")) > 0, "buy").otherwise("sell"))
        .groupBy("side")
        .agg(
            F.count(F.lit(1)).alias("trades"),
            F.sum("pnl").alias("pnl"),
            F.count_if("is_winner").alias("winners"),
            F.count_if(real).alias("moved"),
            F.count_if(real & right).alias("right"),
        )
        .withColumn("direction_pct", ratio(c("right") * 100.0, c("moved")))
    )


def extreme_trades(trades: DataFrame, n: int = 5) -> DataFrame:
    return best_and_worst(trades, "pnl", ["date", "entity"], n)


def last_equity(equity: DataFrame, n: int = 10) -> DataFrame:
    return equity.orderBy(c("date").desc()).limit(n)


def attach_actuals(stored: DataFrame, trades: DataFrame) -> DataFrame:
    """Write actual returns into stored signals that have none yet, with their correctness."""
    keys = ["entity", "date", "signal_type"]
    found = trades.select(*keys, c("actual_return").alias("actual_return_1day"))
    out = update_from(stored, found, keys, ["actual_return_1day"], only_null=True)
    return out.withColumn(
        "signal_correct_1day",
        F.when(c("actual_return_1day").isNotNull(), side(c("signal_type")) * c("actual_return_1day") > 0),
    )
