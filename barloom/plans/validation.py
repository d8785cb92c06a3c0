"""Predictions against what happened (VAL-01..11)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.scalars import round_to
from barloom.operators.aggregates import top_n
from barloom.operators.windows import ordered, ratio

c = F.col


def outcomes(bars: DataFrame, horizon: int = 1, key: str = "entity", ts: str = "date") -> DataFrame:
    """Percent return and direction ``horizon`` rows later; rows without a later bar are left out."""
    later = F.lead("close", horizon).over(ordered(key, ts))
    return (
        bars.select(key, ts, "close", later.alias("_later"))
        .where(c("_later").isNotNull())
        .select(
            key, ts,
            (ratio(c("_later") - c("close"), c("close")) * 100).alias("_ret"),
            (c("_later") > c("close")).alias("_up"),
        )
    )


def validate(preds: DataFrame, bars: DataFrame, horizon: int = 1, pending_only: bool = True, key: str = "entity", ts: str = "date") -> DataFrame:
    """Fill actual return, direction and correctness of every prediction that can be judged.

    A row is judged with its own direction and version.  With ``pending_only`` rows judged before keep their
    values; a row without a later bar stays open.
    """
    tag = "" if horizon == 1 else f"{horizon}day_"
    ret, up, ok = f"actual_{tag}return", f"actual_{tag}direction", ("prediction_correct" if horizon == 1 else f"prediction_{tag}correct")
    said = "predicted_direction" if horizon == 1 else f"predicted_{tag}direction"
    have = set(preds.columns)
    old = {n: (c(n) if n in have else F.lit(None).cast(t)) for n, t in ((ret, "double"), (up, "boolean"), (ok, "boolean"))}
    known = outcomes(bars, horizon, key, ts).withColumnsRenamed({"_ret": "_new_ret", "_up": "_new_up"})
    joined = preds.join(known, [key, ts], "left").withColumns({f"_old_{n}": v for n, v in old.items()})
    take = c("_new_ret").isNotNull()
    if pending_only:
        take = take & c(f"_old_{up}").isNull()
    fresh = {ret: c("_new_ret"), up: c("_new_up"), ok: c(said) == c("_new_up")}
    out = joined.withColumns({n: F.when(take, v).otherwise(c(f"_old_{n}")) for n, v in fresh.items()})
    rest = [n for n in preds.columns if n not in fresh]
    return out.select(*rest, *fresh)


def validation_stats(validated: DataFrame, high: float = 0.7) -> DataFrame:
    """Accuracy, mean predicted and actual return, mean absolute error, bias, and the confident subset."""
    df = validated.where(c("actual_return").isNotNull())
    sure = c("confidence") > high
    err = c("predicted_return") - c("actual_return")
    return df.agg(
        F.count(F.lit(1)).alias("validated"),
        F.count_if("prediction_correct").alias("correct"),
        F.count_if(~c("prediction_correct")).alias("incorrect"),
        (F.avg(c("prediction_correct").cast("int")) * 100).alias("accuracy_pct"),
        F.avg("predicted_return").alias("avg_predicted"),
        F.avg("actual_return").alias("avg_actual"),
        F.avg(F.abs(err)).alias("mae"),
        F.avg(err).alias("bias"),
        F.count_if(sure).alias("high_total"),
        F.count_if(sure & c("prediction_correct")).alias("high_correct"),
    )


def calibration(validated: DataFrame, bins: int = 10) -> DataFrame:
    """Accuracy per confidence bucket."""
    bucket = F.least(F.floor(c("confidence") * bins), F.lit(bins - 1))
    return (
        validated.where(c("actual_return").isNotNull())
        .groupBy(bucket.alias("bucket"))
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if("prediction_correct").alias("correct"),
            (F.avg(c("prediction_correct").cast("int")) * 100).alias("accuracy_pct"),
        )
    )


def regression_metrics(df: DataFrame, pred: str = "predicted_return", actual: str = "actual_return") -> DataFrame:
    err = c(pred) - c(actual)
    return df.where(c(pred).isNotNull() & c(actual).isNotNull()).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(err * err).alias("mse"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(F.abs(err)).alias("mae"),
        F.avg(((c(pred) > 0) == (c(actual) > 0)).cast("int")).alias("direction_accuracy"),
    )


def label_distribution(df: DataFrame, label: str = "next_day_return", ts: str = "date") -> DataFrame:
    """Per date: mean, deviation and range of the label and the shares of rises, falls and unchanged."""
    pct = lambda cond: F.avg(cond.cast("int")) * 100
    return df.where(c(label).isNotNull()).groupBy(ts).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(label).alias("mean"),
        F.stddev_pop(label).alias("std"),
        F.min(label).alias("min"),
        F.max(label).alias("max"),
        pct(c(label) > 0).alias("up_pct"),
        pct(c(label) < 0).alias("down_pct"),
        pct(c(label) == 0).alias("flat_pct"),
    )


def movers(df: DataFrame, col: str = "close_pct", n: int = 5, ts: str = "date") -> DataFrame:
    """The n largest gains and losses of every date."""
    best = top_n(df, ts, [c(col).desc_nulls_last(), c("entity")], n).withColumn("side", F.lit("best"))
    return best.unionByName(top_n(df, ts, [c(col).asc_nulls_last(), c("entity")], n).withColumn("side", F.lit("worst")))


def directional_accuracy(df: DataFrame, pred: str, actual: str) -> DataFrame:
    """Share of rows whose signs agree strictly; a zero on either side counts as a miss."""
    agree = ((c(pred) > 0) & (c(actual) > 0)) | ((c(pred) < 0) & (c(actual) < 0))
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(agree).alias("correct"),
        round_to(ratio(F.count_if(agree) * 100.0, F.count(F.lit(1))), 2).alias("accuracy_pct"),
    )


def price_errors(df: DataFrame, base: str, pred_pct: str, actual_pct: str, confidence: str, high: float = 0.7) -> DataFrame:
    """Errors in price space: both percents applied to the same base price."""
    gap = c(base) * (1 + c(pred_pct) / 100) - c(base) * (1 + c(actual_pct) / 100)
    right = (c(pred_pct) > 0) == (c(actual_pct) > 0)
    sure = c(confidence) >= high
    return df.where(c(actual_pct).isNotNull() & c(pred_pct).isNotNull()).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(gap)).alias("close_mae"),
        F.sqrt(F.avg(gap * gap)).alias("close_rmse"),
        F.avg(right.cast("int")).alias("direction_accuracy"),
        F.coalesce(F.avg(F.when(sure, right.cast("int"))), F.lit(0.0)).alias("high_conf_accuracy"),
        F.avg(sure.cast("int")).alias("high_conf_share"),
        F.min(confidence).alias("min_confidence"),
        F.max(confidence).alias("max_confidence"),
    )


def roster(preds: DataFrame, ts: str = "date", n: int | None = None) -> DataFrame:
    """All predictions of the newest date, most confident first; ``n`` keeps the first n."""
    latest = preds.where(c(ts) == preds.agg(F.max(ts)).scalar())
    ranked = latest.orderBy(c("confidence").desc_nulls_last(), "entity")
    return ranked if n is None else ranked.limit(n)


def history(preds: DataFrame, entity, n: int = 100, ts: str = "date") -> DataFrame:
    return preds.where(c("entity") == entity).orderBy(c(ts).desc()).limit(n)
