"""Grouped and conditional aggregates, top-k, correlation (AG-*, SRT-*)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.scalars import round_to
from barloom.operators.ranking import global_row_number, tie_ranks
from barloom.session import settle
from barloom.operators.windows import names, ratio

c = F.col


def sector_bars(bars: DataFrame, dim: DataFrame, group: str = "industry", key: str = "entity", ts: str = "date") -> DataFrame:
    """Mean prices and summed volume per group and date, rounded to cents."""
    return (
        bars.join(dim.select(key, group), key)
        .where(c(group).isNotNull())
        .groupBy(group, ts)
        .agg(
            *[round_to(F.avg(x), 2).alias(x) for x in ("open", "high", "low", "close")],
            *[round_to(F.sum(x), 2).alias(x) for x in ("volume", "amount")],
        )
    )


def segment_bars(bars: DataFrame, code: Column, width: int = 3, ts: str = "date") -> DataFrame:
    """The same per leading characters of the code."""
    return (
        bars.withColumn("segment", F.substring(code, 1, width))
        .groupBy("segment", ts)
        .agg(
            *[round_to(F.avg(x), 2).alias(x) for x in ("open", "high", "low", "close")],
            *[round_to(F.sum(x), 2).alias(x) for x in ("volume", "amount")],
        )
    )


def pearson(x: Column, y: Column) -> Column:
    """Correlation, 0 when either side does not vary."""
    return F.coalesce(F.corr(x, y), F.lit(0.0))


def ic(df: DataFrame, pred: str, target: str) -> DataFrame:
    """Information coefficient: Pearson and Spearman (average ranks) over the whole table, in one row."""
    pairs = df.where(c(pred).isNotNull() & c(target).isNotNull()).select(c(pred).cast("double").alias("_p"), c(target).cast("double").alias("_t"))
    pairs = settle(pairs)  # range bounds are sampled: evaluate the input once
    ranked = tie_ranks(tie_ranks(pairs, [], "_p", "_rp"), [], "_t", "_rt")
    return ranked.agg(
        F.count(F.lit(1)).alias("n"),
        pearson(c("_p"), c("_t")).alias("pearson"),
        pearson(c("_rp"), c("_rt")).alias("spearman"),
    )


def top_n(df: DataFrame, by: str | Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each group; Spark trims each map task to n rows before the shuffle."""
    w = Window.partitionBy(*names(by)).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(c("rank") <= n)


def first_per_key(df: DataFrame, key: str | Sequence[str], order: Sequence[Column], limit: int) -> DataFrame:
    """Best row of each key, then the best ``limit`` of those."""
    return top_n(df, key, order, 1).drop("rank").orderBy(*order).limit(limit)


def best_and_worst(df: DataFrame, value: str, ties: Sequence[str], n: int = 5) -> DataFrame:
    best = df.orderBy(c(value).desc_nulls_last(), *ties).limit(n).withColumn("side", F.lit("best"))
    worst = df.orderBy(c(value).asc_nulls_last(), *ties).limit(n).withColumn("side", F.lit("worst"))
    return best.unionByName(worst)


def topk_stats(
    df: DataFrame, pred: str, target: str, points: Sequence[float], ties: Sequence[str]
) -> DataFrame:
    """Accuracy of direction and mean target among the k = max(1, floor(n p)) largest |pred|, per p.

    Zero counts as positive.  Ranks come from a range partitioning, not from a single-task window.
    """
    rows = df.where(c(pred).isNotNull() & c(target).isNotNull()).select(pred, target, *[t for t in ties if t not in (pred, target)])
    ranked = global_row_number(rows, [F.abs(c(pred)).desc(), *[c(t) for t in ties]], "rn")
    n = rows.agg(F.count(F.lit(1))).scalar()
    hit = ((c(pred) >= 0) == (c(target) >= 0)).cast("int")
    levels = F.array(*[F.lit(float(p)) for p in points if 0 < p <= 1])
    k = F.greatest(F.lit(1), F.floor(c("n") * c("p")))
    return (
        ranked.withColumn("n", n)
        .withColumn("p", F.explode(levels))
        .where(c("rn") <= k)
        .groupBy("p")
        .agg(
            F.count(F.lit(1)).alias("k"),
            F.avg(hit).alias("accuracy"),
            F.avg(target).alias("mean_return"),
        )
    )


def win_rate(hit: Column, total: Column | None = None) -> Column:
    """Percent of rows for which ``hit`` holds."""
    return ratio(F.count_if(hit) * 100.0, total if total is not None else F.count(F.lit(1)))


def rows_per_key(df: DataFrame, key: str = "entity") -> DataFrame:
    """How many rows the keys have: number of keys, rows, min / mean / max per key."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(
        F.count(F.lit(1)).alias("keys"),
        F.sum("n").alias("rows"),
        F.min("n").alias("min_rows"),
        F.avg("n").alias("avg_rows"),
        F.max("n").alias("max_rows"),
    )
