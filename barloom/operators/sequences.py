"""Sliding sequences per entity (SEQ-01..03) and time-decay weights (VEC-06)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.windows import names, ordered, whole

c = F.col


def make_sequences(
    df: DataFrame, cols: Sequence[str], length: int, target: str | None = None, shift: int = 0,
    drop_last: bool = False, key: str = "entity", ts: str = "date",
) -> DataFrame:
    """L consecutive rows of one entity as ``seq`` (array of L rows x columns).

    shift=0 ends each sequence at the current row; shift=1 ends it one row earlier, so that ``target`` of the
    current row is what follows the sequence.  ``drop_last`` leaves out the newest window of each entity,
    which gives n - L samples per entity.  A frame holds at most ``length`` rows; sequences never cross
    entities.
    """
    w = ordered(key, ts)
    frame = w.rowsBetween(-(length - 1) - shift, -shift)
    row = F.array(*[F.coalesce(c(x).cast("double"), F.lit(0.0)) for x in cols])
    out = df.withColumn("seq", F.collect_list(row).over(frame))
    if drop_last:
        out = out.withColumn("_newest", F.max(ts).over(whole(key)))
    out = out.where(F.size("seq") == length)
    if drop_last:
        out = out.where(c(ts) < c("_newest"))
    keep = [*names(key), ts, "seq"] + ([target] if target else [])
    return out.select(*keep)


def shift_inputs(df: DataFrame, labels: str | None = None) -> DataFrame:
    """Split L+1 rows into inputs (all but the last) and next-step targets (all but the first)."""
    n = F.size("seq") - 1
    out = df.withColumns({"inputs": F.slice(c("seq"), F.lit(1), n), "targets": F.slice(c("seq"), F.lit(2), n)})
    return out.withColumn("aligned", F.slice(c(labels), F.lit(2), n)) if labels else out


def time_decay_weight(df: DataFrame, lam: float, norm: str = "mean", ts: str = "date") -> DataFrame:
    """exp(-lam x age in days) against the newest date, divided by the mean or the sum of all weights."""
    newest = df.agg(F.max(ts)).scalar()
    weight: Column = F.exp(F.datediff(newest, c(ts)) * F.lit(-float(lam)))
    weighted = df.withColumn("weight", weight)
    total = weighted.agg(F.avg("weight") if norm == "mean" else F.sum("weight")).scalar()
    return weighted.withColumn("weight", F.try_divide(c("weight"), total))


def complete_windows(df: DataFrame, length: int, key: str = "entity") -> DataFrame:
    """How many sequences of a length each entity yields (n - L), without building them."""
    n = df.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    return n.withColumn("samples", F.greatest(c("rows") - length, F.lit(0)))


