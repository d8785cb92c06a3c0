"""Cross-sectional treatment of labels (L-03)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.ranking import exact_percentiles

PERIODS = {"month": "yyyyMM", "year": "yyyy"}


def winsorize(df: DataFrame, col: str, pct: float = 0.025, by: str = "month", ts: str = "date") -> DataFrame:
    """Clamp a column to the [pct, 1 - pct] percentiles of its calendar month; nulls stay null.

    The bounds are exact and come from ranks over range partitions, so a month that holds a third of the
    rows is still spread over the cluster.
    """
    period = F.date_format(ts, PERIODS[by])
    marked = df.withColumn("_period", period)
    bounds = exact_percentiles(marked.select("_period", col), ["_period"], col, {"_low": pct, "_high": 1 - pct})
    clamped = F.when(F.col(col).isNotNull(), F.least(F.greatest(col, "_low"), F.col("_high")))
    return marked.join(bounds, "_period", "left").withColumn(col, clamped).select(*df.columns)
