"""Windows over entities too long for one task.

A daily panel never needs this: an entity has one row per trading day.  For finer bars, or when one entity
holds a large share of all rows, its rows are numbered without gathering them, cut into blocks of ``size``
rows, and each block receives copies of the ``overlap`` rows before it (and ``ahead`` rows after it).  Any
feature whose frames fit the overlap then comes out the same from windows keyed (entity, block), and
running sums add the totals of the earlier blocks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.windows import running
from barloom.session import settle_by

c = F.col


def add_row_index(df: DataFrame, key: str = "entity", ts: str = "date", period: str = "month", rows: int = 0) -> DataFrame:
    """``_row``: 1..n per entity in time order.

    Rows are counted per (entity, period) first; only those counts are summed along the entity, and row
    numbers are taken inside a period, so no task sees more than one period of one entity.  ``df`` is evaluated once and
    stored by entity and period, where rows are counted, numbered and given their start; ``rows``: see ``parts_of``.
    """
    marked = settle_by(df.withColumn("_period", F.date_trunc(period, ts)), (key, "_period"), ts, rows)
    sizes = marked.groupBy(key, "_period").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(key).orderBy("_period").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(key, "_period", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(key, "_period").orderBy(ts))
    return marked.join(starts, [key, "_period"]).withColumn("_row", c("_start") + inside).drop("_period", "_start")


def in_blocks(
    df: DataFrame,
    build: Callable[[DataFrame, tuple[str, str]], DataFrame],
    size: int = 4096,
    overlap: int = 260,
    ahead: int = 3,
    key: str = "entity",
    ts: str = "date",
    period: str = "month",
    rows: int = 0,
) -> DataFrame:
    """Run ``build(df, key_columns)`` on blocks of each entity and keep every row once.

    ``overlap`` must cover the longest trailing frame and warm-up, ``ahead`` the longest lead, both at most
    ``size``.
    """
    if max(overlap, ahead) > size:
        raise ValueError("overlap and ahead must not exceed the block size")
    place = (c("_row") - 1) % size
    home = F.floor((c("_row") - 1) / size)
    homes = F.array_compact(
        F.array(home, F.when(place >= size - overlap, home + 1), F.when((place < ahead) & (home > 0), home - 1))
    )
    spread = (
        add_row_index(df, key, ts, period, rows)
        .withColumns({"_home": home, "_homes": homes})
        .withColumn("_block", F.explode("_homes"))
        .withColumn("_own", c("_block") == c("_home"))
        .drop("_homes", "_home")
    )
    return build(spread, (key, "_block")).where("_own").drop("_own", "_block", "_row")


def running_sum_in_blocks(
    df: DataFrame, value: str, out: str, size: int = 4096, key: str = "entity", ts: str = "date", period: str = "month", rows: int = 0
) -> DataFrame:
    """Running sum along each entity: a running sum per block plus the totals of the blocks before."""
    cut = add_row_index(df, key, ts, period, rows).withColumn("_block", F.floor((c("_row") - 1) / size))
    totals = cut.groupBy(key, "_block").agg(F.sum(value).alias("_total"))
    earlier = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(key, "_block", F.coalesce(F.sum("_total").over(earlier), F.lit(0.0)).alias("_before"))
    local = F.sum(value).over(running((key, "_block"), ts))
    return cut.join(offsets, [key, "_block"]).withColumn(out, c("_before") + local).drop("_row", "_block", "_before")
