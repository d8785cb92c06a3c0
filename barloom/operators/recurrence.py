"""Linear recurrences as affine maps composed by a prefix scan.

x[t] = a[t] x[t-1] + b[t] along an entity is the map (a[t], b[t]) applied to the state before, and two maps compose to
(a2 a1, a2 b1 + b2).  A row's state is the composition of all maps up to it.  Rows are numbered without gathering an
entity and cut into blocks; inside a block the compositions of 1, 2, 4, ... rows are built by doubling, each stage a
lag over one window.  The maps of whole blocks are composed in the same way, and each block's rows are applied to
the state before the block.  Everything is a Spark expression, and an entity with a third of all rows lies in as many
tasks as it has blocks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.blocks import add_row_index
from barloom.operators.windows import Steps

c = F.col

SIZE = 64


def composed_steps(maps: Sequence[tuple[str, str]], rows: int, by: Sequence[str], at: str) -> Steps:
    """Columns (a, b) of each row replaced by the composition of its map with all before it, ``rows`` at most."""
    w = Window.partitionBy(*by).orderBy(at)
    steps: Steps = []
    reach = 1
    while reach < rows:
        stage: dict[str, Column] = {}
        for a, b in maps:
            stage[a] = c(a) * F.coalesce(F.lag(a, reach).over(w), F.lit(1.0))
            stage[b] = c(a) * F.coalesce(F.lag(b, reach).over(w), F.lit(0.0)) + c(b)
        steps.append(stage)
        reach *= 2
    return steps


def _scanned(cut: DataFrame, wanted: Mapping[str, tuple[Column, Column]], longest: int, size: int, key: str) -> DataFrame:
    maps = [(f"__a_{n}", f"__b_{n}") for n in wanted]
    known = {n: a.isNotNull() & b.isNotNull() for n, (a, b) in wanted.items()}
    made = {f"__a_{n}": F.when(known[n], a.cast("double")).otherwise(1.0) for n, (a, b) in wanted.items()}
    made |= {f"__b_{n}": F.when(known[n], b.cast("double")).otherwise(0.0) for n, (a, b) in wanted.items()}
    rows = cut.withColumns(made)
    for stage in composed_steps(maps, min(size, longest), (key, "_block"), "_row"):
        rows = rows.withColumns(stage)
    blocks = -(-longest // size)
    if blocks <= 1:
        return rows.withColumnsRenamed({b: n for (_, b), n in zip(maps, wanted, strict=True)}).drop(*[a for a, _ in maps])
    last = F.max_by(F.struct(*[x for m in maps for x in m]), "_row").alias("m")
    ends = rows.groupBy(key, "_block").agg(last).select(key, "_block", "m.*")
    for stage in composed_steps(maps, blocks, (key,), "_block"):
        ends = ends.withColumns(stage)
    before = Window.partitionBy(key).orderBy("_block")
    ends = ends.select(key, "_block", *[F.coalesce(F.lag(b).over(before), F.lit(0.0)).alias(f"__x_{n}") for (_, b), n in zip(maps, wanted, strict=True)])
    out = rows.join(ends, [key, "_block"])
    out = out.withColumns({n: c(f"__a_{n}") * c(f"__x_{n}") + c(f"__b_{n}") for n in wanted})
    return out.drop(*[x for m in maps for x in m], *[f"__x_{n}" for n in wanted])


def linear_recurrences(
    df: DataFrame, *stages: Mapping[str, tuple[Column, Column]], size: int = SIZE, key: str = "entity", ts: str = "date", period: str = "month"
) -> DataFrame:
    """Columns ``name: (a, b)`` with x[t] = a[t] x[t-1] + b[t] along each entity, from x = 0 before its first row.

    ``_row`` (1 on an entity's first row) may be used in a and b; a later stage may use the columns of earlier ones.  A
    row whose a or b is null leaves the state as it is.  ``period``: a stretch of time whose rows of one entity fit a task.
    """
    longest = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    cut = add_row_index(df, key, ts, period).withColumn("_block", F.floor((c("_row") - 1) / size))
    for wanted in stages:
        cut = _scanned(cut, wanted, longest, size, key)
    return cut.drop("_row", "_block")


def smoothing(value: Column, period: int) -> tuple[Column, Column]:
    """The map of an exponential average with 2 / (period + 1) that begins at the first value."""
    alpha = 2.0 / (period + 1)
    first = c("_row") == 1
    return F.when(first, F.lit(0.0)).otherwise(1.0 - alpha), F.when(first, value).otherwise(value * alpha)
