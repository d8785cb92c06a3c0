"""Shared window specifications and the staged way features are declared.

A feature is declared as *steps*: a list of ``{column: expression}`` stages.  Steps of many features are
merged stage by stage, so a whole feature table needs a handful of Window nodes over one Exchange and one
Sort instead of one node per feature.  Helper columns start with ``_`` and are dropped at the end.

An entity holds at most one row per date, so a window partition is bounded by the length of the calendar,
not by the number of raw rows.  Panels whose entities are longer than one task should hold are cut by
:mod:`barloom.operators.blocks`; every function here accepts several partition columns for that purpose.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import cache, reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

Steps = list[dict[str, Column]]
Key = str | Iterable[str]


def names(key: Key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def ordered(key: Key = "entity", ts: Key = "date") -> WindowSpec:
    return Window.partitionBy(*names(key)).orderBy(*names(ts))


def trailing(n: int, key: Key = "entity", ts: Key = "date") -> WindowSpec:
    """The current row and the n-1 rows before it."""
    return ordered(key, ts).rowsBetween(-(n - 1), Window.currentRow)


def preceding(n: int, key: Key = "entity", ts: Key = "date") -> WindowSpec:
    """The n rows before the current one."""
    return ordered(key, ts).rowsBetween(-n, -1)


def running(key: Key = "entity", ts: Key = "date") -> WindowSpec:
    """All rows up to and including the current one."""
    return ordered(key, ts).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def before(key: Key = "entity", ts: Key = "date") -> WindowSpec:
    """All rows before the current one."""
    return ordered(key, ts).rowsBetween(Window.unboundedPreceding, -1)


def whole(key: Key = "entity") -> WindowSpec:
    return Window.partitionBy(*names(key))


def lagged(col: str, n: int = 1, key: Key = "entity", ts: Key = "date") -> Column:
    return F.lag(col, n).over(ordered(key, ts))


def row_no(key: Key = "entity", ts: Key = "date") -> Column:
    return F.row_number().over(ordered(key, ts))


def warm(n: int, value: Column, key: Key = "entity", ts: Key = "date") -> Column:
    """``value`` from the n-th row of the entity on, else null."""
    return F.when(row_no(key, ts) >= n, value)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null when b is zero."""
    return F.try_divide(a, b)


def float_ratio(a: Column, b: Column) -> Column:
    """a / b as floating point has it: an infinity of a's sign when b is zero, NaN when both are."""
    at_zero = F.when(a > 0, float("inf")).when(a < 0, float("-inf")).when(a.isNotNull(), float("nan"))
    return F.when(b == 0, at_zero).otherwise(F.try_divide(a, b))


# ---------------------------------------------------------------------------------------------- steps


def merge(*features: Steps) -> Steps:
    """Stage-wise union of several features' steps."""
    depth = max((len(f) for f in features), default=0)
    out: Steps = []
    for i in range(depth):
        stage: dict[str, Column] = {}
        for f in features:
            if i < len(f):
                stage.update(f[i])
        out.append(stage)
    return out


def apply_steps(df: DataFrame, steps: Steps) -> DataFrame:
    made: list[str] = []
    for stage in steps:
        if stage:
            df = df.withColumns(stage)
            made += [c for c in stage if c.startswith("_")]
    return df.drop(*made) if made else df


# ------------------------------------------------------------------------------ short trailing windows

# A sliding frame folds all of its rows again at every row, a lag writes one value.  Windows of up to so many rows are
# plain expressions over lags, which features share by name.
NEAR = 26
ROW = "_row_no"


def near_lags(n: int, *columns: str, key: Key = "entity", ts: Key = "date") -> dict[str, Column]:
    """The n-1 values before the current one of each column, as ``_<column>_<k>``, and the row's number."""
    lags = {f"_{x}_{k}": lagged(x, k, key, ts) for x in columns for k in range(1, n)}
    return {**lags, ROW: row_no(key, ts)}


def near(column: str, n: int, start: int = 0) -> list[Column]:
    """n values of a column from ``near_lags``, the newest first."""
    return [F.col(f"_{column}_{k}" if k else column) for k in range(start, start + n)]


def from_row(n: int, value: Column) -> Column:
    """``value`` from the n-th row of the entity on, else null; reads the number that ``near_lags`` gives."""
    return F.when(F.col(ROW) >= n, value)


def total(values: list[Column]) -> Column:
    """Sum from the oldest on, without nulls; 0 of none."""
    return reduce(add, [F.coalesce(v, F.lit(0.0)) for v in reversed(values)])


def mean(values: list[Column]) -> Column:
    """Mean without nulls; null of none."""
    return ratio(total(values), reduce(add, [v.isNotNull().cast("int") for v in values]))


# ------------------------------------------------------------------------------- long trailing windows


@cache
def factors(n: int, limit: int = 16) -> tuple[int, ...] | None:
    """The factorisation of n with the smallest sum (fewest lags); None when a prime exceeds ``limit``."""
    if n <= 5:
        return (n,)
    best: tuple[int, ...] | None = (n,) if n <= limit else None
    for d in range(2, min(limit, n // 2) + 1):
        if n % d == 0:
            rest = factors(n // d, limit)
            if rest and (best is None or d + sum(rest) < sum(best)):
                best = tuple(sorted((d, *rest)))
    return best


def geometric_sum_steps(
    value: str, kernels: Mapping[str, tuple[float, int]], key: Key = "entity", ts: Key = "date"
) -> Steps:
    """Columns ``sum over k < n of q**k * value[t-k]`` for each ``name: (q, n)``; null before n rows.

    Up to ``NEAR`` rows are one stage of shared lags and one expression.  A longer kernel is built from a few stages of
    shorter ones: with n = f1*f2, the sum over f1 rows is itself summed at f2 positions, f1 rows apart.  A 260-row kernel
    costs 22 lags rather than 260 updates per row, stays inside one sort order, and needs no Python.
    """
    w = ordered(key, ts)
    short = {name: (q, n) for name, (q, n) in kernels.items() if n <= NEAR}
    plan = {name: (q, factors(n) or (n,)) for name, (q, n) in kernels.items() if n > NEAR}
    steps: Steps = []
    for level in range(max((len(f) for _, f in plan.values()), default=0)):
        stage: dict[str, Column] = {}
        for name, (q, fs) in plan.items():
            if level >= len(fs):
                continue
            stride = 1
            for f in fs[:level]:
                stride *= f
            source = value if level == 0 else name
            total = F.col(source)
            for j in range(1, fs[level]):
                total = total + F.lag(source, j * stride).over(w) * F.lit(float(q) ** (j * stride))
            stage[name] = total
        steps.append(stage)
    if short:
        sums = {name: reduce(add, [v * F.lit(float(q) ** k) if k else v for k, v in enumerate(near(value, n))]) for name, (q, n) in short.items()}
        steps = merge(steps, [near_lags(max(n for _, n in short.values()), value, key=key, ts=ts), sums])
    return steps


def extreme_steps(
    wanted: Mapping[str, tuple[str, str, int]], key: Key = "entity", ts: Key = "date", partial: bool = True
) -> Steps:
    """Trailing extremes for ``name: (column, 'max'|'min', n)``: those of the nearest rows from shared lags, then those of
    such short windows side by side; the last two may overlap.

    greatest/least skip nulls, so short histories give the extreme of the rows there are
    (``partial=True``); otherwise the value is null before n rows.
    """
    w = ordered(key, ts)
    lags, first, second = {}, {}, {}
    for name, (c, how, n) in wanted.items():
        pick = F.greatest if how == "max" else F.least
        size = min(n, NEAR)
        lags |= near_lags(size, c, key=key, ts=ts)
        first[name] = pick(*near(c, size)) if size > 1 else F.col(c)
        if n > size:
            second[name] = pick(F.col(name), *[F.lag(name, k).over(w) for k in (*range(size, n - size, size), n - size)])
    # A stage lies between, for what other features make of their short windows: that is carried, not the lags.
    steps: Steps = [lags, first] + ([{}, second] if second else [])
    if not partial:
        steps.append({name: from_row(n, F.col(name)) for name, (_, _, n) in wanted.items()})
    return steps


# --------------------------------------------------------------------------------------- generic pieces


def latest_rows(df: DataFrame, n: int, key: Key = "entity", ts: str = "date") -> DataFrame:
    """The n newest rows of each entity (the row-number filter becomes a pre-shuffle group limit)."""
    w = Window.partitionBy(*names(key)).orderBy(F.col(ts).desc())
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def run_length_steps(sign: str, out: str, key: Key = "entity", ts: Key = "date") -> Steps:
    """Length of the current run of equal values in ``sign`` (null rows end a run)."""
    prev, start = f"_prev_{out}", f"_start_{out}"
    changed = ~F.col(sign).eqNullSafe(F.col(prev)) | (F.col("_rl_row") == 1)
    return [
        {"_rl_row": row_no(key, ts), prev: lagged(sign, 1, key, ts)},
        {start: F.last(F.when(changed, F.col("_rl_row")), ignorenulls=True).over(running(key, ts))},
        {out: F.col("_rl_row") - F.col(start) + 1},
    ]


def share_below_steps(value: str, out: str, n: int, key: Key = "entity", ts: Key = "date") -> Steps:
    """Share of the last n values that lie strictly below the current one (the frame is gathered once)."""
    frame = f"_frame_{out}"
    below = F.size(F.filter(frame, lambda x: x < F.col(value)))
    return [{frame: F.collect_list(value).over(trailing(n, key, ts))}, {out: below / F.size(frame)}]
