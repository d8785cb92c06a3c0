"""As-of joins and lookups (JN-01..16).

Spark broadcasts a side when its measured size is under the threshold (statically or at run time under AQE) and
otherwise shuffles, splitting skewed keys.  Only ``asof_join`` gives a hint, and only where the caller says that groups x
calendar is small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.windows import names, ordered


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: str | Sequence[str],
    cols: Sequence[str],
    ts: str = "date",
    strict: bool = False,
    left_ts: str | None = None,
    ref_date: str | None = "ref_date",
    asked: DataFrame | None = None,
    small: bool = False,
) -> DataFrame:
    """Attach to each left row the newest right row of its group at (or, strict, before) its date.

    The lookup is solved once per distinct (group, date) rather than per left row: the few dates asked for
    are merged with the reference dates, values are carried forward in one bounded window per group, and the
    left rows join the result by equality.  A group with a third of all left rows never meets in one task.
    ``ref_date`` keeps the date the values come from, for look-ahead checks.  ``asked`` may give the (group,
    date) pairs to solve, or more than those, where that is cheaper than deriving them from ``left``.  ``small``: the pairs
    number groups x calendar and go to every task, so that the left rows stay where they are.
    """
    keys = names(by)
    lts = left_ts or ts
    pairs = (left if asked is None else asked).select(*keys, F.col(lts).alias("_at"))
    wanted = pairs.where(F.col("_at").isNotNull()).distinct()
    stamp = F.struct(F.col(ts).alias("_ref"), *[F.col(c) for c in cols])
    known = right.select(*keys, F.col(ts).alias("_at"), stamp.alias("_v"))
    line = (
        wanted.withColumn("_v", F.lit(None).cast(known.schema["_v"].dataType))
        .unionByName(known)
        .groupBy(*keys, "_at")
        .agg(F.max("_v").alias("_v"))
    )
    last = -1 if strict else Window.currentRow
    w = Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, last)
    solved = line.select(*keys, "_at", F.last("_v", ignorenulls=True).over(w).alias("_v"))
    solved = solved.withColumnRenamed("_at", lts)
    out = left.join(F.broadcast(solved) if small else solved, [*keys, lts], "left")
    picked = {c: F.col("_v")[c] for c in cols}
    if ref_date:
        picked[ref_date] = F.col("_v")["_ref"]
    return out.withColumns(picked).drop("_v").select(*left.columns, *picked)


def latest_per(df: DataFrame, by: str | Sequence[str] = "entity", ts: str = "date") -> DataFrame:
    """The newest row of each entity (one max-by aggregate, combined before the shuffle)."""
    keys = names(by)
    rest = [c for c in df.columns if c not in keys]
    row = F.max_by(F.struct(*rest), F.col(ts)).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def kth_next(df: DataFrame, col: str, k: int, out: str | None = None, key: str = "entity", ts: str = "date") -> DataFrame:
    """The value k rows later in the entity's own calendar."""
    return df.withColumn(out or f"{col}_next_{k}", F.lead(col, k).over(ordered(key, ts)))


def lookup(facts: DataFrame, table: DataFrame, keys: Sequence[str], cols: Sequence[str] | None = None) -> DataFrame:
    """Left equi-join of named columns by key (dimension, valuation and flow lookups)."""
    wanted = list(cols) if cols else [c for c in table.columns if c not in keys]
    return facts.join(table.select(*keys, *wanted), list(keys), "left")


def has_match(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right.select(*keys), list(keys), "left_semi")


def has_no_match(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right.select(*keys), list(keys), "left_anti")


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Cross join with a one-row aggregate, planned as a scalar subquery instead of a product."""
    packed = one_row.select(F.struct(*one_row.columns).alias("s")).scalar()
    return df.withColumn("_s", packed).select(*df.columns, *[F.col("_s")[c].alias(c) for c in one_row.columns])


def resolve_code(df: DataFrame, dim: DataFrame, code: str = "code", name: str = "name") -> DataFrame:
    """Fill a null code from the dimension by name when exactly one listed row bears it.

    ``resolution`` says how: 'given', 'by_name' or 'unresolved' (kept so that the drop can be counted).
    """
    unique = (
        dim.groupBy(name)
        .agg(F.min(code).alias("_by_name"), F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") == 1)
        .drop("_n")
    )
    found = F.when(F.col(code).isNotNull(), "given").when(F.col("_by_name").isNotNull(), "by_name").otherwise("unresolved")
    # Only rows that need a code are joined by name.
    given = F.col(code).isNotNull() | F.col(name).isNull()
    looked_up = df.where(~given).join(unique, name, "left")
    rest = df.where(given).withColumn("_by_name", F.lit(None).cast(dim.schema[code].dataType))
    return (
        rest.unionByName(looked_up)
        .withColumn("resolution", found)
        .withColumn(code, F.coalesce(F.col(code), F.col("_by_name")))
        .drop("_by_name")
    )


def first_available(*series: Column) -> Column:
    """The first non-null of several reference series."""
    return F.coalesce(*series)


def join_counting(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Inner join of features and labels, and a one-row frame with how many rows of each side had no partner."""
    joined = left.join(right, list(keys))
    lone_left = has_no_match(left, right, keys).agg(F.count(F.lit(1)).alias("left_unmatched"))
    lone_right = has_no_match(right, left, keys).agg(F.count(F.lit(1)).alias("right_unmatched"))
    return joined, with_scalars(lone_left, lone_right)


def combine_predictions(truth: DataFrame, base: DataFrame, model: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Truth with two predictions, rows with any null dropped."""
    return truth.join(base, list(keys)).join(model, list(keys)).dropna()
