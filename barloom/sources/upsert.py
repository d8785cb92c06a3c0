"""Keyed merges of a batch into a stored table (UPS-01..11).

Plain Parquet has no MERGE, so each policy is a set expression over (base, new); where the table format
offers MERGE INTO the same policies map to its clauses.  ``new`` should hold one row per key
(:func:`dedup_last`); ``base`` is read once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col


def upsert(base: DataFrame, new: DataFrame, keys: Sequence[str], policy: str = "replace", cols: Sequence[str] | None = None) -> DataFrame:
    """Merge ``new`` into ``base``.

    replace       existing keys take the whole new row
    keep          existing keys stay as they are
    update        existing keys take only ``cols``; new keys are inserted
    coalesce_new  per column the new value, the old one where the new is null
    coalesce_old  per column the old value, the new one where the old is null
    append        no conflict handling (check with ``duplicate_keys`` afterwards)
    """
    keys = list(keys)
    if policy == "replace":
        kept = base.join(new.select(*keys), keys, "left_anti")
        return kept.unionByName(new, allowMissingColumns=True)
    if policy == "keep":
        fresh = new.join(base.select(*keys), keys, "left_anti")
        return base.unionByName(fresh, allowMissingColumns=True)
    if policy == "append":
        return base.unionByName(new, allowMissingColumns=True)
    rest = [n for n in base.columns if n not in keys]
    both = base.withColumn("_old", F.lit(True)).join(
        new.select(*keys, F.lit(True).alias("_new"), *[c(n).alias(f"_n_{n}") for n in rest if n in new.columns]),
        keys,
        "full_outer",
    )

    def merged(n: str) -> Column:
        if n not in new.columns:
            return c(n)
        old, fresh = c(n), c(f"_n_{n}")
        if policy == "coalesce_new":
            return F.coalesce(fresh, old)
        if policy == "coalesce_old":
            return F.coalesce(old, fresh)
        if policy == "update":
            takes_new = c("_old").isNull() | (c("_new") & F.lit(n in (cols or ())))
            return F.when(takes_new, fresh).otherwise(old)
        raise ValueError(f"unknown policy {policy!r}")

    return both.select(*keys, *[merged(n).alias(n) for n in rest])


def upsert_counts(base: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many rows of the batch insert and how many update."""
    seen = base.select(*keys, F.lit(True).alias("_old")).dropDuplicates(list(keys))
    return new.join(seen, list(keys), "left").agg(
        F.count_if(c("_old").isNull()).alias("inserted"), F.count_if(c("_old")).alias("updated")
    )


def upsert_with_counts(base: DataFrame, new: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    return upsert(base, new, keys), upsert_counts(base, new, keys)


def dedup_last(df: DataFrame, keys: Sequence[str], order: str | Sequence[str]) -> DataFrame:
    """The last row per key in ``order``: a max-by aggregate, combined before the shuffle, so a key with
    many copies never gathers in one task."""
    order = [order] if isinstance(order, str) else list(order)
    rest = [n for n in df.columns if n not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(newest).select(*keys, *[c("_row")[n].alias(n) for n in rest])


def dedup_latest(df: DataFrame, keys: Sequence[str], ts: str | Sequence[str], default: str = "") -> DataFrame:
    """Text keys with null filled by ``default``, then the newest row per key."""
    kinds = dict(df.dtypes)
    filled = df.withColumns({k: F.coalesce(c(k), F.lit(default)) for k in keys if kinds[k] == "string"})
    return dedup_last(filled, keys, ts)


def replace_slice(base: DataFrame, new: DataFrame, pred: Column) -> DataFrame:
    """Delete the rows the predicate covers, then insert the new ones."""
    return base.where(~F.coalesce(pred, F.lit(False))).unionByName(new, allowMissingColumns=True)


def update_from(base: DataFrame, other: DataFrame, keys: Sequence[str], cols: Sequence[str], only_null: bool = False) -> DataFrame:
    """Overwrite columns from a matching row of ``other`` (only where still null, if asked)."""
    src = other.select(*keys, F.lit(True).alias("_hit"), *[c(n).alias(f"_o_{n}") for n in cols])
    joined = base.join(src, list(keys), "left")

    def value(n: str) -> Column:
        if only_null:
            return F.coalesce(c(n), c(f"_o_{n}"))
        return F.when(c("_hit"), c(f"_o_{n}")).otherwise(c(n))

    return joined.select(*[value(n).alias(n) if n in cols else c(n) for n in base.columns])


