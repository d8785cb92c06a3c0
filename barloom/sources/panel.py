"""Panel scan, CSV in and out, partitioned Parquet (SRC-01, SRC-04, SNK-01..03)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TARGETS = ("next_day_return", "next_day_direction", "next_3day_return", "next_3day_direction")


def bound(df: DataFrame, start=None, end=None, entities: Sequence | None = None, key: str = "entity", ts: str = "date") -> DataFrame:
    """Date and entity bounds as plain predicates, so that they reach the Parquet scan."""
    if start is not None:
        df = df.where(F.col(ts) >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col(ts) <= F.lit(end).cast("date"))
    if entities is not None:
        df = df.where(F.col(key).isin(list(entities)))
    return df


def read_panel(spark: SparkSession, path: str, start=None, end=None, entities: Sequence | None = None, key: str = "entity", ts: str = "date") -> DataFrame:
    """A stored panel, bounded; a ``year`` partition column is pruned by the date bounds as well."""
    df = spark.read.parquet(path)
    if "year" in df.columns:
        if start is not None:
            df = df.where(F.col("year") >= F.year(F.lit(start).cast("date")))
        if end is not None:
            df = df.where(F.col("year") <= F.year(F.lit(end).cast("date")))
    return bound(df, start, end, entities, key, ts)


def write_panel(df: DataFrame, path: str, mode: str = "overwrite", key: str = "entity", ts: str = "date") -> None:
    """Store a panel by year, each file sorted by (entity, date).

    Rows are range-partitioned on (year, entity, date) so files are even in size even when one entity or
    year dominates, and row-group statistics prune both entity and date lookups.  ``overwrite`` replaces the whole
    panel, years without new rows included; ``replace_years`` rewrites only the years it has rows of.
    """
    _by_year(df, key, ts).mode(mode).option("partitionOverwriteMode", "static").parquet(path)


def replace_years(df: DataFrame, path: str, key: str = "entity", ts: str = "date") -> None:
    """Rewrite the years that ``df`` has rows of and leave the files of all others alone.

    ``df`` must not read from those years itself: store it first.
    """
    _by_year(df, key, ts).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def _by_year(df: DataFrame, key: str, ts: str):
    return df.withColumn("year", F.year(ts)).repartitionByRange("year", key, ts).sortWithinPartitions("year", key, ts).write.partitionBy("year")


BUCKETS = 16


def bucket_of(key: str = "entity", buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_bucketed(df: DataFrame, path: str, buckets: int = BUCKETS, key: str = "entity", ts: str = "date", replace: bool = False) -> None:
    """Store a panel by year and bucket of entities; ``replace`` rewrites only the (year, bucket) folders that ``df`` has rows of."""
    rows = df.withColumns({"year": F.year(ts), "bucket": bucket_of(key, buckets)}).repartitionByRange("year", "bucket", key, ts)
    mode = "dynamic" if replace else "static"
    rows.sortWithinPartitions("year", "bucket", key, ts).write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("year", "bucket").parquet(path)


def read_buckets(spark: SparkSession, path: str, buckets: Sequence[int]) -> DataFrame:
    """The rows of some buckets of entities; the folders of all others are not read."""
    return spark.read.parquet(path).where(F.col("bucket").isin(list(buckets))).drop("year", "bucket")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def training_columns(df: DataFrame, ids: Sequence[str] = ("entity", "date"), targets: Sequence[str] = TARGETS) -> DataFrame:
    """Fixed order: ids, features as they stand, targets."""
    features = [c for c in df.columns if c not in ids and c not in targets]
    return df.select(*ids, *features, *[t for t in targets if t in df.columns])


def export_training(df: DataFrame, path: str, mode: str = "overwrite", fmt: str = "parquet") -> DataFrame:
    """Write a training set; CSV writes a null as an empty field.  Returns what was written."""
    out = training_columns(df)
    writer = out.write.mode(mode)
    if fmt == "csv":
        writer.option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)
    else:
        writer.parquet(path)
    return out


def held_out(df: DataFrame, cutoff: Column, entities: DataFrame | None = None, key: str = "entity", ts: str = "date") -> DataFrame:
    """Rows after the cutoff, of the selected entities only when given."""
    out = df.where(F.col(ts) > cutoff)
    return out.join(entities.select(key).distinct(), key, "left_semi") if entities is not None else out


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
