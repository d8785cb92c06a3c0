"""Data quality and leakage audits (DQ-*, LK-*, SET-02, SET-03).

Per-column questions are answered in one pass: the columns are unpivoted by ``stack`` and aggregated, so a
wide table costs one scan, not one query per column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.joins import with_scalars
from barloom.operators.ranking import rank_correlations
from barloom.operators.windows import ratio
from barloom.session import settle

c = F.col

# Words that make a column name suspicious, and the targets that are meant to be there.
SUSPICIOUS = ("next", "future", "pred", "predict", "target", "label", "leak")
TARGETS = ("next_day_return", "next_day_direction", "next_3day_return", "next_3day_direction")


def melt(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Long form (feature, value) with values as double."""
    return df.select(*keep, *[c(n).cast("double").alias(n) for n in cols]).unpivot(
        list(keep), list(cols), "feature", "value"
    )


def _one_row_to_long(one: DataFrame, cols: Sequence[str], parts: Sequence[str], label: str = "feature") -> DataFrame:
    entries = [F.struct(F.lit(n).alias(label), *[c(f"{n}__{p}").alias(p) for p in parts]) for n in cols]
    return one.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def null_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Null count and percent of every column: one row of counters, laid out as rows afterwards."""
    cols = list(cols or df.columns)
    one = df.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count_if(c(n).isNull()).alias(f"{n}__nulls") for n in cols]
    )
    entries = [F.struct(F.lit(n).alias("column"), c(f"{n}__nulls").alias("nulls")) for n in cols]
    return one.select("_rows", F.explode(F.array(*entries)).alias("e")).select(
        "e.column", "e.nulls", ratio(c("e.nulls") * 100.0, c("_rows")).alias("null_pct")
    )


def most_missing(df: DataFrame, cols: Sequence[str] | None = None, n: int = 10) -> DataFrame:
    """The ``n`` columns with the largest share of nulls, of those with any."""
    return null_profile(df, cols).where(c("nulls") > 0).orderBy(c("null_pct").desc(), "column").limit(n)


def coverage(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows and non-null counts of the named columns, per date or other key if asked."""
    aggs = [F.count(F.lit(1)).alias("rows"), *[F.count(n).alias(f"{n}_filled") for n in cols]]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def profile(df: DataFrame, label: str, key: str = "entity", ts: str = "date", targets: Sequence[str] = TARGETS) -> DataFrame:
    """Rows, date range, distinct dates and entities, label mean and deviation, features and labelled rows, in one row."""
    features = [n for n in df.columns if n not in (key, ts, label, *targets)]
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(ts).alias("first_date"),
        F.max(ts).alias("last_date"),
        F.count_distinct(ts).alias("dates"),
        F.count_distinct(key).alias("entities"),
        F.avg(label).alias("label_mean"),
        F.stddev_samp(label).alias("label_std"),
        F.count(label).alias("valid_targets"),
    ).withColumns({"columns": F.lit(len(df.columns)), "features": F.lit(len(features))})


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where(c("copies") > 1)


def duplicate_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many rows repeat an earlier key, and how many repeat an entire earlier row."""
    extra = lambda cols: df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).agg(F.sum(c("n") - 1))
    by_key = extra(keys).toDF("duplicate_keys")
    return with_scalars(by_key, extra(df.columns).toDF("duplicate_rows"))


def split_audit(df: DataFrame, splits: Sequence[str], key: str = "entity") -> DataFrame:
    """Rows of every entity in every split, its total, and whether all splits are filled."""
    counts = [F.count_if(c("split") == s).alias(s) for s in splits]
    out = df.groupBy(key).agg(*counts, F.count(F.lit(1)).alias("total"))
    full = None
    for s in splits:
        full = (c(s) > 0) if full is None else full & (c(s) > 0)
    return out.withColumn("full_coverage", full)


def split_reconciliation(audit: DataFrame, splits: Sequence[str]) -> DataFrame:
    """Audit totals against the rows they should add up to, with entities missing each split."""
    placed = F.lit(0)
    for s in splits:
        placed = placed + c(s)
    return audit.agg(
        F.count(F.lit(1)).alias("entities"),
        F.sum("total").alias("rows"),
        F.sum(placed).alias("placed"),
        F.sum(c("total") - placed).alias("unplaced"),
        *[F.count_if(c(s) == 0).alias(f"missing_{s}") for s in splits],
        F.count_if("full_coverage").alias("full"),
        F.count_if(~c("full_coverage")).alias("partial"),
    )


def spot_check(df: DataFrame, entity, cols: Sequence[str], n: int = 10, key: str = "entity", ts: str = "date") -> DataFrame:
    return df.where(c(key) == entity).select(key, ts, *cols).orderBy(c(ts).desc()).limit(n)


# --------------------------------------------------------------------------------------------- leakage


def check_no_lookahead(df: DataFrame, ref: str = "ref_date", ts: str = "date", strict: bool = True, as_of: Column | None = None) -> DataFrame:
    """Joined reference dates at or after (strict) / after the row's date, and after ``as_of``."""
    late = c(ref) >= c(ts) if strict else c(ref) > c(ts)
    future = F.coalesce(c(ref) > as_of, F.lit(False)) if as_of is not None else F.lit(False)
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(ref).alias("matched"),
        F.count_if(late).alias("late"),
        F.count_if(future).alias("future"),
    )


def check_split_order(df: DataFrame, order: Sequence[str] = ("train", "val", "test"), key: str = "entity", ts: str = "date") -> DataFrame:
    """Entities whose later split starts on or before the end of the earlier one."""
    bounds = df.groupBy(key).agg(
        *[F.min(F.when(c("split") == s, c(ts))).alias(f"{s}_min") for s in order],
        *[F.max(F.when(c("split") == s, c(ts))).alias(f"{s}_max") for s in order],
    )
    bad = F.lit(False)
    for a, b in zip(order, order[1:]):
        bad = bad | F.coalesce(c(f"{a}_max") >= c(f"{b}_min"), F.lit(False))
    return bounds.withColumn("violates", bad)




def check_schema(df: DataFrame, targets: Sequence[str] = TARGETS) -> dict[str, list[str]]:
    """Column names that look like labels or forward values, and targets that are missing."""
    names = df.columns
    odd = [n for n in names if n not in targets and any(k in n.lower() for k in SUSPICIOUS)]
    return {"suspicious": odd, "missing_targets": [t for t in targets if t not in names]}


def schema_scan(df: DataFrame, targets: Sequence[str] = TARGETS) -> DataFrame:
    """The same verdicts as rows, with how many values each suspicious column holds."""
    found = check_schema(df, targets)
    cols = found["suspicious"] + [t for t in targets if t in df.columns]
    one = df.agg(*[F.count(n).alias(f"{n}__filled") for n in cols])
    out = _one_row_to_long(one, cols, ["filled"], "column")
    return out.withColumn("verdict", F.when(c("column").isin(list(targets)), "target").otherwise("suspicious"))


def split_overlap(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("entity", "date")) -> DataFrame:
    """Keys present in both splits."""
    return a.select(*keys).intersect(b.select(*keys))


def overlap_counts(df: DataFrame, pairs: Sequence[tuple[str, str]], keys: Sequence[str]) -> DataFrame:
    """Shared keys of every pair of splits from one grouped pass."""
    sets = df.groupBy(*keys).agg(F.collect_set("split").alias("in_splits"))
    return sets.agg(
        *[
            F.count_if(F.array_contains("in_splits", x) & F.array_contains("in_splits", y)).alias(f"{x}_{y}")
            for x, y in pairs
        ]
    )


def label_pearson(df: DataFrame, cols: Sequence[str], y: str, min_pairs: int = 30) -> DataFrame:
    """Pairs and Pearson of every feature with the label, from one aggregate over the wide rows.

    Features with fewer than ``min_pairs`` pairs or without variation are left out.
    """
    aggs = []
    for n in cols:
        x, label = c(n).cast("double"), c(y).cast("double")
        paired = F.when(x.isNotNull(), label)
        aggs += [F.count(F.when(label.isNotNull(), x)).alias(f"{n}__n"), F.corr(x, paired).alias(f"{n}__pearson")]
        aggs += [F.stddev_samp(F.when(label.isNotNull(), x)).alias(f"{n}__sx"), F.stddev_samp(paired).alias(f"{n}__sy")]
    long = _one_row_to_long(df.agg(*aggs), list(cols), ["n", "sx", "sy", "pearson"])
    return long.where((c("n") >= min_pairs) & (c("sx") > 0) & (c("sy") > 0)).select("feature", "n", "pearson")


def feature_label_corr(df: DataFrame, cols: Sequence[str], y: str, min_pairs: int = 30) -> DataFrame:
    """Pearson and Spearman of every feature with the label over pairwise non-null rows, strongest |Pearson| first.

    ``place`` numbers the features by |Pearson|, then name.  The label is sorted once
    for all features (``rank_correlations``).  Which features are left out: see ``label_pearson``.
    """
    # Range bounds are sampled, so the input is evaluated once and kept: the label and the features alone.
    df = settle(df.where(c(y).isNotNull()).select(c(y).cast("double").alias("_y"), *[c(n).cast("double").alias(n) for n in cols]))
    name = F.element_at(F.array(*[F.lit(n) for n in cols]), c("_f") + 1).alias("feature")
    spearman = rank_correlations(df, cols, "_y").select(name, "spearman")
    out = label_pearson(df, cols, "_y", min_pairs).join(spearman, "feature")
    # one row per feature
    place = F.row_number().over(Window.orderBy(F.round(F.abs("pearson"), 9).desc(), "feature"))
    return out.select("feature", "n", "pearson", "spearman", (F.abs("pearson") >= 0.9999).alias("near_perfect"), place.alias("place")).orderBy("place")


def corr_summary(corr: DataFrame) -> DataFrame:
    """Smallest, median and largest |Pearson| (one row per feature goes in, so the input is small)."""
    a = F.abs("pearson")
    return corr.agg(F.min(a).alias("min_abs"), F.percentile(a, F.lit(0.5)).alias("median_abs"), F.max(a).alias("max_abs"))


def equality_fraction(df: DataFrame, cols: Sequence[str], y: str, tol: float = 1e-9) -> DataFrame:
    """Share of rows where a feature equals the label exactly / within a tolerance; over 1 % is flagged."""
    label = c(y).cast("double")
    aggs = []
    for n in cols:
        x = c(n).cast("double")
        both = x.isNotNull() & label.isNotNull()
        # The relative part (1e-5 of the label) is the usual definition of closeness.
        close = F.abs(x - label) <= tol + F.abs(label) * 1e-5
        aggs += [
            F.avg(F.when(label.isNotNull(), F.coalesce((x == label).cast("int"), F.lit(0)))).alias(f"{n}__exact"),
            F.avg(F.when(both, close.cast("int"))).alias(f"{n}__near"),
            F.bool_and(F.coalesce(x, F.lit(0.0)) == F.coalesce(label, F.lit(0.0))).alias(f"{n}__identical"),
        ]
    out = _one_row_to_long(df.agg(*aggs), list(cols), ["exact", "near", "identical"])
    return out.withColumn("flagged", (c("exact") > 0.01) | (c("near") > 0.01))


def category_delta(df: DataFrame, cols: Sequence[str], y: str, max_values: int = 50) -> DataFrame:
    """For features with few values: the largest gap between P(y>0 | value) and P(y>0)."""
    rows = melt(df.where(c(y).isNotNull()), cols, [y]).where(c("value").isNotNull())
    per_value = rows.groupBy("feature", "value").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(c(y) > 0).alias("_up")
    )
    # The group's values are counted before any are gathered; wide features leave here.
    totals = per_value.groupBy("feature").agg(
        F.count(F.lit(1)).alias("values"), F.sum("_n").alias("_tn"), F.sum("_up").alias("_tup")
    ).where(c("values") <= max_values)
    gap = F.abs(c("_up") / c("_n") - c("_tup") / c("_tn"))
    return (
        per_value.join(totals, "feature")
        .groupBy("feature")
        .agg(F.first("values").alias("values"), F.max(gap).alias("max_delta"))
        .withColumn("flagged", c("max_delta") > 0.2)
    )


def compare_versions(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys present in both versions with the names of the columns that differ."""
    cols = [n for n in a.columns if n in b.columns and n not in keys]
    right = b.select(*keys, *[c(n).alias(f"_b_{n}") for n in cols])
    diff = F.array_compact(F.array(*[F.when(~c(n).eqNullSafe(c(f"_b_{n}")), F.lit(n)) for n in cols]))
    return a.join(right, list(keys)).withColumn("differs", diff).select(*keys, "differs")


def version_summary(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows in the first version, keys matched in the second, and matched rows with any difference."""
    matched = compare_versions(a, b, keys).agg(
        F.count(F.lit(1)).alias("matched"), F.count_if(F.size("differs") > 0).alias("different")
    )
    return with_scalars(a.agg(F.count(F.lit(1)).alias("total")), matched)


def group_feature_mismatches(df: DataFrame, series: DataFrame, group: str = "industry", ts: str = "date", tol: float = 1e-8) -> DataFrame:
    """Recompute the prior-day group statistic by lag over the group's own dates and compare.

    Valid where the row's date is itself a date of its group, which holds for every row that contributes to
    the group's mean.
    """
    from barloom.operators.windows import lagged

    prior = series.select(
        group, ts, lagged("avg_return", 1, group, ts).alias("_want_avg"), lagged("avg_5d", 1, group, ts).alias("_want_5d")
    )
    j = df.join(prior, [group, ts])
    off = (F.abs(c("industry_avg_return") - c("_want_avg")) > tol) | (F.abs(c("industry_momentum_5d") - c("_want_5d")) > tol)
    lost = c("industry_avg_return").isNull() != c("_want_avg").isNull()
    return j.agg(F.count(F.lit(1)).alias("checked"), F.count_if(F.coalesce(off, F.lit(False)) | lost).alias("mismatches"))


