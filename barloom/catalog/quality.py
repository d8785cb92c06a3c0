"""Data-quality and leakage audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.base import DAYNO, add_view, over, query
from barloom.catalog.features import GROUP_SERIES, LABELS, _GROUP_CTX
from barloom.catalog.universe import SPLIT_SQL, SPLITS, split_rows
from barloom.operators import context
from barloom.operators import quality as dq
from barloom.operators.pattern import add_streak
from barloom.operators.price import add_calendar, add_labels, add_lag_returns, add_returns
from barloom.sources.tables import day_number

c = F.col
W = over()
KEYS = ["entity", "date"]
FEATURES = ["return_lag_1", "return_lag_2", "return_lag_3", "volume", "leaky", "weekday"]

add_view(
    "feats", "bars",
    "SELECT entity, date, volume, " + ", ".join(f"close / lag(close, {n}) {W} - 1 AS return_lag_{n}" for n in (1, 2, 3))
    + f", isodow(date) - 1 AS weekday, CASE WHEN {DAYNO} % 3 = 0 THEN lead(close) {W} / close - 1 ELSE volume END AS leaky, lead(close) {W} / close - 1 AS next_day_return FROM bars",
)


def feature_sample(t):
    """Lagged returns, volume, a calendar field and a feature that leaks the label on every third day."""
    df = add_calendar(add_labels(add_lag_returns(t.bars()), {1: 0.002}))
    leaky = F.when(day_number(c("date")) % 3 == 0, c("next_day_return")).otherwise(c("volume"))
    return df.withColumn("leaky", leaky).select(*KEYS, *FEATURES, "next_day_return")


_NULL_COLUMNS = ["volume", "return_lag_1", "return_lag_2", "return_lag_3", "weekday", "leaky", "next_day_return"]


@query("null_profile", "name:s nulls:i null_pct", "DQ-01", "feats",
       " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) - count({n}) AS nulls, (count(*) - count({n})) * 100.0 / count(*) AS null_pct FROM feats" for n in _NULL_COLUMNS))
def _(t):
    return dq.null_profile(feature_sample(t), _NULL_COLUMNS).withColumnRenamed("column", "name")


@query("coverage_on_date", "date:d n_rows:i return_lag_1_filled:i next_day_return_filled:i", "DQ-02", "feats",
       "SELECT date, count(*) AS n_rows, count(return_lag_1) AS return_lag_1_filled, count(next_day_return) AS next_day_return_filled FROM feats GROUP BY date")
def _(t):
    return dq.coverage(feature_sample(t), ["return_lag_1", "next_day_return"], ["date"]).withColumnRenamed("rows", "n_rows")


@query("dataset_profile", "n_rows:i n_columns:i first_date:d last_date:d dates:i entities:i label_mean label_std valid_targets:i features:i", "DQ-03", "feats",
       """SELECT count(*) AS n_rows, 9 AS n_columns, min(date) AS first_date, max(date) AS last_date, count(DISTINCT date) AS dates, count(DISTINCT entity) AS entities,
 avg(next_day_return) AS label_mean, stddev_samp(next_day_return) AS label_std, count(next_day_return) AS valid_targets, 6 AS features FROM feats""")
def _(t):
    return dq.profile(feature_sample(t), "next_day_return").withColumnsRenamed({"rows": "n_rows", "columns": "n_columns"})


@query("duplicate_keys", "entity:i date:d copies:i", "DQ-04", "versioned", "SELECT entity, date, count(*) AS copies FROM versioned GROUP BY entity, date HAVING count(*) > 1")
def _(t):
    return dq.duplicate_keys(t.versioned(), KEYS)


@query("most_missing", "name:s nulls:i null_pct", "DQ-03", "feats",
       "SELECT name, count(*) - count(v) AS nulls, (count(*) - count(v)) * 100.0 / count(*) AS null_pct FROM ("
       + " UNION ALL ".join(f"SELECT '{n}' AS name, CAST({n} AS DOUBLE) AS v FROM feats" for n in _NULL_COLUMNS)
       + ") GROUP BY name HAVING count(*) > count(v) ORDER BY null_pct DESC, name LIMIT 10")
def _(t):
    return dq.most_missing(feature_sample(t), _NULL_COLUMNS).withColumnRenamed("column", "name")


@query("duplicate_line_keys", "l_orderkey:i l_linenumber:i copies:i", "DQ-04", "", "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(t):
    return dq.duplicate_keys(t.table("lineitem"), ["l_orderkey", "l_linenumber"])


@query("duplicate_counts", "duplicate_keys:i duplicate_rows:i", "DQ-04", "",
       """SELECT (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS duplicate_keys,
 (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) AS duplicate_rows""")
def _(t):
    return dq.duplicate_counts(t.table("lineitem"), ["l_orderkey", "l_linenumber"])


@query("index_coverage", "date:d n_rows:i csi300_filled:i chinext_filled:i", "DQ-05", "idx",
       """SELECT date, count(*) AS n_rows, count(CASE WHEN code = 'csi300' THEN pct_chg END) AS csi300_filled, count(CASE WHEN code = 'chinext' THEN pct_chg END) AS chinext_filled FROM idx GROUP BY date""")
def _(t):
    df = t.index_bars().withColumns({k: F.when(c("code") == k, c("pct_chg")) for k in ("csi300", "chinext")})
    return dq.coverage(df, ["csi300", "chinext"], ["date"]).withColumnRenamed("rows", "n_rows")


@query("split_reconciliation", "entities:i n_rows:i placed:i unplaced:i missing_train:i missing_test:i full_entities:i partial_entities:i", "DQ-06", "bars",
       f"""SELECT count(*) AS entities, sum(n) AS n_rows, sum(p) AS placed, sum(n - p) AS unplaced, count_if(tr = 0) AS missing_train, count_if(te = 0) AS missing_test, count_if(k = 4) AS full_entities, count_if(k < 4) AS partial_entities FROM (
 SELECT entity, count(*) AS n, count_if(split <> 'gap') AS p, count_if(split = 'train') AS tr, count_if(split = 'test') AS te, count(DISTINCT CASE WHEN split <> 'gap' THEN split END) AS k FROM ({SPLIT_SQL}) GROUP BY entity)""")
def _(t):
    return dq.split_reconciliation(dq.split_audit(split_rows(t), SPLITS), SPLITS).withColumnsRenamed({"rows": "n_rows", "full": "full_entities", "partial": "partial_entities"})


@query("spot_check", "entity:i date:d volume return_lag_1", "DQ-07", "feats", "SELECT * FROM feats WHERE entity = 5 ORDER BY date DESC LIMIT 10")
def _(t):
    return dq.spot_check(feature_sample(t), 5, ["volume", "return_lag_1"])


# ---------------------------------------------------------------------------------------------- leakage


def _group_rows(t):
    df = add_returns(t.bars()).join(t.dim().select("entity", "industry"), "entity")
    series = context.group_series(t.returns(), t.dim())
    return context.add_group_context(df, series, ref_date="ref_date"), series


@query("lookahead_guard", "n_rows:i matched:i late:i future:i", "LK-01", "prevs rets dim",
       f"SELECT count(*) AS n_rows, count(ref_date) AS matched, count_if(ref_date >= date) AS late, 0 AS future FROM ({_GROUP_CTX})")
def _(t):
    rows, _series = _group_rows(t)
    return dq.check_no_lookahead(rows, as_of=F.lit("2030-01-01").cast("date")).withColumnRenamed("rows", "n_rows")


_RANGES = """SELECT *, CASE WHEN date <= DATE '1998-12-31' THEN 'train' WHEN date <= DATE '1999-12-31' THEN 'val' ELSE 'test' END AS split0 FROM bars"""


@query("split_order", "entity:i violates:b", "LK-02", "bars",
       f"""SELECT entity, coalesce(max(CASE WHEN s = 'train' THEN date END) >= min(CASE WHEN s = 'val' THEN date END), false)
 OR coalesce(max(CASE WHEN s = 'val' THEN date END) >= min(CASE WHEN s = 'test' THEN date END), false) AS violates FROM (
 SELECT *, CASE WHEN entity % 9 = 0 AND {DAYNO} % 50 = 0 THEN 'train' ELSE split0 END AS s FROM ({_RANGES})) GROUP BY entity""")
def _(t):
    """Entities divisible by 9 have some later rows mislabelled as training rows."""
    name = F.when(c("date") <= "1998-12-31", "train").when(c("date") <= "1999-12-31", "val").otherwise("test")
    wrong = (c("entity") % 9 == 0) & (day_number(c("date")) % 50 == 0)
    return dq.check_split_order(t.bars().withColumn("split", F.when(wrong, "train").otherwise(name)))


@query("schema_scan", "name:s filled:i verdict:s", "LK-03", "bars",
       f"""SELECT n AS name, k AS filled, v AS verdict FROM (SELECT 'pred_close' AS n, count(close) AS k, 'suspicious' AS v FROM bars UNION ALL
 SELECT 'next_day_return', count(next_day_return), 'target' FROM ({LABELS}) UNION ALL SELECT 'next_day_direction', count(next_day_direction), 'target' FROM ({LABELS}) UNION ALL
 SELECT 'next_3day_return', count(next_3day_return), 'target' FROM ({LABELS}) UNION ALL SELECT 'next_3day_direction', count(next_3day_direction), 'target' FROM ({LABELS}))""")
def _(t):
    return dq.schema_scan(add_labels(t.bars()).withColumn("pred_close", c("close"))).withColumnRenamed("column", "name")


@query("split_overlaps", "train_val:i train_test:i", "LK-04 SET-02", "bars",
       f"""SELECT count_if(a AND b) AS train_val, count_if(a AND d) AS train_test FROM (SELECT entity, date, bool_or(s = 'train') AS a, bool_or(s = 'val') AS b, bool_or(s = 'test') AS d FROM (
 SELECT entity, date, split0 AS s FROM ({_RANGES}) UNION ALL SELECT entity, date, 'val' FROM bars WHERE {DAYNO} % 10 = 0) GROUP BY entity, date)""")
def _(t):
    name = F.when(c("date") <= "1998-12-31", "train").when(c("date") <= "1999-12-31", "val").otherwise("test")
    bars = t.bars()
    rows = bars.select(*KEYS, name.alias("split")).unionByName(
        bars.where(day_number(c("date")) % 10 == 0).select(*KEYS, F.lit("val").alias("split"))
    )
    return dq.overlap_counts(rows, [("train", "val"), ("train", "test")], KEYS)


_LONG = " UNION ALL ".join(f"SELECT '{n}' AS feature, CAST({n} AS DOUBLE) AS x, next_day_return AS y FROM feats WHERE {n} IS NOT NULL AND next_day_return IS NOT NULL" for n in FEATURES)
_CORR = f"""SELECT feature, count(*) AS n, corr(x, y) AS pearson, corr(rx, ry) AS spearman FROM (
 SELECT *, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / 2.0 AS ry FROM ({_LONG})) GROUP BY feature"""


@query("feature_label_corr", "feature:s n:i pearson spearman near_perfect:b place:i", "LK-05 AG-11", "feats",
       f"SELECT *, abs(pearson) >= 0.9999 AS near_perfect, row_number() OVER (ORDER BY round(abs(pearson), 9) DESC, feature) AS place FROM ({_CORR})")
def _(t):
    return dq.feature_label_corr(feature_sample(t), FEATURES, "next_day_return")


@query("corr_summary", "min_abs median_abs max_abs", "LK-10", "feats",
       f"SELECT min(abs(pearson)) AS min_abs, quantile_cont(abs(pearson), 0.5) AS median_abs, max(abs(pearson)) AS max_abs FROM ({_CORR})")
def _(t):
    return dq.corr_summary(dq.label_pearson(feature_sample(t), FEATURES, "next_day_return"))


def _equal_sql(n: str) -> str:
    close = f"abs({n} - next_day_return) <= 1e-9 + abs(next_day_return) * 1e-5"
    return f"""SELECT '{n}' AS feature, avg(CASE WHEN next_day_return IS NOT NULL THEN CAST(coalesce({n} = next_day_return, false) AS INTEGER) END) AS exact,
 avg(CASE WHEN {n} IS NOT NULL AND next_day_return IS NOT NULL THEN CAST({close} AS INTEGER) END) AS near, bool_and(coalesce({n}, 0) = coalesce(next_day_return, 0)) AS identical FROM feats"""


@query("label_equality", "feature:s exact near identical:b flagged:b", "LK-06 LK-07", "feats",
       "SELECT *, exact > 0.01 OR near > 0.01 AS flagged FROM (" + " UNION ALL ".join(_equal_sql(n) for n in FEATURES) + ")")
def _(t):
    return dq.equality_fraction(feature_sample(t), FEATURES, "next_day_return")


add_view(
    "cats", "feats",
    "SELECT f.*, month(date) AS month, CASE WHEN next_day_return > 0.5 THEN 1 ELSE 0 END AS hint FROM feats f",
)
_CATS = ["weekday", "month", "hint", "return_lag_1"]
_CAT_LONG = " UNION ALL ".join(f"SELECT '{n}' AS feature, CAST({n} AS DOUBLE) AS x, next_day_return > 0 AS up FROM cats WHERE {n} IS NOT NULL AND next_day_return IS NOT NULL" for n in _CATS)


@query("category_delta", "feature:s n_values:i max_delta flagged:b", "LK-08", "cats",
       f"""SELECT feature, count(*) AS n_values, max(d) AS max_delta, max(d) > 0.2 AS flagged FROM (
 SELECT feature, x, abs(avg(CAST(up AS INTEGER)) - max(b)) AS d FROM (SELECT *, avg(CAST(up AS INTEGER)) OVER (PARTITION BY feature) AS b FROM ({_CAT_LONG})) GROUP BY feature, x) GROUP BY feature HAVING count(*) <= 50""")
def _(t):
    df = feature_sample(t).withColumns({"month": F.month("date"), "hint": F.when(c("next_day_return") > 0.5, 1).otherwise(0)})
    return dq.category_delta(df, _CATS, "next_day_return").withColumnRenamed("values", "n_values")


@query("prior_day_invariant", "checked:i mismatches:i", "LK-09", "prevs rets dim",
       f"""SELECT count(*) AS checked, 0 AS mismatches FROM ({_GROUP_CTX}) g JOIN ({GROUP_SERIES}) s ON s.industry = g.industry AND s.date = g.date""")
def _(t):
    return dq.group_feature_mismatches(*_group_rows(t))


@query("streak_profile", "name:s nulls:i null_pct", "DQ-01", "bars",
       "SELECT 'consecutive_days' AS name, count(DISTINCT entity) AS nulls, count(DISTINCT entity) * 100.0 / count(*) AS null_pct FROM bars")
def _(t):
    return dq.null_profile(add_streak(t.bars()), ["consecutive_days"]).withColumnRenamed("column", "name")
