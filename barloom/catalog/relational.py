"""Filters, projections, joins, aggregates, windows, top-k and set operations."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from barloom.catalog.base import BY, DAYNO, over, query
from barloom.catalog.features import LABELS, label_sql
from barloom.functions import scalars as sc
from barloom.operators import aggregates as ag
from barloom.operators import joins as jn
from barloom.operators import ranking, windows
from barloom.operators import universe as un
from barloom.operators.price import add_labels, add_momentum, add_returns
from barloom.operators.quality import compare_versions, split_overlap, version_summary
from barloom.sources.tables import day_number

c = F.col
W = over()
KEYS = ["entity", "date"]

# -------------------------------------------------------------------------------------------- filters


@query("universe_filter", "entity:i code:s name:s", "FLT-01 JN-03", "dim bars",
       "SELECT * FROM dim WHERE name NOT LIKE 'ST%' AND name NOT LIKE '%ST' AND entity IN (SELECT entity FROM bars)")
def _(t):
    return un.filter_universe(t.dim(), t.bars())


@query("special_names", "entity:i name:s", "FLT-02", "dim",
       "SELECT * FROM dim WHERE upper(trim(name)) LIKE 'ST%' OR upper(trim(name)) LIKE '*ST%'")
def _(t):
    return t.dim().where(sc.is_special_name(c("name")))


@query("listing_age", "entity:i list_date:d", "FLT-03", "dim", "SELECT * FROM dim WHERE list_date <= DATE '2000-01-10' - INTERVAL 5 YEAR")
def _(t):
    return un.filter_universe(t.dim(), exclude_st=False, min_age_years=5, start=F.lit("2000-01-10").cast("date"))


@query("complete_rows", "entity:i date:d next_day_return price_momentum_20", "FLT-04 FLT-10", "bars",
       f"SELECT * FROM (SELECT *, close / lag(close, 20) {W} - 1 AS price_momentum_20 FROM ({LABELS})) WHERE next_day_return IS NOT NULL AND next_3day_return IS NOT NULL AND price_momentum_20 IS NOT NULL")
def _(t):
    df = add_momentum(add_labels(t.bars()), (20,))
    return un.complete_rows(df, ["next_day_return", "next_3day_return", "price_momentum_20"])


@query("latest_slice", "entity:i date:d close:f4", "FLT-05", "bars", "SELECT * FROM bars WHERE date = (SELECT max(date) FROM bars)")
def _(t):
    return un.latest_slice(t.bars())


@query("recent_window", "entity:i date:d close:f4", "FLT-06", "bars", "SELECT * FROM bars WHERE date >= (SELECT max(date) FROM bars) - 90")
def _(t):
    bars = t.bars()
    return bars.where(c("date") >= F.date_sub(bars.agg(F.max("date")).scalar(), 90))


@query("date_set", "entity:i date:d close:f4", "FLT-06", "bars", "SELECT * FROM bars WHERE date IN (DATE '1998-03-02', DATE '1998-03-03', DATE '1999-07-01')")
def _(t):
    return t.bars().where(c("date").isin([date(1998, 3, 2), date(1998, 3, 3), date(1999, 7, 1)]))


@query("industry_filter", "entity:i industry:s", "FLT-07", "dim", "SELECT * FROM dim WHERE contains(industry, '_1') OR contains(industry, '_7')")
def _(t):
    return un.filter_universe(t.dim(), exclude_st=False, industries="_1, _7")


@query("cap_band", "entity:i date:d total_mv:f4", "FLT-08", "bars val",
       """SELECT b.entity, b.date, total_mv FROM bars b LEFT JOIN val v ON v.entity = b.entity AND v.date = b.date
 WHERE total_mv IS NULL OR total_mv BETWEEN 20000 AND 200000""")
def _(t):
    df = jn.lookup(t.bars(), t.valuation(), KEYS, ["total_mv"])
    return df.where(sc.in_band(c("total_mv"), 2.0, 20.0))


@query("well_formed_dates", "cal_date:s parsed:d", "FLT-09 F-01", "cal",
       """SELECT cal_date, date AS parsed FROM cal WHERE regexp_matches(CASE WHEN is_open = '0' THEN cal_date || 'x' ELSE cal_date END, '^[0-9]{8}$')""")
def _(t):
    text = F.when(c("is_open") == "0", F.concat("cal_date", F.lit("x"))).otherwise(c("cal_date"))
    df = t.calendar().withColumn("text", text).where(sc.well_formed_date(c("text")))
    return df.withColumn("parsed", sc.parse_date(c("text")))


@query("future_guard", "kept:i dropped:i", "FLT-11", "bars", "SELECT count_if(date <= DATE '2001-01-01') AS kept, count_if(date > DATE '2001-01-01') AS dropped FROM bars")
def _(t):
    kept, dropped = un.guard_future(t.bars(), F.lit("2001-01-01").cast("date"))
    return jn.with_scalars(kept.agg(F.count(F.lit(1)).alias("kept")), dropped)


@query("placeholders", "entity:i date:d pe sector_momentum_vs_market", "PRJ-01", "bars val",
       "SELECT b.entity, b.date, coalesce(pe, 0) AS pe, 0.0 AS sector_momentum_vs_market FROM bars b LEFT JOIN val v ON v.entity = b.entity AND v.date = b.date")
def _(t):
    df = jn.lookup(t.bars(), t.valuation(), KEYS, ["pe"])
    return df.withColumns({"pe": F.coalesce("pe", F.lit(0.0)), "sector_momentum_vs_market": F.lit(0.0)})


@query("drop_forward", "entity:i date:d close:f4 next_day_return", "PRJ-02", "bars", f"SELECT entity, date, close, next_day_return FROM ({LABELS})")
def _(t):
    return un.drop_forward_cols(add_labels(t.bars()), keep=("next_day_return",))


@query("feature_label_split", "entity:i date:d volume next_day_return", "PRJ-03 JN-15", "bars", f"SELECT entity, date, volume, next_day_return FROM ({LABELS})")
def _(t):
    features, labels = un.split_columns(add_labels(t.bars()), ["next_day_return", "next_day_direction", "next_3day_return", "next_3day_direction"])
    return jn.join_counting(features, labels, KEYS)[0]


@query("bool_text", "entity:i flag:s", "PRJ-04", "dim", "SELECT entity, CASE entity % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE 'Maybe' END AS flag FROM dim")
def _(t):
    raw = F.when(c("entity") % 3 == 0, "True").when(c("entity") % 3 == 1, "FALSE").otherwise("Maybe")
    return t.dim().withColumn("flag", sc.normal_bool_text(raw))


# ---------------------------------------------------------------------------------------------- joins


@query("facts_with_dimension", "entity:i date:d industry:s close:f4", "JN-01", "bars dim", "SELECT * FROM bars JOIN dim USING (entity)")
def _(t):
    return t.bars().join(t.dim(), "entity")


@query("prediction_context", "entity:i date:d industry:s predicted_return pe_ttm", "JN-02", "preds dim val",
       """SELECT p.entity, p.date, industry, predicted_return, pe_ttm FROM preds p LEFT JOIN dim d ON d.entity = p.entity
 LEFT JOIN val v ON v.entity = p.entity AND v.date = p.date""")
def _(t):
    return jn.lookup(t.preds().join(t.dim(), "entity", "left"), t.valuation(), KEYS, ["pe_ttm"])


@query("semi_join", "entity:i date:d close:f4", "JN-03", "bars preds", "SELECT * FROM bars b WHERE EXISTS (SELECT 1 FROM preds f WHERE f.entity = b.entity AND f.date = b.date)")
def _(t):
    return jn.has_match(t.bars(), t.preds(), KEYS)


@query("anti_join", "entity:i date:d close:f4", "JN-04", "bars preds", "SELECT * FROM bars b WHERE NOT EXISTS (SELECT 1 FROM preds f WHERE f.entity = b.entity AND f.date = b.date)")
def _(t):
    return jn.has_no_match(t.bars(), t.preds(), KEYS)


@query("scalar_cross_join", "entity:i date:d close:f4 max_date:d mean_close:f4", "JN-05", "bars",
       "SELECT * FROM bars CROSS JOIN (SELECT max(date) AS max_date, avg(close) AS mean_close FROM bars)")
def _(t):
    bars = t.bars()
    return jn.with_scalars(bars, bars.agg(F.max("date").alias("max_date"), F.avg("close").alias("mean_close")))


@query("asof_strict", "entity:i date:d x:f4 ref_date:d", "JN-08", "bars",
       f"""SELECT b.entity, b.date, r.close AS x, r.date AS ref_date FROM bars b
 ASOF LEFT JOIN (SELECT * FROM bars WHERE {DAYNO} % 3 = 0) r ON r.entity = b.entity AND b.date > r.date""")
def _(t):
    bars = t.bars()
    ref = bars.where(day_number(c("date")) % 3 == 0).select("entity", "date", c("close").alias("x"))
    return jn.asof_join(bars, ref, "entity", ["x"], strict=True)


@query("asof_inclusive", "entity:i date:d x:f4 ref_date:d", "JN-07", "bars",
       f"""SELECT b.entity, b.date, r.close AS x, r.date AS ref_date FROM bars b
 ASOF LEFT JOIN (SELECT * FROM bars WHERE {DAYNO} % 3 = 0) r ON r.entity = b.entity AND b.date >= r.date""")
def _(t):
    bars = t.bars()
    ref = bars.where(day_number(c("date")) % 3 == 0).select("entity", "date", c("close").alias("x"))
    return jn.asof_join(bars, ref, "entity", ["x"])


@query("latest_per_entity", "entity:i date:d close:f4 volume", "JN-09 WIN-01", "bars",
       "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date DESC) AS rn FROM bars) WHERE rn = 1 AND close >= 2")
def _(t):
    return jn.latest_per(t.bars()).where(c("close") >= 2)


@query("third_next", "entity:i date:d close_next_3:f4", "JN-10", "bars",
       f"SELECT entity, date, lead(close, 3) {W} AS close_next_3 FROM bars")
def _(t):
    return jn.kth_next(t.bars(), "close", 3)


@query("next_row", "entity:i date:d next_date:d next_close:f4", "JN-11", "bars",
       """SELECT b.entity, b.date, n.date AS next_date, n.close AS next_close FROM bars b
 ASOF LEFT JOIN bars n ON n.entity = b.entity AND n.date > b.date""")
def _(t):
    return jn.kth_next(jn.kth_next(t.bars(), "date", 1, "next_date"), "close", 1, "next_close")


_RESOLVE = """SELECT p.entity, CASE WHEN p.entity % 4 = 0 THEN NULL ELSE d.code END AS code, CASE WHEN p.entity % 8 = 0 THEN 'nobody' ELSE d.name END AS name FROM places p JOIN dim d ON d.entity = p.entity"""


def _unresolved(t):
    d = t.dim()
    return d.select(
        "entity",
        F.when(c("entity") % 4 != 0, c("code")).alias("code"),
        F.when(c("entity") % 8 == 0, "nobody").otherwise(c("name")).alias("name"),
    )


@query("resolved_codes", "entity:i code:s resolution:s", "JN-12", "places dim",
       f"""SELECT x.entity, coalesce(x.code, u.code, '') AS code, CASE WHEN x.code IS NOT NULL THEN 'given' WHEN u.code IS NOT NULL THEN 'by_name' ELSE 'unresolved' END AS resolution
 FROM ({_RESOLVE}) x LEFT JOIN (SELECT name, min(code) AS code FROM dim GROUP BY name HAVING count(*) = 1) u ON u.name = x.name""")
def _(t):
    return jn.resolve_code(_unresolved(t), t.dim()).withColumn("code", F.coalesce("code", F.lit("")))


@query("resolution_counts", "given:i by_name:i unresolved:i", "JN-12", "dim",
       "SELECT count_if(entity % 4 <> 0) AS given, count_if(entity % 4 = 0 AND entity % 8 <> 0) AS by_name, count_if(entity % 8 = 0) AS unresolved FROM dim")
def _(t):
    r = jn.resolve_code(_unresolved(t), t.dim())
    return r.agg(*[F.count_if(c("resolution") == k).alias(k) for k in ("given", "by_name", "unresolved")])


@query("sector_index_join", "code:s date:d pct_change net_amount:f4", "JN-13", "sectors sflows",
       "SELECT s.code, s.date, s.pct_change, f.net_amount FROM sectors s LEFT JOIN sflows f ON f.code = s.code AND f.date = s.date")
def _(t):
    return jn.lookup(t.sectors(), t.sector_flows(), ["code", "date"], ["net_amount"])


@query("first_available_series", "date:d log_level", "JN-14", "idx",
       """SELECT date, ln(coalesce(max(CASE WHEN code = 'usdcnh' THEN close END), max(CASE WHEN code = 'hsi' THEN close END), max(CASE WHEN code = 'csi300' THEN close END))) AS log_level FROM idx GROUP BY date""")
def _(t):
    from barloom.operators.context import pivot_series

    wide = pivot_series(t.index_bars(), ("usdcnh", "hsi", "csi300"), ("close",))
    return wide.withColumn("log_level", F.ln(jn.first_available(c("usdcnh_close"), c("hsi_close"), c("csi300_close"))))


@query("unmatched_counts", "left_unmatched:i right_unmatched:i", "JN-15", "bars preds",
       """SELECT (SELECT count(*) FROM bars b WHERE NOT EXISTS (SELECT 1 FROM preds f WHERE f.entity = b.entity AND f.date = b.date)) AS left_unmatched,
 (SELECT count(*) FROM preds f WHERE NOT EXISTS (SELECT 1 FROM bars b WHERE f.entity = b.entity AND f.date = b.date)) AS right_unmatched""")
def _(t):
    return jn.join_counting(t.bars(), t.preds().drop("model_version"), KEYS)[1]


@query("three_way_predictions", "entity:i date:d next_day_return base model", "JN-16", "bars preds",
       f"""SELECT l.entity, l.date, next_day_return, predicted_3day_return / 100 AS base, predicted_return / 100 AS model
 FROM ({LABELS}) l JOIN preds p ON p.entity = l.entity AND p.date = l.date WHERE next_day_return IS NOT NULL""")
def _(t):
    p = t.preds()
    base = p.select(*KEYS, (c("predicted_3day_return") / 100).alias("base"))
    model = p.select(*KEYS, (c("predicted_return") / 100).alias("model"))
    return jn.combine_predictions(add_labels(t.bars()).select(*KEYS, "next_day_return"), base, model, KEYS)


# ----------------------------------------------------------------------------------------- aggregates


@query("daily_summary", "date:d n:i avg_close:f4 total_volume min_low:f4 max_high:f4 entities:i", "AG-01 AG-02 AG-15", "bars",
       "SELECT date, count(*) AS n, avg(close) AS avg_close, sum(volume) AS total_volume, min(low) AS min_low, max(high) AS max_high, count(DISTINCT entity) AS entities FROM bars GROUP BY date")
def _(t):
    return t.bars().groupBy("date").agg(
        F.count(F.lit(1)).alias("n"), F.avg("close").alias("avg_close"), F.sum("volume").alias("total_volume"),
        F.min("low").alias("min_low"), F.max("high").alias("max_high"), F.count_distinct("entity").alias("entities"),
    )


@query("conditional_sums", "entity:i up_days:i down_days:i up_volume avg_up best", "AG-03 AG-12", "rets",
       """SELECT entity, count_if(pct_chg > 0) AS up_days, count(*) FILTER (WHERE pct_chg < 0) AS down_days, sum(CASE WHEN pct_chg > 0 THEN volume END) AS up_volume,
 avg(CASE WHEN pct_chg > 0 THEN pct_chg END) AS avg_up, max(CASE WHEN volume > 20 THEN pct_chg END) AS best FROM rets GROUP BY entity""")
def _(t):
    up = c("pct_chg") > 0
    return t.returns().groupBy("entity").agg(
        F.count_if(up).alias("up_days"), F.count_if(c("pct_chg") < 0).alias("down_days"), F.sum(F.when(up, c("volume"))).alias("up_volume"),
        F.avg(F.when(up, c("pct_chg"))).alias("avg_up"), F.max(F.when(c("volume") > 20, c("pct_chg"))).alias("best"),
    )


@query("having_ratio", "entity:i days:i win_rate", "AG-04 AG-12", "rets",
       "SELECT entity, count(*) AS days, count_if(pct_chg > 0) * 100.0 / count(*) AS win_rate FROM rets GROUP BY entity HAVING count(*) >= 50 AND count_if(pct_chg > 0) * 1.0 / count(*) >= 0.48")
def _(t):
    agg = t.returns().groupBy("entity").agg(F.count(F.lit(1)).alias("days"), ag.win_rate(c("pct_chg") > 0).alias("win_rate"))
    return agg.where((c("days") >= 50) & (c("win_rate") >= 48))


@query("monthly_percentiles", "ym:s low high median", "AG-05", "rets",
       "SELECT strftime(date, '%Y%m') AS ym, quantile_cont(pct_chg, 0.025) AS low, quantile_cont(pct_chg, 0.975) AS high, quantile_cont(pct_chg, 0.5) AS median FROM rets GROUP BY 1")
def _(t):
    df = t.returns().select(F.date_format("date", "yyyyMM").alias("ym"), "pct_chg")
    return ranking.exact_percentiles(df, ["ym"], "pct_chg", {"low": 0.025, "high": 0.975, "median": 0.5})


@query("winsorized_labels", "entity:i date:d next_day_return", "L-03 AG-05", "bars",
       f"""WITH l AS ({LABELS}), b AS (SELECT strftime(date, '%Y%m') AS ym, quantile_cont(next_day_return, 0.025) AS lo, quantile_cont(next_day_return, 0.975) AS hi FROM l GROUP BY 1)
 SELECT entity, date, least(greatest(next_day_return, lo), hi) AS next_day_return FROM l JOIN b ON b.ym = strftime(date, '%Y%m') WHERE next_day_return IS NOT NULL""")
def _(t):
    from barloom.operators.labels import winsorize

    return winsorize(add_labels(t.bars()), "next_day_return", 0.025).where(c("next_day_return").isNotNull())


RATE = 7.183264917
_CONVERTED = "(SELECT entity, date, " + ", ".join(f"{x} * CAST({RATE} AS DOUBLE) AS {x}" for x in ("open", "high", "low", "close", "amount")) + ", volume FROM bars)"


def _converted(t):
    """Bars at a fixed exchange rate."""
    return t.bars().withColumns({x: c(x) * RATE for x in ("open", "high", "low", "close", "amount")})


@query("sector_bars", "industry:s date:d open:f2 high:f2 low:f2 close:f2 volume:f2 amount:f2", "AG-08", "bars dim",
       "SELECT industry, date, " + ", ".join(f"avg({x}) AS {x}" for x in ("open", "high", "low", "close")) + ", sum(volume) AS volume, sum(amount) AS amount FROM " + _CONVERTED + " JOIN dim USING (entity) GROUP BY industry, date")
def _(t):
    return ag.sector_bars(_converted(t), t.dim())


@query("segment_bars", "segment:s date:d open:f2 high:f2 low:f2 close:f2 volume:f2 amount:f2", "AG-09", "bars dim",
       "SELECT substr(code, 1, 1) AS segment, date, " + ", ".join(f"avg({x}) AS {x}" for x in ("open", "high", "low", "close")) + ", sum(volume) AS volume, sum(amount) AS amount FROM " + _CONVERTED + " JOIN dim USING (entity) GROUP BY 1, date")
def _(t):
    df = _converted(t).join(t.dim().select("entity", "code"), "entity")
    return ag.segment_bars(df, c("code"), width=1)


@query("pearson_by_entity", "entity:i r", "AG-10", "rets", "SELECT entity, coalesce(corr(pct_chg, volume), 0) AS r FROM rets GROUP BY entity")
def _(t):
    return t.returns().groupBy("entity").agg(ag.pearson(c("pct_chg"), c("volume")).alias("r"))


_AVG_RANK = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0"


@query("information_coefficient", "n:i pearson spearman", "AG-10 AG-11 VAL-07", "bars preds",
       f"""SELECT count(*) AS n, corr(a, b) AS pearson, corr(ra, rb) AS spearman FROM (
 SELECT *, {_AVG_RANK.format('a')} AS ra, {_AVG_RANK.format('b')} AS rb FROM (
  SELECT predicted_return AS a, next_day_return AS b FROM preds p JOIN ({LABELS}) l ON l.entity = p.entity AND l.date = p.date WHERE next_day_return IS NOT NULL))""")
def _(t):
    df = t.preds().join(add_labels(t.bars()).select(*KEYS, "next_day_return"), KEYS)
    return ag.ic(df, "predicted_return", "next_day_return")


@query("rows_per_entity", "keys:i n_rows:i min_rows:i avg_rows max_rows:i", "AG-13", "bars",
       "SELECT count(*) AS keys, sum(n) AS n_rows, min(n) AS min_rows, avg(n) AS avg_rows, max(n) AS max_rows FROM (SELECT entity, count(*) AS n FROM bars GROUP BY entity)")
def _(t):
    return ag.rows_per_key(t.bars()).withColumnRenamed("rows", "n_rows")


@query("universe_composition", "market:s industry:s entities:i", "AG-14", "dim", "SELECT market, industry, count(*) AS entities FROM dim GROUP BY market, industry")
def _(t):
    return t.dim().groupBy("market", "industry").agg(F.count(F.lit(1)).alias("entities"))


@query("distinct_entities", "entity:i", "AG-15", "bars", "SELECT DISTINCT entity FROM bars")
def _(t):
    return t.bars().select("entity").distinct().orderBy("entity")


@query("date_range", "first_date:d last_date:d", "AG-16", "bars", "SELECT min(date) AS first_date, max(date) AS last_date FROM bars")
def _(t):
    return t.bars().agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))


# -------------------------------------------------------------------------------------------- windows


@query("prior_mean", "entity:i date:d prior_mean", "WIN-05", "bars", f"SELECT entity, date, avg(volume) OVER ({BY} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS prior_mean FROM bars")
def _(t):
    return t.bars().withColumn("prior_mean", F.avg("volume").over(windows.preceding(20)))


@query("liquidity_buckets", "entity:i pct_rank:i", "WIN-06 SEL-01", "bars",
       "SELECT entity, avg_amount, ntile(100) OVER (ORDER BY avg_amount DESC, entity) AS pct_rank FROM (SELECT entity, avg(amount) AS avg_amount FROM bars WHERE date >= DATE '2001-01-01' GROUP BY entity)")
def _(t):
    return un.liquidity_rank(t.bars(), t.dim(), F.lit("2001-01-01").cast("date"))


@query("copies_per_key", "entity:i date:d run:i copies:i", "WIN-07", "versioned", "SELECT entity, date, run, count(*) OVER (PARTITION BY entity, date) AS copies FROM versioned")
def _(t):
    # A key has two rows at most, and they lie side by side in the order of the windows before.
    return t.versioned().withColumn("copies", F.count(F.lit(1)).over(windows.whole(KEYS)))


@query("cumulative_growth", "entity:i date:d log_growth", "WIN-08", "prevs",
       f"SELECT entity, date, ln(product(1 + coalesce(close / prev - 1, 0) / 100) OVER ({BY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS log_growth FROM prevs")
def _(t):
    step = 1 + F.coalesce(windows.ratio(c("close"), c("_p")) - 1, F.lit(0.0)) / 100
    return t.bars().withColumn("_p", windows.lagged("close")).withColumn("log_growth", F.ln(F.product(step).over(windows.running())))


@query("share_below", "entity:i date:d share", "WIN-10", "bars", f"SELECT entity, date, len(list_filter(list(close) {over(20)}, lambda v: v < close)) / len(list(close) {over(20)}) AS share FROM bars")
def _(t):
    return windows.apply_steps(t.bars(), windows.share_below_steps("close", "share", 20))


@query("random_row_numbers", "rn:i entity:i", "WIN-13", "dim", "SELECT row_number() OVER (ORDER BY md5(CAST(entity AS VARCHAR) || ':7'), entity) AS rn, entity FROM dim")
def _(t):
    df = t.dim().withColumn("u", ranking.shuffled_order("entity", seed=7))
    return ranking.global_row_number(df, [c("u"), c("entity")])


@query("global_row_numbers", "rn:i entity:i date:d", "WIN-01 SRT-04", "bars", "SELECT row_number() OVER (ORDER BY volume DESC, entity, date) AS rn, entity, date FROM bars")
def _(t):
    return ranking.global_row_number(t.bars(), [c("volume").desc(), c("entity"), c("date")])


@query("grouped_row_numbers", "industry:s entity:i date:d rn:i n:i", "WIN-01 SMP-03", "bars dim",
       "SELECT industry, entity, date, row_number() OVER (PARTITION BY industry ORDER BY close, entity, date) AS rn, count(*) OVER (PARTITION BY industry) AS n FROM bars JOIN dim USING (entity)")
def _(t):
    df = t.bars().join(t.dim().select("entity", "industry"), "entity")
    return ranking.grouped_row_number(df, ["industry"], [c("close"), c("entity"), c("date")], total="n")


# --------------------------------------------------------------------------------------- sort and top-k


@query("top_by_value", "entity:i date:d amount:f4 volume", "SRT-01", "bars", "SELECT * FROM bars ORDER BY amount DESC, entity, date LIMIT 25")
def _(t):
    return t.bars().orderBy(c("amount").desc_nulls_last(), "entity", "date").limit(25)


@query("top_by_absolute", "entity:i date:d pct_chg:f4", "SRT-02", "rets", "SELECT * FROM rets ORDER BY abs(pct_chg) DESC, entity, date LIMIT 25")
def _(t):
    return t.returns().orderBy(F.abs("pct_chg").desc(), "entity", "date").limit(25)


@query("top_per_date", "entity:i date:d amount:f4 rank:i", "SRT-03", "bars", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY amount DESC, entity) AS rank FROM bars) WHERE rank <= 3")
def _(t):
    return ag.top_n(t.bars(), "date", [c("amount").desc(), c("entity")], 3)


@query("topk_stats", "p k:i accuracy mean_return", "SRT-04 VAL-07", "bars preds",
       f"""WITH x AS (SELECT p.entity, p.date, predicted_return AS a, next_day_return AS b, row_number() OVER (ORDER BY abs(predicted_return) DESC, p.entity, p.date) AS rn, count(*) OVER () AS n
 FROM preds p JOIN ({LABELS}) l ON l.entity = p.entity AND l.date = p.date WHERE next_day_return IS NOT NULL)
 SELECT p, count(*) AS k, avg(CAST((a >= 0) = (b >= 0) AS INTEGER)) AS accuracy, avg(b) AS mean_return FROM x CROSS JOIN (VALUES (0.01), (0.05), (0.1), (0.5)) v(p)
 WHERE rn <= greatest(1, floor(n * CAST(p AS DOUBLE))) GROUP BY p""")
def _(t):
    df = t.preds().join(add_labels(t.bars()).select(*KEYS, "next_day_return"), KEYS)
    return ag.topk_stats(df, "predicted_return", "next_day_return", (0.01, 0.05, 0.1, 0.5), KEYS)


@query("first_per_entity", "entity:i date:d amount:f4", "SRT-05", "bars",
       "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY amount DESC, date) AS rn FROM bars) WHERE rn = 1 ORDER BY amount DESC, date LIMIT 50")
def _(t):
    return ag.first_per_key(t.bars(), "entity", [c("amount").desc(), c("date")], 50)


@query("best_and_worst", "side:s entity:i date:d pct_chg:f4", "SRT-06", "rets",
       """SELECT * FROM (SELECT 'best' AS side, * FROM rets ORDER BY pct_chg DESC, entity, date LIMIT 5) UNION ALL
 SELECT * FROM (SELECT 'worst' AS side, * FROM rets ORDER BY pct_chg, entity, date LIMIT 5)""")
def _(t):
    return ag.best_and_worst(t.returns(), "pct_chg", KEYS)


@query("entity_page", "entity:i", "SRT-07", "bars", "SELECT DISTINCT entity FROM bars ORDER BY entity LIMIT 20 OFFSET 5")
def _(t):
    return un.page(t.bars().select("entity").distinct(), "entity", 5, 20)


# ------------------------------------------------------------------------------------------------ sets


@query("union_of_branches", "entity:i", "SET-01", "dim bars",
       "SELECT entity FROM dim WHERE code LIKE '1%' UNION SELECT entity FROM bars WHERE volume > 100 UNION SELECT entity FROM dim WHERE market = 'ASIA'")
def _(t):
    d = t.dim()
    heavy = t.bars().where(c("volume") > 100).select("entity")
    return d.where(c("code").like("1%")).select("entity").union(heavy).union(d.where(c("market") == "ASIA").select("entity")).distinct()


@query("split_overlap", "entity:i date:d", "SET-02 LK-04", "bars",
       "SELECT entity, date FROM bars WHERE date <= DATE '1999-01-31' INTERSECT SELECT entity, date FROM bars WHERE date >= DATE '1999-01-01'")
def _(t):
    bars = t.bars()
    return split_overlap(bars.where(c("date") <= "1999-01-31"), bars.where(c("date") >= "1999-01-01"))


def _two_versions(t):
    bars = t.bars().select(*KEYS, "close", "volume")
    no = day_number(c("date"))
    other = bars.where(no % 6 != 0).withColumns(
        {"close": F.when(no % 4 == 0, c("close") + 1).otherwise(c("close")), "volume": F.when(no % 5 == 0, F.lit(None)).otherwise(c("volume"))}
    )
    return bars, other


@query("version_differences", "entity:i date:d columns:s", "SET-03", "bars",
       f"""SELECT entity, date, concat_ws(',', CASE WHEN {DAYNO} % 4 = 0 THEN 'close' END, CASE WHEN {DAYNO} % 5 = 0 THEN 'volume' END) AS columns FROM bars WHERE {DAYNO} % 6 <> 0""")
def _(t):
    a, b = _two_versions(t)
    return compare_versions(a, b, KEYS).withColumn("columns", F.array_join("differs", ","))


@query("version_summary", "total:i matched:i different:i", "SET-03", "bars",
       f"SELECT count(*) AS total, count_if({DAYNO} % 6 <> 0) AS matched, count_if({DAYNO} % 6 <> 0 AND ({DAYNO} % 4 = 0 OR {DAYNO} % 5 = 0)) AS different FROM bars")
def _(t):
    a, b = _two_versions(t)
    return version_summary(a, b, KEYS)


@query("concatenated_chunks", "entity:i date:d close:f4", "SET-04", "bars", "SELECT * FROM bars WHERE volume > 60 UNION ALL SELECT * FROM bars WHERE volume < 5")
def _(t):
    bars = t.bars()
    return bars.where(c("volume") > 60).unionAll(bars.where(c("volume") < 5))


# --------------------------------------------------------------------------------------- scalar functions


@query("scalar_null_math", "entity:i date:d filled ratio_or_null rounded:f2 clamped logged signed_root soft hard", "Scalar functions: null, math", "raw",
       """SELECT entity, date, coalesce(CASE WHEN volume > 30 THEN NULL ELSE volume END, -1) AS filled, amount / nullif(volume - 7, 0) AS ratio_or_null,
 round(pct_chg, 2) AS rounded, least(greatest(pct_chg, -10), 10) AS clamped, ln(amount) AS logged,
 sign(pct_chg) * sqrt(abs(pct_chg)) AS signed_root, tanh(pct_chg / 300) AS soft, atanh(least(greatest(pct_chg / 1000, -0.999), 0.999)) AS hard FROM raw""")
def _(t):
    x = c("pct_chg")
    return t.raw().withColumns(
        {
            "filled": F.coalesce(F.when(c("volume") <= 30, c("volume")), F.lit(-1.0)),
            "ratio_or_null": windows.ratio(c("amount"), c("volume") - 7),
            "rounded": sc.round_to(x, 2),
            "clamped": sc.clamp(x, -10, 10),
            "logged": F.ln("amount"),
            "signed_root": F.signum(x) * F.sqrt(F.abs(x)),
            "soft": F.tanh(x / 300),
            "hard": F.atanh(sc.clamp(x / 1000, -0.999, 0.999)),
        }
    )


@query("scalar_dates", "entity:i list_date:d month_later:d years_before:d ym:s month:i quarter:i week:i weekday:i", "Scalar functions: date", "dim",
       """SELECT entity, list_date, CAST(list_date + INTERVAL 1 MONTH AS DATE) AS month_later, CAST(list_date - INTERVAL 2 YEAR AS DATE) AS years_before, strftime(list_date, '%Y%m') AS ym,
 month(list_date) AS month, quarter(list_date) AS quarter, weekofyear(list_date) AS week, isodow(list_date) - 1 AS weekday FROM dim""")
def _(t):
    d = c("list_date")
    return t.dim().withColumns(
        {
            "month_later": F.add_months(d, 1), "years_before": F.add_months(d, -24), "ym": F.date_format(d, "yyyyMM"),
            "month": F.month(d), "quarter": F.quarter(d), "week": F.weekofyear(d), "weekday": F.weekday(d),
        }
    )


@query("scalar_text_casts", "entity:i upper_name:s head:s has_one:b starts:b parts:i number:f0", "Scalar functions: string, cast", "dim",
       """SELECT entity, upper(trim(name)) AS upper_name, substr(code, 1, 2) AS head, contains(industry, '1') AS has_one, starts_with(code, '1') AS starts,
 len(string_split(industry, '_')) AS parts, TRY_CAST(replace(industry, 'NATION_', '') AS DOUBLE) AS number FROM dim""")
def _(t):
    return t.dim().withColumns(
        {
            "upper_name": F.upper(F.trim("name")), "head": F.substring("code", 1, 2), "has_one": F.contains(c("industry"), F.lit("1")),
            "starts": F.startswith(c("code"), F.lit("1")), "parts": F.size(F.split("industry", "_")),
            "number": F.replace(c("industry"), F.lit("NATION_"), F.lit("")).try_cast("double"),
        }
    )


@query("scalar_json_guards", "event_id:i k:f0 guarded", "Scalar functions: JSON, float guards", "",
       """SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, CASE WHEN event_id % 5 = 0 THEN 0 WHEN event_id % 7 = 0 THEN 0 ELSE value END AS guarded FROM events""")
def _(t):
    e = t.table("events")
    odd = F.when(c("event_id") % 5 == 0, float("nan")).when(c("event_id") % 7 == 0, float("inf")).otherwise(c("value"))
    return e.select("event_id", sc.to_double(F.get_json_object("props", "$.k")).alias("k"), sc.finite_or_zero(odd).alias("guarded"))


@query("returns_of_users", "entity:i date:d close_pct", "F-02", "ubars",
       f"SELECT entity, date, (close - coalesce(lag(close) {W}, open)) / coalesce(lag(close) {W}, open) * 100 AS close_pct FROM ubars")
def _(t):
    return add_returns(t.user_bars())


@query("labels_five_days", "entity:i date:d next_5day_return next_5day_direction:f0", "L-02", "bars", f"SELECT entity, date, {label_sql(5, 0.01)} FROM bars")
def _(t):
    return add_labels(t.bars(), {5: 0.01})
