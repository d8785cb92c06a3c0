"""Sources, sinks, upserts and incremental planning."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from barloom.catalog.base import DAYNO, add_view, query
from barloom.operators.price import add_momentum
from barloom.operators.windows import row_no
from barloom.session import ensure_checkpoint_dir
from barloom.sources import landing, panel, payload, upsert as ups
from barloom.sources.schemas import ADJUSTED_BARS, conform
from barloom.sources.tables import day_number
from barloom.streaming import incremental as inc

c = F.col

KEYS = ["entity", "date"]


def scratch(spark, name: str) -> str:
    """A fresh folder under the shared checkpoint folder for a written table."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# -------------------------------------------------------------------------------------------- sources


@query("panel_scan", "entity:i date:d close:f4 volume", "SRC-01", "bars",
       "SELECT * FROM bars WHERE date BETWEEN DATE '1997-01-01' AND DATE '1998-06-30'")
def _(t):
    return panel.bound(t.bars(), "1997-01-01", "1998-06-30")


@query("panel_stored", "entity:i date:d close:f4 volume", "SRC-01", "bars",
       "SELECT * FROM bars WHERE date BETWEEN DATE '1997-01-01' AND DATE '1998-06-30'")
def _(t):
    """The same bounds over a written panel: year partitions and row groups are pruned."""
    path = scratch(t.spark, "panel")
    panel.write_panel(t.bars(), path)
    return panel.read_panel(t.spark, path, "1997-01-01", "1998-06-30")


_PAYLOAD_ROWS = """SELECT CAST(entity AS VARCHAR) AS ts_code, date AS trade_date, close, volume AS vol,
 CASE WHEN volume > 30 THEN NULL ELSE amount END AS amount FROM bars WHERE entity % 10 <> 3"""


@query("payload_rows", "ts_code:s trade_date:d close:f4 vol amount:f4", "SRC-02 SRC-05", "bars", _PAYLOAD_ROWS)
def _(t):
    return payload.parse_payload(t.payloads(), "ts_code string, trade_date date, close double, vol double, amount double")


@query("payload_missing_field", "ts_code:s close:f4 turnover", "SRC-02", "bars",
       f"SELECT ts_code, close, CAST(NULL AS DOUBLE) AS turnover FROM ({_PAYLOAD_ROWS})")
def _(t):
    return payload.parse_payload(t.payloads(), "ts_code string, close double, turnover double")


@query("payload_kinds", "field:s samples:i type:s", "SRC-03", "bars",
       """SELECT f AS field, n AS samples, k AS type FROM (
 SELECT count(*) AS n FROM bars WHERE entity % 10 <> 3) CROSS JOIN
 (VALUES ('ts_code', 'string'), ('trade_date', 'string'), ('close', 'double'), ('vol', 'double')) v(f, k)
 UNION ALL SELECT 'amount', count(*), CASE WHEN count_if(volume > 30) > 0 THEN 'string' ELSE 'double' END
 FROM bars WHERE entity % 10 <> 3""")
def _(t):
    kinds = payload.field_kinds(t.payloads())
    return kinds.join(payload.kind_by_name(kinds), "field")


@query("payload_inferred", "ts_code:s close:f4 vol", "SRC-02 SRC-03", "bars", f"SELECT * FROM ({_PAYLOAD_ROWS})")
def _(t):
    df = t.payloads()
    return payload.parse_payload(df, payload.infer_payload_schema(df))


@query("csv_round_trip", "entity:i date:d close:f4 volume", "SRC-04 SNK-03", "bars", "SELECT * FROM bars")
def _(t):
    path = scratch(t.spark, "report")
    panel.write_report(t.bars().select(*KEYS, "close", "volume"), path)
    return panel.read_csv(t.spark, path, "entity bigint, date date, close double, volume double")


_EXPORT = """SELECT entity, date, volume, close / lag(close, 5) OVER (PARTITION BY entity ORDER BY date) - 1 AS price_momentum_5,
 lead(close, 1) OVER (PARTITION BY entity ORDER BY date) / close - 1 AS next_day_return FROM bars"""


def _export_rows(t):
    from barloom.operators.price import add_labels

    return add_labels(add_momentum(t.bars(), (5,))).select(*KEYS, "next_day_return", "volume", "price_momentum_5")


@query("export_training", "entity:i date:d volume price_momentum_5 next_day_return", "SNK-01", "bars", _EXPORT)
def _(t):
    """CSV export and read-back: ids first, targets last, nulls as empty fields."""
    path = scratch(t.spark, "training")
    panel.export_training(_export_rows(t), path, fmt="csv")
    return panel.read_csv(
        t.spark, path, "entity bigint, date date, volume double, price_momentum_5 double, next_day_return double"
    )


@query("export_held_out", "entity:i date:d volume price_momentum_5 next_day_return", "SNK-02", "bars dim",
       f"SELECT * FROM ({_EXPORT}) WHERE date > DATE '2000-06-30' AND entity IN (SELECT entity FROM dim WHERE market = 'ASIA')")
def _(t):
    picked = t.dim().where(c("market") == "ASIA")
    return panel.held_out(_export_rows(t), F.lit("2000-06-30").cast("date"), picked)


@query("conformed", "entity:s date:d close:f4 adj_factor", "Schema system (typed nulls)", "bars",
       "SELECT entity, date, close, CAST(NULL AS DOUBLE) AS adj_factor FROM bars")
def _(t):
    return conform(t.bars(), ADJUSTED_BARS)


# -------------------------------------------------------------------------------------------- landing

add_view("stock_old", "bars", "SELECT CAST(entity AS VARCHAR) AS ts_code, date AS trade_date, close, volume AS vol FROM bars WHERE date < DATE '1999-01-01'")
add_view("stock_new", "bars", f"""SELECT CAST(entity AS VARCHAR) AS ts_code, date AS trade_date, close + CASE WHEN {DAYNO} % 5 = 0 THEN 2 ELSE 1 END AS close,
 CASE WHEN volume <= 30 THEN volume END AS vol FROM bars WHERE date >= DATE '1998-01-01'""")
add_view("macro_old", "idx", "SELECT date AS trade_date, close AS usd_cny_rate, CAST(NULL AS DOUBLE) AS gold_price FROM idx WHERE code = 'usdcnh' AND date < DATE '1999-01-01'")
add_view("macro_new", "idx", f"""SELECT date AS trade_date, CASE WHEN {DAYNO} % 2 = 0 THEN close * 2 END AS usd_cny_rate, close + 1 AS gold_price
 FROM idx WHERE code = 'usdcnh' AND date >= DATE '1998-01-01'""")


def _message(rows, kind: str, fields: dict, day: str, seq: int = 0):
    """Landed payloads of one kind: a month of rows in each; ``seq`` orders months, then landings."""
    item = F.array(*[x.cast("string") for x in fields.values()])
    body = rows.withColumn("_m", F.date_format(day, "yyyyMM")).groupBy("_m").agg(F.collect_list(item).alias("items"))
    data = F.struct(F.array(*[F.lit(n) for n in fields]).alias("fields"), "items", F.lit(False).alias("has_more"))
    text = F.to_json(F.struct(F.lit(0).alias("code"), F.lit("").alias("msg"), data.alias("data")))
    return body.select(F.lit(kind).alias("kind"), (c("_m").cast("long") * 10 + seq).alias("seq"), text.alias("payload"))


def _landed(t):
    """Bars from 1998 on as payloads of two kinds, every fifth day landed again, and a macro series; (payloads, stored tables)."""
    day = lambda n: F.date_format(n, "yyyyMMdd")
    t = t.with_stored_bars("close", "volume")
    bars, macro = t.bars(), t.index_bars().where("code = 'usdcnh'")
    new, old = bars.where("date >= '1998-01-01'"), bars.where("date < '1999-01-01'")
    vol = F.when(c("volume") > 30, "n/a").otherwise(c("volume").cast("string"))
    row = lambda up: {"trade_date": day("date"), "vol": vol, "close": c("close") + up, "ts_code": c("entity")}
    out = None
    for kind in ("stock_daily", "index_daily"):
        for part in (_message(new, kind, row(1), "date"), _message(new.where(day_number(c("date")) % 5 == 0), kind, row(2), "date", 1)):
            out = part if out is None else out.unionByName(part)
    rate = F.when(day_number(c("date")) % 2 == 0, c("close") * 2)
    out = out.unionByName(_message(macro.where("date >= '1998-01-01'"), "macro_daily", {"gold_price": c("close") + 1, "trade_date": day("date"), "usd_cny_rate": rate}, "date"))
    out = out.unionByName(_message(new, "express", {"ts_code": c("entity"), "ann_date": day("date"), "revenue": c("close")}, "date"))
    stock = old.select(c("entity").cast("string").alias("ts_code"), c("date").alias("trade_date"), "close", c("volume").alias("vol"))
    held = macro.where("date < '1999-01-01'").select(c("date").alias("trade_date"), c("close").alias("usd_cny_rate"), F.lit(None).cast("double").alias("gold_price"))
    filings = stock.select("ts_code", c("trade_date").alias("ann_date"), c("close").alias("revenue"))
    return out, {"stock_daily": stock, "index_daily": stock, "macro_daily": held, "express": filings}


def _after_landing(t, kind: str):
    """One table after everything landed: the payloads of kinds without a table are left out, so no other is parsed for it."""
    landed, tables = _landed(t)
    return landing.land(landed, {kind: tables[kind]})[kind]


@query("landing_keep", "ts_code:s trade_date:d close:f4 vol", "SRC-02 UPS-02 UPS-07 (loader map)", "stock_old stock_new",
       "SELECT * FROM stock_old UNION ALL SELECT * FROM stock_new n WHERE NOT EXISTS (SELECT 1 FROM stock_old o WHERE o.ts_code = n.ts_code AND o.trade_date = n.trade_date)")
def _(t):
    return _after_landing(t, "stock_daily")


@query("landing_replace", "ts_code:s trade_date:d close:f4 vol", "SRC-02 UPS-01 UPS-07 (loader map)", "stock_old stock_new",
       "SELECT * FROM stock_new UNION ALL SELECT * FROM stock_old o WHERE NOT EXISTS (SELECT 1 FROM stock_new n WHERE o.ts_code = n.ts_code AND o.trade_date = n.trade_date)")
def _(t):
    return _after_landing(t, "index_daily")


@query("landing_coalesce_new", "trade_date:d usd_cny_rate:f4 gold_price:f4", "SRC-02 UPS-04 (loader map)", "macro_old macro_new",
       """SELECT trade_date, coalesce(n.usd_cny_rate, o.usd_cny_rate) AS usd_cny_rate, coalesce(n.gold_price, o.gold_price) AS gold_price
 FROM macro_old o FULL JOIN macro_new n USING (trade_date)""")
def _(t):
    return _after_landing(t, "macro_daily")


@query("landing_append", "ts_code:s ann_date:d revenue:f4", "SRC-02 UPS-11 (loader map)", "bars",
       """SELECT CAST(entity AS VARCHAR) AS ts_code, date AS ann_date, close AS revenue FROM bars WHERE date < DATE '1999-01-01'
 UNION ALL SELECT CAST(entity AS VARCHAR), date, close FROM bars WHERE date >= DATE '1998-01-01'""")
def _(t):
    return _after_landing(t, "express")


# -------------------------------------------------------------------------------------------- upserts
# The base holds dates up to 1999 with some nulls; the batch starts in 1998 with changed values.

add_view("base_rows", "bars", f"SELECT entity, date, close AS a, CASE WHEN {DAYNO} % 4 = 0 THEN NULL ELSE volume END AS b FROM bars WHERE date < DATE '1999-01-01'")
add_view("batch_rows", "bars", f"SELECT entity, date, CASE WHEN {DAYNO} % 3 = 0 THEN NULL ELSE close + 1 END AS a, volume * 2 AS b FROM bars WHERE date >= DATE '1998-01-01'")


def _pair(t):
    bars = t.bars()
    no = day_number(c("date"))
    base = bars.where(c("date") < "1999-01-01").select(*KEYS, c("close").alias("a"), F.when(no % 4 != 0, c("volume")).alias("b"))
    batch = bars.where(c("date") >= "1998-01-01").select(
        *KEYS, F.when(no % 3 != 0, c("close") + 1).alias("a"), (c("volume") * 2).alias("b")
    )
    return base, batch


def _merge_sql(a: str, b: str) -> str:
    return f"""SELECT coalesce(o.entity, n.entity) AS entity, coalesce(o.date, n.date) AS date, {a} AS a, {b} AS b
 FROM base_rows o FULL JOIN batch_rows n ON o.entity = n.entity AND o.date = n.date"""


def _policy(name: str, ids: str, policy: str, a: str, b: str, cols=None):
    @query(name, "entity:i date:d a:f4 b", ids, "base_rows batch_rows", _merge_sql(a, b))
    def _(t):
        base, batch = _pair(t)
        return ups.upsert(base, batch, KEYS, policy, cols)


_new = "CASE WHEN n.entity IS NOT NULL THEN n.{0} ELSE o.{0} END"
_old = "CASE WHEN o.entity IS NOT NULL THEN o.{0} ELSE n.{0} END"
_policy("upsert_replace", "UPS-01", "replace", _new.format("a"), _new.format("b"))
_policy("upsert_keep", "UPS-02", "keep", _old.format("a"), _old.format("b"))
_policy("upsert_columns", "UPS-03", "update", _old.format("a"), _new.format("b"), ["b"])
_policy("upsert_coalesce_new", "UPS-04", "coalesce_new", "coalesce(n.a, o.a)", "coalesce(n.b, o.b)")
_policy("upsert_coalesce_old", "UPS-05", "coalesce_old", "coalesce(o.a, n.a)", "coalesce(o.b, n.b)")


@query("upsert_append", "entity:i date:d a:f4 b", "UPS-11", "base_rows batch_rows", "SELECT * FROM base_rows UNION ALL SELECT * FROM batch_rows")
def _(t):
    base, batch = _pair(t)
    return ups.upsert(base, batch, KEYS, "append")


@query("upsert_counts", "inserted:i updated:i", "UPS-06", "base_rows batch_rows",
       """SELECT count_if(o.entity IS NULL) AS inserted, count_if(o.entity IS NOT NULL) AS updated
 FROM batch_rows n LEFT JOIN base_rows o ON o.entity = n.entity AND o.date = n.date""")
def _(t):
    base, batch = _pair(t)
    return ups.upsert_counts(base, batch, KEYS)


_LAST = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity, date, {v} ORDER BY run DESC) AS rn FROM {f}) WHERE rn = 1"""


@query("dedup_last", "entity:i date:d predicted_return run:i", "UPS-07", "versioned",
       _LAST.format(v="1", f="versioned"))
def _(t):
    return ups.dedup_last(t.versioned(), KEYS, "run")


@query("dedup_latest", "entity:i date:d model_version:s predicted_return run:i", "UPS-10", "versioned",
       _LAST.format(v="model_version", f="(SELECT * REPLACE (coalesce(model_version, '') AS model_version) FROM versioned)"))
def _(t):
    return ups.dedup_latest(t.versioned(), [*KEYS, "model_version"], "run")


@query("replace_slice", "entity:i date:d a:f4 b", "UPS-08", "base_rows batch_rows",
       "SELECT * FROM base_rows WHERE date < DATE '1998-06-01' UNION ALL SELECT * FROM batch_rows WHERE date >= DATE '1998-06-01'")
def _(t):
    base, batch = _pair(t)
    later = c("date") >= "1998-06-01"
    return ups.replace_slice(base, batch.where(later), later)


@query("update_from", "entity:i date:d a:f4 b", "UPS-09", "base_rows batch_rows",
       """SELECT o.entity, o.date, CASE WHEN n.entity IS NOT NULL THEN n.a ELSE o.a END AS a, o.b FROM base_rows o
 LEFT JOIN batch_rows n ON o.entity = n.entity AND o.date = n.date""")
def _(t):
    base, batch = _pair(t)
    return ups.update_from(base, batch, KEYS, ["a"])


# ---------------------------------------------------------------------------------------- incremental


@query("next_start", "next_start:d", "INC-01", "bars dim", "SELECT coalesce(max(date) + 1, (SELECT min(list_date) FROM dim)) AS next_start FROM bars")
def _(t):
    return inc.next_start(t.bars(), t.dim())


@query("next_start_per_entity", "entity:i next_start:d", "INC-01 AG-16", "bars", "SELECT entity, max(date) + 1 AS next_start FROM bars GROUP BY entity")
def _(t):
    return inc.next_start_per(t.bars())


@query("run_window", "entity:i date:d close:f4", "INC-02", "bars",
       """SELECT * FROM bars WHERE date BETWEEN (SELECT greatest(min(date), max(date) - 750, max(date) - 730) FROM bars) AND (SELECT max(date) FROM bars)""")
def _(t):
    bars = t.bars()
    span = t.table("lineitem").agg(F.min(c("l_shipdate").cast("date")).alias("lo"), F.max(c("l_shipdate").cast("date")).alias("hi")).first()
    lo, hi = inc.plan_window(span["lo"], span["hi"], watermark=span["hi"], history_years=2, as_of=span["hi"])
    return panel.bound(bars, lo, hi)


@query("warmed_momentum", "entity:i date:d price_momentum_20", "INC-03", "bars",
       """SELECT * FROM (SELECT *, close / lag(close, 20) OVER w - 1 AS price_momentum_20, row_number() OVER w AS rn FROM bars
 WHERE date >= DATE '2000-01-01' - 400 WINDOW w AS (PARTITION BY entity ORDER BY date)) WHERE date >= DATE '2000-01-01' AND rn >= 60""")
def _(t):
    return inc.with_warmup(t.bars(), lambda df: add_momentum(df, (20,)), F.lit("2000-01-01").cast("date"))


@query("open_days", "cal_date:s", "INC-05", "cal", "SELECT cal_date FROM cal WHERE TRY_CAST(is_open AS INTEGER) = 1 AND cal_date >= '19960101'")
def _(t):
    return inc.open_days(t.calendar(), F.lit("19960101"))


@query("missing_dates", "date:d", "INC-04 JN-04", "cal bars", "SELECT date FROM cal WHERE is_open = '1' AND date NOT IN (SELECT date FROM bars)")
def _(t):
    return inc.missing_dates(inc.open_days(t.calendar()), t.bars())


@query("fetch_plan", "date:d ord:i has_rows:b empty_run:i", "INC-04 WIN-09", "cal bars",
       """SELECT date, n AS "order", has_rows, n - coalesce(hit, 0) AS empty_run FROM (
 SELECT *, max(CASE WHEN n - coalesce(hit, 0) >= 15 THEN 1 ELSE 0 END) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stopped FROM (
  SELECT *, max(CASE WHEN has_rows THEN n END) OVER (ORDER BY n) AS hit FROM (
   SELECT date, row_number() OVER (ORDER BY date DESC) AS n, date IN (SELECT date FROM bars WHERE date < DATE '2001-01-01') AS has_rows FROM cal)))
 WHERE coalesce(stopped, 0) = 0""".replace('AS "order"', "AS ord"))
def _(t):
    facts = t.bars().where(c("date") < "2001-01-01").select("date").distinct().withColumn("has_rows", F.lit(True))
    return inc.fetch_plan(t.calendar().select("date"), facts).withColumnRenamed("order", "ord")


@query("numbered_rows", "entity:i date:d rn:i", "WIN-01", "bars", "SELECT entity, date, row_number() OVER (PARTITION BY entity ORDER BY date) AS rn FROM bars")
def _(t):
    return t.bars().withColumn("rn", row_no())
