"""Registration of queries with the SQL that gives the same rows.

A query names its output columns and kinds once; both sides are projected by that list: dates as yyyyMMdd
text, flags and counts as BIGINT, doubles rounded.  Kinds: none = double to 6 digits, fN = double to N
digits, i = BIGINT, b = flag as 0/1, d = date text, s = text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.scalars import date_text, round_to
from barloom.session import fit_methods
from barloom.sources.tables import Tables


@dataclass(frozen=True)
class Query:
    name: str
    ids: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    body: str | None = None


REGISTRY: dict[str, Query] = {}


def _columns(out: str) -> list[tuple[str, str]]:
    return [(n, k or "f6") for n, _, k in (x.partition(":") for x in out.split())]


def present(df: DataFrame, out: str) -> DataFrame:
    cols = []
    for n, k in _columns(out):
        x = F.col(n)
        if k == "d":
            x = date_text(x)
        elif k in ("i", "b"):
            x = x.cast("bigint")
        elif k == "s":
            x = x.cast("string")
        else:
            x = round_to(x.cast("double"), int(k[1:]))
        cols.append(x.alias(n))
    return df.select(*cols)


def present_sql(out: str, body: str) -> str:
    cols = []
    for n, k in _columns(out):
        if k == "d":
            x = f"strftime({n}, '%Y%m%d')"
        elif k in ("i", "b"):
            x = f"CAST({n} AS BIGINT)"
        elif k == "s":
            x = f"CAST({n} AS VARCHAR)"
        else:
            x = f"round(CAST({n} AS DOUBLE), {k[1:]})"
            x = f"CASE WHEN {x} = 0 THEN CAST(0 AS DOUBLE) ELSE {x} END"
        cols.append(f"{x} AS {n}")
    return f"SELECT {', '.join(cols)} FROM ({body}) AS q"


# ------------------------------------------------------------------------------- views as SQL

_LINE_ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity"
_DAY = "CAST(l_shipdate AS DATE)"
_OHLC = f"""first(price ORDER BY {_LINE_ORDER}) AS open, max(price) AS high, min(price) AS low,
 last(price ORDER BY {_LINE_ORDER}) AS close, sum(l_quantity) AS volume, sum(l_extendedprice) AS amount"""
DAYNO = "(date - DATE '1970-01-01')"

VIEWS: dict[str, tuple[str, str]] = {
    "lines": ("", f"SELECT *, {_DAY} AS date, l_extendedprice / l_quantity AS price FROM lineitem"),
    "bars": ("lines", f"SELECT l_suppkey AS entity, date, {_OHLC} FROM lines GROUP BY l_suppkey, date"),
    "places": (
        "",
        "SELECT s_suppkey AS entity, s_name, s_acctbal, n_name, r_regionkey, r_name FROM supplier"
        " JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    ),
    "rbars": (
        "lines places",
        f"SELECT r_name AS entity, date, {_OHLC} FROM lines JOIN places p ON l_suppkey = p.entity GROUP BY r_name, date",
    ),
    "ubars": (
        "",
        "SELECT user_id AS entity, CAST(ts AS DATE) AS date, first(value ORDER BY ts, event_id) AS open, max(value) AS high,"
        " min(value) AS low, last(value ORDER BY ts, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume,"
        " sum(value) AS amount FROM events GROUP BY user_id, CAST(ts AS DATE)",
    ),
    "dim": (
        "places",
        f"""SELECT p.entity, reverse(lpad(CAST(p.entity AS VARCHAR), 12, '0')) AS code,
 CASE WHEN p.entity % 11 = 5 THEN 'ST ' || s_name WHEN p.entity % 13 = 7 THEN ' *st ' || s_name ELSE s_name END AS name,
 n_name AS industry, r_name AS market, list_date,
 CASE WHEN p.entity % 4 = 1 THEN 'state' WHEN p.entity % 4 <> 0 THEN 'private' END AS act_ent_type FROM places p
 JOIN (SELECT l_suppkey, min({_DAY}) AS list_date FROM lineitem GROUP BY l_suppkey) f ON f.l_suppkey = p.entity""",
    ),
    "prevs": ("bars", "SELECT *, lag(close) OVER (PARTITION BY entity ORDER BY date) AS prev FROM bars"),
    "raw": (
        "prevs",
        f"""SELECT *, close - pre_close AS change, (close / pre_close - 1) * 100 AS pct_chg FROM (
 SELECT entity, date, open, high, low, close, volume, amount,
  CASE WHEN prev IS NULL THEN open WHEN {DAYNO} % 61 = 0 THEN prev * CAST(0.91372846193 AS DOUBLE) ELSE prev END AS pre_close FROM prevs)""",
    ),
    "rets": ("prevs", "SELECT * EXCLUDE (prev), (close / prev - 1) * 100 AS pct_chg FROM prevs WHERE prev IS NOT NULL"),
    "idx": (
        "bars places",
        f"""SELECT *, (close / lag(close) OVER (PARTITION BY code ORDER BY date) - 1) * 100 AS pct_chg FROM (
 SELECT code, date, avg(close) AS close FROM (
  SELECT 'csi300' AS code, date, close FROM bars JOIN places USING (entity) UNION ALL
  SELECT CASE r_regionkey WHEN 0 THEN 'chinext' WHEN 1 THEN 'xin9' WHEN 2 THEN 'hsi' WHEN 3 THEN 'usdcnh' ELSE 'gold' END, date, close
  FROM bars JOIN places USING (entity)) GROUP BY code, date)""",
    ),
    "flows": (
        "lines",
        f"""SELECT l_suppkey AS entity, date,
 sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END) AS net_mf_vol,
 sum(CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END) AS net_mf_amount,
 sum(CASE WHEN l_returnflag <> 'R' THEN l_extendedprice ELSE 0 END) AS buy_amount,
 sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END) AS sell_amount
 FROM lines GROUP BY l_suppkey, date""",
    ),
    "val": (
        "lines",
        f"""SELECT entity, date, vol / 10 AS turnover_rate, vol / 8 AS turnover_rate_f, pe_ttm * 1.1 AS pe, pe_ttm,
 close / 3000 AS pb, close / 2500 AS ps, close / 2600 AS ps_ttm, tax AS dv_ratio,
 CASE WHEN entity % 3 <> 0 THEN tax * 0.9 END AS dv_ttm, vol * 100 AS total_share, vol * 60 AS float_share,
 vol * 40 AS free_share, close * vol AS total_mv, close * vol * 0.6 AS circ_mv FROM (
  SELECT d.*, close / (disc + 1) * CASE WHEN s_acctbal < 0 THEN -1.0 ELSE 1.0 END / 1000 AS pe_ttm FROM (
   SELECT l_suppkey AS entity, date, last(price ORDER BY {_LINE_ORDER}) AS close, sum(l_quantity) AS vol,
    avg(l_discount) AS disc, avg(l_tax) AS tax FROM lines GROUP BY l_suppkey, date) d
  JOIN supplier ON s_suppkey = entity)""",
    ),
    "preds": (
        "bars",
        """SELECT entity, date, 'v1' AS model_version, r AS predicted_return,
 ((entity * 7 + dayofyear(date)) % 100) / 100 AS confidence, r > 0 AS predicted_direction,
 r / 2 AS predicted_3day_return, r > 1 AS predicted_3day_direction FROM (
  SELECT entity, date, greatest(-15.0, least(15.0, (close / lag(close, 5) OVER (PARTITION BY entity ORDER BY date) - 1) * 100)) AS r,
   lag(close, 5) OVER (PARTITION BY entity ORDER BY date) AS c5 FROM bars) WHERE c5 IS NOT NULL""",
    ),
    "sectors": (
        "rets places",
        """SELECT n_name AS code, date, 'sector ' || n_name AS name, avg(pct_chg) AS pct_change,
 count_if(pct_chg > 0) AS up_num, count_if(pct_chg < 0) AS down_num, sum(volume) / 100 AS turnover_rate,
 sum(amount) AS total_mv, count_if(pct_chg > 9.8) AS limit_up_num, avg(volume) / 20 AS vol_ratio,
 last(entity ORDER BY pct_chg, entity) AS leading_code, max(pct_chg) AS leading_pct
 FROM rets JOIN places USING (entity) GROUP BY n_name, date""",
    ),
    "sflows": (
        "rets flows places",
        """SELECT n_name AS code, r.date, 'sector ' || n_name AS name, sum(net_mf_amount) AS net_amount,
 sum(buy_amount) AS net_buy_amount, sum(sell_amount) AS net_sell_amount, avg(pct_chg) AS pct_change,
 last(r.entity ORDER BY pct_chg, r.entity, close) AS lead_stock, last(close ORDER BY pct_chg, r.entity, close) AS close_price
 FROM rets r JOIN flows f ON f.entity = r.entity AND f.date = r.date JOIN places p ON p.entity = r.entity
 GROUP BY n_name, r.date""",
    ),
    "cal": (
        "",
        """SELECT DISTINCT CAST(o_orderdate AS DATE) AS date, strftime(CAST(o_orderdate AS DATE), '%Y%m%d') AS cal_date,
 CASE WHEN isodow(CAST(o_orderdate AS DATE)) = 7 THEN '0' ELSE '1' END AS is_open FROM orders""",
    ),
    "versioned": (
        "preds",
        f"""SELECT entity, date, CASE WHEN {DAYNO} % 9 = 0 THEN NULL ELSE model_version END AS model_version,
 predicted_return, confidence, run FROM (
 SELECT entity, date, model_version, predicted_return, confidence, 1 AS run FROM preds UNION ALL
 SELECT entity, date, model_version, -predicted_return, confidence, 2 FROM preds WHERE {DAYNO} % 5 = 0)""",
    ),
}


def add_view(name: str, uses: str, sql: str) -> None:
    """A further view for use in ``uses=``."""
    VIEWS[name] = (uses, sql)


def _resolve(names: str, seen: list[str]) -> list[str]:
    for n in names.split():
        if n not in seen:
            _resolve(VIEWS[n][0], seen)
            if n not in seen:
                seen.append(n)
    return seen


def with_views(uses: str, body: str) -> str:
    order = _resolve(uses, [])
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({VIEWS[n][1]})" for n in order) + "\n" + body


def query(name: str, out: str, ids: str, uses: str = "bars", sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``; ``sql`` is the body over the named views."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name!r} is registered twice")

        def run(spark: SparkSession, path: str) -> DataFrame:
            fit_methods(spark)
            return present(fn(Tables(spark, path)), out)

        run.__name__ = name
        text = with_views(uses, present_sql(out, sql)) if sql else None
        REGISTRY[name] = Query(name, ids, run, text, sql)
        return fn

    return wrap


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: q.run for n, q in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {n: q.sql for n, q in REGISTRY.items() if q.sql}


# ------------------------------------------------------------------------------- window snippets

BY = "PARTITION BY entity ORDER BY date"


def over(n: int | None = None, by: str = BY) -> str:
    """OVER clause: the trailing n rows, or the plain ordering."""
    frame = f" ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW" if n else ""
    return f"OVER ({by}{frame})"


def full(expr: str, n: int, by: str = BY) -> str:
    """``expr`` where at least n rows exist up to this one."""
    return f"CASE WHEN row_number() OVER ({by}) >= {n} THEN {expr} END"
