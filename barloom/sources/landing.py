"""From landed vendor payloads to stored tables: which fields a kind of payload has, its key, and what happens to rows
whose key is there already (SRC-02 with UPS-*).

``land`` reads the landed payloads once, whatever number of kinds they mix: the items of all kinds are written by kind,
and each kind's rows are then typed, cut to the last one per key and merged into their table.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.operators.joins import resolve_code
from barloom.session import settle
from barloom.sources.payload import parse_items, payload_items
from barloom.sources.upsert import dedup_last, upsert

c = F.col


@dataclass(frozen=True)
class Landing:
    """``keys``, ``texts``, ``numbers``: fields by name; ``dates``: which of them are dates.  ``resolve``: a text field by which
    a missing first key is looked up in the dimension."""

    policy: str
    keys: str
    numbers: str = ""
    texts: str = ""
    dates: str = "trade_date"
    resolve: str | None = None

    @property
    def schema(self) -> T.StructType:
        kind = lambda n: T.DateType() if n in self.dates.split() else T.StringType()
        fields = [T.StructField(n, kind(n)) for n in [*self.keys.split(), *self.texts.split()]]
        return T.StructType(fields + [T.StructField(n, T.DoubleType()) for n in self.numbers.split()])


# Tables, their keys, fields and conflict policies as the vendors' feeds and the stored tables have them.
_DAY, _BAR, _MOVES = "ts_code trade_date", "open high low close", "pre_close change pct_chg vol amount"
_FLOW = "net_buy_amount net_sell_amount net_amount"
_SIZES = " ".join(f"{side}_{size}_{what}" for size in ("sm", "md", "lg", "elg") for side in ("buy", "sell") for what in ("vol", "amount"))
LANDINGS: dict[str, Landing] = {
    "stock_daily": Landing("keep", _DAY, f"{_BAR} {_MOVES}"),
    "stock_daily_adjusted": Landing("replace", _DAY, f"{_BAR} {_MOVES}"),
    "weekly": Landing("keep", _DAY, f"{_BAR} {_MOVES}"),
    "monthly": Landing("keep", _DAY, f"{_BAR} {_MOVES}"),
    "index_daily": Landing("replace", _DAY, f"{_BAR} {_MOVES}"),
    "stock_basic": Landing(
        "replace", "ts_code",
        texts="symbol name area industry fullname enname cnspell market exchange curr_type list_status list_date delist_date is_hs act_name act_ent_type",
        dates="list_date delist_date",
    ),
    "index_basic": Landing(
        "replace", "ts_code", "base_point",
        "name fullname market publisher index_type category base_date list_date weight_rule description exp_date", "base_date list_date exp_date",
    ),
    "daily_basic": Landing(
        "keep", _DAY,
        "close turnover_rate turnover_rate_f volume_ratio pe pe_ttm pb ps ps_ttm dv_ratio dv_ttm total_share float_share free_share total_mv circ_mv",
    ),
    "moneyflow": Landing("keep", _DAY, f"{_SIZES} net_mf_vol net_mf_amount"),
    "moneyflow_ind_ths": Landing("keep", _DAY, _FLOW, "industry_name"),
    "moneyflow_ind_dc": Landing("keep", _DAY, _FLOW, "industry_name"),
    "moneyflow_industry": Landing("replace", _DAY, _FLOW, "industry_name"),
    "moneyflow_cnt_ths": Landing(
        "keep", _DAY, f"close_price pct_change industry_index company_num pct_change_stock {_FLOW}", "name lead_stock", resolve="name",
    ),
    "dc_index": Landing("replace", _DAY, "pct_change up_num down_num turnover_rate total_mv leading_pct", "name leading leading_code"),
    "dc_daily": Landing("replace", _DAY, f"{_BAR} change pct_change vol amount swing turnover_rate"),
    "dc_member": Landing("replace", "ts_code trade_date con_code", texts="name"),
    "tdx_index": Landing("replace", _DAY, "idx_count total_share float_share total_mv float_mv", "name idx_type"),
    "tdx_daily": Landing("replace", _DAY, f"{_BAR} pct_change vol amount vol_ratio turnover_rate up_num down_num limit_up_num float_mv"),
    "tdx_member": Landing("replace", "ts_code trade_date con_code", texts="con_name"),
    "macro_daily": Landing("coalesce_new", "trade_date", "usd_cny_rate usd_cny_pct_chg gold_price gold_pct_chg"),
    "income": Landing(
        "append", "ts_code", "basic_eps diluted_eps total_revenue revenue int_income prem_earned comm_income",
        "ann_date f_ann_date end_date report_type comp_type end_type", "ann_date f_ann_date end_date",
    ),
    "forecast": Landing(
        "append", "ts_code", "p_change_min p_change_max net_profit_min net_profit_max last_parent_net",
        "ann_date end_date type first_ann_date summary change_reason update_flag", "ann_date end_date first_ann_date",
    ),
    "express": Landing(
        "append", "ts_code",
        "revenue operate_profit total_profit n_income total_assets total_hldr_eqy_exc_min_int diluted_eps diluted_roe yoy_net_profit bps",
        "ann_date end_date perf_summary", "ann_date end_date",
    ),
}


def rows_of_kind(items: DataFrame, kind: str, registry: Mapping[str, Landing] = LANDINGS, dim: DataFrame | None = None) -> DataFrame:
    """Typed rows of one kind: without a key they go, and of equal keys the last landed one stays (all, when appended).

    ``items``: kind, seq, fields, item.  A first key that is missing is looked up by name in ``dim`` where the kind says so.
    """
    spec = registry[kind]
    rows = parse_items(items.where(c("kind") == kind), spec.schema, keep=("seq",))
    keys = spec.keys.split()
    if spec.resolve and dim is not None:
        rows = resolve_code(rows, dim, code=keys[0], name=spec.resolve)
    rows = rows.dropna(subset=keys)
    return rows.drop("seq") if spec.policy == "append" else dedup_last(rows, keys, "seq").drop("seq")


def land(landed: DataFrame, tables: Mapping[str, DataFrame], registry: Mapping[str, Landing] = LANDINGS, dim: DataFrame | None = None) -> dict[str, DataFrame]:
    """Every table of ``tables`` after the landed payloads (kind, seq, payload) of its kind were merged in.

    The payloads are parsed once for all kinds.  Payloads with an error code or without items give nothing; kinds without
    a table are left out.  ``seq`` orders what was landed.
    """
    wanted = landed.where(c("kind").isin(list(tables)))
    items = settle(payload_items(wanted, keep=("kind", "seq")))
    merged = {}
    for kind, base in tables.items():
        spec = registry[kind]
        fresh = rows_of_kind(items, kind, registry, dim).select(*[n for n in base.columns if n in spec.schema.names])
        merged[kind] = upsert(base, fresh, spec.keys.split(), spec.policy)
    return merged


def unfinished(landed: DataFrame) -> DataFrame:
    """(kind, request, page): requests whose last landed page says that there is more; the next page is to be fetched.

    ``landed``: kind, request, page, payload.
    """
    more = F.get_json_object("payload", "$.data.has_more") == "true"
    w = Window.partitionBy("kind", "request").orderBy(c("page").desc())
    last = landed.select("kind", "request", "page", more.alias("_more"), F.row_number().over(w).alias("_n")).where("_n = 1 and _more")
    return last.select("kind", "request", (c("page") + 1).alias("page"))
