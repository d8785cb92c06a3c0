"""Table schemas (dates as DATE; provenance as TIMESTAMP)."""

from pyspark.sql import types as T


def _struct(keys: dict[str, T.DataType], doubles: str = "", **more: T.DataType) -> T.StructType:
    fields = [T.StructField(k, t, False) for k, t in keys.items()]
    fields += [T.StructField(n, T.DoubleType()) for n in doubles.split()]
    fields += [T.StructField(n, t) for n, t in more.items()]
    return T.StructType(fields)


S, D, I, B, TS = T.StringType(), T.DateType(), T.IntegerType(), T.BooleanType(), T.TimestampType()
PANEL = {"entity": S, "date": D}

BARS = _struct(PANEL, "open high low close pre_close change pct_chg volume amount")
ADJUSTED_BARS = _struct(PANEL, "open high low close volume amount pct_chg adj_factor")
INDEX_BARS = _struct({"code": S, "date": D}, "open high low close pre_close change pct_chg volume amount")
VALUATION = _struct(
    PANEL,
    "close turnover_rate turnover_rate_f volume_ratio pe pe_ttm pb ps ps_ttm dv_ratio dv_ttm "
    "total_share float_share free_share total_mv circ_mv",
)
FLOWS = _struct(
    PANEL,
    " ".join(f"{s}_{z}_{m}" for z in ("sm", "md", "lg", "elg") for s in ("buy", "sell") for m in ("vol", "amount"))
    + " net_mf_vol net_mf_amount",
)
SECTOR_FLOWS = _struct(PANEL, "net_buy_amount net_sell_amount net_amount", industry_name=S)
DIMENSION = T.StructType(
    [T.StructField("entity", S, False)]
    + [
        T.StructField(n, S)
        for n in (
            "symbol name area industry fullname enname cnspell market exchange curr_type list_status "
            "is_hs act_name act_ent_type"
        ).split()
    ]
    + [T.StructField("list_date", D), T.StructField("delist_date", D)]
)
MACRO = _struct({"date": D}, "usd_cny_rate usd_cny_pct_chg gold_price gold_pct_chg")
CALENDAR = T.StructType([T.StructField("exchange", S), T.StructField("cal_date", S), T.StructField("is_open", S)])
PREDICTIONS = _struct(
    {**PANEL, "model_version": S},
    "predicted_return confidence predicted_3day_return actual_return actual_3day_return",
    prediction_date=TS,
    predicted_direction=B,
    actual_direction=B,
    prediction_correct=B,
    predicted_3day_direction=B,
    actual_3day_direction=B,
    prediction_3day_correct=B,
)
PAYLOAD = "struct<code:int,msg:string,data:struct<fields:array<string>,items:array<array<string>>,has_more:boolean>>"


def conform(df, schema: T.StructType):
    """Project to a schema: columns it lacks become typed nulls, extra ones go."""
    from pyspark.sql import functions as F

    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )
