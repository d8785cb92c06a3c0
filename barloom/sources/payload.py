"""Landed vendor payloads to typed rows (SRC-02, SRC-03)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.scalars import to_double
from barloom.sources.schemas import PAYLOAD

# Name parts that mean a number when the sample holds no value.
NUMERIC_NAME = r"(vol|amount|pct|rate|num|mv|close|open|high|low|price|ratio|share)"


def payload_items(df: DataFrame, col: str = "payload", keep: Sequence[str] = ()) -> DataFrame:
    """(fields, item) per row of every successful payload, with the columns in ``keep``; code != 0 or no items gives nothing."""
    p = F.from_json(F.col(col), PAYLOAD).alias("p")
    return df.select(*keep, p).where((F.col("p.code") == 0) & (F.size("p.data.items") > 0)).select(
        *keep, F.col("p.data.fields").alias("fields"), F.explode("p.data.items").alias("item")
    )


def parse_payload(df: DataFrame, schema: T.StructType | str, col: str = "payload", date_format: str = "yyyyMMdd") -> DataFrame:
    """Pick fields by name from the positional items and cast them; what does not parse is null."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    return parse_items(payload_items(df, col), schema, date_format)


def parse_items(rows: DataFrame, schema: T.StructType, date_format: str = "yyyyMMdd", keep: Sequence[str] = ()) -> DataFrame:
    """The same from items (fields, item)."""

    def field(f: T.StructField):
        # get() is zero-based and null-safe; a field the payload lacks has position 0 and gives null.
        text = F.get("item", (F.array_position("fields", f.name) - 1).cast("int"))
        if isinstance(f.dataType, T.DateType):
            value = F.to_date(F.try_to_timestamp(text, F.lit(date_format)))
        elif isinstance(f.dataType, T.DoubleType):
            value = to_double(text)
        else:
            value = text.try_cast(f.dataType)
        return value.alias(f.name)

    return rows.select(*keep, *[field(f) for f in schema.fields])


def field_kinds(df: DataFrame, col: str = "payload") -> DataFrame:
    """Per field: whether every non-null sample value is a number (null without samples)."""
    pairs = payload_items(df, col).select(F.explode(F.arrays_zip("fields", "item")).alias("z")).select(
        F.col("z.fields").alias("field"), F.col("z.item").alias("text")
    )
    return pairs.groupBy("field").agg(
        F.count("text").alias("samples"),
        F.bool_and(F.when(F.col("text").isNotNull(), to_double(F.col("text")).isNotNull())).alias("numeric"),
    )


def kind_by_name(kinds: DataFrame, keys=("ts_code", "trade_date", "code", "date")) -> DataFrame:
    """double or string per field; keys stay text, and names decide where there is no sample."""
    name = F.lower(F.col("field"))
    guess = name.rlike(NUMERIC_NAME)
    numeric = ~name.isin(*keys) & F.coalesce(F.col("numeric"), guess)
    return kinds.select("field", F.when(numeric, "double").otherwise("string").alias("type"))


def infer_payload_schema(df: DataFrame, col: str = "payload", keys=("ts_code", "trade_date")) -> T.StructType:
    """Schema for :func:`parse_payload`; the driver sees one row per field name."""
    found = kind_by_name(field_kinds(df, col), keys).orderBy("field").collect()
    return T.StructType(
        [T.StructField(r["field"], T.DoubleType() if r["type"] == "double" else T.StringType()) for r in found]
    )
