"""Null, number, date, text and cast helpers used across operators (SRC-05, FLT-07..09, PRJ-04)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_double(col: Column) -> Column:
    """A JSON number or numeric text as double, anything else null."""
    return col.cast("string").try_cast("double")


def finite_or_zero(x: Column) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")) | x.isNull(), F.lit(0.0)).otherwise(x)


def clamp(x: Column, low: float, high: float) -> Column:
    """Bound a number; null stays null (least and greatest alone would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x)))


def parse_date(text: Column) -> Column:
    """yyyyMMdd text to a date; malformed text to null."""
    return F.when(well_formed_date(text), F.to_date(F.try_to_timestamp(text, F.lit("yyyyMMdd"))))


def date_text(date: Column) -> Column:
    return F.date_format(date, "yyyyMMdd")


def well_formed_date(text: Column) -> Column:
    return text.rlike("^[0-9]{8}$")


def is_special_name(name: Column) -> Column:
    """Names that start with ST or *ST, whatever their case and outer blanks."""
    n = F.upper(F.trim(name))
    return n.like("ST%") | n.like("*ST%")


def marked_name(name: Column) -> Column:
    """The narrower test: ST at the start or the end of the name as stored."""
    return name.like("ST%") | name.like("%ST")


def contains_any(col: Column, wanted: Column) -> Column:
    """True when the text contains one of a comma list's entries; null text gives false."""
    return F.coalesce(F.exists(F.split(wanted, ","), lambda x: F.contains(col, F.trim(x))), F.lit(False))


def in_band(value: Column, low: float | None, high: float | None, scale: float = 10000.0) -> Column:
    """Value inside [low, high] x scale; an unknown value passes."""
    ok = F.lit(True)
    if low is not None:
        ok = ok & (value >= low * scale)
    if high is not None:
        ok = ok & (value <= high * scale)
    return value.isNull() | ok


def normal_bool_text(col: Column) -> Column:
    """True/TRUE/False/FALSE in lower case, other text unchanged."""
    return F.when(F.lower(col).isin("true", "false"), F.lower(col)).otherwise(col)


def segment(code: Column, prefixes: Sequence[str]) -> Column:
    """The first listed prefix the code starts with, else null."""
    return F.coalesce(*[F.when(code.startswith(p), F.lit(p)) for p in prefixes])


def round_to(x: Column | str, digits: int) -> Column:
    """Half-up rounding of the scaled double, i.e. round(x * 10^n) / 10^n.

    Rounding the scaled value rather than its decimal text keeps prices such as 1.005 where other engines
    and the stored tables put them.
    """
    x = F.col(x) if isinstance(x, str) else x
    scale = float(10**digits)
    # Spark's own rounding of a double goes through its decimal text.  ``rint`` puts ties to the even side, and what is
    # left over is exact: a tie that went towards zero takes one step out.  Adding 0.0 turns -0.0 into 0.0.
    y = x.cast("double") * scale
    near, side = F.rint(y), F.signum(y)
    return (near + F.when((y - near) * side == 0.5, side).otherwise(0.0)) / scale
