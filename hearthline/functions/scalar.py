"""Scalar columns: keys, formats and safe arithmetic (SCL01 to SCL33)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def zfill(x: Column, width: int) -> Column:
    """Zero-padded on the left; longer text stays whole, unlike lpad (SCL01)."""
    return F.when(F.length(x) < width, F.lpad(x, width, "0")).otherwise(x)


def strip_decimal(x: Column) -> Column:
    """Text without a closing ``.0`` (SCL02)."""
    return F.regexp_replace(x, r"\.0$", "")


def normalise_fips(x: Column, width: int = 2) -> Column:
    return zfill(strip_decimal(F.trim(x.cast("string"))), width)


def block_group(geoid: Column) -> Column:
    """The 12 leading digits of a block's code (SCL03)."""
    return F.substring(zfill(geoid, 15), 1, 12)


def folded_code(geoid12: Column) -> Column:
    """A 12-digit code modulo 2**32 as a signed 32-bit number (SCL04)."""
    low = F.pmod(geoid12.cast("long"), F.lit(1 << 32))
    return F.when(low > 2147483647, low - F.lit(1 << 32)).otherwise(low)


def quote_identifier(name: str) -> str:
    """A name as a quoted identifier (SCL05)."""
    return "`" + name.replace("`", "``") + "`"


def token(x: Column) -> Column:
    """Lower-case letters and digits only (SCL06)."""
    return F.regexp_replace(F.lower(x), "[^a-z0-9]", "")


def nfkc(x: Column) -> Column:
    """Unicode compatibility composition, which Spark has no built-in for (SCL07)."""

    @F.pandas_udf("string")
    def compose(values: pd.Series) -> pd.Series:
        return values.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))

    return compose(x)


def blank_to_empty(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit(""))


def is_filled(x: Column) -> Column:
    """Whether text has more than blanks (SCL09)."""
    return F.trim(blank_to_empty(x)) != ""


def row_key(*cols: Column) -> Column:
    """A 256-bit key of several columns; nulls and empty text differ, and so do column borders (SCL10, SCL11)."""
    parts = [F.coalesce(F.concat(F.lit("1"), F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("0:")) for c in cols]
    return F.sha2(F.concat(*parts), 256)


def to_number(x: Column) -> Column:
    """A number, or null where the text is none (SCL13, PRJ13)."""
    return F.trim(x).try_cast("double")


def percent(part: Column, whole: Column) -> Column:
    """Share in percent, null for an empty whole (SCL14)."""
    return F.when(whole != 0, part * 100.0 / whole)


def round_half_even(x: Column) -> Column:
    """SCL17."""
    return F.rint(x)


def nice_ceiling(x: Column, step: float) -> Column:
    """The next multiple of a step (SCL31)."""
    return F.ceil(x / F.lit(step)) * F.lit(step)


def hex16(x: Column) -> Column:
    """Sixteen hexadecimal digits (SCL22)."""
    return F.lpad(F.lower(F.hex(x)), 16, "0")


def says_true(x: Column) -> Column:
    """SCL23, FLT12."""
    return F.lower(F.trim(x)) == "true"


def is_sha256(x: Column) -> Column:
    """SCL33."""
    return x.rlike("^[0-9a-f]{64}$")


def combination(*cols: Column) -> Column:
    """Names joined as one identifier, without hyphens (SCL27)."""
    return F.concat_ws("__", *[F.regexp_replace(c.cast("string"), "-", "") for c in cols])


def thousands(x: Column, digits: int = 0, none: str = "--") -> Column:
    """Grouped digits, or a dash for null (SCL28)."""
    return F.coalesce(F.format_number(x, digits), F.lit(none))


def p_text(p: Column) -> Column:
    """A p-value in print (SCL29)."""
    return F.when(p.isNull(), "--").when(p < 0.001, "<0.001").otherwise(F.format_number(p, 3))


def setting(radius: Column) -> Column:
    """``Fixed`` for a method without radius, else the radius (SCL30)."""
    return F.when(F.coalesce(radius, F.lit(0)) == 0, "Fixed").otherwise(radius.cast("string"))


def iso_utc(ts: Column) -> Column:
    """SCL24."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
