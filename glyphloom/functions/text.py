"""Text scalars: cleaning, codepoints, Unicode normalisation."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Unicode white space plus the byte order mark.
SPACE = r"(?U)[\s﻿]+"


def clean_text(text: Column) -> Column:
    """White-space runs become one blank, ends are trimmed; null becomes the empty string."""
    return F.trim(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE, " "))


def codepoints(text: Column) -> Column:
    """ARRAY<INT> of the codepoints; empty for the empty string, null for null."""
    return F.when(text == "", F.array().cast("array<int>")).otherwise(F.transform(F.split(text, ""), lambda c: F.ascii(c)))


def from_codepoints(cps: Column) -> Column:
    """The string of an ARRAY<INT> of codepoints."""
    return F.decode(F.unhex(F.array_join(F.transform(cps, lambda c: F.lpad(F.hex(c), 8, "0")), "")), "UTF-32")


def to_utf8(text: Column) -> Column:
    return F.encode(text, "UTF-8")


@F.pandas_udf(StringType())
def _composed(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else s if s.isascii() else unicodedata.normalize("NFC", s), na_action="ignore")


def nfc(text: Column | str) -> Column:
    """Canonical composition of the whole value (Spark has no built-in for it).

    Nothing below U+0300 is changed by it, so only values with a codepoint from there on go to Python.
    """
    c = F.col(text) if isinstance(text, str) else text
    open_ = c.rlike(r"[^\x{0}-\x{2FF}]")
    return F.when(open_, _composed(F.when(open_, c))).otherwise(c)


def estimate_size(rows: Column, chars_per_row: int = 350) -> Column:
    """Display string of the size to expect of so many rows: kilobytes below one megabyte, else megabytes."""
    kb = rows * F.lit(chars_per_row / 1024.0)
    return F.when(kb < 1024, F.format_string("~%.1f KB", F.round(kb, 1))).otherwise(F.format_string("~%.1f MB", F.round(kb / 1024, 1)))


def round_significant(x: Column, digits: int) -> Column:
    """x to so many significant digits; null where x is null, zero stays."""
    size = F.floor(F.log10(F.abs(F.nullif(x, F.lit(0.0)))))
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - size)
    return F.when(x == 0, F.lit(0.0)).otherwise(F.rint(x * scale) / scale)
