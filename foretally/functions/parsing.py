"""String cells to typed columns; anything unparsable becomes NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: white space, and the accepted shapes of date and count cells ----
WHITE_SPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
DATE_SHAPE = r"^(3[01]|[12][0-9]|0[1-9]|[1-9])/(1[0-2]|0[1-9]|[1-9])/([0-9]{4}|[0-9]{2})$"
NUMBER_SHAPE = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
SHORT_NUMBER = r"^[0-9]{1,9}$"  # most cells; fits 32 bits


def stripped(cell: Column | str) -> Column:
    """Trim every kind of white space (``trim`` alone removes only spaces); NULL becomes ''."""
    return F.coalesce(F.btrim(cell, F.lit(WHITE_SPACE)), F.lit(""))


def is_blank(cell: Column | str) -> Column:
    return stripped(cell) == ""


def _text(cell: Column | str, trimmed: bool) -> Column:
    if not trimmed:
        return stripped(cell)
    return F.col(cell) if isinstance(cell, str) else cell


def parse_match_date(cell: Column | str, trimmed: bool = False) -> Column:
    """``d/m/Y`` or ``d/m/y``; two-digit years 69-99 belong to the 1900s."""
    text = _text(cell, trimmed)
    # parts are cut at the slashes, so a cell of the right shape meets one regular expression
    day, year = F.substring_index(text, "/", 1), F.substring_index(text, "/", -1)
    month = F.substring_index(F.substring_index(text, "/", 2), "/", -1)
    short = year.try_cast("int")
    full_year = F.when(F.length(year) == 4, year).otherwise(
        F.when(short >= 69, F.lit(1900) + short).otherwise(F.lit(2000) + short).cast("string")
    )
    iso = F.concat_ws("-", full_year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.when(text.rlike(DATE_SHAPE) & (full_year != "0000"), iso.try_cast("date"))


def is_too_large(cell: Column | str) -> Column:
    """A whole number beyond the 32 bits of a count."""
    text = stripped(cell)
    value = F.when(text.rlike(NUMBER_SHAPE), text.try_cast("double"))
    return F.coalesce((value >= F.lit(2147483648.0)) & (value == F.floor(value)), F.lit(False))


def parse_count(cell: Column | str, trimmed: bool = False) -> Column:
    """Non-negative whole number up to 2**31 - 1; ``6``, ``6.0`` and ``1e1`` are whole numbers."""
    text = _text(cell, trimmed)
    value = F.when(text.rlike(NUMBER_SHAPE), text.try_cast("double"))
    whole = (value >= 0) & (value == F.floor(value)) & (value < F.lit(2147483648.0))
    return F.when(text.rlike(SHORT_NUMBER), text.try_cast("int")).otherwise(F.when(whole, value.cast("int")))
