"""Numbers written as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_number(text: Column) -> Column:
    """A decimal number, or a hexadecimal one after 0x; null where it is neither or over 63 bits."""
    t = F.lower(F.trim(text))
    digits = F.regexp_extract(t, "^0x([0-9a-f]+)$", 1)
    # Sixteen digits at most reach the conversion; its unsigned result is null beyond 63 bits.
    plain = F.regexp_replace(digits, "^0+(?=.)", "")
    hexadecimal = F.when(F.length(plain) <= 16, F.conv(plain, 16, 10).try_cast("long"))
    return F.when(t.startswith("0x"), F.when(digits != "", hexadecimal)).otherwise(t.try_cast("long"))
