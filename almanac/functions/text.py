"""Text helpers: localised number format, address shortening, slugs, truncation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label for a missing address.
UNKNOWN_PLACE = "Local desconhecido"
UNKNOWN_SLUG = "unknown"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fmt_number(x) -> Column:
    """``1.234,56``; integral values lose their decimals (``1.234``); NULL -> ``0``."""
    v = _c(x).cast("double")
    integral = F.translate(F.format_number(v, 0), ",", ".")
    frac = F.translate(F.format_number(v, 2), ",.", ".,")
    return F.when(v.isNull(), F.lit("0")).when(v == F.floor(v), integral).otherwise(frac)


def shorten_address(addr) -> Column:
    """Parts 0 and 2 of a comma list when there are >= 3, else part 0; blank -> unknown."""
    a = _c(addr)
    parts = F.transform(F.split(a, ","), lambda p: F.trim(p))
    short = F.when(F.size(parts) >= 3, F.concat(F.get(parts, 0), F.lit(", "), F.get(parts, 2))).otherwise(F.get(parts, 0))
    return F.when(a.isNull() | (a == ""), F.lit(UNKNOWN_PLACE)).otherwise(short)


def slug(x) -> Column:
    """lower, strip, drop leading '@', non-alphanumerics -> '-', trim '-'; blank -> 'unknown'."""
    s = F.ltrim(F.lower(F.trim(_c(x), F.lit(" \t\n\r\x0b\x0c"))), F.lit("@"))
    s = F.trim(F.regexp_replace(s, r"[^a-z0-9]+", "-"), F.lit("-"))
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(UNKNOWN_SLUG))


# An incomplete UTF-8 sequence at the end of a byte string, in hex: a lead byte with
# fewer continuation bytes than it announces (anchored at the end, so pair-aligned).
_PARTIAL_UTF8_HEX = r"(?:[CD][0-9A-F]|E[0-9A-F](?:[89AB][0-9A-F])?|F[0-7](?:[89AB][0-9A-F]){0,2})$"


def truncate_bytes(x, n: int) -> Column:
    """First ``n`` UTF-8 bytes (``head -c``); a character cut in the middle is dropped
    instead of producing invalid text."""
    cut = F.hex(F.substring(F.encode(_c(x), "UTF-8"), 1, n))
    return F.decode(F.unhex(F.regexp_replace(cut, _PARTIAL_UTF8_HEX, "")), "UTF-8")
