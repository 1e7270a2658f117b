"""Sensor helpers over a ``items: array<struct<code, value>>`` status document."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _first_item(items: Column, code: str) -> Column:
    """First item with ``code`` (NULL when absent). ``array_position`` scans the
    codes without building a filtered array; ``get`` (0-based) gives NULL for -1."""
    pos = F.array_position(items["code"], F.lit(code))
    return F.get(items, (pos - 1).cast("int"))


def sensor_double(items: Column, code: str, default: float | None = None) -> Column:
    """Value of the first item with ``code`` as double; blank/invalid/missing -> default."""
    v = F.nullif(_first_item(items, code)["value"], F.lit(""))
    d = v.try_cast("double")
    return d if default is None else F.coalesce(d, F.lit(float(default)))


def sensor_bool(items: Column, code: str, true_val: str = "1") -> Column:
    """First item with ``code``: value == ``true_val``; item absent -> NULL."""
    it = _first_item(items, code)
    return F.when(it.isNull(), F.lit(None).cast("boolean")).otherwise(F.coalesce(it["value"] == F.lit(true_val), F.lit(False)))


def sensor_fallback(primary: Column, fallback: Column) -> Column:
    """Primary reading unless it is NULL or 0, then the fallback."""
    return F.coalesce(F.nullif(primary, F.lit(0.0)), fallback)
