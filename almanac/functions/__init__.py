"""Column helpers (``Column -> Column``); all JVM-side built-ins, no Python UDFs."""

from almanac.functions.numeric import avg_exact, round_half_away, py_round0, to_double
from almanac.functions.dates import (
    DateRange, month_key, week_key, weekday_sun0, recent_window, month_range, month_label,
)

__all__ = [
    "avg_exact", "round_half_away", "py_round0", "to_double",
    "DateRange", "month_key", "week_key", "weekday_sun0", "recent_window", "month_range", "month_label",
]
