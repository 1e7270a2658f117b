"""Restart alerts with a window and a cooldown (batch twin of the streaming watchdog).

The watchdog looks at a service's log all the time, in whole seconds: a restart is due when an error line
(one of three patterns) that no earlier restart has answered is at most ``window`` seconds old and the last restart is at
least ``cooldown`` seconds ago. So an error outside the cooldown alerts at once; one inside the cooldown alerts
at its end if it is no older than the window then, and is forgotten otherwise.

With ``a`` the latest alert decided so far, an error at ``e`` gives

* nothing if ``e <= a`` (that alert answers it) or if ``a + cooldown - e > window``;
* an alert at ``max(e, a + cooldown)`` otherwise.

Each alert depends on the one before. The fold needs no loop of jobs: at the start of a day only the
seconds between ``a`` and midnight matter, a whole number from -cooldown (long ago) to +cooldown. A day is
therefore a table of ``2 * cooldown + 1`` results, built from that day's errors alone (at most 86,400 seconds
a service, whatever the log holds). The tables of a service are chained from day to day, which gives each
day's true start, and the days are folded once more from there. Tasks hold one day of one service or
one service's day tables; both are bounded by the calendar.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.session import cut_lineage

# Error patterns that call for a restart; cooldown and window seconds.
ERROR_PATTERNS = r"(?i)tick timeout|device nonce required|gateway connect failed"
COOLDOWN_SEC = 180
WINDOW_SEC = 300
DAY = 86_400


def next_alert(last: int | None, error: int, cooldown: int, window: int) -> int | None:
    """The latest alert after an error, given the latest alert before it (both in seconds)."""
    if last is None or error >= last + cooldown:
        return error
    if error <= last or last + cooldown - error > window:
        return last
    return last + cooldown


def error_days(log: DataFrame, service: str = "service", ts: str = "timestamp", line: str = "line") -> DataFrame:
    """(service, day, seconds): the distinct seconds of a day with a matching line, in order. Lines without a time are left out."""
    e = log.filter(F.col(line).rlike(ERROR_PATTERNS) & F.col(ts).isNotNull())
    second = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    e = e.select(F.col(service).alias("service"), F.col(ts).cast("date").alias("day"), second.cast("int").alias("s")).distinct()
    return e.groupBy("service", "day").agg(F.array_sort(F.collect_list("s")).alias("seconds"))


def day_table(seconds: np.ndarray, cooldown: int, window: int) -> np.ndarray:
    """The latest alert relative to the next midnight, for every latest alert (-cooldown to cooldown) relative to this one."""
    last = np.arange(-cooldown, cooldown + 1, dtype=np.int64)
    for e in seconds:
        held = (e <= last) | (last + cooldown - e > window)
        last = np.where(e >= last + cooldown, e, np.where(held, last, last + cooldown))
    return np.maximum(last - DAY, -cooldown)


def alert_cooldown(log: DataFrame, cooldown_sec: int = COOLDOWN_SEC, window_sec: int = WINDOW_SEC, service: str = "service",
                   ts: str = "timestamp", line: str = "line", checkpoint: bool = True) -> DataFrame:
    """Alert times (service, alert_ts), in whole seconds. ``checkpoint``: scan the log once, not twice."""
    if not 0 < cooldown_sec <= DAY // 2:
        raise ValueError("the cooldown must be between one second and half a day")
    days = error_days(log, service, ts, line)
    days = cut_lineage(days) if checkpoint else days

    def tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"service": b["service"], "day": b["day"], "table": [day_table(s, cooldown_sec, window_sec) for s in b["seconds"]]})

    def starts(of: pd.DataFrame) -> pd.DataFrame:
        of = of.sort_values("day")
        out, last, before = [], -cooldown_sec, None
        for day, table in zip(of["day"], of["table"]):
            last = last if before is not None and (day - before).days == 1 else -cooldown_sec
            out.append(last)
            last, before = int(table[last + cooldown_sec]), day
        return pd.DataFrame({"service": of["service"], "day": of["day"], "start": out})

    def alerts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = []
            for name, day, seconds, last in zip(b["service"], b["day"], b["seconds"], b["start"]):
                for e in seconds.tolist():
                    new = next_alert(last, e, cooldown_sec, window_sec)
                    if new != last:
                        found.append((name, day, new))
                    last = new
            yield pd.DataFrame(found, columns=["service", "day", "at"])

    t = days.mapInPandas(tables, "service string, day date, table array<int>")
    t = t.groupBy("service").applyInPandas(starts, "service string, day date, start int")
    t = t.select(F.col("service").alias("_s"), F.col("day").alias("_d"), "start")
    placed = days.join(t, F.col("service").eqNullSafe(F.col("_s")) & (F.col("day") == F.col("_d"))).select("service", "day", "seconds", "start")
    found = placed.mapInPandas(alerts, "service string, day date, at int")
    return found.select("service", F.timestamp_add("SECOND", F.col("at"), F.col("day").cast(log.schema[ts].dataType)).alias("alert_ts"))
