"""Date helpers: windows relative to ``as_of``, ranges, month/week keys, weekday numbers."""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Localised month names used in report period labels (index 1..12).
MONTH_NAMES_PT = [
    "Janeiro", "Fevereiro", "Março", "Abril", "Maio", "Junho",
    "Julho", "Agosto", "Setembro", "Outubro", "Novembro", "Dezembro",
]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_date(d) -> _dt.date:
    if isinstance(d, _dt.datetime):
        return d.date()
    if isinstance(d, _dt.date):
        return d
    return _dt.date.fromisoformat(str(d)[:10])


def ntz(value) -> Column:
    """A TIMESTAMP_NTZ literal built from text, so it does not depend on the Python
    process's or the session's time zone."""
    if isinstance(value, _dt.datetime):
        value = value.isoformat(sep=" ")
    elif isinstance(value, _dt.date):
        value = f"{value.isoformat()} 00:00:00"
    return F.lit(str(value)).cast("timestamp_ntz")


def recent_window(date_col, as_of, days: int, ts_col=None) -> Column:
    """``date >= as_of - days``.

    When the row also has a raw timestamp column the equivalent predicate on it is
    added: a filter on a derived ``date`` cannot reach the parquet scan, the one on
    the timestamp can (row-group skipping on min/max).
    """
    start = as_date(as_of) - _dt.timedelta(days=days)
    p = _c(date_col) >= F.lit(start)
    if ts_col is not None:
        p = p & (_c(ts_col) >= ntz(start))
    return p


@dataclass(frozen=True)
class DateRange:
    """A reporting period. Four modes, as the reference uses all four:

    * ``half_open``       start <= x <  end                (monthly report)
    * ``closed_date``     start <= date(x) <= end           (dashboard on a DATE column)
    * ``closed_midnight`` start <= x <= end 00:00:00        (dashboard on a TIMESTAMP column: the
      last day's events after midnight fall out, as in the reference)
    * ``end_of_day``      start <= x <= end 23:59:59
    """

    start: _dt.date
    end: _dt.date
    mode: str = "half_open"

    @staticmethod
    def of(start, end, mode: str = "half_open") -> "DateRange":
        return DateRange(as_date(start), as_date(end), mode)

    def _ts_bounds(self):
        s = _dt.datetime.combine(self.start, _dt.time())
        e0 = _dt.datetime.combine(self.end, _dt.time())
        if self.mode == "half_open":
            return s, e0, False
        if self.mode == "closed_date":
            return s, e0 + _dt.timedelta(days=1), False
        if self.mode == "closed_midnight":
            return s, e0, True
        if self.mode == "end_of_day":
            return s, e0 + _dt.timedelta(hours=23, minutes=59, seconds=59), True
        raise ValueError(f"unknown DateRange mode {self.mode!r}")

    def on_timestamp(self, ts_col) -> Column:
        s, e, inclusive = self._ts_bounds()
        c = _c(ts_col)
        lo = c >= ntz(s)
        hi = (c <= ntz(e)) if inclusive else (c < ntz(e))
        return lo & hi

    def on_date(self, date_col, ts_col=None) -> Column:
        """Predicate on a DATE column (plus the pushable twin on ``ts_col``)."""
        c = _c(date_col)
        if self.mode == "half_open":
            p = (c >= F.lit(self.start)) & (c < F.lit(self.end))
        elif self.mode in ("closed_date", "end_of_day"):
            p = (c >= F.lit(self.start)) & (c <= F.lit(self.end))
        else:  # closed_midnight on a DATE column behaves as closed on dates
            p = (c >= F.lit(self.start)) & (c <= F.lit(self.end))
        if ts_col is not None:
            s = _dt.datetime.combine(self.start, _dt.time())
            last = self.end if self.mode != "half_open" else self.end - _dt.timedelta(days=1)
            e = _dt.datetime.combine(last + _dt.timedelta(days=1), _dt.time())
            p = p & (_c(ts_col) >= ntz(s)) & (_c(ts_col) < ntz(e))
        return p

    def sql_dates(self) -> tuple[str, str]:
        return self.start.isoformat(), self.end.isoformat()


def month_range(month: str | None = None, as_of=None) -> tuple[_dt.date, _dt.date, str]:
    """``YYYY-MM`` (or the month before ``as_of``) -> (start, end, label), end exclusive."""
    if month:
        y, m = (int(p) for p in month.split("-"))
    else:
        ref = as_date(as_of) if as_of is not None else _dt.date.today()
        prev = ref.replace(day=1) - _dt.timedelta(days=1)
        y, m = prev.year, prev.month
    start = _dt.date(y, m, 1)
    end = _dt.date(y + 1, 1, 1) if m == 12 else _dt.date(y, m + 1, 1)
    return start, end, f"{MONTH_NAMES_PT[m - 1]} {y}"


def month_label(date_col) -> Column:
    """Localised ``<Month> <year>`` label as a column (for all months in one pass)."""
    names = F.array(*[F.lit(n) for n in MONTH_NAMES_PT])
    d = _c(date_col)
    return F.concat(F.element_at(names, F.month(d)), F.lit(" "), F.year(d).cast("string"))


def month_key(date_col) -> Column:
    """``strftime(d, '%Y-%m')``."""
    return F.date_format(_c(date_col), "yyyy-MM")


def week_key(date_col) -> Column:
    """``strftime(d, '%Y-W%W')``: Monday-based week number, days before the first
    Monday are week 00. Spark has no pattern for it, so it is computed."""
    d = _c(date_col)
    wk = F.floor((F.dayofyear(d) - 1 + 7 - F.weekday(d)) / 7).cast("int")
    return F.concat(F.date_format(d, "yyyy"), F.lit("-W"), F.lpad(wk.cast("string"), 2, "0"))


def weekday_sun0(date_col) -> Column:
    """DAYOFWEEK with Sunday = 0 (Spark's ``dayofweek`` has Sunday = 1)."""
    return F.dayofweek(_c(date_col)) - 1
