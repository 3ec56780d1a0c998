"""One clock for a whole script: as-of values and relative date ranges become literals."""

from __future__ import annotations

import calendar
from dataclasses import dataclass
from datetime import UTC, date, datetime, timedelta
from zoneinfo import ZoneInfo

from quillframe.errors import ArgumentError

WEEKDAYS = ["SUNDAY", "MONDAY", "TUESDAY", "WEDNESDAY", "THURSDAY", "FRIDAY", "SATURDAY"]


def _month(d: date, k: int) -> date:
    m = d.year * 12 + d.month - 1 + k
    return date(m // 12, m % 12 + 1, 1)


@dataclass(frozen=True)
class Clock:
    as_of: datetime
    zone: str = "UTC"

    @staticmethod
    def now(zone: str = "UTC") -> Clock:
        return Clock(datetime.now(UTC), zone)

    @property
    def today(self) -> date:
        return self.as_of.astimezone(ZoneInfo(self.zone)).date()

    def scalar(self, name: str) -> str:
        """Text of NOW, TODAY, MONTH_START, NEXT_MONTH_START and the CURRENT_ functions."""
        if name in ("NOW", "CURRENT_TIMESTAMP"):
            return self.as_of.astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%S.") + f"{self.as_of.microsecond // 1000:03d}Z"
        if name in ("TODAY", "CURRENT_DATE"):
            return self.today.isoformat()
        return _month(self.today, 1 if name == "NEXT_MONTH_START" else 0).isoformat()

    def span(self, name: str, args: tuple) -> tuple[date, date]:
        """[start, end) of a relative date function; weeks begin on Sunday."""
        d, day = self.today, timedelta(days=1)
        if name in ("TODAY", "YESTERDAY", "TOMORROW"):
            s = d + {"TODAY": 0, "YESTERDAY": -1, "TOMORROW": 1}[name] * day
            return s, s + day
        if name == "FROM_TODAY":
            n, unit = int(args[0]), str(args[1]).upper().rstrip("S")
            if unit in ("DAY", "WEEK"):
                s = d + n * (7 if unit == "WEEK" else 1) * day
            elif unit in ("MONTH", "YEAR"):
                m = _month(d, n * (12 if unit == "YEAR" else 1))
                s = m.replace(day=min(d.day, calendar.monthrange(m.year, m.month)[1]))
            else:
                raise ArgumentError(f"unknown unit {args[1]}")
            return s, s + day
        step = {"THIS": 0, "LAST": -1, "NEXT": 1}[name.split("_")[0]]
        period = name.split("_")[1]
        if period == "WEEK":
            s = d - timedelta(days=(d.weekday() + 1) % 7) + 7 * step * day
            if args:
                s += WEEKDAYS.index(str(args[0]).upper()) * day
                return s, s + day
            return s, s + 7 * day
        if period == "MONTH":
            s, e = _month(d, step), _month(d, step + 1)
            if args:
                at = e - day if str(args[0]).upper() == "LAST" else s.replace(day=min(int(args[0]), (e - day).day))
                return at, at + day
            return s, e
        return date(d.year + step, 1, 1), date(d.year + step + 1, 1, 1)
