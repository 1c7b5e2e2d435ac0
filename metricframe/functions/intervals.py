"""Calendar intervals, and time arithmetic on the driver."""

from __future__ import annotations

import calendar
import datetime as dt
from dataclasses import dataclass

UNITS = tuple("seconds minutes hours days months years".split())


@dataclass(frozen=True)
class timeinterval:  # noqa: N801 - a value like datetime.timedelta
    """``num`` calendar units; months and years keep the day of the month where there is one."""

    unit: str
    num: int

    def __post_init__(self) -> None:
        if self.unit not in UNITS:
            raise ValueError(f"no such unit: {self.unit}")


def shift(time: dt.date, by: dt.timedelta | timeinterval, sign: int = 1) -> dt.date:
    """A date or time moved by an interval; whole seconds count."""
    if isinstance(by, dt.timedelta):
        by = dt.timedelta(days=by.days, seconds=by.seconds)
        if not isinstance(time, dt.datetime):
            time = dt.datetime(time.year, time.month, time.day)
        return time + sign * by
    if by.unit in ("years", "months"):
        months = time.year * 12 + time.month - 1 + sign * by.num * (12 if by.unit == "years" else 1)
        year, month = divmod(months, 12)
        return time.replace(year=year, month=month + 1, day=min(time.day, calendar.monthrange(year, month + 1)[1]))
    if not isinstance(time, dt.datetime):
        time = dt.datetime(time.year, time.month, time.day)
    return time + sign * dt.timedelta(**{by.unit: by.num})


def truncate(time: dt.date, unit: str, first_weekday: int = 6) -> dt.date:
    """The beginning of the unit that a time is in; ``first_weekday`` counts from Monday as 0."""
    if not isinstance(time, dt.datetime):
        time = dt.datetime(time.year, time.month, time.day)
    time = time.replace(microsecond=0)
    if unit == "second":
        return time
    if unit in ("minute", "hour"):
        return time.replace(second=0, **({"minute": 0} if unit == "hour" else {}))
    day = time.replace(hour=0, minute=0, second=0)
    if unit == "week":
        return day - dt.timedelta(days=(day.weekday() - first_weekday) % 7)
    if unit == "quarter":
        return day.replace(month=(day.month - 1) // 3 * 3 + 1, day=1)
    return {"day": day, "month": day.replace(day=1), "year": day.replace(month=1, day=1)}[unit]
