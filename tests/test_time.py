"""Formats, truncation and shifts against Python's own."""

from __future__ import annotations

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from metricframe import Connection, Model, attr, column, timeinterval
from metricframe.expressions import GRANULARITIES
from metricframe.functions.intervals import shift, truncate
from metricframe.functions.timeformat import format_sql

TOKENS = "%a %A %w %d %-d %b %B %m %-m %y %Y %H %-H %I %-I %p %M %-M %S %-S %f %j %-j %U %-U %W %-W %%"


@pytest.fixture(scope="module")
def times(spark):
    days = [dt.datetime(2019, 12, 20) + dt.timedelta(days=d, hours=d * 7 % 24, minutes=d % 60, microseconds=d * 997) for d in range(800)]
    return Model(Connection(spark, t=spark.createDataFrame([(d,) for d in days] + [(None,)], "t timestamp_ntz")), "t").with_attributes("t"), days


def test_every_token(times):
    model, days = times
    for token in TOKENS.split():
        got = [r["s"] for r in model.filter(attr.t != None).pick(attr.t.strftime(token).named("s")).run().py_records]  # noqa: E711
        assert got == [d.strftime(token) for d in days], token


def test_formats(times):
    model, days = times
    made = model.sort(attr.t, nulls="first").limit(2)
    got = [tuple(r.values()) for r in made.pick(attr.t.format_timestamp().named("iso"), attr.t.strftime("it's %Y 100%%\\n").named("odd")).run().py_records]
    assert got == [(None, None), (days[0].isoformat()[:19] + "+00", f"it's {days[0].year} 100%\\n")]
    for bad in ("%c", "%x", "%X", "%E"):
        with pytest.raises(ValueError):
            format_sql(bad, "t")


def test_truncation_equals_python(times):
    model, days = times
    for unit in GRANULARITIES:
        got = [r["t"] for r in model.filter(attr.t != None).pick(attr.t.by_granularity(unit)).run().py_records]  # noqa: E711
        assert got == [truncate(d, unit) for d in days], unit
    monday = model.with_connection(model.connection.with_first_weekday(0))
    assert all(r["t"].weekday() == 0 for r in monday.filter(attr.t != None).pick(attr.t.by_week).run().py_records)  # noqa: E711
    assert all(truncate(d, "week").weekday() == 6 for d in days)
    with pytest.raises(ValueError):
        attr.t.by_granularity("century")


@settings(max_examples=200, deadline=None)
@given(st.datetimes(dt.datetime(1990, 1, 1), dt.datetime(2040, 1, 1)), st.integers(-40, 40))
def test_month_shifts_keep_the_day(time, months):
    moved = shift(time, timeinterval("months", months))
    assert (moved.year * 12 + moved.month) - (time.year * 12 + time.month) == months and moved.day <= time.day
    assert truncate(time, "quarter") <= time and truncate(time, "quarter").month in (1, 4, 7, 10)


def test_constant_times_are_folded(times):
    model, _ = times
    made = model.filter(attr.t >= column(value=dt.datetime(2020, 5, 17)).by_month - dt.timedelta(days=1)).sql()
    assert "2020-04-30" in made
    assert "2020-04-30" in model.filter(attr.t > column(value=dt.date(2020, 5, 31)) - timeinterval("months", 1)).sql()


def test_relative_periods(spark):
    now = dt.datetime.now()
    for name, unit, back in (("is_today", "day", 0), ("is_this_week", "week", 0), ("is_this_month", "month", 0), ("is_this_quarter", "quarter", 0), ("is_this_year", "year", 0)):
        begin = truncate(now, unit)
        data = [(begin,), (begin - dt.timedelta(microseconds=1),)]
        model = Model(Connection(spark, t=spark.createDataFrame(data, "t timestamp_ntz")), "t")
        assert [r["t"] for r in model.filter(getattr(column("t"), name)).run().py_records] == [begin]
        last = name.replace("this", "last") if "this" in name else "is_yesterday"
        assert [r["t"] for r in model.filter(getattr(column("t"), last)).run().py_records] == [data[1][0]]
