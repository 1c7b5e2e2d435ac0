"""Ordered step matching of events, in one exchange however many steps there are.

For each group the first step's match is its earliest event that fits; each further
step's is the earliest that fits strictly later than the match before.  Times come
from a chain of window minima over one partitioning without an order; the matched
events come from an aggregate over the same partitioning.

With partitioned start events a group has many chains.  Going from the last step back, one
running minimum a step over the later events of the group gives each event what would follow
it; the chain of a start is then what follows its earliest event.  Only events that fit some
step are exchanged, once, and a group takes space in proportion to its events.
"""

from __future__ import annotations

import datetime as dt
import functools
import operator
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def match_steps(
    events: DataFrame,
    *,
    group: Column,
    group_name: str,
    timestamp: Column,
    steps: Sequence[tuple[str, Column]],
    starts: Sequence[tuple[str, Column]] = (),
    time_limit: dt.timedelta | None = None,
    columns: Mapping[str, Sequence[str]],
    timestamp_name: str | None = None,
) -> DataFrame:
    """One row a group (and combination of ``starts``), with a struct of the matched event for each step in ``columns``.

    A step's struct is null where it was not reached.  Of several events that fit at the
    same time the one with the least of the wanted columns is taken.  Groups without a
    match keep their row, unless there are ``starts``; a null group matches nothing.
    A step of which only the column ``timestamp_name`` is wanted takes the matched time
    itself, without a look at the events again.
    """
    timed_only = {name for name, wanted in columns.items() if timestamp_name is not None and list(wanted) == [timestamp_name]}
    used = sorted({c for name, wanted in columns.items() if name not in timed_only for c in wanted})
    base = events.select(
        group.alias("__group"),
        timestamp.alias("__ts"),
        *[c.alias(f"__start_{i}") for i, (_, c) in enumerate(starts)],
        *[(c & group.isNotNull()).alias(f"__fits_{k}") for k, (_, c) in enumerate(steps)],
        *[F.col(f"self.`{c}`").alias(f"__col_{c}") for c in used],
    )
    parts = [f"__start_{i}" for i in range(len(starts))]
    event = lambda name: F.struct(*[F.col(f"`__col_{c}`").alias(c) for c in columns[name]])
    keys = ["__group", *parts]
    if starts:
        return _from_starts(base, parts, group_name, steps, starts, time_limit, columns, timed_only, timestamp_name)
    window = Window.partitionBy(*keys)
    timed = base
    for k in range(len(steps)):
        later = F.col(f"__fits_{k}") if k == 0 else F.col(f"__fits_{k}") & (F.col("__ts") > F.col(f"__t_{k - 1}"))
        timed = timed.withColumn(f"__t_{k}", F.min(F.when(later, F.col("__ts"))).over(window))

    def within(k: int, at: Column) -> Column:
        return at if k == 0 or time_limit is None else F.when(F.col(f"__t_{k}") < F.col("__t_0") + F.lit(time_limit), at)

    made = []
    for k, (name, _) in enumerate(steps):
        if name not in columns:
            continue
        if name in timed_only:
            time = F.min(within(k, F.col(f"__t_{k}")))
            made.append(F.when(time.isNotNull(), F.struct(time.alias(timestamp_name))).alias(name))
            continue
        fits = F.col(f"__fits_{k}") & (F.col("__ts") == F.col(f"__t_{k}"))
        if k:
            fits = fits & (F.col("__ts") > F.col(f"__t_{k - 1}"))
        made.append(F.min(within(k, F.when(fits, event(name)))).alias(name))
    out = timed.groupBy(*keys)
    done = out.agg(*made) if made else timed.select(*keys).distinct()
    return done.select(F.col("__group").alias(group_name), *[F.col(f"`{name}`") for name, _ in steps if name in columns])


def _from_starts(
    base: DataFrame,
    parts: Sequence[str],
    group_name: str,
    steps: Sequence[tuple[str, Column]],
    starts: Sequence[tuple[str, Column]],
    time_limit: dt.timedelta | None,
    columns: Mapping[str, Sequence[str]],
    timed_only: set[str],
    timestamp_name: str | None,
) -> DataFrame:
    """One row for each group and combination of its first step's ``parts``."""

    def link(k: int) -> Column:
        """An event at step ``k`` with all that follows it; the least link is the earliest event's."""
        fields = [(-F.col("__place")).alias("place"), F.col("__ts").alias("time")]
        name = steps[k][0]
        if name in columns and name not in timed_only:
            fields.append(F.struct(*[F.col(f"`__col_{c}`").alias(c) for c in columns[name]]).alias("event"))
        if k + 1 < len(steps):
            fields.append(F.col(f"__next_{k + 1}").alias("next"))
        return F.struct(*fields)

    fits = functools.reduce(operator.or_, [F.col(f"__fits_{k}") for k in range(len(steps))])
    chained = base.filter(fits & F.col("__ts").isNotNull())
    # Places count different times, the last one first, so that later events are those of lower places.
    chained = chained.withColumn("__place", F.dense_rank().over(Window.partitionBy("__group").orderBy(F.desc("__ts"))))
    later = Window.partitionBy("__group").orderBy("__place").rangeBetween(Window.unboundedPreceding, -1)
    for k in range(len(steps) - 1, 0, -1):
        chained = chained.withColumn(f"__next_{k}", F.min(F.when(F.col(f"__fits_{k}"), link(k))).over(later))
    done = chained.filter("__fits_0").groupBy("__group", *parts).agg(F.min(link(0)).alias("__chain"))
    made, at = [], F.col("__chain")
    for k, (name, _) in enumerate(steps):
        time = at["time"]
        if name in columns:
            within = time.isNotNull()
            if k and time_limit is not None:
                within = within & (time < F.col("__chain")["time"] + F.lit(time_limit))
            made.append(F.when(within, F.struct(time.alias(timestamp_name)) if name in timed_only else at["event"]).alias(name))
        if k + 1 < len(steps):
            at = at["next"]
    renamed = [F.col("__group").alias(group_name), *[F.col(p).alias(name) for p, (name, _) in zip(parts, starts, strict=True)]]
    return done.select(*renamed, *made)
