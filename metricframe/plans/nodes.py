"""Logical plan nodes: what a model's verbs add to its source."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from typing import TYPE_CHECKING

from metricframe.expressions import Expression

if TYPE_CHECKING:
    from metricframe.model import Model


class Plan:
    """A node; all but the leaves have a ``base``."""

    def default_name(self) -> str | None:
        base = getattr(self, "base", None)
        return base.default_name() if base is not None else None


node = dataclass(frozen=True, eq=False)


@node
class Table(Plan):
    name: str
    schema: str | None = None

    def default_name(self) -> str | None:
        return self.name.rsplit("/", 1)[-1].split(".")[0]


@node
class Text(Plan):
    query: str


@node
class Pick(Plan):
    base: Plan
    columns: tuple[Expression, ...]


@node
class Filter(Plan):
    base: Plan
    condition: Expression


@node
class Aggregate(Plan):
    base: Plan
    groups: tuple[Expression, ...]
    measures: tuple[Expression, ...]


@node
class Sort(Plan):
    base: Plan
    key: Expression
    descending: bool = False
    nulls: str = "auto"


@node
class Limit(Plan):
    base: Plan
    count: int
    offset: int = 0


@node
class JoinOne(Plan):
    base: Plan
    relation: str
    model: Model
    condition: Expression
    drop_unmatched: bool = False


@node
class Union(Plan):
    base: Plan
    other: Model


@node
class Fold(Plan):
    base: Plan
    ids: tuple[Expression, ...]
    values: tuple[Expression, ...]
    key_name: str = "key"
    value_name: str = "value"


@node
class Match(Plan):
    base: Plan
    group: Expression
    timestamp: Expression
    steps: tuple[Expression, ...]
    starts: tuple[Expression, ...] = ()
    time_limit: dt.timedelta | None = None
    #: The events model, whose attributes the steps' relations have.
    events: Model | None = None
