"""Expressions: immutable trees that name, scope and combine columns until they are lowered to Spark SQL."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, fields, replace
from typing import TYPE_CHECKING, Any

from metricframe.functions.intervals import timeinterval

if TYPE_CHECKING:
    from metricframe.model import Model

GRANULARITIES = ("year", "quarter", "month", "week", "day", "hour", "minute", "second")
ISO = "%Y-%m-%dT%H:%M:%S%z"
_PRIVATE = re.compile(r"__.+__[0-9]*")


def is_private(name: str) -> bool:
    return _PRIVATE.fullmatch(name) is not None


class Expression:
    """What all nodes share: naming, operators and chained transforms.

    A node has an explicit name or none; ``default_name`` is what its shape implies.
    Comparison operators build nodes, so nodes are compared by their wire form.
    """

    explicit: str | None = None
    __hash__ = object.__hash__

    # Naming.

    @property
    def default_name(self) -> str | None:
        return None

    @property
    def optional_name(self) -> str | None:
        return self.explicit or self.default_name

    @property
    def identifier(self) -> str:
        if not self.optional_name:
            raise ValueError(f"this expression has no name of its own; give it one with .named(): {self!r}")
        return self.optional_name

    def named(self, name: str | Expression) -> Expression:
        if isinstance(name, AttrRef | MsrRef):
            name = name.key
        if not isinstance(name, str):
            raise TypeError("a name is a string")
        if is_private(name):
            raise ValueError(f"names like {name} are reserved")
        return replace(self, explicit=name)

    def disambiguated(self, relation: Any) -> Expression:
        """The same expression about the columns of a relation."""
        name = relation if isinstance(relation, str) else relation.identifier
        scoped = rewrite(self, lambda e: replace(e, relation=name) if isinstance(e, Column | Star | Sql) and e.relation is None else e)
        return replace(scoped, explicit=self.explicit)

    # Time.

    def by_granularity(self, granularity: str) -> Expression:
        return Truncated(self, granularity)

    by_second = property(lambda self: self.by_granularity("second"))
    by_minute = property(lambda self: self.by_granularity("minute"))
    by_hour = property(lambda self: self.by_granularity("hour"))
    by_day = property(lambda self: self.by_granularity("day"))
    by_week = property(lambda self: self.by_granularity("week"), doc="Weeks begin on Sunday unless the model's settings say otherwise.")
    by_month = property(lambda self: self.by_granularity("month"))
    by_quarter = property(lambda self: self.by_granularity("quarter"))
    by_year = property(lambda self: self.by_granularity("year"))

    def _within(self, unit: str, back: int) -> Expression:
        """In the current period of the unit (back 0) or the one before (back 1); the end is exclusive."""
        step = {"day": ("days", 1), "week": ("days", 7), "month": ("months", 1), "quarter": ("months", 3), "year": ("years", 1)}[unit]
        this = Call("now").by_granularity(unit)
        shift = timeinterval(unit=step[0], num=step[1])
        return (self >= this - shift) & (self < this) if back else (self >= this) & (self < this + shift)

    is_today = property(lambda self: self._within("day", 0))
    is_yesterday = property(lambda self: self._within("day", 1))
    is_this_week = property(lambda self: self._within("week", 0))
    is_last_week = property(lambda self: self._within("week", 1))
    is_this_month = property(lambda self: self._within("month", 0))
    is_last_month = property(lambda self: self._within("month", 1))
    is_this_quarter = property(lambda self: self._within("quarter", 0))
    is_last_quarter = property(lambda self: self._within("quarter", 1))
    is_this_year = property(lambda self: self._within("year", 0))
    is_last_year = property(lambda self: self._within("year", 1))

    def format_timestamp(self, fmt: str = "iso") -> Expression:
        return Formatted(self, ISO if fmt == "iso" else fmt, explicit=self.explicit)

    strftime = format_timestamp

    # Membership.

    def in_(self, other: Any, /, *, case_sensitive: bool = True) -> Expression:
        from metricframe.model import Model

        if not case_sensitive and not isinstance(other, str):
            raise ValueError("`case_sensitive=False` is for strings only")
        if isinstance(other, str):
            return Binary("contained", self, Literal(other), folded=not case_sensitive)
        if isinstance(other, Model):
            return Membership(self, other)
        if isinstance(other, Expression):
            return Binary("element", self, other)
        values = list(other)
        present = [v for v in values if v is not None]
        missing = Binary("==", self, Literal(None))
        if not values:
            return Literal(False)
        if not present:
            return missing
        listed = Binary("in", self, Literal(tuple(present)))
        return listed | missing if len(present) < len(values) else listed & Binary("!=", self, Literal(None))

    def contains(self, value: Any, *, case_sensitive: bool = True) -> Expression:
        """Strings: LIKE around the value, whose ``%`` and ``_`` stay wildcards; others: an element of this array."""
        if isinstance(value, str):
            return Binary("like" if case_sensitive else "ilike", self, Literal(f"%{value}%"))
        if not case_sensitive:
            raise ValueError("`case_sensitive=False` is for strings only")
        return Binary("element", _as_node(value), self)

    def contains_any(self, *values: Any, case_sensitive: bool = True) -> Expression:
        return _joined("or", [self.contains(v, case_sensitive=case_sensitive) for v in values])

    def contains_all(self, *values: Any, case_sensitive: bool = True) -> Expression:
        return _joined("and", [self.contains(v, case_sensitive=case_sensitive) for v in values])

    def bucket_other(self, *buckets: Any, other: Any = "Other") -> Expression:
        """The value, where it is one of the buckets (values, or models to be a member of); else ``other``."""
        from metricframe.model import Model

        values = [b for b in buckets if not isinstance(b, Model)]
        pairs = [(self.in_(values), self)] if values else []
        pairs += [(self.in_(b), self) for b in buckets if isinstance(b, Model)]
        # As yet unresolved references take their name from what they turn out to be.
        return Cases(tuple(pairs), _as_node(other), explicit=self.optional_name)

    # Operators.

    def __eq__(self, other: object) -> Expression:  # type: ignore[override]
        return Binary("==", self, _as_node(other))

    def __ne__(self, other: object) -> Expression:  # type: ignore[override]
        return Binary("!=", self, _as_node(other))

    def __lt__(self, other: object) -> Expression:
        return Binary("<", self, _as_node(other))

    def __le__(self, other: object) -> Expression:
        return Binary("<=", self, _as_node(other))

    def __gt__(self, other: object) -> Expression:
        return Binary(">", self, _as_node(other))

    def __ge__(self, other: object) -> Expression:
        return Binary(">=", self, _as_node(other))

    def __add__(self, other: object) -> Expression:
        return Binary("+", self, _as_node(other))

    def __sub__(self, other: object) -> Expression:
        return Binary("-", self, _as_node(other))

    def __mul__(self, other: object) -> Expression:
        return Binary("*", self, _as_node(other))

    def __truediv__(self, other: object) -> Expression:
        return Binary("/", self, _as_node(other))

    def __and__(self, other: object) -> Expression:
        return Call("and", (self, _as_node(other)))

    def __or__(self, other: object) -> Expression:
        return Call("or", (self, _as_node(other)))

    def __invert__(self) -> Expression:
        return Call("not", (self,))

    def __bool__(self) -> bool:
        raise TypeError("an expression has no truth value; use &, | and ~")

    def __iter__(self) -> Iterator:
        raise TypeError(f"{self!r} cannot be iterated")


def _as_node(value: Any) -> Expression:
    from metricframe.model import Model

    if isinstance(value, Expression):
        return value
    return Subquery(value) if isinstance(value, Model) else Literal(tuple(value) if isinstance(value, list) else value)


def _joined(fn: str, parts: list[Expression]) -> Expression:
    return Call(fn, tuple(parts)) if parts else Literal(fn == "and")


node = dataclass(frozen=True, eq=False)


@node
class Column(Expression):
    """A physical column by name, of the model itself or of a relation."""

    name: str
    relation: str | None = None
    explicit: str | None = None

    @property
    def default_name(self) -> str | None:
        return self.name


@node
class Star(Expression):
    """``*``: all physical columns of the model or of a relation."""

    relation: str | None = None
    explicit: str | None = None

    def named(self, name: str | Expression) -> Expression:
        raise ValueError("a star cannot be named")


@node
class Sql(Expression):
    """Raw Spark SQL; ``{{ref}}`` stands for attributes, measures and ``relation.attribute``."""

    text: str
    relation: str | None = None
    refs: tuple[tuple[str, Expression], ...] = ()
    explicit: str | None = None

    @property
    def default_name(self) -> str | None:
        m = re.fullmatch(r"\s*(?:`?\w+`?\s*\.\s*)*`?([A-Za-z_]\w*)`?\s*", self.text)
        return m[1] if m else None


@node
class Literal(Expression):
    value: Any = None
    explicit: str | None = None


@node
class Binary(Expression):
    op: str
    left: Expression
    right: Expression
    folded: bool = False
    explicit: str | None = None


@node
class Call(Expression):
    fn: str
    args: tuple[Expression, ...] = ()
    explicit: str | None = None

    @property
    def default_name(self) -> str | None:
        inner = self.args[0].default_name if self.args else None
        return f"{self.fn}_{inner}" if inner else self.fn


@node
class Cases(Expression):
    pairs: tuple[tuple[Expression, Expression], ...]
    other: Expression = field(default_factory=lambda: Literal(None))
    explicit: str | None = None

    def matches_any_case(self) -> Expression:
        return _joined("or", [condition for condition, _ in self.pairs])


@node
class Truncated(Expression):
    base: Expression
    unit: str
    explicit: str | None = None

    def __post_init__(self) -> None:
        if self.unit not in GRANULARITIES:
            raise ValueError(f"no such granularity: {self.unit}")

    @property
    def default_name(self) -> str | None:
        return self.base.default_name


@node
class Formatted(Expression):
    base: Expression
    fmt: str
    explicit: str | None = None

    @property
    def default_name(self) -> str | None:
        return self.base.default_name


@node
class Membership(Expression):
    """Null-aware membership in a model's column."""

    base: Expression
    model: Model
    explicit: str | None = None


@node
class Subquery(Expression):
    """A model's only value."""

    model: Model
    explicit: str | None = None

    @property
    def default_name(self) -> str | None:
        return next(iter(self.model.attributes), None)


@node
class Exists(Expression):
    model: Model
    explicit: str | None = None

    @property
    def default_name(self) -> str | None:
        return "exists"


# References, replaced when a model's verb is called.


@node
class AttrRef(Expression):
    key: str
    explicit: str | None = None

    @property
    def default_name(self) -> str | None:
        return self.key


@node
class MsrRef(Expression):
    key: str
    explicit: str | None = None

    @property
    def default_name(self) -> str | None:
        return self.key


@node
class RelRef(Expression):
    relation: str
    key: str
    explicit: str | None = None

    @property
    def default_name(self) -> str | None:
        return self.key


@node
class Spread(Expression):
    """``*attr``, ``*msr`` or ``*rel.name``: all expressions of that kind."""

    kind: str
    relation: str | None = None
    explicit: str | None = None


def children(e: Expression) -> Iterator[Expression]:
    for f in fields(e):  # type: ignore[arg-type]
        yield from _nested(getattr(e, f.name))


def _nested(value: Any) -> Iterator[Expression]:
    if isinstance(value, Expression):
        yield value
    elif isinstance(value, tuple):
        for x in value:
            yield from _nested(x)


def walk(e: Expression) -> Iterator[Expression]:
    yield e
    for child in children(e):
        yield from walk(child)


def rewrite(e: Expression, change: Callable[[Expression], Expression]) -> Expression:
    """``e`` with ``change`` applied to every node, leaves first."""

    def of(value: Any) -> Any:
        if isinstance(value, Expression):
            return rewrite(value, change)
        if isinstance(value, tuple):
            new = tuple(of(x) for x in value)
            return new if any(a is not b for a, b in zip(new, value, strict=True)) else value
        return value

    new = {}
    for f in fields(e):  # type: ignore[arg-type]
        was = getattr(e, f.name)
        now = of(was)
        if now is not was:
            new[f.name] = now
    return change(replace(e, **new) if new else e)


def relations_in(e: Expression, known: Iterable[str]) -> dict[str, set[str] | None]:
    """The relations that an expression is about, each with the columns it names, or ``None`` for all."""
    known = set(known)
    found: dict[str, set[str] | None] = {}

    def note(relation: str, column: str | None) -> None:
        if column is None or found.get(relation, set()) is None:
            found[relation] = None
        else:
            found.setdefault(relation, set()).add(column)  # type: ignore[union-attr]

    for x in walk(e):
        if isinstance(x, Column) and x.relation:
            note(x.relation, x.name)
        elif isinstance(x, Star) and x.relation:
            note(x.relation, None)
        elif isinstance(x, Sql):
            if x.relation:
                note(x.relation, None)
            for m in re.finditer(r"`?(\w+)`?\s*\.", x.text):
                if m[1] in known:
                    note(m[1], None)
    return found


def literal_kind(value: Any) -> str:
    """What kind of constant a Python value is, for folding dates on the driver."""
    if isinstance(value, dt.datetime | dt.date):
        return "time"
    return "interval" if isinstance(value, dt.timedelta | timeinterval) else "plain"
