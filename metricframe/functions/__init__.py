"""``func``: aggregates, scalar functions and logic over expressions."""

from __future__ import annotations

from typing import TYPE_CHECKING, Any

from metricframe.functions.intervals import timeinterval

if TYPE_CHECKING:
    from metricframe.expressions import Expression
    from metricframe.model import Model

__all__ = [
    "and_", "avg", "cases", "ceiling", "count", "count_if", "diff_seconds", "distinct", "exists",
    "floor", "max", "min", "not_", "now", "or_", "sum", "timeinterval",
]


def _call(fn: str, *args: Any) -> Expression:
    from metricframe.expressions import Call, _as_node

    return Call(fn, tuple(_as_node(a) for a in args))


def count(target: Any = None) -> Expression:
    """All records, or those with a value; ``count(distinct(x))`` counts different values."""
    return _call("count") if target is None else _call("count", target)


def count_if(condition: Any) -> Expression:
    """The sum of ones where the condition holds: null, not 0, where there is no record at all."""
    return _call("sum", cases((condition, 1), other=0))


def distinct(target: Any) -> Expression:
    return _call("distinct", target)


def sum(target: Any) -> Expression:  # noqa: A001
    return _call("sum", target)


def avg(target: Any) -> Expression:
    return _call("avg", target)


def min(target: Any) -> Expression:  # noqa: A001
    return _call("min", target)


def max(target: Any) -> Expression:  # noqa: A001
    return _call("max", target)


def floor(target: Any) -> Expression:
    return _call("floor", target)


def ceiling(target: Any) -> Expression:
    return _call("ceiling", target)


def now() -> Expression:
    """The time at which the query is run, one value a query."""
    return _call("now")


def diff_seconds(ts1: Any, ts2: Any) -> Expression:
    """Seconds from ``ts2`` to ``ts1``, with fractions."""
    return _call("diff_seconds", ts1, ts2)


def and_(*clauses: Any) -> Expression:
    return _call("and", *clauses)


def or_(*clauses: Any) -> Expression:
    return _call("or", *clauses)


def not_(clause: Any) -> Expression:
    return _call("not", clause)


def exists(target: Model) -> Expression:
    from metricframe.expressions import Exists

    return Exists(target)


def cases(*pairs: tuple[Any, Any], other: Any = None) -> Expression:
    """The value of the first condition that holds, else ``other``."""
    from metricframe.expressions import Cases, _as_node

    if not pairs:
        raise ValueError("`cases` needs at least one case")
    return Cases(tuple((_as_node(c), _as_node(v)) for c, v in pairs), _as_node(other))
