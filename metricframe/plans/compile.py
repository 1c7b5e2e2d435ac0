"""Expressions to Spark SQL text."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from decimal import Decimal
from typing import TYPE_CHECKING, Any

from metricframe.expressions import (
    AttrRef,
    Binary,
    Call,
    Cases,
    Column,
    Exists,
    Expression,
    Formatted,
    Literal,
    Membership,
    MsrRef,
    RelRef,
    Spread,
    Sql,
    Star,
    Subquery,
    Truncated,
    literal_kind,
    rewrite,
)
from metricframe.functions.intervals import shift, timeinterval, truncate
from metricframe.functions.timeformat import format_sql, quoted

if TYPE_CHECKING:
    from metricframe.model import Model

_COMPARE = {"==": "=", "!=": "<>", "<": "<", "<=": "<=", ">": ">", ">=": ">="}
_PLAIN = {"sum": "sum", "avg": "avg", "min": "min", "max": "max"}
#: Types that ``cast`` knows, as on the wire.
_TYPES = {
    "string": "STRING", "text": "STRING", "int": "INT", "integer": "INT", "bigint": "BIGINT", "float": "DOUBLE", "double": "DOUBLE",
    "decimal": "DECIMAL(38, 9)", "bool": "BOOLEAN", "boolean": "BOOLEAN", "date": "DATE", "datetime": "TIMESTAMP_NTZ", "timestamp": "TIMESTAMP_NTZ",
}


@dataclass
class Context:
    """What one query shares: its time, its week and how a model becomes a view."""

    view: Callable[[Model], tuple[str, list[str]]]
    now: dt.datetime = field(default_factory=dt.datetime.now)
    first_weekday: int = 6
    warnings: list[str] = field(default_factory=list)
    #: The names of the query's relations, which raw SQL may use.
    relations: set[str] = field(default_factory=set)


def physical(relation: str) -> str:
    """The column that holds a relation's struct; no column of a model has such a name."""
    return f"__rel_{relation}"


def _qualified(text: str, relations: set[str]) -> str:
    """Raw SQL with the relations' names before a dot replaced by their columns' names, strings left alone."""

    def change(m: re.Match) -> str:
        return f"{name_sql(physical(m[2]))}." if m[2] in relations else m[0]

    return re.sub(r"""('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?<![\w.`])`?(\w+)`?\s*\.(?!\d)""", lambda m: m[0] if m[1] else change(m), text)


def name_sql(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def literal_sql(value: Any) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, str):
        return quoted(value)
    if isinstance(value, dt.datetime):
        kind = "TIMESTAMP_NTZ" if value.tzinfo is None else "TIMESTAMP"
        return f"{kind}'{value.isoformat(sep=' ')}'"
    if isinstance(value, dt.date):
        return f"DATE'{value.isoformat()}'"
    if isinstance(value, dt.timedelta):
        return f"INTERVAL '{int(value.days * 86400 + value.seconds)}' SECOND"
    if isinstance(value, timeinterval):
        return f"INTERVAL '{value.num}' {value.unit[:-1].upper()}"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        return f"CAST({value!r} AS DOUBLE)" if value != value or value in (float("inf"), float("-inf")) else f"{value!r}D"
    if isinstance(value, Decimal):
        return f"{value}BD"
    if isinstance(value, bytes):
        return f"X'{value.hex()}'"
    if isinstance(value, list | tuple):
        return f"array({', '.join(map(literal_sql, value))})"
    raise TypeError(f"a {type(value).__name__} cannot stand in a query")


def fold(e: Expression, context: Context) -> Expression:
    """Constant times, truncations and shifts computed on the driver, so that scans get plain literals."""

    def change(x: Expression) -> Expression:
        if isinstance(x, Call) and x.fn == "now":
            return Literal(context.now, x.explicit)
        if isinstance(x, Truncated) and isinstance(x.base, Literal) and literal_kind(x.base.value) == "time":
            return Literal(truncate(x.base.value, x.unit, context.first_weekday), x.explicit)
        if isinstance(x, Binary) and x.op in "+-" and isinstance(x.left, Literal) and isinstance(x.right, Literal):
            if literal_kind(x.left.value) == "time" and literal_kind(x.right.value) == "interval":
                return Literal(shift(x.left.value, x.right.value, 1 if x.op == "+" else -1), x.explicit)
        return x

    return rewrite(e, change)


def to_sql(e: Expression, context: Context) -> str:
    return _sql(fold(e, context), context)


def _sql(e: Expression, context: Context) -> str:
    of = lambda x: _sql(x, context)
    match e:
        case Column():
            return f"{name_sql(physical(e.relation) if e.relation else 'self')}.{name_sql(e.name)}"
        case Star():
            return f"{name_sql(physical(e.relation) if e.relation else 'self')}.*"
        case Literal():
            return literal_sql(e.value)
        case Sql():
            refs = dict(e.refs)
            pieces = re.split(r"\{\{\s*(.*?)\s*\}\}", e.text)
            text = "".join(f"({of(refs[x])})" if i % 2 else _qualified(x, context.relations) for i, x in enumerate(pieces))
            return text if re.fullmatch(r"\s*[\w`.]+\s*", text) else f"({text})"
        case Binary():
            return _binary(e, of, context)
        case Call():
            return _call(e, of, context)
        case Cases():
            pairs = " ".join(f"WHEN {of(c)} THEN {of(v)}" for c, v in e.pairs)
            return f"CASE {pairs} ELSE {of(e.other)} END"
        case Truncated():
            base = of(e.base)
            if e.unit == "week":
                back = (context.first_weekday - 7) % 7
                # date_trunc's weeks begin on Monday.
                moved = f"date_trunc('WEEK', {base} - INTERVAL '{back}' DAY) + INTERVAL '{back}' DAY"
                return f"CAST({moved} AS TIMESTAMP_NTZ)"
            return f"CAST(date_trunc('{e.unit.upper()}', {base}) AS TIMESTAMP_NTZ)"
        case Formatted():
            return format_sql(e.fmt, of(e.base))
        case Membership():
            view, names = context.view(e.model)
            wanted = e.base.optional_name
            column = name_sql(_member(e.model, wanted, names))
            base = of(e.base)
            return (
                f"({base} IN (SELECT {column} FROM {view}) OR "
                f"({base} IS NULL AND EXISTS (SELECT 1 FROM {view} WHERE {column} IS NULL)))"
            )
        case Subquery():
            view, names = context.view(e.model)
            return f"(SELECT {name_sql(names[0])} FROM {view})"
        case Exists():
            view, _ = context.view(e.model)
            return f"EXISTS (SELECT 1 FROM {view})"
        case AttrRef() | MsrRef() | RelRef() | Spread():
            raise ValueError(f"{e!r} was not resolved against a model")
    raise TypeError(f"no SQL for {type(e).__name__}")


def _member(model: Model, wanted: str | None, names: list[str]) -> str:
    if wanted in names:
        return wanted  # type: ignore[return-value]
    if len(names) == 1:
        return names[0]
    raise ValueError(f"the model has no column `{wanted}` to look for membership in")


def _null(e: Expression) -> bool:
    return isinstance(e, Literal) and e.value is None


def _binary(e: Binary, of: Callable[[Expression], str], context: Context) -> str:
    left, right = e.left, e.right
    if e.op in ("==", "!=") and (_null(left) or _null(right)):
        if _null(left) and _null(right):
            context.warnings.append("two nulls are compared; the result is constant")
            return "TRUE" if e.op == "==" else "FALSE"
        value = right if _null(left) else left
        return f"({of(value)} IS {'NOT ' if e.op == '!=' else ''}NULL)"
    a, b = of(left), of(right)
    if e.op in _COMPARE:
        return f"({a} {_COMPARE[e.op]} {b})"
    if e.op in ("/", "//"):
        # True division; by zero it gives null.
        return f"try_divide(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))"
    if e.op in ("+", "-", "*"):
        return f"({a} {e.op} {b})"
    if e.op == "in":
        values = right.value if isinstance(right, Literal) else ()
        return f"({a} IN ({', '.join(map(literal_sql, values))}))"
    if e.op in ("like", "ilike"):
        return f"({a} {e.op.upper()} {_pattern(b, right)})"
    if e.op == "contained":
        return f"contains({f'lower({b})' if e.folded else b}, {f'lower({a})' if e.folded else a})"
    if e.op == "element":
        return f"array_contains({b}, {a})"
    raise ValueError(f"no such operator: {e.op}")


def _pattern(sql: str, e: Expression) -> str:
    # Spark's LIKE escapes with a backslash, which the pattern doesn't mean to.
    return quoted(e.value.replace("\\", "\\\\")) if isinstance(e, Literal) and isinstance(e.value, str) else sql


def _call(e: Call, of: Callable[[Expression], str], context: Context) -> str:
    args = [of(a) for a in e.args]
    if e.fn in ("and", "or"):
        return "(" + f" {e.fn.upper()} ".join(args) + ")" if args else literal_sql(e.fn == "and")
    match e.fn:
        case "not":
            if isinstance(e.args[0], Membership):
                return _absence(e.args[0], of, context)
            return f"(NOT {args[0]})"
        case "count":
            return f"count({args[0] if args else '*'})"
        case "distinct":
            return f"DISTINCT {args[0]}"
        case "floor" | "ceiling":
            return f"CAST({'floor' if e.fn == 'floor' else 'ceil'}({args[0]}) AS DOUBLE)"
        case "diff_seconds":
            return f"(timestampdiff(MICROSECOND, {args[1]}, {args[0]}) / 1000000D)"
        case "cast":
            kind = _TYPES.get(str(e.args[1].value).lower()) if isinstance(e.args[1], Literal) else None
            if kind is None:
                context.warnings.append(f"cast to an unknown type: {args[1]}")
                return args[0]
            return f"CAST({args[0]} AS {kind})"
    if e.fn in _PLAIN:
        return f"{_PLAIN[e.fn]}({', '.join(args)})"
    raise ValueError(f"no such function: {e.fn}")


def _absence(e: Membership, of: Callable[[Expression], str], context: Context) -> str:
    """The negated membership, as a plain anti join; with nulls it is as unknown as NOT IN is."""
    view, names = context.view(e.model)
    column, base = name_sql(_member(e.model, e.base.optional_name, names)), of(e.base)
    held = f"EXISTS (SELECT 1 FROM (SELECT {column} AS __member FROM {view}) WHERE __member = {base})"
    some, a_null = f"EXISTS (SELECT 1 FROM {view})", f"EXISTS (SELECT 1 FROM {view} WHERE {column} IS NULL)"
    return (
        f"(NOT {held} AND CASE WHEN {base} IS NULL THEN CASE WHEN {a_null} THEN FALSE WHEN {some} THEN NULL ELSE TRUE END "
        f"WHEN {a_null} THEN NULL ELSE TRUE END)"
    )


def plain(e: Expression) -> Expression:
    """``e`` without its explicit name."""
    return replace(e, explicit=None)
