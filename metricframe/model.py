"""``Model``: an immutable table with attributes, measures, relations and verbs that lower to one DataFrame."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace
from typing import TYPE_CHECKING, Any

from metricframe import functions as func
from metricframe.expressions import (
    AttrRef,
    Column,
    Expression,
    Literal,
    MsrRef,
    RelRef,
    Spread,
    Sql,
    Star,
    rewrite,
    walk,
)
from metricframe.keys import RelationKey
from metricframe.plans import nodes as n

if TYPE_CHECKING:
    from pyspark.sql import DataFrame

    from metricframe.results import RunResults
    from metricframe.sources import Connection

ENTITIES = "entities"
SORT_DIRECTIONS, NULL_PLACES = ("asc", "desc"), ("first", "auto", "last")
#: References in raw SQL may stand for others, but not without end.
MOST_REFERENCES = 10_000


@dataclass(frozen=True)
class ActivitySchema:
    """What makes a model's records events: whose, when and which."""

    group: Expression | None
    timestamp: Expression | None
    event_key: Expression | None


@dataclass(frozen=True)
class Relation:
    """A joined model under a name; iterating gives its attributes."""

    identifier: str
    model: Model
    foreign_key: Expression | None = None

    def attribute(self, name: str) -> Expression:
        from metricframe.plans.lower import derived

        if name not in self.model.attributes:
            known = ", ".join(self.model.attributes) or "none"
            raise AttributeError(f"the relation `{self.identifier}` has no attribute `{name}`; it has: {known}")
        found = self.model.attributes[name]
        if all(not isinstance(x, Sql) and getattr(x, "relation", None) is None for x in walk(found)):
            scoped = found.disambiguated(self.identifier)
            return scoped if scoped.optional_name else replace(scoped, explicit=name)
        return Column(derived(name), self.identifier, explicit=name)

    def __getitem__(self, name: str) -> Expression:
        return self.attribute(name)

    def __iter__(self) -> Iterator[Expression]:
        return (self.attribute(a) for a in self.model.attributes)

    def get_custom_meta(self, name: str) -> Any:
        return self.model.get_custom_meta(name)

    def __repr__(self) -> str:
        return f"Relation `{self.identifier}`:\n  Attributes: {', '.join(self.model.attributes)}"


@dataclass(frozen=True, eq=False, repr=False)
class Model:
    """``Model(connection, "table")`` or ``Model(connection, sql_query=...)``; every verb gives a new model."""

    connection: Connection | None = None
    table: str | None = None
    schema: str | None = None
    sql_query: str | None = None
    source: n.Plan | None = None
    attributes: dict[str, Expression] = field(default_factory=dict)
    measures: dict[str, Expression] = field(default_factory=dict)
    relations: dict[str, Relation] = field(default_factory=dict)
    primary_key: Expression = field(default_factory=lambda: Column("id"))
    activity: ActivitySchema | None = None
    meta: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.source is None and (self.table or self.sql_query):
            made = self.with_source(self.table, schema=self.schema, sql_query=self.sql_query)
            object.__setattr__(self, "source", made.source)
        for name in ("table", "schema", "sql_query"):
            object.__setattr__(self, name, None)

    # Building.

    def with_connection(self, connection: Connection) -> Model:
        return replace(self, connection=connection)

    def with_source(self, table: str | None = None, *, schema: str | None = None, sql_query: str | None = None) -> Model:
        if (table is None) == (sql_query is None):
            raise ValueError("a source is either a table or a `sql_query`")
        if table is not None:
            return replace(self, source=n.Table(table, schema))
        query = sql_query.strip()
        while (stripped := re.sub(r"(;|--[^\n]*)\s*\Z", "", query).rstrip()) != query:
            query = stripped
        return replace(self, source=n.Text(query))

    def with_attributes(self, *expressions: Expression | str, **named: Expression | str) -> Model:
        model = self
        for e in [*expressions, *[self._expression(e).named(k) for k, e in named.items()]]:
            for resolved in model._resolved([self._expression(e)]):
                model = replace(model, attributes=model.attributes | {resolved.identifier: resolved})
        return model

    def with_measures(self, *expressions: Expression, **named: Expression) -> Model:
        model = self
        for e in [*expressions, *[self._expression(e).named(k) for k, e in named.items()]]:
            for resolved in model._resolved([e]):
                model = replace(model, measures=model.measures | {resolved.identifier: resolved})
        return model

    def with_primary_key(self, expression: Expression) -> Model:
        return replace(self, primary_key=self._one(expression))

    def get_custom_meta(self, name: str) -> Any:
        return self.meta.get(name)

    def with_custom_meta(self, name: str, value: object) -> Model:
        return replace(self, meta=self.meta | {name: value})

    def with_activity_schema(self, *, group: Expression, timestamp: Expression, event_key: Expression) -> Model:
        return replace(self, activity=ActivitySchema(self._one(group), self._one(timestamp), self._one(event_key)))

    def with_join_one(
        self,
        joined: Model,
        *,
        foreign_key: Expression | None = None,
        condition: Expression | None = None,
        named: str | Expression | RelationKey | None = None,
        drop_unmatched: bool = False,
    ) -> Model:
        """A relation to at most one record of ``joined``; it costs nothing until something refers to it.

        Unmatched records have nulls, or go with ``drop_unmatched``, which makes the join even unreferenced.
        """
        if foreign_key is None and condition is None:
            raise ValueError("`with_join_one` needs a `foreign_key` and/or a `condition`")
        name = named.identifier if isinstance(named, RelationKey) else named.key if isinstance(named, AttrRef) else named
        name = name or (joined.source.default_name() if joined.source is not None else None)
        if not name:
            raise ValueError("the relation has no default name; give one with `named=`")
        parts = []
        if foreign_key is not None:
            foreign_key = self._one(foreign_key)
            parts.append(foreign_key == joined.primary_key.disambiguated(name))
        relation = Relation(name, joined, foreign_key if condition is None else None)
        model = replace(self, relations={**{k: v for k, v in self.relations.items() if k != name}, name: relation})
        if condition is not None:
            parts.append(model._one(condition))
        on = parts[0] if len(parts) == 1 else func.and_(*parts)
        return replace(model, source=n.JoinOne(self.source, name, joined, on, drop_unmatched))

    # Verbs.

    def pick(self, *columns: Expression) -> Model:
        resolved = self._resolved(columns)
        return self._with_outputs(n.Pick(self.source, tuple(resolved)), resolved)

    def filter(self, condition: Expression) -> Model:
        return replace(self, source=n.Filter(self.source, self._one(condition)))

    def sort(self, sort: Expression, dir: str = "asc", nulls: str = "auto") -> Model:  # noqa: A002
        for given, known in ((dir, SORT_DIRECTIONS), (nulls, NULL_PLACES)):
            if given not in known:
                raise ValueError(f"`{given}` is none of {', '.join(known)}")
        return replace(self, source=n.Sort(self.source, self._one(sort), dir == "desc", nulls))

    def limit(self, count: int, *, offset: int | None = 0) -> Model:
        return replace(self, source=n.Limit(self.source, count, offset or 0))

    def aggregate(self, *, groups: Iterable[Expression] = (), measures: Iterable[Expression] = ()) -> Model:
        keys, values = self._resolved(groups), self._resolved(measures)
        return self._with_outputs(n.Aggregate(self.source, tuple(keys), tuple(values)), [*keys, *values])

    def union_all(self, other: Model) -> Model:
        return replace(self, source=n.Union(self.source, other), relations={})

    def fold(self, ids: Iterable[Expression], values: Iterable[Expression], key_name: str = "key", value_name: str = "value") -> Model:
        """One record for each record and value expression: its name as key, and the value."""
        keys, melted = self._resolved(ids), self._resolved(values)
        outputs = [*keys, Column(key_name), Column(value_name)]
        return self._with_outputs(n.Fold(self.source, tuple(keys), tuple(melted), key_name, value_name), outputs)

    def match_steps(
        self,
        steps: Iterable[str | Expression | tuple[str, str]],
        *,
        group: Expression | None = None,
        timestamp: Expression | None = None,
        event_key: Expression | None = None,
        partition_start_events: Iterable[Expression] | None = None,
        time_limit: dt.timedelta | None = None,
    ) -> Model:
        """One record a group with the events that match the steps in order as relations of the steps' names."""
        from metricframe.operators.funnels import match_steps

        return match_steps(self, list(steps), group, timestamp, event_key, list(partition_start_events or ()), time_limit)

    def funnel(
        self,
        steps: Iterable[str | Expression | tuple[str, str]],
        *,
        group: Expression | None = None,
        timestamp: Expression | None = None,
        event_key: Expression | None = None,
        time_limit: dt.timedelta | None = None,
        partition_start_events: Iterable[Expression] | None = None,
        partition_matches: Iterable[Expression] | None = None,
        top_of_funnel: int | str = 0,
    ) -> Model:
        """Counts of the groups that reach each step, in order of partitions and steps."""
        from metricframe.operators.funnels import funnel

        return funnel(
            self, list(steps), group, timestamp, event_key, time_limit, list(partition_start_events or ()), list(partition_matches or ()), top_of_funnel
        )

    def funnel_conversion_rate(
        self,
        steps: Iterable[str | Expression | tuple[str, str]],
        *,
        group: Expression | None = None,
        timestamp: Expression | None = None,
        event_key: Expression | None = None,
        time_limit: dt.timedelta | None = None,
        partition_start_events: Iterable[Expression] | None = None,
        partition_matches: Iterable[Expression] | None = None,
    ) -> Model:
        """Of the groups that start, the share that reach the last step, and the mean time that takes."""
        from metricframe.operators.funnels import conversion_rate

        return conversion_rate(
            self, list(steps), group, timestamp, event_key, time_limit, list(partition_start_events or ()), list(partition_matches or ())
        )

    # Running.

    def spark_df(self) -> DataFrame:
        """The lazy DataFrame of the model."""
        from metricframe.plans.lower import lower_model

        return lower_model(self)[0]

    def run(self, *, print_exec_stats: bool = False, print_warnings: bool = True, freshness: Any = None) -> RunResults:
        """Run the model.  ``freshness`` is accepted for its callers' sake: nothing here is cached."""
        from metricframe.results import run

        return run(self, print_warnings=print_warnings, print_exec_stats=print_exec_stats)

    def df(self, **options: Any) -> Any:
        """The result as a pandas frame."""
        return self.run(**options).df

    def sql(self, **options: Any) -> str:
        """The optimised logical plan that would be run; nothing is."""
        from metricframe.results import plan_text

        return plan_text(self)

    # Inner workings.

    def _with_outputs(self, source: n.Plan, outputs: list[Expression]) -> Model:
        names = [e.identifier for e in outputs if not isinstance(e, Star) and not (isinstance(e, Sql) and e.text.strip() == "*")]
        return replace(self, source=source, attributes={x: Column(x) for x in names}, measures={}, relations={})

    def _expression(self, e: Expression | str) -> Expression:
        return Column(e) if isinstance(e, str) else e

    def _one(self, e: Expression) -> Expression:
        return self._resolved([e])[0]

    def _resolved(self, expressions: Iterable[Expression]) -> list[Expression]:
        """The expressions with every reference replaced by what it stands for now."""
        flat: list[Expression] = []
        for e in expressions:
            if isinstance(e, RelationKey):
                flat += list(e)
            else:
                flat.append(e if isinstance(e, Expression) else Literal(e))
        out: list[Expression] = []
        for e in flat:
            if isinstance(e, Spread):
                out += self._spread(e)
            else:
                out.append(rewrite(e, self._replaced))
        return out

    def _spread(self, e: Spread) -> list[Expression]:
        if e.kind == "rel":
            return list(self._relation(e.relation))
        return list((self.attributes if e.kind == "attr" else self.measures).values())

    def _replaced(self, e: Expression) -> Expression:
        if isinstance(e, AttrRef | MsrRef):
            found = self._named("attributes" if isinstance(e, AttrRef) else "measures", e.key)
        elif isinstance(e, RelRef):
            found = self._relation(e.relation, e.key).attribute(e.key)
        elif isinstance(e, Sql) and "{{" in e.text and not e.refs:
            return replace(e, refs=self._references(e.text))
        else:
            return e
        return replace(found, explicit=e.explicit) if e.explicit else found

    def _references(self, text: str) -> tuple[tuple[str, Expression], ...]:
        """What the ``{{...}}`` of raw SQL stand for; attributes go before measures."""
        left, found = MOST_REFERENCES, {}
        for token in re.findall(r"\{\{\s*(.*?)\s*\}\}", text):
            left -= 1
            if left < 0:
                raise ValueError("too many references in raw SQL")
            relation, _, key = token.rpartition(".")
            if relation:
                found[token] = self._relation(relation, key).attribute(key)
            elif token in self.attributes or token not in self.measures:
                found[token] = self._named("attributes", token, ref=True)
            else:
                found[token] = self.measures[token]
        return tuple(found.items())

    def _named(self, kind: str, key: str, ref: bool = False) -> Expression:
        found = getattr(self, kind).get(key)
        if found is None:
            raise AttributeError(self._not_found(kind[:-1], key, ref))
        return found

    def _relation(self, name: str | None, key: str | None = None) -> Relation:
        if name not in self.relations:
            text = self._not_found("relation", str(name), False)
            if key in self.attributes:
                text += f"\nThe attribute `{key}` was found; a verb may have moved it out of the relation. Did you mean `attr.{key}`?"
            raise AttributeError(text)
        return self.relations[name]

    def _not_found(self, kind: str, key: str, ref: bool) -> str:
        lines = [f"No {kind} named `{key}` was found in the model."]
        for other, short, things in (
            ("attribute", "attr", self.attributes),
            ("measure", "msr", self.measures),
            ("relation", "rel", self.relations),
        ):
            if other != kind and key in things:
                meant = f"{{{{{key}}}}}" if ref and short != "rel" else f"{short}.{key}"
                lines.append(f"There is such a {other}. Did you mean `{meant}`?")
        if len(lines) == 1:
            have = {"attribute": self.attributes, "measure": self.measures, "relation": self.relations}[kind]
            lines.append(f"Available {kind}s: {', '.join(have)}" if have else f"No {kind}s are defined for this model.")
        return "\n".join(lines)

    def __repr__(self) -> str:
        parts = [f"Model of {self.source.default_name() or type(self.source).__name__}" if self.source else "Model without a source"]
        for title, things in (("Attributes", self.attributes), ("Measures", self.measures), ("Relations", self.relations)):
            if things:
                parts.append(f"  {title}: {', '.join(things)}")
        return "\n".join(parts)

    # Wire format.

    def to_wire(self) -> dict:
        from metricframe.plans.wire import model_to_wire

        return model_to_wire(self)

    @staticmethod
    def from_wire(wire: dict, connection: Connection | None = None) -> Model:
        from metricframe.plans.wire import model_from_wire

        return model_from_wire(wire, connection)

    def stable_hash(self) -> str:
        from metricframe.plans.wire import stable_hash

        return stable_hash(self)


def column(name: str | None = None, *, sql: str | None = None, value: Any = None) -> Expression:
    """``column("name")``, ``column(sql="raw SQL")`` or ``column(value=constant)``."""
    if name is not None:
        if name == "*":
            raise ValueError('`column("*")` is ambiguous: use `*attr`, `*rel.name`, or `column(sql="*")` for the physical columns')
        return Column(name)
    return Sql(sql) if sql is not None else Literal(value)
