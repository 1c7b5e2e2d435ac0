"""Plans to DataFrames.

A relation is one struct column named after it beside the model's own columns, so
``relation.column`` resolves natively in expressions and raw SQL, and Catalyst
still prunes and pushes through the struct.  Which relations, and which of their
columns, are needed is known before a join is made: a left join that nothing
refers to is not made at all.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass, replace
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricframe.expressions import Call, Column, Expression, Sql, Star, is_private, relations_in, walk
from metricframe.operators.match_steps import match_steps
from metricframe.plans import nodes as n
from metricframe.plans.compile import Context, name_sql, physical, plain, to_sql

if TYPE_CHECKING:
    from metricframe.model import Model

#: Relations that are needed, each with the columns, or None for all.
Need = dict[str, set[str] | None]


@dataclass(frozen=True)
class Frame:
    """A DataFrame whose own columns come apart from its relations' structs; sort keys wait for a barrier."""

    df: DataFrame
    columns: tuple[str, ...]
    relations: frozenset[str] = frozenset()
    sorts: tuple[n.Sort, ...] = ()


def derived(attribute: str) -> str:
    """The column of a relation that holds an attribute which its plain columns cannot express."""
    return f"__attr_{attribute}"


def merged(*needs: Need) -> Need:
    out: Need = {}
    for need in needs:
        for relation, columns in need.items():
            was = out.get(relation, set())
            out[relation] = None if was is None or columns is None else was | columns
    return out


class Lowering:
    """One query's lowering; equal subplans of a query share their DataFrame."""

    def __init__(self, spark: SparkSession, context: Context) -> None:
        self.spark, self.context = spark, context
        self.memo: dict[tuple, Frame] = {}

    def column(self, e: Expression, alias: str | None = None) -> F.Column:
        made = F.expr(to_sql(plain(e), self.context))
        return made.alias(alias) if alias else made

    def needs(self, expressions: Iterable[Expression], plan: n.Plan) -> Need:
        known = relations_of(plan)
        self.context.relations |= known
        return merged(*[relations_in(e, known) for e in expressions])

    def lower(self, plan: n.Plan, need: Need) -> Frame:
        key = (id(plan), tuple(sorted((r, None if c is None else tuple(sorted(c))) for r, c in need.items())))
        if key not in self.memo:
            made = getattr(self, "_" + type(plan).__name__.lower())(plan, need)
            self.memo[key] = replace(made, df=made.df.alias("self"))
        return self.memo[key]

    def settle(self, frame: Frame) -> Frame:
        """The frame with its waiting sort keys applied, the first one as the primary key."""
        if not frame.sorts:
            return frame
        keys = []
        for sort in frame.sorts:
            column = self.column(sort.key)
            first = sort.nulls == "first" or (sort.nulls == "auto" and not sort.descending)
            if sort.descending:
                keys.append(column.desc_nulls_first() if first else column.desc_nulls_last())
            else:
                keys.append(column.asc_nulls_first() if first else column.asc_nulls_last())
        return replace(frame, df=frame.df.orderBy(*keys).alias("self"), sorts=())

    def model(self, model: Model, need: Need | None = None) -> Frame:
        return self.settle(self.lower(model.source, need or {}))

    def result(self, model: Model) -> DataFrame:
        """The model's own columns, private ones left out."""
        frame = self.model(model)
        return frame.df.select(*[F.col(name_sql(c)) for c in frame.columns if not is_private(c)])

    # Leaves.

    def _table(self, plan: n.Table, need: Need) -> Frame:
        df = self.context_tables(plan)
        return Frame(df, tuple(df.columns))

    def context_tables(self, plan: n.Table) -> DataFrame:
        return self.connection.table(plan.name, plan.schema)

    def _text(self, plan: n.Text, need: Need) -> Frame:
        self.connection.publish()
        df = self.spark.sql(plan.query)
        return Frame(df, tuple(df.columns))

    # Verbs.

    def _filter(self, plan: n.Filter, need: Need) -> Frame:
        frame = self.lower(plan.base, merged(need, self.needs([plan.condition], plan.base)))
        return replace(frame, df=frame.df.filter(self.column(plan.condition)))

    def _sort(self, plan: n.Sort, need: Need) -> Frame:
        frame = self.lower(plan.base, merged(need, self.needs([plan.key], plan.base)))
        return replace(frame, sorts=(*frame.sorts, plan))

    def _limit(self, plan: n.Limit, need: Need) -> Frame:
        frame = self.settle(self.lower(plan.base, need))
        df = frame.df.offset(plan.offset) if plan.offset else frame.df
        return replace(frame, df=df.limit(plan.count))

    def outputs(self, expressions: Iterable[Expression], frame: Frame) -> list[tuple[str, Expression]]:
        """Output names, made unique, and expressions; a star gives every column."""
        flat: list[tuple[str, Expression]] = []
        for e in expressions:
            if isinstance(e, Sql) and e.text.strip() == "*" and e.explicit is None:
                e = Star(e.relation)
            if isinstance(e, Star):
                if e.relation:
                    struct = frame.df.schema[physical(e.relation)].dataType
                    flat += [(c, Column(c, e.relation)) for c in struct.names if not c.startswith("__attr_")]
                else:
                    flat += [(c, Column(c)) for c in frame.columns]
            else:
                flat.append((e.identifier, e))
        used: dict[str, int] = {}
        unique = []
        for name, e in flat:
            used[name] = used.get(name, 0) + 1
            if used[name] > 1:
                self.context.warnings.append(f"the name `{name}` is used twice; the later one becomes `{name}_{used[name]}`")
                name = f"{name}_{used[name]}"
            unique.append((name, e))
        return unique

    def _pick(self, plan: n.Pick, need: Need) -> Frame:
        frame = self.settle(self.lower(plan.base, self.needs(plan.columns, plan.base)))
        made = self.outputs(plan.columns, frame)
        distinct = any(isinstance(e, Call) and e.fn == "distinct" for _, e in made)
        bare = [(name, e.args[0] if isinstance(e, Call) and e.fn == "distinct" else e) for name, e in made]
        df = frame.df.select(*[self.column(e, name) for name, e in bare])
        return Frame(df.distinct() if distinct else df, tuple(name for name, _ in made))

    def _aggregate(self, plan: n.Aggregate, need: Need) -> Frame:
        frame = self.settle(self.lower(plan.base, self.needs([*plan.groups, *plan.measures], plan.base)))
        made = self.outputs([*plan.groups, *plan.measures], frame)
        columns = [self.column(e, name) for name, e in made]
        keys, values = columns[: len(made) - len(plan.measures)], columns[len(made) - len(plan.measures) :]
        if not values:
            df = frame.df.select(*keys).distinct()
        elif keys:
            # Keys are made first, so that a measure cannot be mistaken for one of them.
            df = frame.df.groupBy(*keys).agg(*values)
        else:
            df = frame.df.agg(*values)
        return Frame(df, tuple(name for name, _ in made))

    def _joinone(self, plan: n.JoinOne, need: Need) -> Frame:
        wanted = plan.relation in need
        if not wanted and not plan.drop_unmatched:
            return self.lower(plan.base, need)
        own = merged({k: v for k, v in need.items() if k != plan.relation}, {})
        condition = relations_in(plan.condition, relations_of(plan))
        columns = merged({plan.relation: need.get(plan.relation, set())}, {plan.relation: condition.pop(plan.relation, set())})[plan.relation]
        base = self.settle(self.lower(plan.base, merged(own, condition)))
        right = self.struct_of(plan.model, plan.relation, columns)
        self.context.relations.add(plan.relation)
        # A relation that is joined again under its name replaces the former one.
        left = base.df.drop(physical(plan.relation)).alias("self")
        df = left.join(right, self.column(plan.condition), "inner" if plan.drop_unmatched else "left")
        return Frame(df, base.columns, base.relations | {plan.relation})

    def struct_of(self, model: Model, relation: str, columns: set[str] | None) -> DataFrame:
        """The model as one struct column, with the derived attributes that are asked for."""
        asked = sorted(a for a in model.attributes if columns is None or derived(a) in columns)
        expressions = {a: model.attributes[a] for a in asked}
        frame = self.settle(self.lower(model.source, self.needs(expressions.values(), model.source)))
        extra = [
            self.column(e, derived(a)) for a, e in expressions.items() if not any(isinstance(x, Call) and x.fn == "distinct" for x in walk(e))
        ]
        fields = [F.col(f"self.{name_sql(c)}") for c in frame.columns]
        return frame.df.select(F.struct(*fields, *extra).alias(physical(relation)))

    def _union(self, plan: n.Union, need: Need) -> Frame:
        left = self.settle(self.lower(plan.base, {}))
        right = self.model(plan.other)
        own = lambda f: f.df.select(*[F.col(f"self.{name_sql(c)}") for c in f.columns])
        return Frame(own(left).union(own(right)), left.columns)

    def _fold(self, plan: n.Fold, need: Need) -> Frame:
        frame = self.settle(self.lower(plan.base, self.needs([*plan.ids, *plan.values], plan.base)))
        ids = self.outputs(plan.ids, frame)
        values = [(e.identifier, e) for e in plan.values]
        # One pass over the rows: each becomes an array of key and value structs.
        entries = F.array(*[F.struct(F.lit(k).alias(plan.key_name), self.column(e, plan.value_name)) for k, e in values])
        df = frame.df.select(*[self.column(e, k) for k, e in ids], F.inline(entries))
        return Frame(df, (*[k for k, _ in ids], plan.key_name, plan.value_name))

    def _match(self, plan: n.Match, need: Need) -> Frame:
        names = [s.identifier for s in plan.steps]
        used = [plan.group, plan.timestamp, *plan.steps, *plan.starts]
        wanted: Need = {k: v for k, v in need.items() if k in names}
        asked = {c[len(derived("")) :] for v in wanted.values() for c in (v or ()) if c.startswith(derived(""))}
        attributes = dict(plan.events.attributes) if plan.events is not None else {}
        if any(v is None for v in wanted.values()):
            asked |= set(attributes)
        extra = {a: attributes[a] for a in sorted(asked) if a in attributes}
        frame = self.settle(self.lower(plan.base, self.needs([*used, *extra.values()], plan.base)))
        df = frame.df
        if extra:
            df = df.select("self.*", *[self.column(e, derived(a)) for a, e in extra.items()]).alias("self")
        every = [*frame.columns, *[derived(a) for a in extra]]
        columns = {physical(k): sorted(every if v is None else v & set(every)) for k, v in wanted.items()}
        made = match_steps(
            df,
            group=self.column(plan.group),
            group_name=plan.group.identifier,
            timestamp=self.column(plan.timestamp),
            steps=[(physical(s.identifier), self.column(s)) for s in plan.steps],
            starts=[(s.identifier, self.column(s)) for s in plan.starts],
            time_limit=plan.time_limit,
            columns=columns,
            timestamp_name=plan.timestamp.name if isinstance(plan.timestamp, Column) and plan.timestamp.relation is None else None,
        )
        own = (plan.group.identifier, *[s.identifier for s in plan.starts])
        return Frame(made, own, frozenset(wanted))


def relations_of(plan: n.Plan | None) -> set[str]:
    """The relations that expressions over a plan can be about."""
    found: set[str] = set()
    while isinstance(plan, n.Filter | n.Sort | n.Limit | n.JoinOne | n.Match):
        if isinstance(plan, n.JoinOne):
            found.add(plan.relation)
        if isinstance(plan, n.Match):
            return found | {s.identifier for s in plan.steps}
        plan = plan.base
    return found


def lower_model(model: Model, context: Context | None = None) -> tuple[DataFrame, Context]:
    """The model's DataFrame, not yet run, and the context with its warnings."""
    spark = model.connection.spark
    published: dict[int, tuple[str, list[str]]] = {}

    def view(inner: Model) -> tuple[str, list[str]]:
        if id(inner) not in published:
            frame = lowering_for(inner).result(inner)
            name = f"metricframe_{uuid.uuid4().hex}"
            frame.createOrReplaceTempView(name)
            context.views.append(name)  # type: ignore[union-attr]
            published[id(inner)] = (name, frame.columns)
        return published[id(inner)]

    if context is None:
        context = Context(view=view, first_weekday=model.connection.first_weekday)
    context.view = view
    context.views = []  # type: ignore[attr-defined]

    def lowering_for(m: Model) -> Lowering:
        lowering = Lowering(m.connection.spark, context)
        lowering.connection = m.connection  # type: ignore[attr-defined]
        return lowering

    df = lowering_for(model).result(model)
    df.columns  # noqa: B018 - analyse now, while the views exist
    for name in context.views:  # type: ignore[attr-defined]
        spark.catalog.dropTempView(name)
    return df, context
