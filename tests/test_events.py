"""Step matching, funnels and conversion rates, against a plain matcher."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from metricframe import Connection, Model, attr, column, func, rel

DAY = dt.datetime(2024, 1, 1)


def at(day, **more):
    return DAY + dt.timedelta(days=day - 1, **more)


def events(spark, data, schema="user_id long, event string, timestamp timestamp_ntz, part string, id long"):
    model = Model(Connection(spark, events=spark.createDataFrame(data, schema)), "events").with_attributes("user_id", "event", "timestamp", "part", "id")
    return model.with_activity_schema(group=column("user_id"), timestamp=column("timestamp"), event_key=column("event"))


def rows(model):
    return [tuple(r.values()) for r in model.run().py_records]


@pytest.fixture(scope="module")
def shop(spark):
    visits = {
        0: [("ad", 1), ("visit", 2), ("buy", 4)], 1: [("ad", 1), ("visit", 2), ("buy", 3), ("buy", 4)], 2: [("ad", 1), ("visit", 2)],
        3: [("ad", 1), ("visit", 2)], 4: [("ad", 1)], 5: [("visit", 1), ("buy", 2)], 6: [("other", 1)],
    }
    data = [(u, e, at(d), None, 10 * u + i) for u, es in visits.items() for i, (e, d) in enumerate(es)]
    return events(spark, data)


def test_funnel(shop):
    steps = ["ad", "visit", "buy"]
    assert rows(shop.funnel(steps)) == [("ad", 5), ("visit", 4), ("buy", 2)]
    assert rows(shop.funnel(steps, top_of_funnel="users")) == [("users", 7), ("ad", 5), ("visit", 4), ("buy", 2)]
    assert rows(shop.funnel(steps, top_of_funnel=1)) == [("visit", 4), ("buy", 2)]
    assert rows(shop.funnel(steps, time_limit=dt.timedelta(days=3))) == [("ad", 5), ("visit", 4), ("buy", 1)]


def test_conversion_rate(shop):
    made = shop.funnel_conversion_rate(["ad", "visit", "buy"])
    assert made.spark_df().columns == ["rate", "startedCount", "convertedCount", "avgSecondsToConvert"]
    assert rows(made) == [(0.4, 5, 2, 216000.0)]
    assert sorted(made.attributes) == sorted(made.spark_df().columns)


def test_empty_steps(shop):
    assert rows(shop.funnel([], top_of_funnel="users")) == [("users", 7)]
    assert rows(shop.funnel_conversion_rate([])) == [(7, 7, 0, 1)]
    with pytest.raises(ValueError):
        shop.funnel([])
    with pytest.raises(ValueError):
        shop.match_steps([])


def test_invalid_arguments(shop):
    for bad in ({"top_of_funnel": -1}, {"top_of_funnel": 3}, {"top_of_funnel": "x", "partition_start_events": [attr.part]}):
        with pytest.raises(ValueError):
            shop.funnel(["ad", "visit", "buy"], **bad)
    with pytest.raises(ValueError):
        shop.match_steps(["ad", "ad"])
    with pytest.raises(ValueError):
        Model(shop.connection, "events").match_steps(["ad"])


def test_names_of_steps(shop):
    made = shop.match_steps(["ad", ("buy", "first buy"), (column("event") == "buy").named("again")])
    assert list(made.relations) == ["ad", "first buy", "again"]
    assert [r for r in rows(made.pick(attr.user_id, rel["first buy"].id, rel.again.id)) if r[0] == 1] == [(1, 12, 13)]
    assert list(shop.match_steps(["sign up!"]).relations) == ["sign_up_"]


def test_activity_schema_is_merged_field_by_field(shop):
    assert rows(shop.funnel(["x"], event_key=func.cases((attr.event == "ad", "x"), other="y"))) == [("x", 5)]


def test_whole_events_and_derived_attributes(shop):
    model = shop.with_attributes(upper=column(sql="upper(event)"))
    made = model.match_steps(["ad", "buy"]).sort(attr.user_id)
    assert rows(made.pick(attr.user_id, rel.ad.id, rel.buy.id, rel.buy.upper, attr.last_matched_step_name, attr.last_matched_step_index))[:3] == [
        (0, 0, 2, "BUY", "buy", 1), (1, 10, 12, "BUY", "buy", 1), (2, 20, None, None, "ad", 0),
    ]


def test_ties_overlaps_and_null_groups(spark):
    data = [(1, "a", at(1), None, 1), (1, "b", at(1), None, 2), (2, "ab", at(1), None, 3), (None, "a", at(1), None, 4), (None, "b", at(2), None, 5), (3, "ab", at(1), None, 6), (3, "ab", at(2), None, 7)]
    model = events(spark, data)
    steps = [column("event").contains("a").named("a"), column("event").contains("b").named("b")]
    found = sorted(rows(model.match_steps(steps).pick(attr.user_id, rel.a.id, rel.b.id)), key=str)
    assert found == sorted([(1, 1, None), (2, 3, None), (3, 6, 7), (None, None, None)], key=str)
    assert rows(model.funnel(steps, top_of_funnel="all")) == [("all", 4), ("a", 3), ("b", 1)]


def test_time_limit_is_strict(spark):
    data = [(1, "a", at(1), None, 1), (1, "b", at(2), None, 2), (2, "a", at(1), None, 3), (2, "b", at(2, microseconds=-1), None, 4)]
    made = events(spark, data).match_steps(["a", "b"], time_limit=dt.timedelta(days=1)).sort(attr.user_id)
    assert rows(made.pick(attr.user_id, rel.b.id)) == [(1, None), (2, 4)]


def test_partitions(spark):
    data = [(1, "a", at(1), "x", 1), (1, "a", at(3), "x", 2), (1, "a", at(4), "y", 3), (1, "b", at(5), None, 4), (1, "a", at(6), None, 5), (2, "b", at(1), "x", 6)]
    made = events(spark, data).match_steps(["a", "b"], partition_start_events=[attr.part])
    assert sorted(rows(made.pick(attr.user_id, attr.part, rel.a.id, rel.b.id)), key=str) == sorted(
        [(1, "x", 1, 4), (1, "y", 3, 4), (1, None, 5, None)], key=str
    )
    assert rows(events(spark, data).funnel(["a", "b"], partition_start_events=[attr.part])) == [
        (None, "a", 1), (None, "b", 0), ("x", "a", 1), ("x", "b", 1), ("y", "a", 1), ("y", "b", 1),
    ]


def test_relations_on_the_group_survive(spark, shop):
    c = shop.connection.with_table("users", [{"id": u, "plan": "pro" if u % 2 else "free"} for u in range(7)])
    users = Model(c, "users").with_attributes("id", "plan")
    model = shop.with_connection(c).with_join_one(users, foreign_key=column("user_id"))
    assert sorted(rows(model.funnel(["ad", "buy"], partition_matches=[rel.users.plan]))) == [
        ("free", "ad", 3), ("free", "buy", 1), ("pro", "ad", 2), ("pro", "buy", 1),
    ]


def plain_match(data, conditions, limit, parted):
    """By group (and part of the first match): the matched times."""
    out = {}
    groups = {}
    for u, e, t, p, _ in data:
        groups.setdefault(u, []).append((t, e, p))
    for u, es in groups.items():
        starts = {}
        for t, e, p in es:
            if u is not None and conditions[0](e):
                key = (u, p) if parted else (u,)
                starts[key] = min(t, starts.get(key, t))
        for key, t0 in (starts or ({} if parted else {(u,): None})).items():
            times = [t0]
            for condition in conditions[1:]:
                later = [t for t, e, _ in es if times[-1] is not None and t > times[-1] and condition(e)]
                times.append(min(later) if later else None)
            out[key] = tuple(t if t is None or k == 0 or limit is None or t - t0 < limit else None for k, t in enumerate(times))
    return out


@pytest.mark.parametrize("parted", [False, True])
@pytest.mark.parametrize("limit", [None, dt.timedelta(hours=9)])
def test_against_a_plain_matcher(spark, parted, limit):
    rng = random.Random(17)
    for kinds, span in ((["a", "b", "c"], 40), (["ab", "bc", "abc", "a", "c"], 6)):
        data = [(rng.choice([None, *range(25)]), rng.choice(kinds), DAY + dt.timedelta(hours=rng.randint(0, span)), rng.choice([None, "x", "y"]), i) for i in range(220)]
        steps = [column("event").contains(x).named(x) for x in "abc"]
        made = events(spark, data).match_steps(steps, partition_start_events=[attr.part] if parted else None, time_limit=limit)
        own = [attr.user_id, attr.part] if parted else [attr.user_id]
        got = {r[: len(own)]: r[len(own) :] for r in rows(made.pick(*own, *[rel[x].timestamp.named(f"t_{x}") for x in "abc"]))}
        assert got == plain_match(data, [lambda e, x=x: x in e for x in "abc"], limit, parted)


def test_one_exchange_however_many_steps(spark, tmp_path):
    data = [(u, e, at(d), None, d) for u in range(50) for d, e in enumerate("abcde")]
    spark.createDataFrame(data, "user_id long, event string, timestamp timestamp_ntz, part string, id long").write.parquet(str(tmp_path / "events.parquet"))
    model = Model(Connection(spark, events=str(tmp_path / "events.parquet")), "events").with_attributes("user_id", "event", "timestamp", "id")
    model = model.with_activity_schema(group=column("user_id"), timestamp=column("timestamp"), event_key=column("event"))
    for steps in ("abc", "abcde"):
        made = model.match_steps(list(steps)).pick(attr.user_id, *[rel[x].id.named(x) for x in steps])
        plan = made.spark_df()._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1, plan


def test_hot_group_of_partitioned_starts(spark):
    """Many starts and events in one group: one exchange, no join, space in proportion to the events."""
    rows = spark.range(110_000).selectExpr(
        "id div 1000000 AS user_id", "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, id) AS ts", "CASE WHEN id % 11 = 0 THEN 'a' ELSE 'b' END AS kind"
    )
    made = (
        Model(Connection(spark, rows=rows), "rows")
        .with_attributes("ts")
        .with_activity_schema(group=column("user_id"), timestamp=column("ts"), event_key=column("kind"))
        .match_steps(["a", "b"], partition_start_events=[column("ts").named("began")])
        .pick(column("began"), rel.b.ts.named("then"))
        .spark_df()
    )
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    found = made.selectExpr("count(*)", "sum(timestampdiff(SECOND, began, then))").first()
    assert tuple(found) == (10_000, 10_000)


def test_absence_needs_no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        c = Connection(spark, a=spark.range(10), b=spark.range(5))
        made = Model(c, "a").filter(~column("id").in_(Model(c, "b").pick(column("id")))).spark_df()
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "LeftAnti" in plan
        assert sorted(r[0] for r in made.collect()) == [5, 6, 7, 8, 9]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
