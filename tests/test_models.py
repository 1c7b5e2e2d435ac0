"""The semantic layer on small hand-made frames."""

from __future__ import annotations

import datetime as dt
import json

import pandas as pd
import pytest

from metricframe import Connection, Model, attr, column, func, msr, rel, timeinterval
from metricframe.results import RunResultsError


def rows(model, *names):
    return [tuple(r[n] for n in names) if names else tuple(r.values()) for r in model.run(print_warnings=False).py_records]


@pytest.fixture(scope="module")
def people(spark):
    data = [("Alice", 25, "New York"), ("Bob", 32, "New York"), ("Cassie", 30, "Chicago"), ("David", 42, "Houston")]
    c = Connection(spark, people=[dict(zip(("name", "age", "city"), r, strict=True)) for r in data])
    return Model(c, "people").with_attributes("name", "age", "city").with_measures(func.count(), oldest=func.max(column("age")))


@pytest.fixture(scope="module")
def nulls(spark):
    df = spark.createDataFrame([(1, "a", "50%"), (2, None, "x_y"), (None, "c", "a\\b"), (4, "D", None)], "x int, s string, p string")
    return Model(Connection(spark, nulls=df), "nulls").with_attributes("x", "s", "p")


def test_limit(people):
    assert rows(people.sort(attr.name).limit(2), "name") == [("Alice",), ("Bob",)]


def test_limits_in_written_order(people):
    assert rows(people.sort(attr.name).limit(2).filter(attr.age > 30), "name") == [("Bob",)]
    assert rows(people.sort(attr.name).limit(3).limit(5), "name") == [("Alice",), ("Bob",), ("Cassie",)]


def test_names():
    x = column("x")
    assert func.sum(x).identifier == "sum_x" and func.count().identifier == "count" and func.count(func.distinct(x)).identifier == "count_distinct_x"
    assert func.sum(x.named("y")).identifier == "sum_x" and func.count_if(x > 1).identifier == "sum"
    assert column(sql="t.c").identifier == "c" and column(sql="c").identifier == "c" and x.by_year.identifier == "x"
    assert x.named("y").by_year.identifier == "x" and x.named("y").strftime("%Y").identifier == "y" and x.named("y").bucket_other(1).identifier == "y"
    for nameless in (x + 1, func.cases((x > 1, 2)), column(value=3), column(sql="a + b")):
        with pytest.raises(ValueError):
            nameless.identifier  # noqa: B018
    with pytest.raises(ValueError):
        x.named("__private__")
    with pytest.raises(ValueError):
        column("*")
    with pytest.raises(TypeError):
        bool(x == 1)


def test_null_comparisons_and_membership(nulls):
    of = lambda c: sorted(r[0] if r[0] is not None else -1 for r in rows(nulls.filter(c), "x"))
    assert of(attr.x == None) == [-1] and of(attr.x != None) == [1, 2, 4]  # noqa: E711
    assert of(attr.x.in_([1, 2])) == [1, 2] and of(attr.x.in_([1, None])) == [-1, 1] and of(attr.x.in_([None])) == [-1] and of(attr.x.in_([])) == []
    assert of(~attr.x.in_([1])) == [-1, 2, 4] and of(~attr.x.in_([1, None])) == [2, 4]
    assert of(attr.s.in_("abc")) == [-1, 1] and of(attr.s.in_("abcd", case_sensitive=False)) == [-1, 1, 4]
    with pytest.raises(ValueError):
        attr.x.in_([1], case_sensitive=False)


def test_membership_of_models(nulls, spark):
    some = Model(Connection(spark, t=spark.createDataFrame([(1,), (4,)], "x int")), "t").with_attributes("x")
    with_null = Model(Connection(spark, t=spark.createDataFrame([(1,), (None,)], "x int")), "t").with_attributes("x")
    of = lambda c: sorted(r[0] if r[0] is not None else -1 for r in rows(nulls.filter(c), "x"))
    assert of(attr.x.in_(some)) == [1, 4] and of(~attr.x.in_(some)) == [2]
    assert of(attr.x.in_(with_null)) == [-1, 1] and of(~attr.x.in_(with_null)) == []
    assert of(func.exists(some.filter(attr.x > 100))) == []
    assert of(attr.x > some.aggregate(measures=[func.min(attr.x)])) == [2, 4]


def test_patterns(nulls):
    of = lambda c: [r[0] for r in rows(nulls.filter(c), "p")]
    assert of(attr.p.contains("\\")) == ["a\\b"] and of(attr.p.contains("_")) == ["50%", "x_y", "a\\b"]
    assert of(attr.p.contains("A", case_sensitive=False)) == ["a\\b"] and of(attr.p.contains_all("x", "y")) == ["x_y"]
    assert of(attr.p.contains_any("%", "zz")) == ["50%", "x_y", "a\\b"]


def test_sort_nulls_and_accumulated_keys(nulls, people):
    assert [r[0] for r in rows(nulls.sort(attr.x), "x")] == [None, 1, 2, 4]
    assert [r[0] for r in rows(nulls.sort(attr.x, dir="desc"), "x")] == [4, 2, 1, None]
    assert [r[0] for r in rows(nulls.sort(attr.x, nulls="last"), "x")] == [1, 2, 4, None]
    assert [r[0] for r in rows(people.sort(attr.city).sort(attr.age, dir="desc"), "name")] == ["Cassie", "David", "Bob", "Alice"]
    with pytest.raises(ValueError):
        people.sort(attr.city, dir="up")
    with pytest.raises(ValueError):
        people.sort(attr.city, nulls="middle")


def test_empty_aggregates(nulls):
    none = nulls.filter(attr.x > 100).aggregate(measures=[func.count(), func.count_if(attr.x > 1), func.sum(attr.x)])
    assert rows(none, "count", "sum", "sum_x") == [(0, None, None)]


def test_division(nulls):
    assert rows(nulls.filter(attr.x == 1).pick((attr.x / 2).named("half"), (attr.x / 0).named("none"))) == [(0.5, None)]


def test_duplicate_and_private_names(people):
    result = people.pick(attr.name, attr.city.named("name"), attr.age).run(print_warnings=False)
    assert result.spark_df.columns == ["name", "name_2", "age"] and result.warnings
    hidden = Model(Connection(people.connection.spark, t=[{"a": 1, "__b__": 2}]), "t")
    assert hidden.spark_df().columns == ["a"] and rows(hidden.pick(column("__b__"), column("a"))) == [(1,)]


def test_distinct(people):
    assert sorted(rows(people.pick(func.distinct(attr.city)))) == [("Chicago",), ("Houston",), ("New York",)]
    assert sorted(rows(people.aggregate(groups=[attr.city]))) == [("Chicago",), ("Houston",), ("New York",)]


def test_fold(spark):
    c = Connection(spark, sales=[{"year": 2023, "income": 150, "expenses": 30}, {"year": 2024, "income": 500, "expenses": 130}])
    made = Model(c, "sales").with_attributes("year", "income", "expenses").fold([attr.year], [attr.income, attr.expenses], key_name="type")
    assert sorted(rows(made, "year", "type", "value")) == [(2023, "expenses", 30), (2023, "income", 150), (2024, "expenses", 130), (2024, "income", 500)]


def test_fold_keeps_nulls(nulls):
    assert len(rows(nulls.fold([attr.x], [attr.s, attr.p]))) == 8


def test_joins(spark):
    c = Connection(
        spark,
        products=[{"id": 1, "size": "S"}, {"id": 2, "size": "Large"}],
        sales=[{"product_id": p, "n": n} for p, n in ((1, 10), (2, 20), (3, 30))],
        twice=[{"id": 1, "k": "a"}, {"id": 1, "k": "b"}],
    )
    products = Model(c, "products").with_attributes("id", "size")
    sales = Model(c, "sales").with_attributes("product_id", "n").with_measures(total=func.sum(column("n")))
    small = sales.with_join_one(products, foreign_key=attr.product_id, condition=rel.products.size != "Large")
    assert sorted(rows(small.aggregate(groups=[rel.products.size], measures=[msr.total])), key=str) == [("S", 10), (None, 50)]
    assert len(rows(sales.with_join_one(products, foreign_key=attr.product_id, named=rel.p, drop_unmatched=True))) == 2
    fan = sales.with_join_one(Model(c, "twice").with_attributes("id", "k"), foreign_key=attr.product_id, named="t")
    assert len(rows(fan)) == 3 and len(rows(fan.pick(attr.n, rel.t.k))) == 4
    with pytest.raises(ValueError):
        sales.with_join_one(products)


def test_unused_joins_are_not_in_the_plan(spark):
    c = Connection(spark, a=[{"id": 1, "x": 1}], b=[{"id": 1, "y": 2}], d=[{"id": 1, "z": 3}])
    a, b, d = (Model(c, t).with_attributes("id", x) for t, x in (("a", "x"), ("b", "y"), ("d", "z")))
    both = a.with_join_one(b, foreign_key=attr.id).with_join_one(d, condition=rel.b.y + 1 == rel.d.z)
    assert "Join" not in both.pick(attr.x).sql()
    assert both.pick(rel.b.y).sql().count("Join") == 1
    assert both.pick(rel.d.z).sql().count("Join") == 2 and rows(both.pick(rel.d.z)) == [(3,)]


def test_relations_of_relations(spark):
    c = Connection(spark, a=[{"id": 1, "b": 5}], b=[{"id": 5, "d": 9}], d=[{"id": 9, "name": "deep"}])
    b = Model(c, "b").with_join_one(Model(c, "d").with_attributes("name"), foreign_key=column("d")).with_attributes(
        deep=rel.d.name, loud=column(sql="upper({{d.name}}) || '!'")
    )
    a = Model(c, "a").with_join_one(b, foreign_key=column("b"), named="r")
    assert rows(a.pick(rel.r.deep, rel.r.loud)) == [("deep", "DEEP!")]


def test_references_in_raw_sql(people):
    made = people.with_attributes(old=column(sql="{{age}} > 30"), label=column(sql="concat({{ name }}, ':', {{old}})"))
    assert rows(made.sort(attr.name).limit(1).pick(attr.label)) == [("Alice:false",)]
    assert rows(people.aggregate(measures=[column(sql="{{oldest}} + count(distinct city)").named("m")])) == [(45,)]


def test_star_expansion(people):
    assert people.pick(*attr).spark_df().columns == ["name", "age", "city"]
    assert people.aggregate(measures=[*msr]).spark_df().columns == ["count", "oldest"]
    assert people.pick(column(sql="*")).spark_df().columns == ["age", "city", "name"]


def test_helpful_errors(people):
    for make, text in (
        (lambda: people.pick(attr.nam), "Available attributes"),
        (lambda: people.pick(attr.oldest), "msr.oldest"),
        (lambda: people.aggregate(measures=[msr.age]), "attr.age"),
        (lambda: people.pick(rel.gone.name), "attr.name"),
    ):
        with pytest.raises(AttributeError, match=text):
            make()


def test_error_phases(people):
    with pytest.raises(RunResultsError) as failed:
        people.pick(column("nowhere")).run()
    assert failed.value.phase == "compile"
    with pytest.raises(RunResultsError) as failed:
        people.pick(column(sql="raise_error('no')").named("e")).df()
    assert failed.value.phase == "data"


def test_attributes_are_resolved_when_used(people):
    before = people.with_attributes(k=column(value=1)).pick(attr.k)
    assert rows(before.with_attributes(k=column(value=2)).limit(1)) == [(1,)]


def test_order_of_replaced_attributes(people):
    assert list(people.with_attributes(age=attr.age + 1).attributes) == ["name", "age", "city"]


def test_results(people):
    result = people.sort(attr.name).run()
    assert isinstance(result.df, pd.DataFrame) and len(result) == 4 and result.arrow.num_rows == 4 and "Sort" in result.sql_query


def test_wire_round_trip(people, spark):
    made = (
        people.with_join_one(people, condition=rel.other.age > attr.age, named="other")
        .filter(attr.city.in_(["Chicago", None]) | (attr.age >= 30))
        .with_attributes(when=column(value=dt.datetime(2024, 1, 2)) + timeinterval(unit="months", num=1), b=attr.city.bucket_other("Houston"))
        .with_custom_meta("owner", {"name": "me"})
        .pick(attr.name, attr.b, rel.other.name.named("older"), attr.when)
    )
    wire = json.loads(json.dumps(made.to_wire()))
    back = Model.from_wire(wire, people.connection)
    assert back.to_wire() == made.to_wire() and back.stable_hash() == made.stable_hash() != people.stable_hash()
    assert sorted(map(str, rows(back))) == sorted(map(str, rows(made)))
    assert back.get_custom_meta("owner") == {"name": "me"}
    with pytest.raises(ValueError):
        Model.from_wire(wire | {"version": 99})


def test_sources(spark, tmp_path):
    frame = pd.DataFrame({"a": [1, 2], "b": ["x", "y"]})
    frame.to_csv(tmp_path / "t.csv", index=False)
    frame.to_parquet(tmp_path / "t.parquet")
    frame.to_json(tmp_path / "t.json", orient="records")
    spark.createDataFrame(frame).createOrReplaceTempView("in_catalog")
    c = Connection(spark, pandas=frame, csv=str(tmp_path / "t.csv"), parquet=tmp_path / "t.parquet", json=str(tmp_path / "t.json"), df=spark.createDataFrame(frame))
    for name in ("pandas", "csv", "parquet", "json", "df", "in_catalog"):
        assert sorted(rows(Model(c, name).pick(column("a"), column("b")))) == [(1, "x"), (2, "y")], name
    assert rows(Model(c, str(tmp_path / "t.parquet")).aggregate(measures=[func.count()])) == [(2,)]
    assert rows(Model(c, sql_query="SELECT sum(a) AS s FROM csv;  -- all\n;")) == [(3,)]
    assert set(c.models()) == {"pandas", "csv", "parquet", "json", "df"} and list(c.models()["csv"].attributes) == ["a", "b"]
    assert sorted(rows(Model(c.with_table("csv", [{"z": 1}]), "csv"))) == [(1,)]
    with pytest.raises(ValueError):
        Model(Connection(spark, bad="x.unknown"), "bad").run()
    with pytest.raises(RuntimeError, match="Excel"):
        Model(Connection(spark, bad=str(tmp_path / "x.xlsx")), "bad").run()


def test_repr(people):
    assert "Attributes: name, age, city" in repr(people) and "Model of people" in repr(people)


def test_stream_of_windowed_counts(spark, tmp_path):
    from metricframe.streaming import start, windowed_counts

    base = dt.datetime(2024, 1, 1)
    data = [(base + dt.timedelta(minutes=m), m) for m in range(0, 60, 5)] + [(base + dt.timedelta(days=1), 0)]
    spark.createDataFrame(data, "ts timestamp_ntz, v int").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp_ntz, v int").parquet(str(tmp_path / "in"))
    model = Model(Connection(spark, events=stream), "events").filter(column("v") < 50)
    query = start(windowed_counts(model, "ts", "10 minutes", "15 minutes"), "closed_windows", str(tmp_path / "check"))
    query.awaitTermination(120)
    assert [r["count"] for r in spark.sql("SELECT * FROM closed_windows ORDER BY start").collect()] == [3, 3, 3, 1]
