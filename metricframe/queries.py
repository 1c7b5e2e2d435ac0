"""The registered queries of the semantic layer, each with the same question as DuckDB SQL."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricframe import Connection, Model, attr, column, func, msr, rel, timeinterval
from metricframe.expressions import GRANULARITIES

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "pages")
#: name -> (model of the tables, SQL, columns whose sums depend on the order of addition)
QUERIES: dict[str, tuple[Callable[[Connection], Model], str, tuple[str, ...]]] = {}
#: Such columns are compared at so many decimals.
DECIMALS = 4


def query(sql: str, *floats: str) -> Callable:
    def register(make: Callable[[Connection], Model]) -> Callable:
        QUERIES[make.__name__] = (make, sql, floats)
        return make

    return register


def connect(spark: SparkSession, sf_dir: str) -> Connection:
    return Connection(spark, **{name: f"{sf_dir}/{name}.parquet" for name in NAMES})


def orders(c: Connection) -> Model:
    return Model(c, "orders").with_attributes("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority").with_primary_key(column("o_orderkey")).with_measures(
        func.count().named("n"), revenue=func.sum(column("o_totalprice"))
    )


def customers(c: Connection) -> Model:
    return Model(c, "customer").with_attributes("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment").with_primary_key(column("c_custkey"))


def nations(c: Connection) -> Model:
    return Model(c, "nation").with_attributes("n_nationkey", "n_name", "n_regionkey").with_primary_key(column("n_nationkey"))


def lineitems(c: Connection) -> Model:
    return Model(c, "lineitem").with_attributes("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def events(c: Connection) -> Model:
    return (
        Model(c, "events")
        .with_attributes("event_id", "ts", "user_id", "event_type", "value", "props")
        .with_activity_schema(group=column("user_id"), timestamp=column("ts"), event_key=column("event_type"))
    )


# Sources.


@query("SELECT r_regionkey, r_name FROM region")
def source_table(c):
    return Model(c, "region")


@query("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def source_sql(c):
    return Model(c, sql_query="SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1; -- by region")


@query("SELECT * FROM (VALUES ('Alice', CAST(25 AS BIGINT)), ('Bob', 32)) t(name, age)")
def source_records(c):
    people = c.with_table("people", [{"age": 32, "name": "Bob"}, {"age": 25, "name": "Alice"}, {"age": 30, "name": "Cassie"}])
    return Model(people, "people").sort(column("name")).limit(2).pick(column("name"), column("age"))


# Projections and predicates.


@query("SELECT o_orderkey, o_totalprice AS price FROM orders")
def pick_basic(c):
    return orders(c).pick(attr.o_orderkey, attr.o_totalprice.named("price"))


@query("SELECT DISTINCT o_orderstatus AS distinct_o_orderstatus FROM orders")
def pick_distinct(c):
    return orders(c).pick(func.distinct(attr.o_orderstatus))


@query("SELECT o_orderkey FROM orders WHERE (o_totalprice > 1000 AND o_orderstatus = 'O') OR NOT (o_orderkey <= 5000)")
def filter_and_or_not(c):
    return orders(c).filter(((attr.o_totalprice > 1000) & (attr.o_orderstatus == "O")) | ~(attr.o_orderkey <= 5000)).pick(attr.o_orderkey)


@query("SELECT count(*) AS count FROM orders WHERE o_totalprice >= 1000 AND o_totalprice < 200000 AND o_orderstatus <> 'F'")
def filter_comparisons(c):
    return orders(c).filter(func.and_(attr.o_totalprice >= 1000, attr.o_totalprice < 200000, attr.o_orderstatus != "F")).aggregate(measures=[func.count()])


@query("SELECT d.doc_id, l.quality IS NULL AS unlabelled FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def null_compare(c):
    labels = Model(c, "labels").with_attributes("quality").with_primary_key(column("doc_id"))
    docs = Model(c, "documents").with_join_one(labels, foreign_key=column("doc_id"))
    return docs.pick(column("doc_id"), (rel.labels.quality == None).named("unlabelled"))  # noqa: E711


@query("SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def in_list(c):
    return customers(c).filter(attr.c_mktsegment.in_(["BUILDING", "MACHINERY"])).pick(attr.c_custkey)


@query("SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic IN (1) OR l.toxic IS NULL")
def in_list_null(c):
    labels = Model(c, "labels").with_attributes("toxic").with_primary_key(column("doc_id"))
    return Model(c, "documents").with_join_one(labels, foreign_key=column("doc_id")).filter(rel.labels.toxic.in_([1, None])).pick(column("doc_id"))


@query("SELECT count(*) AS count FROM orders WHERE o_orderstatus NOT IN ('O', 'F')")
def not_in_list(c):
    return orders(c).filter(~attr.o_orderstatus.in_(["O", "F"])).aggregate(measures=[func.count()])


@query("SELECT p_partkey FROM part WHERE p_type LIKE '%EDI%'")
def contains_like(c):
    return Model(c, "part").filter(column("p_type").contains("EDI")).pick(column("p_partkey"))


@query("SELECT p_partkey FROM part WHERE p_type ILIKE '%prom%'")
def contains_ilike(c):
    return Model(c, "part").filter(column("p_type").contains("prom", case_sensitive=False)).pick(column("p_partkey"))


@query("SELECT p_partkey FROM part WHERE p_type LIKE '%EDI%' OR p_type LIKE '%TAND%'")
def contains_any(c):
    return Model(c, "part").filter(column("p_type").contains_any("EDI", "TAND")).pick(column("p_partkey"))


@query("SELECT p_partkey FROM part WHERE p_name LIKE '%a%' AND p_name LIKE '%r%'")
def contains_all(c):
    return Model(c, "part").filter(column("p_name").contains_all("a", "r")).pick(column("p_partkey"))


@query("SELECT n_nationkey FROM nation WHERE contains('NATION_1 NATION_2 FRANCE BRAZIL', n_name)")
def in_string(c):
    return nations(c).filter(attr.n_name.in_("NATION_1 NATION_2 FRANCE BRAZIL")).pick(attr.n_nationkey)


@query("SELECT vec_id FROM embeddings WHERE list_contains([1, 3], label)")
def array_element(c):
    vectors = c.with_table("embeddings", c.tables["labels"].replace("labels.parquet", "embeddings.parquet"))
    return Model(vectors, "embeddings").filter(column(sql="array(1, 3)").contains(column("label"))).pick(column("vec_id"))


@query("SELECT count(*) AS count FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def in_model(c):
    some = nations(c).filter(attr.n_regionkey == 1).pick(attr.n_nationkey)
    return customers(c).filter(attr.c_nationkey.in_(some)).aggregate(measures=[func.count()])


@query("SELECT count(*) AS count FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def not_in_model(c):
    labels = Model(c, "labels").pick(column("doc_id"))
    return Model(c, "documents").filter(~column("doc_id").in_(labels)).aggregate(measures=[func.count()])


@query("SELECT r_regionkey FROM region WHERE EXISTS (SELECT 1 FROM nation WHERE n_regionkey = 3)")
def exists_model(c):
    return Model(c, "region").filter(func.exists(nations(c).filter(attr.n_regionkey == 3))).pick(column("r_regionkey"))


@query("SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)")
def scalar_model(c):
    return customers(c).filter(attr.c_acctbal > customers(c).aggregate(measures=[func.avg(attr.c_acctbal)])).pick(attr.c_custkey)


# Scalars.


@query("SELECT l_orderkey, l_extendedprice * (1 - l_discount) AS net, l_extendedprice / l_quantity AS unit, l_quantity + l_tax - 1 AS odd FROM lineitem")
def arithmetic(c):
    one = column(value=1)
    return lineitems(c).pick(
        attr.l_orderkey,
        (attr.l_extendedprice * (one - attr.l_discount)).named("net"),
        (attr.l_extendedprice / attr.l_quantity).named("unit"),
        (attr.l_quantity + attr.l_tax - 1).named("odd"),
    )


@query("SELECT o_orderkey, floor(o_totalprice) AS low, ceil(o_totalprice) AS high FROM orders")
def floor_ceiling(c):
    return orders(c).pick(attr.o_orderkey, func.floor(attr.o_totalprice).named("low"), func.ceiling(attr.o_totalprice).named("high"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice < 1000 THEN 'small' WHEN o_totalprice < 100000 THEN 'medium' ELSE 'large' END AS size FROM orders")
def cases(c):
    return orders(c).pick(
        attr.o_orderkey, func.cases((attr.o_totalprice < 1000, "small"), (attr.o_totalprice < 100000, "medium"), other="large").named("size")
    )


@query("SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'FURNITURE') THEN c_mktsegment ELSE 'Other' END AS c_mktsegment FROM customer")
def bucket_other(c):
    return customers(c).pick(attr.c_custkey, attr.c_mktsegment.bucket_other("BUILDING", "FURNITURE"))


@query(
    """WITH top AS (SELECT c_nationkey FROM customer GROUP BY 1 ORDER BY count(*) DESC, c_nationkey LIMIT 3)
    SELECT CASE WHEN c_nationkey IN (SELECT c_nationkey FROM top) THEN c_nationkey ELSE -1 END AS c_nationkey, count(*) AS count FROM customer GROUP BY 1"""
)
def bucket_other_model(c):
    top = customers(c).aggregate(groups=[attr.c_nationkey], measures=[func.count()]).sort(attr["count"], dir="desc").sort(attr.c_nationkey).limit(3)
    return customers(c).aggregate(groups=[attr.c_nationkey.bucket_other(top, other=-1)], measures=[func.count()])


@query("SELECT o_orderkey, o_totalprice * 2 AS twice, upper(o_orderstatus) AS status, o_totalprice BETWEEN 500 AND 5000 AS small FROM orders WHERE o_totalprice IS NOT NULL", "twice")
def sql_expressions(c):
    return orders(c).filter(column(sql="o_totalprice IS NOT NULL")).pick(
        column(sql="o_orderkey"),
        column(sql="self.o_totalprice * 2").named("twice"),
        column(sql="upper({{o_orderstatus}})").named("status"),
        column(sql="o_totalprice BETWEEN 500 AND 5000").named("small"),
    )


@query("SELECT o_orderstatus, sum(o_totalprice) / count(DISTINCT o_custkey) AS per_customer FROM orders GROUP BY 1", "per_customer")
def sql_measure_refs(c):
    return orders(c).aggregate(groups=[attr.o_orderstatus], measures=[column(sql="{{revenue}} / count(distinct o_custkey)").named("per_customer")])


@query("SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer")
def sql_window(c):
    return customers(c).pick(attr.c_custkey, column(sql="row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey)").named("place"))


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, c_acctbal > 0 AS good FROM customer")
def star_attributes(c):
    return customers(c).pick(*attr, (attr.c_acctbal > 0).named("good"))


@query("SELECT c_custkey, n_nationkey, n_name, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey")
def star_relation(c):
    return customers(c).with_join_one(nations(c), foreign_key=attr.c_nationkey).pick(attr.c_custkey, *rel.nation)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def star_sql(c):
    return nations(c).pick(column(sql="*"))


# Aggregates.


@query("SELECT count(*) AS count, sum(o_totalprice) AS sum_o_totalprice FROM orders", "sum_o_totalprice")
def agg_global(c):
    return orders(c).aggregate(measures=[func.count(), func.sum(attr.o_totalprice)])


@query(
    """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, sum(l_extendedprice) AS sum_base, avg(l_discount) AS avg_disc,
    min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship, count(*) AS n FROM lineitem GROUP BY 1, 2""", "sum_qty", "sum_base", "avg_disc")
def agg_all_measures(c):
    return lineitems(c).aggregate(
        groups=[attr.l_returnflag, attr.l_linestatus],
        measures=[
            func.sum(attr.l_quantity).named("sum_qty"),
            func.sum(attr.l_extendedprice).named("sum_base"),
            func.avg(attr.l_discount).named("avg_disc"),
            func.min(attr.l_shipdate).named("first_ship"),
            func.max(attr.l_shipdate).named("last_ship"),
            func.count().named("n"),
        ],
    )


@query("SELECT count(DISTINCT o_custkey) AS count_distinct_o_custkey, count(o_custkey) AS count_o_custkey FROM orders")
def count_distinct(c):
    return orders(c).aggregate(measures=[func.count(func.distinct(attr.o_custkey)), func.count(attr.o_custkey)])


@query("SELECT sum(DISTINCT l_quantity) AS s, avg(DISTINCT l_quantity) AS a FROM lineitem", "s", "a")
def sum_distinct(c):
    return lineitems(c).aggregate(measures=[func.sum(func.distinct(attr.l_quantity)).named("s"), func.avg(func.distinct(attr.l_quantity)).named("a")])


@query(
    """SELECT o_orderpriority, CAST(sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS open,
    sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) / count(*) AS share FROM orders GROUP BY 1""", "share")
def count_if(c):
    is_open = func.count_if(attr.o_orderstatus == "O")
    return orders(c).aggregate(groups=[attr.o_orderpriority], measures=[is_open.named("open"), (is_open / func.count()).named("share")])


@query("SELECT CAST(sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS sum, count(*) AS count FROM orders WHERE o_orderkey < 0")
def count_if_empty(c):
    return orders(c).filter(attr.o_orderkey < 0).aggregate(measures=[func.count_if(attr.o_orderstatus == "O"), func.count()])


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 10")
def having(c):
    return orders(c).aggregate(groups=[attr.o_custkey], measures=[msr.n]).filter(attr.n > 10)


@query("SELECT n AS orders, count(*) AS customers FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) GROUP BY 1")
def reaggregate(c):
    return orders(c).aggregate(groups=[attr.o_custkey], measures=[msr.n]).aggregate(groups=[attr.n.named("orders")], measures=[func.count().named("customers")])


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def group_only_distinct(c):
    return orders(c).aggregate(groups=[attr.o_orderstatus, attr.o_orderpriority])


@query("SELECT count(*) AS n, sum(o_totalprice) AS revenue FROM orders", "revenue")
def star_measures(c):
    return orders(c).aggregate(measures=[*msr])


@query("SELECT floor(c_acctbal / 1000) AS bin, count(*) AS count FROM customer GROUP BY 1")
def binning(c):
    return customers(c).aggregate(groups=[func.floor(attr.c_acctbal / 1000).named("bin")], measures=[func.count()])


# Sort, limit, set operations.


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_k(c):
    return orders(c).sort(attr.o_totalprice, dir="desc").sort(attr.o_orderkey).limit(20).pick(attr.o_orderkey, attr.o_totalprice)


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 25")
def limit_offset(c):
    return orders(c).sort(attr.o_orderkey).limit(10, offset=25).pick(attr.o_orderkey)


@query("SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY l.quality DESC NULLS FIRST, d.doc_id LIMIT 50")
def sort_nulls(c):
    labels = Model(c, "labels").with_attributes("quality").with_primary_key(column("doc_id"))
    docs = Model(c, "documents").with_attributes("doc_id").with_join_one(labels, foreign_key=column("doc_id"))
    return docs.sort(rel.labels.quality, dir="desc", nulls="first").sort(attr.doc_id).limit(50).pick(attr.doc_id, rel.labels.quality)


@query("SELECT sum(o_totalprice) AS total FROM (SELECT o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100)", "total")
def limit_then_aggregate(c):
    return orders(c).sort(attr.o_orderkey).limit(100).aggregate(measures=[func.sum(attr.o_totalprice).named("total")])


@query("SELECT c_nationkey AS k, c_acctbal AS b FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier")
def union_all(c):
    suppliers = Model(c, "supplier").pick(column("s_nationkey"), column("s_acctbal"))
    return customers(c).pick(attr.c_nationkey.named("k"), attr.c_acctbal.named("b")).union_all(suppliers)


@query(
    """SELECT o_orderstatus, 'low' AS kind, min(o_totalprice) AS amount FROM orders GROUP BY 1 UNION ALL
    SELECT o_orderstatus, 'high', max(o_totalprice) FROM orders GROUP BY 1 UNION ALL
    SELECT o_orderstatus, 'mean', avg(o_totalprice) FROM orders GROUP BY 1""", "amount")
def fold(c):
    price = attr.o_totalprice
    made = orders(c).aggregate(
        groups=[attr.o_orderstatus], measures=[func.min(price).named("low"), func.max(price).named("high"), func.avg(price).named("mean")]
    )
    return made.fold(ids=[attr.o_orderstatus], values=[attr.low, attr.high, attr.mean], key_name="kind", value_name="amount")


# Time.


def _truncated(unit: str) -> None:
    def make(c: Connection) -> Model:
        return events(c).aggregate(groups=[getattr(attr.ts, f"by_{unit}")], measures=[func.count()])

    make.__name__ = f"by_{unit}"
    sql = f"date_trunc('{unit}', ts)" if unit != "week" else "date_trunc('week', ts - INTERVAL 6 DAY) + INTERVAL 6 DAY"
    query(f"SELECT CAST({sql} AS TIMESTAMP) AS ts, count(*) AS count FROM events GROUP BY 1")(make)


for _unit in GRANULARITIES:
    _truncated(_unit)


@query("SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month, count(*) AS n, sum(o_totalprice) AS revenue FROM orders GROUP BY 1", "revenue")
def orders_by_month(c):
    return orders(c).aggregate(groups=[attr.o_orderdate.by_month.named("month")], measures=[msr.n, msr.revenue]).sort(attr.month)


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') || strftime(ts, 'T%H:%M:%S') || '+00' AS iso FROM events")
def format_iso(c):
    return events(c).pick(attr.event_id, attr.ts.format_timestamp().named("iso"))


@query("SELECT event_id, strftime(ts, '%a %A %w %d %-d %b %B %m %-m %y %Y %H %-H %I %-I %p %M %-M %S %-S %f %j %-j %U %W %%') || '!' AS tokens FROM events")
def format_tokens(c):
    return events(c).pick(
        attr.event_id, attr.ts.strftime("%a %A %w %d %-d %b %B %m %-m %y %Y %H %-H %I %-I %p %M %-M %S %-S %f %j %-j %U %W %%!").named("tokens")
    )


@query("SELECT event_id, (epoch_us(ts) - epoch_us(date_trunc('day', ts))) / 1000000 AS seconds FROM events")
def diff_seconds(c):
    return events(c).pick(attr.event_id, func.diff_seconds(attr.ts, attr.ts.by_day).named("seconds"))


@query("SELECT event_id, ts + INTERVAL 90 MINUTE AS later, ts - INTERVAL 2 MONTH AS earlier FROM events")
def interval_shift(c):
    return events(c).pick(
        attr.event_id,
        (attr.ts + dt.timedelta(minutes=90)).named("later"),
        (attr.ts - timeinterval(unit="months", num=2)).named("earlier"),
    )


@query("SELECT count(*) AS count FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-17'")
def date_range_literal(c):
    start = column(value=dt.datetime(2024, 1, 10))
    return events(c).filter((attr.ts >= start) & (attr.ts < start + dt.timedelta(days=7))).aggregate(measures=[func.count()])


@query("SELECT count(*) AS count FROM events WHERE ts < now() AND NOT (ts >= date_trunc('year', CAST(now() AS TIMESTAMP)))")
def relative_time(c):
    return events(c).filter((attr.ts < func.now()) & ~attr.ts.is_this_year).aggregate(measures=[func.count()])


_ABSENT_SQL = """SELECT doc_id, doc_id NOT IN (SELECT l.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) AS absent FROM documents"""
_PERIODS = ("today", "yesterday", "this_week", "last_week", "this_month", "last_month", "this_quarter", "last_quarter", "this_year", "last_year")


def _periods_sql() -> str:
    """Counts by period of one time an hour, back from half past this one."""
    counts = []
    for name in _PERIODS:
        unit = {"today": "day", "yesterday": "day"}.get(name, name.split("_")[-1])
        this = "date_trunc('week', now_ - INTERVAL 6 DAY) + INTERVAL 6 DAY" if unit == "week" else f"date_trunc('{unit}', now_)"
        step = "3 MONTH" if unit == "quarter" else f"1 {unit}"
        low, high = (f"{this} - INTERVAL {step}", this) if name.startswith(("last", "yesterday")) else (this, f"{this} + INTERVAL {step}")
        counts.append(f"count(*) FILTER (seen >= {low} AND seen < {high}) AS {name}")
    times = "SELECT CAST(now() AS TIMESTAMP) AS now_, date_trunc('hour', CAST(now() AS TIMESTAMP)) + INTERVAL 30 MINUTE - event_id * INTERVAL 1 HOUR AS seen FROM events"
    return f"SELECT {', '.join(counts)} FROM ({times})"


@query(_periods_sql())
def relative_periods(c):
    hours = "CAST(date_trunc('HOUR', now()) AS TIMESTAMP_NTZ) + INTERVAL 30 MINUTE - make_interval(0, 0, 0, 0, event_id) AS seen"
    at = column("seen")
    return Model(c, sql_query=f"SELECT {hours} FROM events").aggregate(measures=[func.count_if(getattr(at, f"is_{x}")).named(x) for x in _PERIODS])


@query("SELECT r_regionkey AS r_name, r_name AS r_name_2, r_regionkey * 2 AS r_name_3 FROM region")
def names_made_unique(c):
    return Model(c, "region").pick(column("r_regionkey").named("r_name"), column("r_name"), (column("r_regionkey") * 2).named("r_name"))


@query("SELECT r_regionkey, r_name FROM region")
def source_pandas(c):
    return Model(c.with_table("frame", c.table("region").toPandas()), "frame").pick(column("r_regionkey"), column("r_name"))


@query(_ABSENT_SQL)
def not_in_model_with_nulls(c):
    """A missing label makes it unknown whether a document is absent, unless it is there."""
    toxic = Model(c, "documents").with_join_one(
        Model(c, "labels").with_attributes("toxic", "doc_id").with_primary_key(column("doc_id")), foreign_key=column("doc_id")
    ).pick(rel.labels.doc_id.named("doc_id"))
    return Model(c, "documents").pick(column("doc_id"), (~column("doc_id").in_(toxic)).named("absent"))


# Joins.


@query("SELECT c_mktsegment, count(*) AS n, sum(o_totalprice) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1", "revenue")
def join_fk(c):
    return orders(c).with_join_one(customers(c), foreign_key=attr.o_custkey).aggregate(groups=[rel.customer.c_mktsegment], measures=[msr.n, msr.revenue])


@query(
    """SELECT c_mktsegment, count(*) AS n FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0 AND o_totalprice > 100000
    GROUP BY 1"""
)
def join_condition(c):
    good = (rel.customer.c_acctbal > 0) & (attr.o_totalprice > 100000)
    return orders(c).with_join_one(customers(c), foreign_key=attr.o_custkey, condition=good).aggregate(groups=[rel.customer.c_mktsegment], measures=[msr.n])


@query("SELECT count(*) AS n FROM orders JOIN (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') ON o_custkey = c_custkey")
def join_inner(c):
    builders = customers(c).filter(attr.c_mktsegment == "BUILDING")
    return orders(c).with_join_one(builders, foreign_key=attr.o_custkey, named="builder", drop_unmatched=True).aggregate(measures=[msr.n])


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def join_unused_elided(c):
    return orders(c).with_join_one(lineitems(c).with_primary_key(column("l_orderkey")), foreign_key=attr.o_orderkey).aggregate(groups=[attr.o_orderstatus], measures=[msr.n])


@query(
    """SELECT n_name AS nation, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    GROUP BY 1"""
)
def join_two_level(c):
    placed = customers(c).with_join_one(nations(c), foreign_key=attr.c_nationkey).with_attributes(nation=rel.nation.n_name)
    return orders(c).with_join_one(placed, foreign_key=attr.o_custkey).aggregate(groups=[rel.customer.nation], measures=[msr.n])


@query("SELECT n.n_nationkey, r.r_regionkey FROM nation n LEFT JOIN region r ON r.r_regionkey < n.n_regionkey - 2")
def join_theta(c):
    regions = Model(c, "region").with_attributes("r_regionkey")
    return nations(c).with_join_one(regions, condition=rel.region.r_regionkey < attr.n_regionkey - 2).pick(attr.n_nationkey, rel.region.r_regionkey)


@query(
    """WITH w AS (SELECT date_trunc('week', o_orderdate - INTERVAL 6 DAY) + INTERVAL 6 DAY AS week, sum(o_totalprice) AS revenue FROM orders GROUP BY 1)
    SELECT CAST(a.week AS TIMESTAMP) AS week, a.revenue, a.revenue - b.revenue AS change FROM w a LEFT JOIN w b ON a.week = b.week + INTERVAL 7 DAY""", "revenue", "change")
def wow_self_join(c):
    weekly = orders(c).aggregate(groups=[attr.o_orderdate.by_week.named("week")], measures=[msr.revenue])
    before = weekly.with_join_one(weekly, condition=attr.week == rel.last.week + dt.timedelta(days=7), named="last")
    return before.pick(attr.week, attr.revenue, (attr.revenue - rel.last.revenue).named("change"))


@query(
    """WITH ltv AS (SELECT o_custkey, sum(o_totalprice) AS value FROM orders GROUP BY 1)
    SELECT CASE WHEN value > 1000000 THEN 'high' ELSE 'low' END AS segment, o_orderstatus, count(*) AS n
    FROM orders JOIN ltv USING (o_custkey) GROUP BY 1, 2"""
)
def segments_ltv(c):
    ltv = orders(c).aggregate(groups=[attr.o_custkey], measures=[msr.revenue.named("value")]).with_primary_key(column("o_custkey"))
    segment = func.cases((rel.ltv.value > 1000000, "high"), other="low").named("segment")
    return orders(c).with_join_one(ltv, foreign_key=attr.o_custkey, named="ltv").aggregate(groups=[segment, attr.o_orderstatus], measures=[msr.n])


# Events.


def _steps_sql(conditions: list[str], limit: str | None = None, parts: str = "") -> str:
    """CTEs ``m``: one row a user (and part) with the times t0, t1, ... of the matched steps."""
    keys = "user_id" + (f", {parts}" if parts else "")
    out = [f"t0 AS (SELECT {keys}, min(ts) AS t FROM events WHERE {conditions[0]} GROUP BY ALL)"]
    for k, condition in enumerate(conditions[1:], 1):
        mine = ", ".join(f"p.{x.strip()}" for x in keys.split(","))
        out.append(f"t{k} AS (SELECT {mine}, min(e.ts) AS t FROM t{k - 1} p JOIN events e ON e.user_id = p.user_id AND e.ts > p.t WHERE {condition.replace('event_type', 'e.event_type').replace('value', 'e.value')} GROUP BY ALL)")
    base = "t0" if parts else "(SELECT DISTINCT user_id FROM events)"
    same = lambda k: " AND ".join(f"g.{x.strip()} IS NOT DISTINCT FROM t{k}.{x.strip()}" for x in keys.split(","))
    within = lambda k: f"CASE WHEN t{k}.t - t0.t < INTERVAL {limit} THEN t{k}.t END" if limit and k else f"t{k}.t"
    columns = ", ".join(f"{within(k)} AS t{k}" for k in range(len(conditions)))
    joins = " ".join(f"LEFT JOIN t{k} ON {same(k)}" for k in range(len(conditions)))
    own = ", ".join(f"g.{x.strip()}" for x in keys.split(","))
    out.append(f"m AS (SELECT {own}, {columns} FROM {base} g {joins})")
    return "WITH " + ", ".join(out)


_VCP = ["event_type = 'view'", "event_type = 'click'", "event_type = 'purchase'"]


@query(_steps_sql(_VCP) + " SELECT user_id, t0 AS viewed, t1 AS clicked, t2 AS bought FROM m")
def match_steps_basic(c):
    made = events(c).match_steps(["view", "click", "purchase"])
    return made.pick(attr.user_id, rel.view.ts.named("viewed"), rel.click.ts.named("clicked"), rel.purchase.ts.named("bought"))


@query(
    _steps_sql(_VCP[:2])
    + " SELECT m.user_id, a.event_id AS view_id, a.value AS view_value, b.event_id AS click_id FROM m LEFT JOIN events a ON a.user_id = m.user_id"
    " AND a.ts = t0 LEFT JOIN events b ON b.user_id = m.user_id AND b.ts = t1"
)
def match_steps_events(c):
    made = events(c).match_steps(["view", "click"])
    return made.pick(attr.user_id, rel.view.event_id.named("view_id"), rel.view.value.named("view_value"), rel.click.event_id.named("click_id"))


@query(_steps_sql(_VCP, "1 HOUR") + " SELECT user_id, t0 AS viewed, t1 AS clicked, t2 AS bought FROM m")
def match_steps_time_limit(c):
    made = events(c).match_steps(["view", "click", "purchase"], time_limit=dt.timedelta(hours=1))
    return made.pick(attr.user_id, rel.view.ts.named("viewed"), rel.click.ts.named("clicked"), rel.purchase.ts.named("bought"))


@query(_steps_sql(["event_type = 'view' AND value > 90", "value > 50", "event_type = 'error'"]) + " SELECT user_id, t0 AS a, t1 AS b, t2 AS c FROM m")
def match_steps_conditions(c):
    steps = [((attr.event_type == "view") & (attr.value > 90)).named("a"), (attr.value > 50).named("b"), ("error", "c")]
    return events(c).match_steps(steps).pick(attr.user_id, rel.a.ts.named("a"), rel.b.ts.named("b"), rel.c.ts.named("c"))


@query(_steps_sql(["event_type = 'purchase'"] * 3) + " SELECT user_id, t0 AS p1, t1 AS p2, t2 AS p3 FROM m")
def match_steps_repeat_event(c):
    steps = [("purchase", "first"), ("purchase", "second"), ("purchase", "third")]
    return events(c).match_steps(steps).pick(attr.user_id, rel.first.ts.named("p1"), rel.second.ts.named("p2"), rel.third.ts.named("p3"))


@query(
    _steps_sql(_VCP[:2], "6 HOUR", "day").replace("FROM events", "FROM (SELECT *, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day FROM events)")
    + " SELECT user_id, day, t0 AS viewed, t1 AS clicked FROM m"
)
def match_steps_partition(c):
    made = events(c).match_steps(["view", "click"], partition_start_events=[attr.ts.by_day.named("day")], time_limit=dt.timedelta(hours=6))
    return made.pick(attr.user_id, attr.day, rel.view.ts.named("viewed"), rel.click.ts.named("clicked"))


@query(
    _steps_sql(_VCP, "3 HOUR")
    + " SELECT user_id, CASE WHEN t2 IS NOT NULL THEN 'purchase' WHEN t1 IS NOT NULL THEN 'click' WHEN t0 IS NOT NULL THEN 'view' END AS last_matched_step_name,"
    " CASE WHEN t2 IS NOT NULL THEN 2 WHEN t1 IS NOT NULL THEN 1 WHEN t0 IS NOT NULL THEN 0 END AS last_matched_step_index FROM m"
)
def last_matched_step(c):
    return events(c).match_steps(["view", "click", "purchase"], time_limit=dt.timedelta(hours=3)).pick(
        attr.user_id, attr.last_matched_step_name, attr.last_matched_step_index
    )


def _funnel_sql(names: list[str], first: int = 0, top: str | None = None, parts: str = "", start: str = "m") -> str:
    group = f"{parts}, " if parts else ""
    rows = [f"SELECT {group}'{top}' AS step, count(*) AS entities FROM {start} {'GROUP BY ' + parts if parts else ''}"] if top else []
    rows += [
        f"SELECT {group}'{x}' AS step, CAST(sum(CASE WHEN t{k} IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS entities FROM {start} {'GROUP BY ' + parts if parts else ''}"
        for k, x in enumerate(names)
        if k >= first
    ]
    return " " + " UNION ALL ".join(rows)


_SHORT = ["view", "click", "purchase"]


@query(_steps_sql(_VCP, "2 HOUR") + _funnel_sql(_SHORT))
def funnel_time_limit(c):
    return events(c).funnel(_SHORT, time_limit=dt.timedelta(hours=2))


@query(_steps_sql(["event_type = 'view' AND value > 95", "event_type = 'click' AND value > 95", "event_type = 'purchase' AND value > 95"]) + _funnel_sql(_SHORT))
def funnel_default(c):
    steps = [((attr.event_type == x) & (attr.value > 95)).named(x) for x in _SHORT]
    return events(c).funnel(steps)


@query(_steps_sql(_VCP, "2 HOUR") + _funnel_sql(_SHORT, top="users"))
def funnel_top_name(c):
    return events(c).funnel(_SHORT, time_limit=dt.timedelta(hours=2), top_of_funnel="users")


@query(_steps_sql(_VCP, "2 HOUR") + _funnel_sql(_SHORT, first=1))
def funnel_top_index(c):
    return events(c).funnel(_SHORT, time_limit=dt.timedelta(hours=2), top_of_funnel=1)


@query(
    _steps_sql(_VCP, "4 HOUR")
    + ", h AS (SELECT m.*, a.value > 50 AS big FROM m LEFT JOIN events a ON a.user_id = m.user_id AND a.ts = t0)"
    + _funnel_sql(_SHORT, parts="big", start="h")
)
def funnel_partition_matches(c):
    return events(c).funnel(_SHORT, time_limit=dt.timedelta(hours=4), partition_matches=[(rel.view.value > 50).named("big")])


@query(
    _steps_sql(_VCP, "6 HOUR", "week").replace(
        "FROM events", "FROM (SELECT *, CAST(date_trunc('week', ts - INTERVAL 6 DAY) + INTERVAL 6 DAY AS TIMESTAMP) AS week FROM events)"
    )
    + _funnel_sql(_SHORT, parts="week")
)
def funnel_partition_start(c):
    return events(c).funnel(_SHORT, time_limit=dt.timedelta(hours=6), partition_start_events=[attr.ts.by_week.named("week")])


@query(_steps_sql(["event_type = 'signup'", *_VCP, "event_type = 'error'"], "1 DAY") + _funnel_sql(["signup", *_SHORT, "error"]))
def funnel_five_steps(c):
    return events(c).funnel(["signup", *_SHORT, "error"], time_limit=dt.timedelta(days=1))


_RATE = (
    "CAST(sum(CASE WHEN t2 IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) / count(*) AS rate, count(*) AS startedCount, "
    "CAST(sum(CASE WHEN t2 IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS convertedCount, round(avg((epoch_us(t2) - epoch_us(t0)) / 1000000), 3) AS avgSecondsToConvert"
)


@query(_steps_sql(_VCP, "4 HOUR") + f" SELECT {_RATE} FROM m WHERE t0 IS NOT NULL", "rate")
def conversion_rate(c):
    made = events(c).funnel_conversion_rate(_SHORT, time_limit=dt.timedelta(hours=4))
    return made.pick(attr.rate, attr.startedCount, attr.convertedCount, column(sql="round(avgSecondsToConvert, 3)").named("avgSecondsToConvert"))


@query(
    _steps_sql(_VCP, "8 HOUR", "day").replace("FROM events", "FROM (SELECT *, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day FROM events)")
    + f" SELECT day, {_RATE} FROM m WHERE t0 IS NOT NULL GROUP BY day", "rate")
def conversion_rate_partition(c):
    made = events(c).funnel_conversion_rate(_SHORT, time_limit=dt.timedelta(hours=8), partition_start_events=[attr.ts.by_day.named("day")])
    return made.pick(attr.day, attr.rate, attr.startedCount, attr.convertedCount, column(sql="round(avgSecondsToConvert, 3)").named("avgSecondsToConvert"))


def _rounded(df: DataFrame, floats: tuple[str, ...]) -> DataFrame:
    return df.withColumns({c: F.round(c, DECIMALS) for c in floats}) if floats else df


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        name: (lambda spark, sf_dir, make=make, floats=floats: _rounded(make(connect(spark, sf_dir)).spark_df(), floats))
        for name, (make, _, floats) in QUERIES.items()
    }


def oracle_sql() -> dict[str, str]:
    found = {}
    for name, (_, sql, floats) in QUERIES.items():
        changed = ", ".join(f"round({c}, {DECIMALS}) AS {c}" for c in floats)
        found[name] = f"SELECT * REPLACE ({changed}) FROM ({sql})" if floats else sql
    return found
