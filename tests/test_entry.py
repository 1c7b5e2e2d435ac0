"""The driver's entry module."""

from __future__ import annotations

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from metricframe import queries as core

SMALL = "/root/testdata/sf0.001"


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["step", "entities"]


def test_names_agree():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(core.queries()) == set(core.oracle_sql())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the driver's tables")
def test_row_counts_of_the_semantic_layer(spark):
    con = duckdb.connect()
    for name in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{SMALL}/{name}'")
    made, sql = core.queries(), core.oracle_sql()
    for name in ("agg_all_measures", "join_two_level", "fold", "wow_self_join", "in_model", "match_steps_partition", "funnel_five_steps", "sql_window"):
        got = made[name](spark, SMALL).toPandas()
        want = con.execute(sql[name]).df()
        assert len(got) == len(want) and sorted(got.columns) == sorted(want.columns), name


def test_core_stands_without_the_text_libraries():
    code = "import sys; sys.modules['xxhash'] = None\nimport __spark_entry__ as e\nprint(len(e.queries()), 'op8_simhash' in e.queries())"
    out = subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(__spark_entry__.__file__), capture_output=True, text=True, check=True).stdout
    assert out.split() == [str(len(core.queries())), "False"]
