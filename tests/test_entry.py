"""Every query against its SQL on the smallest tables."""

import datetime
import os
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
OWN = [n for n in QUERIES if not n.startswith("op") and n != "pipeline"]
#: Python-side parsing, similarity search and fitted models have no SQL.
WITHOUT_SQL = {"html_paragraphs", "fuzzy_mentions", "linear_probe", "leave_one_out", "penalty_grid", "chosen_model"}


@pytest.fixture(scope="module")
def tables(sf):
    db = duckdb.connect()
    for name in os.listdir(sf):
        db.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{name}'")
    return db


def plain(value):
    if value is None or (not isinstance(value, (list, dict)) and pd.isna(value)):
        return None
    if isinstance(value, (pd.Timestamp, datetime.date)):
        return str(pd.Timestamp(value))
    if isinstance(value, float):
        return int(value) if value == int(value) else value
    return value


def rows(frame, columns):
    return sorted(([plain(v) for v in r] for r in frame[columns].astype(object).values.tolist()), key=repr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(ORACLES)))
def test_equals_sql(spark, sf, tables, name):
    got, want = QUERIES[name](spark, sf).toPandas(), tables.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


def test_lengths_are_rounded_once(spark):
    # four lengths of these tables lie just below half a centimetre: rounded to millimetres first they would go up
    larger, db = "/root/testdata/sf0.01", duckdb.connect()
    for name in ("customer", "supplier"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{larger}/{name}.parquet'")
    want = db.execute(ORACLES["metric_lengths"]).fetchall()
    assert sorted(map(tuple, QUERIES["metric_lengths"](spark, larger).collect())) == sorted(want)


@pytest.mark.parametrize("name", sorted(WITHOUT_SQL))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_which_queries_have_sql():
    assert set(OWN) - set(ORACLES) == WITHOUT_SQL
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() == 4


def test_rest_stands_without_the_llm_package(tmp_path):
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run(["cp", "-r", f"{here}/skein", f"{here}/__spark_entry__.py", f"{here}/corpus_pipeline.py", str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", f"{tmp_path}/skein/llm"], check=True)
    code = "import __spark_entry__ as e; assert 'phase_totals' in e.queries() and not any(n.startswith('op') for n in e.queries()); e.oracle_sql()"
    for gone in (None, "corpus_pipeline.py"):
        if gone:
            os.remove(tmp_path / gone)
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": ""})
