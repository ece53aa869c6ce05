"""Every query with SQL gives the rows that DuckDB gives."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from twinsieve.plans import queries as plans
from twinsieve.plans.experiment import QUERIES as EXPERIMENT
from twinsieve.plans.oracle import BODIES, ORACLES
from twinsieve.plans.queries import QUERIES as PLANS
from twinsieve.plans.reports import QUERIES as REPORTS

QUERIES = PLANS | REPORTS | EXPERIMENT

SF = "/root/testdata/sf0.001"


def plain(row):
    return repr(tuple(float(f"{v:.9g}") if isinstance(v, float) else v for v in row))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = sorted(plain(r) for r in df.collect())
    if name in ORACLES:
        got = duck.execute(ORACLES[name])
        names = [d[0] for d in got.description]
        assert sorted(names) == sorted(df.columns)
        order = [names.index(c) for c in df.columns]
        assert rows == sorted(plain([r[i] for i in order]) for r in got.fetchall())


def test_radius_is_selected_by_the_rounded_rates(spark, monkeypatch):
    """Recalls of 1 and 1 - 1 / 3,000,001, or precisions of 0.1 and just below, are equal to six digits."""
    for wrong in (1000, 27_000_012):
        rows = [(0, True, False, 10, 3_000_000), (0, True, False, 40, 1), (0, False, False, 10, wrong), (1, True, False, 12, 5), (1, False, False, 9, 7)]
        con = duckdb.connect()
        values = ", ".join(map(str, rows))
        con.execute(f"CREATE TABLE truth AS SELECT fold, is_duplicate, exact, distance FROM (VALUES {values}) v(fold, is_duplicate, exact, distance, n), range(n)")
        pairs = spark.createDataFrame(rows, "fold int, is_duplicate boolean, exact boolean, distance int, n long")
        monkeypatch.setattr(plans, "_truth", lambda spark, sf_dir, pairs=pairs: pairs)
        df = QUERIES["select_radius"](spark, SF)
        got = con.execute(f"SELECT {', '.join(df.columns)} FROM ({BODIES['select_radius']})").fetchall()
        assert sorted(map(plain, df.collect())) == sorted(map(plain, got)) and len(got) == 2 and got[0][0] == 10


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
