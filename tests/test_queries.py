"""Every query with SQL against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from talkscale.plans import queries as plans
from talkscale.plans import asking, charts, histories, reports, speech, transcripts  # noqa: F401  register their queries

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_against_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = duck.execute(plans.ORACLES[name])
    at = [d[0] for d in found.description]
    assert sorted(at) == columns
    assert got == sorted((tuple(plain(r[at.index(c)]) for c in columns) for r in found.fetchall()), key=repr)


def test_bootstrap_is_reproducible_and_near_the_analytic_error(spark):
    a = {(r.year, r.n_name): r.se_boot for r in plans.bootstrap_se(spark, DIR).collect()}
    b = {(r.year, r.n_name): r.se_boot for r in plans.bootstrap_se(spark, DIR).collect()}
    assert a == b and all(x >= 0 for x in a.values())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
