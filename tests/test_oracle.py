"""Every query of the core with an SQL equivalent, on the smallest tables, against DuckDB."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb
import pytest

from quire import plans
from tests.conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings exams questions blocks page_images subject_labels eval_items mix_targets subject_areas".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, (float, decimal.Decimal)):
        return None if math.isnan(v) else float(f"{float(v):.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_matches_sql(spark, con, name):
    df = plans.queries()[name](spark, SMALL)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = con.execute(plans.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_runs(spark, name):
    assert plans.queries()[name](spark, SMALL).count() >= 0
