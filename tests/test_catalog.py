"""Every registered query against its SQL on the smallest tables."""

import decimal
import math
from pathlib import Path

import duckdb
import pytest

from millrace.plans.catalog import QUERIES, SQL


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for f in Path(data).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)
    assert len(SQL) > 150


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, data, name):
    df = QUERIES[name](spark, data)
    got = [tuple(plain(x) for x in r) for r in df.collect()]
    rows = con.execute(SQL[name])
    names = [d[0] for d in rows.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in df.columns]
    want = [tuple(plain(r[i]) for i in order) for r in rows.fetchall()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    df = QUERIES[name](spark, data)
    assert df.columns
    df.count()


def test_coverage_names_registered_queries():
    import re

    text = (Path(__file__).resolve().parent.parent / "COVERAGE.md").read_text()
    rows = [r for r in text.splitlines() if re.match(r"\| [A-M]\d+ \|", r)]
    named = {m for r in rows for m in re.findall(r"`(\w+)`(?=\*?(?:,| \|))", r)}
    assert len(rows) == 324 and len(named) > 200 and named <= set(QUERIES)
    assert {m for r in rows for m in re.findall(r"`(\w+)`\*", r)}.isdisjoint(SQL)
