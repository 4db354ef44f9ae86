"""Every registered engine query against its SQL."""

from __future__ import annotations

import duckdb
import pytest

from eventide.plans import flows, ledgers, statements  # noqa: F401  they register their queries
from eventide.plans.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def shown(rows):
    return sorted([tuple("null" if v is None else repr(round(float(v), 6) + 0.0) if isinstance(v, float) else repr(v) for v in r) for r in rows])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(name, spark, duck, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    want = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    columns = sorted(df.columns)
    assert shown(df.select(*columns).collect()) == shown(want.select(*[f'"{c}"' for c in columns]).fetchall())
