"""Every query against its oracle at the smallest scale; those without one against their rules."""

import os

import duckdb
import pytest

from noteloom.plans import catalog, index_catalog, note_catalog, staging_catalog  # noqa: F401  the others add to the first

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def norm(x):
    return round(x, 6) + 0.0 if isinstance(x, float) else x


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_oracle(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in names) for r in df.collect()), key=str)
    cur = duck.execute(catalog.ORACLE_SQL[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == names
    order = [columns.index(c) for c in names]
    want = sorted((tuple(norm(r[i]) for i in order) for r in cur.fetchall()), key=str)
    assert len(got) == len(want) and got
    for a, b in zip(got, want, strict=True):
        assert a == b
