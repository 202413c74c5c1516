"""Every registered query of the graph against its SQL."""

import duckdb
import pytest
from weftgraph.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(catalog.ORACLE))
def test_query_equals_sql(spark, sf_dir, con, name):
    got = catalog.QUERIES[name](spark, sf_dir)
    want = con.sql(catalog.ORACLE[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = sorted(map(repr, (tuple(r) for r in got.select(columns).collect())))
    assert rows == sorted(map(repr, want.select(", ".join(f'"{c}"' for c in columns)).fetchall()))
