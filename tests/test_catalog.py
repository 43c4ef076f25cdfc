"""Every query of the catalog against its SQL on the smallest tables."""

import os

import pytest

from voxelmill.plans import catalog

DIR = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")


def _key(row):
    return tuple(f"{v:.6f}" if isinstance(v, float) else repr(v) for v in row)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("lineitem", "events", "embeddings", "nation", "part", "supplier", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    c.execute(catalog.oracle_sql()[name])
    columns = [x[0] for x in c.description]
    want = sorted(map(_key, c.fetchall()))
    out = catalog.queries()[name](spark, DIR)
    assert sorted(out.columns) == sorted(columns)
    got = sorted(_key([r[x] for x in columns]) for r in out.collect())
    assert got == want
