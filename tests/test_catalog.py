"""Every query with SQL gives DuckDB's rows, and the rest import and run without the optional operators."""

import glob
import os

import pytest

from weftline.plans import catalog_streams as catalog

SF = "/root/testdata/sf0.001"


def rows(cols, data):
    out = []
    for r in data:
        out.append(tuple(None if v is None or v != v else round(v, 4) if isinstance(v, float) else int(v) if isinstance(v, bool) else list(v) if isinstance(v, (list, tuple)) else v for v in (r[c] for c in cols)))
    return sorted(out, key=str)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", [*catalog.QUERIES])
def test_query(spark, name):
    import duckdb

    got = catalog.QUERIES[name](spark, SF)
    data = [r.asDict() for r in got.collect()]
    if name not in catalog.SQL:
        assert data
        return
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    cur = con.execute(catalog.SQL[name])
    names = [d[0] for d in cur.description]
    want = [dict(zip(names, r, strict=True)) for r in cur.fetchall()]
    assert sorted(names) == sorted(got.columns)
    assert rows(sorted(names), data) == rows(sorted(names), want)
