"""Every query with SQL against DuckDB on the same tables."""

import math
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))

from quillon.plans import catalog, registered  # noqa: E402, F401


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19].replace(" ", "T")
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    if type(v).__name__ == "Decimal":
        return round(float(v), 5)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    want = con.sql(catalog.SQL[name])
    got = catalog.QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows_of(got.columns, [tuple(r) for r in got.collect()]), rows_of(want.columns, want.fetchall())
    assert len(a) == len(b)
    assert a == b
