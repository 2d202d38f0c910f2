import os

import duckdb
import pytest

from lodestar.plans import catalog

SF = "/root/testdata/sf0.001"


def views():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda x: round(x, 5) if isinstance(x, float) else x.replace(tzinfo=None) if hasattr(x, "tzinfo") else x
    return sorted(str([plain(r[i]) for i in order]) for r in data)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_like_sql(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    con = views().execute(catalog.SQL[name])
    wanted = con.fetchall()
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([d[0] for d in con.description], wanted)
