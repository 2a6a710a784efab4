"""Every registered query of the engine's own operators against its DuckDB twin on the smallest tables."""

import datetime
import math
from pathlib import Path

import pytest

from seriesmill.plans.catalogue import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return (1, "")
    if isinstance(x, bool):
        return (0, str(int(x)))
    if isinstance(x, (int, float)) or type(x).__name__ == "Decimal":
        return (0, f"{round(float(x), 5) + 0.0:.5f}")
    if isinstance(x, datetime.datetime):
        return (0, x.isoformat().replace("T00:00:00", ""))
    if isinstance(x, datetime.date):
        return (0, x.isoformat())
    return (0, str(x))


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted(tuple(plain(r[k]) for k in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_twin(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = table(df.columns, df.collect())
    cur = duck.execute(ORACLE[name])
    want = table([c[0] for c in cur.description], cur.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1]
