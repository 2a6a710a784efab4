"""Twins on series of one row, and on values whose rounding is a tie."""

import duckdb
import pytest

from seriesmill.plans.catalogue import ORACLE, QUERIES


@pytest.mark.parametrize("name", ["a6_series_stats", "m1_feature_table"])
def test_short_series_and_ties(spark, tmp_path, name):
    con = duckdb.connect()
    rows = [(1, "click", 7, "2024-01-01 10:00:00"), (2, "click", 8, "2024-01-02 10:00:00"), (2, "view", 8, "2024-01-02 10:00:00"), (3, "click", 9, "2024-01-02 10:00:00")]
    rows += [(10 + k, "error", 20, f"2024-01-{k % 28 + 1:02d} 00:00:00") for k in range(128)] + [(3, "view", 21, "2024-01-05 01:00:00"), (4, "view", 21, "2024-01-05 01:00:00")]
    # rows less than a second apart
    rows += [(20000 + 2 * u + i, "signup", 500 + u, f"2024-01-03 00:00:0{i}.{(u * 7907) % 1000000:06d}") for u in range(200) for i in range(2)]
    # means of four risks that end in half a millionth
    rows += [(1000 + 10 * u + i, a, 100 + u, "2024-01-03 00:00:00") for u in range(300) for i, a in enumerate(("click", "purchase", "error", "view"))]
    con.execute("create table events (event_id bigint, event_type varchar, user_id bigint, ts timestamp, value double, props varchar)")
    con.executemany("insert into events values (?, ?, ?, ?, 0, '')", rows)
    con.execute("update events set value = ((event_id * 2654435761) % 25000 + 1) / 100.0")
    con.execute("create table customer as select i as c_custkey, i % 25 as c_nationkey from range(1, 300) t(i)")
    for t in ("events", "customer"):
        con.execute(f"copy {t} to '{tmp_path}/{t}.parquet' (format parquet)")
    df = QUERIES[name](spark, str(tmp_path))
    cur = con.execute(ORACLE[name])
    at = [c[0] for c in cur.description]
    want = sorted(cur.fetchall(), key=lambda r: repr(r[:2]))
    assert sorted((tuple(r) for r in df.select(*at).collect()), key=lambda r: repr(r[:2])) == want
