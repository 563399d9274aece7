"""Every query of the analytics operators against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from lodestone.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(columns, records):
    plain = lambda v: "∅" if v is None else f"{v:.6g}" if isinstance(v, float) and not math.isnan(v) else str(list(v)) if isinstance(v, (list, tuple)) else str(v)
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(plain(float(r[k]) if isinstance(r[k], (int, float)) and not isinstance(r[k], bool) else r[k]) for k in order) for r in records)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    found = rows(got.columns, [tuple(r) for r in got.collect()])
    if name in ORACLE_SQL:
        result = duck.execute(ORACLE_SQL[name])
        names = [c[0] for c in result.description]
        assert sorted(names) == sorted(got.columns)
        assert found == rows(names, result.fetchall())
    else:
        assert found


def test_edit_pauses_rounds_times_as_sql_does(spark, tmp_path):
    us = [-1500, -500, -499, 499, 500, 1499, 1500, 600_000_499, 600_000_500]
    values = ", ".join(f"({k}, {k % 2}, make_timestamp({t}::BIGINT), 'x')" for k, t in enumerate(us))
    own = duckdb.connect()
    own.execute(f"CREATE VIEW events AS SELECT * FROM (VALUES {values}) v(event_id, user_id, ts, event_type)")
    own.execute(f"COPY events TO '{tmp_path}/events.parquet'")
    got = QUERIES["edit_pauses"](spark, str(tmp_path))
    result = own.execute(ORACLE_SQL["edit_pauses"])
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows([c[0] for c in result.description], result.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(ORACLE_SQL) <= set(entry.oracle_sql()) and set(QUERIES) <= set(entry.queries())
