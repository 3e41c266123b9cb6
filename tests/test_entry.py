import duckdb
import pytest

from quern import catalogue

DATA = "/root/testdata/sf0.001"
NAMES = sorted(catalogue.ORACLE)


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("customer", "supplier", "orders", "lineitem", "events", "documents", "embeddings", "benchmark", "labels", "conversations", "nation", "pages"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = con.sql(catalogue.ORACLE[name])
    columns = sorted(want.columns)
    got = catalogue.QUERIES[name](spark, DATA)
    assert sorted(got.columns) == columns
    at = [want.columns.index(c) for c in columns]
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    assert sorted([tuple(plain(r[c]) for c in columns) for r in got.collect()], key=repr) == sorted([tuple(plain(r[i]) for i in at) for r in want.fetchall()], key=repr)
