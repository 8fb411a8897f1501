"""Every registered query of the bitemporal part against its SQL; those without SQL run and give rows."""

import pytest
from oracle import SMALL, rows_of, rows_of_sql

from chronoset.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, name):
    found = catalogue.QUERIES[name](spark, SMALL)
    if name in catalogue.ORACLE_SQL:
        assert rows_of(found) == rows_of_sql(catalogue.ORACLE_SQL[name])
    else:
        assert found.count() > 0


def test_entry_names(spark):
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert entry.entry(spark).count() > 0


def test_mask_pii_values(spark):
    import hashlib
    import re

    import xxhash

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    mask = lambda t: re.sub("[0-9]{12}", lambda m: f"PII_REDACTED_{xxhash.xxh64_hexdigest(m[0].encode())}", t)
    want = {k: hashlib.sha256(mask(t).encode()).hexdigest() if t is not None else None for k, t in texts.items()}
    assert {r.doc_id: r.masked for r in catalogue.QUERIES["mask_pii"](spark, SMALL).collect()} == want
    assert any(mask(t) != t for t in texts.values() if t)


def test_strata_estimate_query(spark):
    from test_replica import plain_estimate

    keys = {r.seq: r.key for r in catalogue.QUERIES["hash_dot"](spark, SMALL).collect()}
    sides = [[k for n, k in keys.items() if n % 100 != gone] for gone in (1, 0)]
    assert catalogue.QUERIES["strata_estimate"](spark, SMALL).first()[0] == plain_estimate(*sides)


def test_open_end_clamp_of_spans_past_64_bits(spark, tmp_path):
    from datetime import datetime

    import duckdb

    keys = [*range(104_158, 104_172), *range(106_745, 106_760), 149_999, 9_000_003, 2**63 - 5, -(2**63) + 5, -106_754, -3, 0, None]
    dates = [datetime(1800, 1, 1), datetime(1969, 12, 31, 23, 59), datetime(1995, 1, 1, 0, 0, 0, 7), datetime(2262, 1, 1), None]
    path = f"{tmp_path}/orders.parquet"
    spark.createDataFrame([(k, t) for k in keys for t in dates], "o_orderkey long, o_orderdate timestamp_ntz").coalesce(1).write.parquet(path)
    sql, product = catalogue.ORACLE_SQL["open_end_clamp"], "o_orderkey * 86400000000000"
    assert product in sql
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{path}/*.parquet'")
    want = con.sql(sql.replace(product, "CAST(o_orderkey AS HUGEINT) * 86400000000000")).fetchall()  # the SQL as it is overflows itself
    got = catalogue.QUERIES["open_end_clamp"](spark, str(tmp_path))
    assert got.columns == ["o_orderkey", "valid_time_start_ns", "valid_time_end_ns"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert len({end for _, _, end in want}) == 7  # six computed ends and the open one


def test_entry_without_the_optional_part(monkeypatch):
    import sys

    import __spark_entry__ as entry

    monkeypatch.setitem(sys.modules, "chronoset.llm.queries", None)  # as if a library that it needs were not there
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    with pytest.warns(UserWarning, match="left out"):
        assert set(entry.queries()) == set(catalogue.QUERIES)
