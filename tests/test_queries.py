"""Every query with SQL against DuckDB on the small tables; the others run and give rows."""

import os

import duckdb
import pandas as pd
import pytest

from reqloom.plans import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(frame):
    columns = sorted(frame.columns)
    value = lambda v: None if v is None or v is pd.NA or (isinstance(v, float) and v != v) else (float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v)
    return sorted(repr(tuple(value(v.item() if hasattr(v, "item") else v) for v in r)) for r in frame[columns].astype(object).itertuples(index=False, name=None))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck):
    query, sql = QUERIES[name]
    got = query(spark, SF)
    if sql is None:
        assert got.count() > 0
        return
    want = duck.sql(sql)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.toPandas()) == rows(want.df())


def test_tags(spark, tmp_path):
    from reqloom.operators import relational as J

    parts = [(1, "Brand#1", "T", "a"), (3, "Brand#12", "T", "b"), (6, "Brand#23", "T", "c"), (7, "Brand#2", "T", "d")]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_type string, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    used = {r.tag: r.used for r in QUERIES["tag_counts"][0](spark, str(tmp_path)).collect()}
    assert used["t"] == 4 and used["brand#12"] == 1
    assert {r.p_partkey for r in QUERIES["tagged_parts"][0](spark, str(tmp_path)).collect()} == {3, 6}
    rows = spark.createDataFrame([(["a", "b"],), (["c"],), ([],), (None,)], "tags array<string>")
    assert [r[0] for r in rows.select(J.has_any(rows.tags, [" B ", "x"])).collect()] == [True, False, False, False]
    assert not any(r[0] for r in rows.select(J.has_any(rows.tags, [])).collect())


def test_json_equality(spark):
    from reqloom.operators import relational as J

    rows = spark.createDataFrame([('{"k": {"action": "grant"}}',), ('{"k": {"action": "revoke"}}',), ('{"k": null}',), ("no json",), (None,)], "props string")
    assert [r[0] for r in rows.select(J.json_equals(rows.props, "$.k.action", "grant")).collect()] == [True, False, False, False, False]
    assert QUERIES["events_by_detail"][0](spark, SF).count() > 0
