"""Orders of labels as people read them, against the locale order of DuckDB, and by UTF-16 units."""

import itertools

import duckdb
from pyspark.sql import functions as F

from reqloom.functions import sections as S


def test_locale_order(spark):
    parts = ["a", "A", "b", "B", "é", "e", "ä", "ss", "z", "1", "10", "9", "-", "_", " ", ".", "(", "я", "Ж", "中"]
    labels = ["", *parts, *map("".join, itertools.permutations(parts, 2))]
    rows = spark.createDataFrame(list(enumerate(labels)), "id long, label string")
    got = [r.label for r in rows.orderBy(S.locale_key(F.col("label")), "id").collect()]
    con = duckdb.connect()
    con.execute("create table t (id bigint, label varchar)")
    con.executemany("insert into t values (?, ?)", list(enumerate(labels)))
    assert got == [r[0] for r in con.execute("select label from t order by label collate en, id").fetchall()]
    assert got.index("a") < got.index("A") < got.index("ä") < got.index("b") < got.index("B") and got.index("-") < got.index("1") < got.index("a")


def test_category_order(spark):
    rows = spark.createDataFrame([(x,) for x in ["10", "b", "9", "A", "Uncategorized", "3x", "é", "f", "-", "B", "9"]], "category string")
    assert [r[0] for r in rows.orderBy(*S.category_keys(F.col("category"))).collect()] == ["3x", "9", "9", "10", "-", "A", "b", "B", "é", "f", "Uncategorized"]


def test_code_unit_order(spark):
    tags = ["\uff5e", "\U0001f600", "z", "é", "", "a", "\ue000"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in tags], "tag string").orderBy(S.code_unit_key(F.col("tag"))).collect()]
    assert got == sorted(tags, key=lambda t: t.encode("utf-16-be"))
