"""All queries of the layout engine against their SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from paneweave.plans.queries import ORACLES, QUERIES

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="the tables aren't there")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for f in SF.glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from read_parquet('{f}')")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5) + 0.0
    return x if x is None or isinstance(x, (bool, int, str)) else round(float(x), 5)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, oracle, name):
    df = QUERIES[name](spark, str(SF))
    columns = sorted(df.columns)
    rel = oracle.sql(ORACLES[name])
    assert sorted(rel.columns) == columns
    order = [rel.columns.index(c) for c in columns]
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    want = sorted((tuple(plain(r[i]) for i in order) for r in rel.fetchall()), key=repr)
    assert got == want and got


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_queries_without_sql(spark):
    import json

    sf = str(SF)
    parts = spark.read.parquet(f"{sf}/part.parquet").count()
    decoded = QUERIES["image_decode"](spark, sf)
    assert decoded.count() == parts and decoded.where("error is not null").count() == 0
    traced = QUERIES["canny_contours"](spark, sf).where("reason = 'kept'")
    assert traced.select("image_id").distinct().count() == parts
    orders = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey").distinct().count()
    rows = QUERIES["nested_json"](spark, sf).collect()
    assert len(rows) == orders and all(json.loads(r["json"])["root"]["kind"] == "root" for r in rows)
    pages = QUERIES["skeleton_html"](spark, sf).collect()
    assert len(pages) == orders and all('class="node kind-text"' in r["html"] for r in pages)
