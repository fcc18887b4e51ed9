"""Every registered query against its SQL in another engine, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from tarnflow import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


def normal(df: pd.DataFrame) -> list[tuple]:
    rows = df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None).itertuples(index=False)
    return sorted((tuple(None if v is None else round(float(v), 6) if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v) for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name not in catalog.ORACLE_SQL:
        assert len(got)
        return
    expected = duck.execute(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert normal(got) == normal(expected)


def test_pushdown(spark):
    """Filters and columns reach the scan."""
    plan = catalog.QUERIES["filter_rows"](spark, SF)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(o_orderstatus), IsNotNull(o_totalprice), EqualTo(o_orderstatus,F)" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_totalprice:double>" in plan


def test_kmeans_matches_lloyd(spark):
    import numpy as np

    df = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").toPandas()
    x = np.array(df.embedding.tolist(), float)
    c = x[:10].copy()
    for _ in range(5):
        near = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        c = np.array([x[near == k].mean(0) if (near == k).any() else c[k] for k in range(10)])
    got = catalog.QUERIES["kmeans"](spark, SF).orderBy("cluster", "dim").toPandas()
    assert np.allclose(got.value.to_numpy().reshape(c.shape), c, atol=1e-5)


def test_components_of_the_whole_graph(spark, duck):
    pairs = duck.execute("SELECT DISTINCT l_partkey, l_suppkey + 100000000 FROM lineitem").fetchall()
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.node: r.component for r in catalog.QUERIES["connected_components_hubs"](spark, SF).collect()}
    assert got == {x: find(x) for x in root} and duck.execute("SELECT count(DISTINCT l_partkey) + count(DISTINCT l_suppkey) FROM lineitem").fetchone()[0] == len(got)


def test_pagerank_of_the_whole_graph(spark, duck):
    import numpy as np

    pairs = np.array(duck.execute("SELECT DISTINCT l_partkey, l_suppkey + 100000000 FROM lineitem").fetchall())
    nodes, at = np.unique(pairs, return_inverse=True)
    a, b = at.reshape(pairs.shape).T
    src, dst = np.concatenate((a, b)), np.concatenate((b, a))
    degree, rank = np.bincount(src), np.full(len(nodes), 1 / len(nodes))
    for _ in range(10):
        rank = 0.15 / len(nodes) + 0.85 * np.bincount(dst, rank[src] / degree[src], len(nodes))
    got = {r.node: r.rank for r in catalog.QUERIES["pagerank"](spark, SF).collect()}
    assert set(got) == set(nodes.tolist()) and np.allclose([got[k] for k in nodes.tolist()], rank * 1e6, atol=2e-3)


def test_joins_of_whole_tables(spark, duck):
    """No customer and no order is left out of a full join."""
    for name in ("join_full", "keyed_join_outer"):
        out = catalog.QUERIES[name](spark, SF).selectExpr("count(distinct c)", "count(distinct r_o)", "count_if(c is null) > 0", "count_if(r_o is null) > 0").first()
        assert tuple(out) == (*duck.execute("SELECT (SELECT count(*) FROM customer), (SELECT count(*) FROM orders)").fetchone(), True, True)
