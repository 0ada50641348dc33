"""Queries against their DuckDB SQL at the smallest scale (the driver compares all at a larger one)."""

import os

import duckdb
import pytest

from graphlode.plans import catalog

SF = "/root/testdata/sf0.001"
SOME = ["bm25_topk", "rank_rrf", "pool_mean", "metrics_overall", "bootstrap_ci", "cluster_summary", "graph_stats", "hash_embed_buckets", "node_merge", "prng_draws", "similar_nodes", "tune_leaderboard", "url_path_normalize", "chunk_windows", "chunk_next_edges", "graph_edges_dedup", "holdout_assign", "kfold_assign", "labels_build", "labels_from_passages", "link_resolve", "vector_topk"]


def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        p = f"{SF}/{f}"
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return c


@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    want = duck().sql(catalog.ORACLE[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    rows = [sorted(map(repr, x[cols].astype(object).values.tolist())) for x in (got, want)]
    assert rows[0] == rows[1]


@pytest.mark.parametrize("name", ["candidates_fullouter", "rank_rrf", "rank_vector", "rank_bm25", "pool_sum", "metrics_overall"])
def test_all_candidates(spark, name):
    """200 candidates a signal, in the queries and in their SQL."""
    assert catalog.CAND == 200
    sql, few = catalog.ORACLE[name], catalog.SQL_CAND
    assert f"{few} + bt.rank" in sql and sql.count(f"rank <= {few})") == 2
    got = catalog.QUERIES[name](spark, SF).toPandas()
    want = duck().sql(sql.replace(f"{few} + bt.rank", "200 + bt.rank").replace(f"rank <= {few})", "rank <= 200)")).df()
    cols = sorted(want.columns)
    rows = [sorted(map(repr, x[cols].astype(object).values.tolist())) for x in (got, want)]
    assert rows[0] == rows[1]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
