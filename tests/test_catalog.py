"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from notegraph import catalog

DATA = "/root/testdata/sf0.001"
SOME = (
    "fp_key_to_key fp_all fp_not_3vl fp_glob_scope fp_repo_pattern fn_matches pr_select sl_default_order_limit sc_live jn_has_dangling jn_links_exists_theta "
    "jn_links_all st_set_algebra ag_distinct_degree gr_bfs_both gr_budget ft_phrase ft_bm25 vs_semantic_filter hs_since_gap hs_reconcile hs_bursts "
    "hs_push sc_ndjson st_modes pr_absent vf_selection wr_worker wr_replay sh_writable fp_repo_sigils ln_syntaxes vs_embed_reuse ln_resolve ln_stale vf_chain vf_cycle vf_chunks vf_links"
).split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


def rounded(x):
    return round(x, 6) if isinstance(x, float) else x


@pytest.mark.parametrize("name", SOME)
def test_query(spark, sql, name):
    df = catalog.queries()[name](spark, DATA)
    got = sql.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in got.description]
    assert sorted(df.columns) == sorted(names)
    cols = sorted(names)
    want = sorted((tuple(rounded(dict(zip(names, r, strict=True))[c]) for c in cols) for r in got.fetchall()), key=repr)
    assert sorted((tuple(rounded(r[c]) for c in cols) for r in df.collect()), key=repr) == want


def test_entry(spark):
    got = entry.entry(spark)
    assert got.columns == ["$path", "$updated_at", "$version_id"] and got.count() > 0


def test_every_query_has_sql_or_is_known():
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == {"ft_porter", "fn_chunker", "ln_repair", "fn_diff"}
