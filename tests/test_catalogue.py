"""Every third registered query, and some of each kind, against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from graphloom import catalogue

SF = "/root/testdata/sf0.001"


ALWAYS = {"q_type_status_recent", "q_ref_both", "q_project_status", "q_bfs_edges", "q_fts_phrase", "q_knn_dedup_node", "q_cdc_counts", "q_validate_all", "q_batch", "q_rebuild_edges", "q_incremental_fields", "q_coerce_fields", "q_patch_all", "q_fts_group", "q_fts_phrase_rank", "q_update_edges", "q_bulk_update_edges", "q_dup_near_block", "q_knn_cells", "q_parse_edges", "q_rename_links", "q_commit_batch_edges", "q_normalize_version", "q_schema_merge", "q_task_lists"}
NAMES = sorted(ALWAYS | set(sorted(catalogue.SQL)[::3]))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


def plain(v):
    return round(v, 9) if isinstance(v, float) else v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    a = sorted((tuple(plain(r[c]) for c in cols) for r in got.collect()), key=repr)
    rel = duck.sql(catalogue.SQL[name])
    assert sorted(rel.columns) == cols
    b = sorted((tuple(plain(dict(zip(rel.columns, x))[c]) for c in cols) for x in rel.fetchall()), key=repr)
    assert a == b
    assert a or name == "q_in_empty"


def test_every_sql_has_a_query():
    assert set(catalogue.SQL) <= set(catalogue.QUERIES)
