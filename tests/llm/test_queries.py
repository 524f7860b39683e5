"""The registered queries of the corpus operators against their SQL, and what each returns, on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from callscope.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_url_filters": {"page_id", "host", "path", "rule", "verdict"},
    "op2_quality": {"doc_id"},
    "op3_simhash": {"doc_id", "fingerprint", "component_id"},
    "op4_lm_scoring": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    "op5_mixing": {"doc_id", "size", "source_size", "target", "taken"},
    "op6_fingerprints": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
    "op7_repeats": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"},
    "op8_sharding": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
    "op9_decontamination": {"doc_id"},
    "op10_secrets": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"},
    "op11_divergence": {"lang", "source", "part", "item", "value", "rank"},
    "op12_pii": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"},
    "op13_prefix_trie": {"conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"},
}


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    return round(float(x), 4) if isinstance(x, float) else x


def rows(names, found):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    got = queries.QUERIES[name](spark, SF)
    want = con.sql(queries.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns) and rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_returns_whole_tables(spark, name):
    """Every document or page once; only the search for benchmark items may find none or several in one. Groups and nodes are held against SQL above."""
    got = queries.QUERIES[name](spark, SF)
    assert COLUMNS[name] <= set(got.columns)
    if name not in ("op9_decontamination", "op11_divergence", "op13_prefix_trie"):
        key, table = ("page_id", "pages") if name == "op1_url_filters" else ("doc_id", "documents")
        ids = sorted(r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect())
        assert sorted(r[0] for r in got.select(key).collect()) == ids


def test_pipeline_over_the_smallest_tables(spark):
    got = corpus_pipeline.run(spark, SF).collect()
    assert got and {r.shard for r in got} <= set(range(8))
