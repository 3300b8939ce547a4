"""Every registered query of the engine against its SQL, computed by DuckDB on the same tables."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest

from ledgerlens.plans.oracles import ORACLES
from ledgerlens.plans.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return con


def test_every_query_has_sql_or_a_test_of_its_own():
    own = {"rerank_explained", "query_normalize_profiles", "identifier_subtokens", "hash_embed", "chunk_documents", "chunk_search", "chunk_browse", "ltr_train_logistic", "generalize_clusters", "chunk_search_fused", "chunk_excerpts", "redlined_chunks", "replaced_chunk_layer"}
    assert set(QUERIES) - set(ORACLES) == own


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, data, name):
    got, want = QUERIES[name](spark, data), duck.sql(ORACLES[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    plain = lambda x: float(x) if hasattr(x, "as_tuple") else x
    mine = Counter(tuple(plain(r[c]) for c in names) for r in got.collect())
    at = [want.columns.index(c) for c in names]
    assert mine == Counter(tuple(plain(r[i]) for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0
