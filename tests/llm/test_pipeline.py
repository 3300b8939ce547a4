"""The pipeline, stage by stage against brute force on what the stage was given, and SQL against the queries."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
import duckdb
import pytest

import __spark_entry__ as entry
from ledgerlens.llm import decontaminate, quality, queries
from ledgerlens.llm.common import materialize, table

from .test_near_copies import groups_of
from .test_operators import _domain, _mixture


def test_stages(spark, data):
    docs = table(spark, data, "documents")
    columns = docs.columns
    items = [decontaminate.plain(r["text"]) for r in table(spark, data, "benchmark").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()} if name != "sharding" else None
        given, docs = docs, materialize(stage(spark, docs, data), f"test-{name}")
        after = docs.collect()
        if name != "sharding":
            assert docs.columns == columns
        if name == "quality":
            scorer = queries.quality_model(spark, data, given).scorer()
            assert {r["doc_id"] for r in after} == {d for d, r in before.items() if scorer(r["text"] or "")[0] >= 0.5}
        elif name == "near_duplicates":
            ids = sorted(before)  # all pairs by true similarity
            assert sorted(r["doc_id"] for r in after) == sorted({ids[i] for i in groups_of([before[d]["text"] for d in ids])})
        elif name == "decontamination":
            gone = set(before) - {r["doc_id"] for r in after}
            assert {d for d, r in before.items() if any(i in decontaminate.plain(r["text"] or "") for i in items)} <= gone
        elif name == "mixing":
            want = _mixture([(d, r["text"], r["lang"], r["source"]) for d, r in before.items()], _domain, queries.WEIGHTS, queries.SHARE, queries.MAX_EPOCHS, queries.SEED)
            per_doc = Counter()
            for (d, *_), n in want.items():
                per_doc[d] += n
            assert Counter(r["doc_id"] for r in after) == per_doc
        else:
            assert Counter(r["doc_id"] for r in after) == Counter(r["doc_id"] for r in given.collect())
    assert quality.SAMPLE and len(corpus_pipeline.STAGES) == 5


def test_pipeline_on_odd_tables(spark, odd, empty, data):
    for docs in (odd, empty):
        for name, stage in corpus_pipeline.STAGES:
            docs = materialize(stage(spark, docs, data), f"odd-{name}")
            assert name == "sharding" or docs.columns == odd.columns


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_agrees(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    got = entry.queries()[name](spark, data)
    assert sorted(got.columns) == sorted(want.columns)
    names = sorted(got.columns)
    mine = Counter(tuple(r[c] for c in names) for r in got.collect())
    theirs = Counter(tuple(r[want.columns.index(c)] for c in names) for r in want.fetchall())
    assert mine == theirs
