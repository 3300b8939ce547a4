"""Searches whose texts were dealt out to meet a small table: plans and results that would have shown it."""

from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import text as t
from ledgerlens.operators import evaluation, governance, hybrid, lexical, segments
from ledgerlens.plans.queries import CHANGED, QUERIES
from ledgerlens.sources import views


@pytest.fixture
def no_broadcast(spark):
    """As at a size where labels are too many to be sent to all tasks."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.fixture
def plans(monkeypatch):
    """The plan of each table that a module writes, by its name."""
    found = {}

    def watch(module):
        def write(df, name, put=module.write_shared):
            found[name] = df._jdf.queryExecution().executedPlan().toString()
            return put(df, name)

        monkeypatch.setattr(module, "write_shared", write)

    found["watch"] = watch
    return found


def _rows(df, *names):
    return sorted(tuple(r[c] for c in names) for r in df.collect())


def test_hits_meet_labels_not_texts(spark, data, no_broadcast, plans):
    plans["watch"](lexical)
    found = QUERIES["bm25f_count_topk"](spark, data)
    plan = plans["hits"]
    assert "SortMergeJoin" not in plan and plan.index("Exchange hashpartitioning") < plan.index("MapInArrow")  # the outer step comes first in a plan
    want = lexical.retrieve(views.entries(spark, data), views.queries(spark, data), 5, frequency="count")
    names = ["query_id", "id", "rank", "score"]
    assert _rows(found, *names) == _rows(want, *names)


ODD = [None, "", " ", "a b", "Ab_1 c2 C2, x", "İKK ſS zz", "汉", "汉字库 and 漢x字", "é🙂ab\x00cd\tEF gh", "㐀㐁鿿", "__ 9 99", "ab" * 300]


@pytest.mark.parametrize("start", [0, 3])
def test_tokens_of_a_batch_are_those_of_the_column(spark, start):
    rows = spark.createDataFrame(list(enumerate(ODD)), "i int, x string").coalesce(1)
    want = {r["i"]: sorted(r["t"] or []) for r in rows.select("i", t.all_tokens(F.col("x")).alias("t")).collect()}
    token, row = lexical.batch_tokens(pa.array(ODD, pa.string()).slice(start))
    got = {i: [] for i in range(start, len(ODD))}
    for x, i in zip(token.to_pylist(), row.tolist()):
        got[i + start].append(x)
    assert {i: sorted(x) for i, x in got.items()} == {i: x for i, x in want.items() if i >= start}


@pytest.mark.parametrize("identifiers", [False, True])
@pytest.mark.parametrize("frequency", ["presence", "count"])
def test_hits_and_lengths_are_those_of_tokens(spark, identifiers, frequency):
    rows = [(i, ODD[-i], ["Tag_x", x] if i % 3 else [], x, [(2, 4)] if i % 2 else []) for i, x in enumerate(ODD)]
    entries = spark.createDataFrame(rows, "id long, title string, tags array<string>, text string, redlines array<struct<`from`: int, `to`: int>>").coalesce(1)
    words = ["ab", "汉字", "c2", "tag_x", "99", "zz", "tag"]
    got = {r["id"]: r for r in lexical.entry_hits(entries, words, frequency, identifiers=identifiers).collect()}
    for r in lexical.fielded(entries, identifiers).collect():
        fields = [r[f"tok_{f}"] for f in lexical.FIELDS]
        for f, x in zip(lexical.FIELDS, fields):
            assert (got[r["id"]][f"dl_{f}"], got[r["id"]][f"tl_{f}"]) == ((None, None) if x is None else (len(set(x)), len(x)))
        tf = lambda w, x: x.count(w) if frequency == "count" else int(w in x)
        want = [] if None in fields else [(n, *(tf(w, x) for x in fields)) for n, w in enumerate(words) if any(w in x for x in fields)]
        assert [tuple(h) for h in got[r["id"]]["hits"]] == want


def test_recall_and_window_leave_texts_in_place(spark, data, no_broadcast, plans):
    plans["watch"](lexical)
    plans["watch"](hybrid)
    found = QUERIES["rerank_topk"](spark, data)
    assert plans["hits"].index("Exchange hashpartitioning") < plans["hits"].index("MapInArrow")
    shown = plans["shown"]
    assert shown.index("Exchange") < shown.index("BroadcastHashJoin")  # the window's entries are taken where texts are read, before anything is dealt out
    e, q = views.entries(spark, data), views.queries(spark, data)
    v = views.table(spark, data, "embeddings").select(F.col("vec_id").alias("key"), "embedding")
    asked = q.select("query_id").join(v, F.col("query_id") == F.col("key")).select("query_id", "embedding")
    scores = governance.window_scores(views.signals(spark, data), views.now()).select("entry_id", "window_score")
    want = hybrid.hybrid_search(e, q, v, asked, views.now(), scores, CHANGED)
    names = ["query_id", "id", "rank", "score"]
    assert found.count() and _rows(found, *names) == _rows(want, *names)


def test_needles_come_to_documents(spark, plans):
    """Needles in blocks, without inner words, of none, in a null text; documents are neither shuffled nor joined."""
    texts = ["the quick brown fox", "quick brown", "a brown", "ab", None, "汉字 in brown foxes", "the quick brown foxes"]
    needles = ["quick brown fox", "brown", "b", "", "none such here", "he quick brown f", "字 in br", "the quick brown fox"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, body string").coalesce(1)
    asked = spark.createDataFrame(list(enumerate(needles)), "query_id int, needle string")
    want = sorted((q, d) for q, n in enumerate(needles) for d, x in enumerate(texts) if n and x and n in x)
    plans["watch"](evaluation)
    for block in (1, 3, 100):
        found = evaluation.containing(docs, asked, block)
        assert _rows(found, "query_id", "doc_id") == want
    plan = plans["holding"]
    assert "MapInArrow" in plan and "Exchange" not in plan and "Join" not in plan


def test_refreshes_read_entries_that_met_their_labels_once(spark, data, no_broadcast, plans):
    plans["watch"](segments)
    assert QUERIES["refreshed_index_topk"](spark, data).count()
    assert "toxic" not in plans["stale"] and "toxic" not in plans["touched"]
    assert "ShuffledHashJoin" in plans["touched"] and "SortMergeJoin" not in plans["touched"].split("ShuffledHashJoin")[0]
