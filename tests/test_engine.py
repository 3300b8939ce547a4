"""What SQL cannot express, and edge cases, against small plain versions."""

from __future__ import annotations

import itertools
import json
import math
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlens.functions import params as p
from ledgerlens.functions import text as t
from ledgerlens.operators import documents, evaluation, governance, index, lexical, ranking, store
from ledgerlens.sources import files, views
from ledgerlens.streaming import streams


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first()["x"]


def test_tokens(spark):
    rows = {"Foo foo_bar x ab1": ["ab1", "foo", "foo_bar"], "知识库 a 中": ["中", "知识", "识库"], "": [], "K ſ Éa": []}
    for text, want in rows.items():
        assert one(spark, t.tokenize(F.col("s")), s=text) == want
    assert one(spark, t.all_tokens(F.col("s")), s="Foo foo") == ["foo", "foo"]
    for name, parts in {"HTTPServer_utf8": ["http", "httpserver", "server", "utf", "utf8"], "updateEntryText": ["entry", "text", "update"], "plain": []}.items():
        got = one(spark, t.subtokens(F.col("s")), s=name)
        assert set(got) <= set(parts) and {"plain": set(), "updateEntryText": {"entry", "text", "update"}}.get(name, {"server", "utf", "utf8"}) <= set(got)


def _redline(text, ranges):
    out, at = "", 0
    for a, b in sorted(ranges):
        a, b = max(0, a - 1), min(len(text), b)
        if b > at and a < len(text):
            out += (text[at:a] if a > at else "") + "[…]"
            at = b
    return out + text[at:]


def test_redlines(spark):
    cases = [("abcdefghij", r) for r in ([], [(1, 3)], [(2, 4), (3, 6)], [(2, 8), (3, 4)], [(9, 20)], [(11, 12)], [(0, 2), (5, 5)])]
    df = spark.createDataFrame([(i, x, [dict(zip(("from", "to"), q)) for q in r]) for i, (x, r) in enumerate(cases)], "i int, s string, r array<struct<`from`: int, `to`: int>>")
    got = {r["i"]: (r["a"], r["b"]) for r in df.select("i", t.redline(F.col("s"), F.col("r")).alias("a"), t.redline_ratio(F.col("s"), F.col("r")).alias("b")).collect()}
    for i, (x, r) in enumerate(cases):
        assert got[i] == (_redline(x, r), sum(max(0, min(10, b) - max(0, a - 1)) for a, b in r) / 10)


def test_scalars(spark):
    assert one(spark, t.round_half_up(F.col("v"), 0), v=-0.5) == 0
    assert one(spark, t.exact_phrase(F.lower(F.col("h")), F.col("q")), h="the big  fox", q=" Big  ") == 1.0
    assert one(spark, t.exact_phrase(F.col("h"), F.col("q")), h="quickly there", q="zz, quick") == 0.5
    assert one(spark, t.pack(F.array(F.lit("aaaa"), F.lit("bbbbbbbb"), F.lit("cc")), 8)) == ["aaaa", "cc"]
    assert one(spark, t.as_rate(F.col("v")), v=85.0) == 0.85 and one(spark, t.as_rate(F.col("v")), v=7.0) == 0.7
    assert json.loads(one(spark, t.lenient_json(F.col("s")), s='sure: {"a": 1} ok')) == {"a": 1}
    assert one(spark, t.posix_path(F.col("s")), s=".\\a\\b.ts") == "a/b.ts" and one(spark, t.encode_segment(F.col("s")), s="/a b/c") == "-a-b-c"
    white, black = t.luminance(F.lit(255), F.lit(255), F.lit(255)), t.luminance(F.lit(0), F.lit(0), F.lit(0))
    assert one(spark, t.contrast(white, black)) == 21.0
    assert one(spark, t.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0)))) == 0.0
    assert one(spark, F.array_join(t.assets(F.col("s")), ","), s='<link rel="x" href="b.css"><script src="a.js"></script><script src="https://x/y.js"></script>') == "a.js,b.css"
    html = "<h1>T &amp; x</h1><script>bad()</script><ul><li>a</li><li>b</li></ul><table><tr><td>1</td><td>2</td></tr></table>"
    assert one(spark, t.html_to_markdown(F.col("s")), s=html) == "# T & x\n\n- a\n- b\n\n1 | 2 |"


def test_query_profiles(spark):
    q = "fix  `code` src/a.ts API_KEY v2.1 focus-trap plainword updateText"
    for name in p.PROFILES:
        n = t.normalize_query(F.col("q"), name)
        r = spark.range(1).select(F.lit(q).alias("q")).select(n["lexical"].alias("l"), n["semantic"].alias("s"), n["identifiers"].alias("i"), n["truncated"].alias("t")).first()
        assert not r["t"] and "  " not in r["l"] and ("code" in r["l"]) == (name != "pre-step")
        assert r["i"] == (["src/a.ts", "API_KEY", "v2.1", "focus-trap", "updateText"] if name == "gate" else [])
        assert ("src/a.ts" in r["s"]) == (name != "gate")
    n = t.normalize_query(F.col("q"), "pre-step")
    assert one(spark, F.length(n["lexical"]), q="ab " * 900) == 1200


def test_index_equals_scan_and_notices_changes(spark, data, tmp_path):
    e, q = lexical.visible(views.entries(spark, data)), views.queries(spark, data)
    index.write_index(e, str(tmp_path))
    ix = index.read_index(spark, str(tmp_path))
    assert index.is_current(ix, e)
    changed = e.withColumn("text", F.when(F.col("id") == 1, "other words").otherwise(F.col("text"))).filter("id <> 2")
    assert not index.is_current(ix, changed)
    assert {(r["id"], r["state"]) for r in index.stale(ix, changed).collect()} == {(1, "changed"), (2, "gone")} & {(r["id"], s) for r in e.select("id").collect() for s in ("changed", "gone")}
    for scorer, frequency in (("bm25", "presence"), ("bm25", "count"), ("weights", "presence")):
        scan = {(r["query_id"], r["id"], r["score"]) for r in lexical.retrieve(e, q, 5, scorer=scorer, frequency=frequency).collect()}
        assert scan == {(r["query_id"], r["id"], r["score"]) for r in index.search(ix, q, 5, scorer, frequency).collect()}


def test_fusion_by_hand(spark):
    rows = [(1, "lexical", 1.0, 1, "a"), (1, "lexical", 1.0, 2, "b"), (1, "vector", 0.3, 2, "b"), (1, "vector", 0.3, 3, "c"), (1, "vector", 0.3, 9, "b"), (1, "vector", 0.3, 4, "d")]
    got = {r["key"]: r for r in ranking.fuse(spark.createDataFrame(rows, "query_id int, channel string, weight double, rank int, key string")).collect()}
    assert got["b"]["fused"] == round(1 / 62 + 0.3 / 62, 9) and got["b"]["ranks"] == {"lexical": 2, "vector": 2}
    assert [k for k, _ in sorted(got.items(), key=lambda x: x[1]["position"])] == ["b", "a", "c", "d"]
    kept = ranking.quota(ranking.fuse(spark.createDataFrame(rows, "query_id int, channel string, weight double, rank int, key string")), 1)
    assert {r["key"] for r in kept.collect()} == {"a", "b", "c"}


def test_hash_embedder_and_cache(spark):
    texts = spark.createDataFrame([("a", "one two two"), ("b", ""), ("c", "one two")], "key string, text string")
    got = {r["key"]: r["embedding"] for r in ranking.hash_embed(texts, 32).collect()}
    assert got["a"] == got["c"] and math.isclose(sum(x * x for x in got["a"]), 1, abs_tol=1e-6) and not any(got["b"])
    calls = []
    broken = lambda xs: [[float(len(x))] for x in xs] if "one two" not in xs or len(xs) == 1 else 1 / 0
    empty = spark.createDataFrame([], "version string, cache_key string, vector array<float>")
    built = ranking.build_vectors(texts, empty, "v", broken, 8)
    assert {r["vector"][0] for r in built.collect()} == {0.0, 7.0, 11.0} and not calls
    assert ranking.embed_plan(texts, built, "v").filter("not cached").count() == 0


def _chunks(text):
    """Sections by a second, line-by-line reading."""
    lines = text.split("\n")
    while lines and lines[-1] == "":
        lines.pop()
    fence, heads = None, []
    for i, x in enumerate(lines):
        m = re.match(r"\s*(```+|~~~+)", x)
        if m:
            fence = m[1][0] if fence is None else None if fence == m[1][0] else fence
        elif fence is None and re.match(r"#{1,6}\s+\S", x):
            heads.append(i)
    return lines, heads


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["# A", "## B b", "text " * 20, "", "```", "~~~", "# not # a", "x" * 900, "short"]), max_size=40))
def test_chunks_cover_the_document(parts):
    text = "\n".join(parts)
    lines, heads = _chunks(text)
    got = documents.chunk(text)
    assert [c[0] for c in got] == list(range(1, len(got) + 1))
    covered = {n for c in got for n in range(c[2], c[3] + 1)}
    assert {i + 1 for i, x in enumerate(lines) if x.strip()} <= covered
    for c in got:
        assert not any(c[2] - 1 < h <= c[3] - 1 for h in heads)  # no chunk goes over a heading
        body = "\n".join(lines[c[2] - 1 : c[3]])
        assert c[4] == len(body) and (c[4] <= p.CHUNK_CHARS or c[2] == c[3])
    for a, b in zip(got, got[1:]):
        if b[6] is not None:
            assert b[6] == a[0] and a[2] < b[2]


def test_chunk_headings():
    got = documents.chunk("intro\n# A\nx\n## B\ny\n# C\n```\n# no\n```\n")
    assert [(c[1], c[2], c[3]) for c in got] == [("", 1, 1), ("A", 2, 3), ("A > B", 4, 5), ("C", 6, 9)]


def test_chunk_search_respects_redlines_and_overlap(spark):
    long = "\n".join(f"line {i} common word{i} " + "pad " * 30 for i in range(20))
    docs = spark.createDataFrame([("d", long), ("e", "# Head common\nbody"), ("f", "common here")], "doc_id string, text string")
    ch = documents.chunk_documents(docs, bodies=True)
    ask = spark.createDataFrame([(1, "d", "common"), (2, "e", "head common"), (3, "f", "common")], "query_id int, doc_id string, query string")
    red = spark.createDataFrame([("f", 1, 5)], "doc_id string, from_line int, to_line int")
    rows = documents.search_chunks(ch, ask, red, 50).collect()
    assert [r["seq"] for r in rows if r["query_id"] == 1] == [1]  # each later window repeats part of a match
    assert [r["score"] for r in rows if r["query_id"] == 2] == [6.0]
    assert not [r for r in rows if r["query_id"] == 3]


def test_every_transition(spark):
    cases = [(i, *x) for i, x in enumerate(itertools.product(p.STATUSES, p.STATUSES, p.TRIGGERS))]
    e = spark.createDataFrame([(i, a) for i, a, *_ in cases], "id long, status string").withColumn("discarded_at", F.lit(None).cast("timestamp_ntz"))
    c = spark.createDataFrame([(i, b, g, "r") for i, _, b, g in cases], "id long, to_status string, trigger string, reason string")
    after, refused = governance.transition(e, c, views.now())
    legal = {i for i, a, b, g in cases if (a, b, g) in p.EDGES}
    assert {r["id"] for r in refused.collect()} == {i for i, *_ in cases} - legal
    for r in after.collect():
        _, a, b, _ = cases[r["id"]]
        assert r["status"] == (b if r["id"] in legal else a) and len(r["history"]) == (r["id"] in legal)
        assert (r["discarded_at"] is not None) == (r["id"] in legal and b == "discarded")


def _greedy(nodes, similar):
    out, free = {}, [i for i, _ in nodes]
    project = dict(nodes)
    for seed in [i for i, _ in nodes]:
        if seed not in free:
            continue
        free.remove(seed)
        cluster, grew = [seed], True
        while grew:
            grew = False
            for i in list(free):
                if all(project[i] != project[m] for m in cluster) and any((min(i, m), max(i, m)) in similar for m in cluster):
                    cluster.append(i)
                    free.remove(i)
                    grew = True
        if len(cluster) > 1:
            out |= dict.fromkeys(cluster, seed)
    return out


def test_clusters_are_greedy(spark):
    import random

    r = random.Random(4)
    nodes = [(i, f"p{r.randint(0, 4)}") for i in range(40)]
    pairs = {(a, b) for a in range(40) for b in range(a + 1, 40) if nodes[a][1] != nodes[b][1] and r.random() < 0.06}
    v = spark.createDataFrame(nodes, "id long, project string")
    got = governance.clusters(v, spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "a long, b long, similarity double"))
    assert {x["id"]: x["cluster"] for x in got.collect()} == _greedy(nodes, pairs)


def test_logistic_is_gradient_descent(spark):
    rows = [(x / 10, (x * 7 % 10) / 10, int(x % 3 == 0)) for x in range(30)]
    got = evaluation.train_logistic(spark.createDataFrame(rows, "a double, b double, label int"), ["a", "b"], epochs=15)
    w = [0.0, 0.0, 0.0]
    for _ in range(15):
        g = [0.0, 0.0, 0.0]
        for a, b, y in rows:
            e = 1 / (1 + math.exp(-(w[0] * a + w[1] * b + w[2]))) - y
            g = [g[0] + e * a, g[1] + e * b, g[2] + e]
        w = [x - 0.1 / len(rows) * d for x, d in zip(w, g)]
    assert all(math.isclose(got[k], x, abs_tol=1e-9) for k, x in zip(("a", "b", "bias"), w))
    with pytest.raises(ValueError, match="one kind"):
        evaluation.train_logistic(spark.createDataFrame(rows, "a double, b double, label int").filter("label = 1"), ["a"])


def test_ndcg_by_hand(spark):
    qrels = spark.createDataFrame([(1, "a", 2.0), (1, "b", 1.0), (1, "c", 0.0), (2, "z", 1.0)], "query_id int, doc_id string, grade double")
    top = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (1, "x", 3)], "query_id int, doc_id string, rank int")
    got = {r["query_id"]: r for r in evaluation.retrieval_metrics(top, qrels).collect()}
    assert math.isclose(got[1]["ndcg"], (1 + 3 / math.log2(3)) / (3 + 1 / math.log2(3)), abs_tol=1e-9) and round(got[1]["ndcg"], 4) == 0.7967
    assert got[1]["recall"] == 1 and got[1]["rr"] == 1 and got[2]["ndcg"] == got[2]["rr"] == 0


def test_judge_answers_that_say_nothing(spark):
    a = spark.createDataFrame([(1, "no json", 3, 0), (2, '{"relevance": 8}', 0, 2)], "id int, raw string, retrieved int, gold_points int")
    got = {r["id"]: r for r in evaluation.judge_metrics(a).collect()}
    assert got[1]["faithfulness"] is None and got[2]["relevance"] == 0.8 and got[2]["context_precision"] == 0 == got[2]["context_recall"]


def test_rerank_explains_its_score(spark, data):
    from ledgerlens.plans.queries import QUERIES

    for r in QUERIES["rerank_explained"](spark, data).limit(20).collect():
        parts = re.findall(r"([+-]\d+\.\d{4})", r["lines"])
        factors = re.findall(r"x(\d\.\d\d)", r["lines"])
        assert math.isclose(r["score"], sum(map(float, parts)) * math.prod(map(float, factors)), abs_tol=2e-3)


def test_model_order_is_repaired(spark):
    base = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], "query_id int, id string, rank int")
    ans = spark.createDataFrame([(1, 'I say ```json\n{"order": ["c", "zz", "c", "a"]}\n```')], "query_id int, raw string")
    got = sorted((r["final_rank"], r["id"]) for r in ranking.permuted(base, ans).collect())
    assert [i for _, i in got] == ["c", "a", "b"]


def test_files(spark, tmp_path):
    (tmp_path / "qrels").mkdir()
    (tmp_path / "corpus.jsonl").write_text('{"_id":"1","title":"t","text":"x"}\n\n')
    (tmp_path / "queries.jsonl").write_text('{"_id":"q1","text":"a"}\n{"_id":"q2","text":"b"}\n')
    (tmp_path / "qrels" / "test.tsv").write_text("query-id\tcorpus-id\tscore\nq1\t1\t0\nq1\t2\t2\n")
    got = files.read_beir(spark, str(tmp_path))
    assert [r["query_id"] for r in got["queries"].collect()] == ["q1"] and {r["doc_id"]: r["grade"] for r in got["qrels"].collect()} == {"1": 1.0, "2": 2.0}
    ledger = str(tmp_path / "signals")
    files.append_jsonl(spark.createDataFrame([("2024-01-01T00:00:00Z", "k", "positive", "human", 5.0, ""), ("nonsense", "k", "positive", "human", 5.0, "")], files.SIGNAL), ledger)
    assert files.read_signals(spark, ledger).count() == 1
    now = F.lit(views.NOW).cast("timestamp_ntz")
    src = spark.createDataFrame([("a.md", "one\ntwo"), ("a.md", "three"), ("b.html", "<p>x</p>")], "path string, content string").withColumn("at", now)
    snaps = files.ingest_snapshots(src, spark.createDataFrame([], "doc_id string, path string, at timestamp_ntz"))
    assert snaps.count() == 3 and snaps.filter("supersedes is not null").count() == 1
    again = files.ingest_snapshots(src, snaps.select("doc_id", "path", "at"))
    assert again.count() == 0
    both = files.upsert(spark.createDataFrame([(1, 1, "a")], "k int, v int, x string"), spark.createDataFrame([(1, 2, "b"), (2, 1, "c")], "k int, v int, x string"), "k", "v")
    assert {(r["k"], r["x"]) for r in both.collect()} == {(1, "b"), (2, "c")}


def test_streams_equal_batch(spark, data):
    events = views.table(spark, data, "events")
    got = streams.drain(streams.stream_scores(streams.signals_stream(spark, data)), "test_scores", "complete")
    batch = streams.stream_scores(views.to_signals(events))
    assert got.count() == batch.count() and got.exceptAll(batch.select(*got.columns)).count() == 0


def test_store_changes(spark, data):
    now = views.now()
    e = views.entries(spark, data)
    ids = spark.createDataFrame([(1,), (2,)], "id long")
    flagged = store.flag_review(e, ids.withColumn("reason", F.lit("why")))
    twice = store.flag_review(flagged, ids.withColumn("reason", F.lit("why")))
    assert {r["id"] for r in flagged.filter("review_reason = 'why' and needs_review").collect()} == {1, 2} and flagged.exceptAll(twice).count() == 0
    cleared = store.clear_review(flagged, ids)
    assert cleared.filter("id in (1, 2) and (needs_review or review_reason is not null)").count() == 0 and cleared.filter("needs_review").count() == e.filter("needs_review").count()
    assert store.touch(e, ids, now).filter(F.col("last_referenced_at") == now).filter("id in (1, 2)").count() == 2
    none = spark.createDataFrame([], "entry_id long, action string, reason string, score double, created_at timestamp_ntz, resolved_at timestamp_ntz, resolution string")
    want = spark.createDataFrame([(1, "promote", "r", 20.0), (1, "promote", "r", 20.0), (2, "retire", "r", 0.0)], "entry_id long, action string, reason string, score double")
    first = store.request_approvals(none, want, now)
    assert first.count() == 2 and store.request_approvals(first, want, now).count() == 0
    assert store.list_entries(e, status="candidate", tier="project").count() == e.filter("status = 'candidate' and tier = 'project'").count()
    with pytest.raises(ValueError, match="unknown status"):
        store.list_entries(e, status="lost")
    with pytest.raises(Exception, match="unknown signal"):
        store.signal_rows(spark.createDataFrame([(1, "cheer", "")], "entry_id long, signal string, note string"), now).collect()
    files_ = lambda *rows: spark.createDataFrame(rows, "path string, hash string")
    assert {(r["path"], r["state"]) for r in store.stale_sources(files_(("a", "1"), ("b", "1"), ("c", "1")), files_(("a", "1"), ("b", "2"), ("d", "1"))).collect()} == {("b", "changed"), ("c", "gone"), ("d", "new")}
    cited = store.cite(e, spark.createDataFrame([(1,), (10**9,)], "id long"))
    assert {r["id"]: r["found"] for r in cited.collect()} == {1: True, 10**9: False}
