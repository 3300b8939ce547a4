"""Small operators on rows made for them."""

from __future__ import annotations

import random
import time
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import text as t
from ledgerlens.operators import documents, evaluation, governance, hybrid, layout, lexical, ranking, roster, store
from ledgerlens.sources import files, views
from ledgerlens.streaming import streams

def test_p90_is_the_discrete_point(spark):
    r = random.Random(1)
    rows = [(q, r.choice([0.0, 1.0, r.random(), r.random() * 1000, 1e-9])) for q in range(8) for _ in range(q * q * 7 + 1)]
    got = {x["query_id"]: x["scale"] for x in lexical.p90_scale(spark.createDataFrame(rows, "query_id int, raw double")).collect()}
    for q in range(8):
        xs = sorted(x for i, x in rows if i == q and x > 0)
        assert got.get(q) == (xs[min(len(xs) - 1, int(len(xs) * 0.9))] if xs else None)


@pytest.mark.parametrize("threshold", [0.5, 0.75, 1.0])
def test_similar_pairs_against_all(spark, threshold):
    r = random.Random(int(threshold * 8))
    words = [f"w{i}" for i in range(12)]
    rows = [(i, f"p{i % 3}", " ".join(r.sample(words, r.randint(0, 5))), " ".join(r.sample(words, r.randint(0, 4)))) for i in range(60)]
    entries = spark.createDataFrame(rows, "id long, project string, title string, text string")
    share = lambda a, b: len(a & b) / min(len(a), len(b)) if a and b else 0.0
    want = {}
    for i, p, a, b in rows:
        for j, q, c, d in rows:
            if i < j and p != q:
                s = max(share(set(a.split()), set(c.split())), share(set(f"{a} {b}".split()), set(f"{c} {d}".split())))
                if s >= threshold:
                    want[i, j] = s
    got = governance.similar_pairs(entries, threshold).collect()
    assert {(x["a"], x["b"]): x["similarity"] for x in got} == pytest.approx(want) and len(got) == len(want)


@pytest.mark.parametrize("block", [3, 1024])
def test_vectors_in_blocks(spark, block):
    r = np.random.default_rng(5)
    v = [(i, r.normal(size=4 if i % 9 else 3).round(1).tolist()) for i in range(80)] + [(80, [0.0] * 4), (81, None)]
    vectors = spark.createDataFrame(v, "key long, embedding array<float>")
    got = ranking.vector_topk(vectors, vectors.filter("key < 10").select(F.col("key").alias("query_id"), "embedding"), 5, block=block).collect()
    for q in range(10):
        score = {}
        for k, x in v:
            if x and len(x) == len(v[q][1]) and any(x):
                a, b = np.float32(x).astype(float), np.float32(v[q][1]).astype(float)
                score[k] = np.floor(a @ b / np.linalg.norm(a) / np.linalg.norm(b) * 1e6 + 0.5) / 1e6
        best = sorted((-s, k) for k, s in score.items() if s > 0)[:5]
        assert [(x["key"], x["score"]) for x in sorted(got, key=lambda x: x["rank"]) if x["query_id"] == q] == [(k, pytest.approx(-s, abs=2e-6)) for s, k in best]


def test_hybrid_without_vectors_is_the_lexical_channel(spark, data):
    e, q = views.entries(spark, data), views.queries(spark, data)
    found = hybrid.recall(e, q)
    ranked = lexical.retrieve(e, q, 50)
    assert {(r["query_id"], r["key"], r["position"]) for r in found.fused.collect()} == {(r["query_id"], r["id"], r["rank"]) for r in ranked.collect()}
    top = hybrid.hybrid_search(e, q, None, None, views.now(), limit=3, window=10)
    assert max(r["rank"] for r in top.collect()) == 3 and {"features", "contributions", "factors"} <= set(top.columns)


def test_packing_a_group_in_steps(spark):
    r = random.Random(3)
    rows = [(g, i, "x" * r.randint(0, 30)) for g in "abc" for i in range(200)]
    got = {x["g"]: x["packed"] for x in documents.pack_groups(spark.createDataFrame(rows, "g string, i long, line string"), "g", "i", "line", 60).collect()}
    for g in "abc":
        left, out = 60, []
        for _, _, line in (x for x in rows if x[0] == g):
            if len(line) <= left:
                out.append(line)
                left -= len(line) + 1
        assert got[g] == "|".join(out)


def test_needles_in_documents(spark):
    r = random.Random(4)
    words = ["alpha", "beta", "c3", "d", "e.f", "漢字", "gamma-ray"]
    docs = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 12)))) for i in range(60)]
    needles = [(i, x) for i, x in enumerate(["alpha", "lpha beta c3 alp", "beta c3 d", "d", "e.f gamma-ray alpha", "漢字 漢字 d", "", "zzz yyy xxx", "a b"])]
    got = evaluation.containing(spark.createDataFrame(docs, "doc_id long, body string"), spark.createDataFrame(needles, "query_id long, needle string")).collect()
    want = {(q, d) for q, n in needles for d, b in docs if n and n in b}
    assert {(x["query_id"], x["doc_id"]) for x in got} == want and len(got) == len(want)


def test_later_judgements_count(spark, tmp_path):
    (tmp_path / "qrels").mkdir()
    (tmp_path / "corpus.jsonl").write_text('{"_id": "1", "title": "", "text": "a"}\n')
    (tmp_path / "queries.jsonl").write_text('{"_id": "q1", "text": "a"}\n{"_id": "q2", "text": "b"}\n')
    (tmp_path / "qrels" / "test.tsv").write_text("query-id\tcorpus-id\tscore\nq2\t1\t3\nq1\t1\t2\nq2\t1\t1\n")
    got = files.read_beir(spark, str(tmp_path))
    assert {(r["query_id"], r["grade"]) for r in got["qrels"].collect()} == {("q1", 2.0), ("q2", 1.0)}
    first = files.read_beir(spark, str(tmp_path), max_queries=1)
    assert [r["query_id"] for r in first["queries"].collect()] == ["q2"] == [r["query_id"] for r in first["qrels"].collect()]


def test_stored_vectors(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.5, -1.0])], "key long, embedding array<float>")
    files.write_vectors(rows, str(tmp_path / "v"), "m@dim=2", 2)
    assert files.read_vectors(spark, str(tmp_path / "v"), "m@dim=2", 2).count() == 2
    assert files.read_vectors(spark, str(tmp_path / "v"), "other", 2) is None and files.read_vectors(spark, str(tmp_path / "v"), "m@dim=2", 3) is None
    for bad in (rows.unionAll(rows.limit(1)), spark.createDataFrame([(3, [1.0])], rows.schema)):
        with pytest.raises(Exception, match="repeated key|wrong length"):
            files.write_vectors(bad, str(tmp_path / "w"), "m@dim=2", 2)
    coded = rows.select("key", files.float_bytes().alias("b"))
    assert bytes(coded.filter("key = 1").first()["b"]) == np.float32([1, 2]).tobytes()
    assert {(r["key"], tuple(r["v"])) for r in coded.select("key", files.floats("b").alias("v")).collect()} == {(1, (1.0, 2.0)), (2, (0.5, -1.0))}


def test_chunk_ledger(spark):
    old = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "doc_id string, seq int")
    new = spark.createDataFrame([("a", 1)], old.schema)
    assert sorted(map(tuple, files.replace_chunks(old, new).collect())) == [("a", 1), ("b", 1)]
    assert sorted(map(tuple, files.drop_chunks(old, new).collect())) == [("b", 1)]


def test_findings_are_sorted_worst_first(spark):
    rows = [("b", "text", "info", "x"), ("a", "moved", "error", "y"), (None, "hint", "warn", "z"), ("a", "added", "error", "w")]
    got = layout.worst_first(spark.createDataFrame(rows, "module_id string, kind string, severity string, detail string")).collect()
    assert [r["detail"] for r in got] == ["w", "y", "z", "x"]


def test_escalations_of_a_stream(spark):
    counts = spark.createDataFrame([(1, 3), (2, 1), (3, 0)], "key long, escalations long")
    before = spark.createDataFrame([(1, 1), (2, 1)], counts.schema)
    assert [tuple(r) for r in streams.escalation_actions(counts, before, "entry").collect()] == [(1, "user-reject", 2)]


def test_json_of_a_map_is_stable(spark):
    row = spark.range(1).select(t.stable_json(F.create_map(F.lit("b"), F.lit(1), F.lit("a"), F.lit(2))).alias("x")).first()
    assert row["x"] == '{"a":2,"b":1}'


def test_writes_that_must_fail(spark):
    entry = "id long, tier string, kind string, title string, text string, tags array<string>, bindings array<string>"
    none = spark.createDataFrame([], "path string, hash string")
    for bad in ((1, "project", "fact", " ", "x", [], []), (1, "global", "fact", "t", "x", [], ["a"]), (1, "project", "fact", "t", "x", [], ["a"])):
        with pytest.raises(Exception, match="blank|bind no files|no such file"):
            store.add_entries(spark.createDataFrame([bad], entry), none, views.now()).collect()
    old = spark.createDataFrame([(1, "project", "candidate", False, "t", [("a", "h")], 2)], "id long, tier string, status string, needs_review boolean, text string, bindings array<struct<path: string, content_hash: string>>, version int")
    with pytest.raises(Exception, match="no such file"):
        store.rebind(old, spark.createDataFrame([(1, ["b"], "why")], "id long, paths array<string>, reason string"), none, views.now()).collect()
    with pytest.raises(Exception, match="blank"):
        store.update_texts(old, spark.createDataFrame([(1, " ", "why")], "id long, text string, reason string"), views.now()).collect()
    with pytest.raises(Exception, match="foreign version"):
        store.point_lookup(old, old.select("id")).collect()
    cleared = store.rebind(old, spark.createDataFrame([(1, [], "why")], "id long, paths array<string>, reason string"), none, views.now()).first()
    assert cleared["bindings"] == [] and cleared["history"][0]["reason"] == "why (a -> none)" and cleared["history"][0]["at"] == datetime(2024, 1, 31)


@pytest.mark.parametrize("threshold", [0.5, 0.75, 1.0])
def test_sets_stand_for_all_pairs_and_clusters(spark, threshold):
    """Linked sets say what all pairs say, with repeated titles, empty ones, and entries without a project; clusters grow alike over both."""
    r = random.Random(int(threshold * 100))
    words = [f"w{i}" for i in range(9)]
    titles = [" ".join(r.sample(words, k)) for k in (0, 1, 2, 3, 4, 4)]
    rows = [(i, r.choice(["p0", "p1", "p2", "p3", None]), r.choice(titles), " ".join(r.sample(words, r.randint(0, 4)))) for i in range(70)]
    entries = spark.createDataFrame(rows, "id long, project string, title string, text string")
    members, links = governance.similar_sets(entries, threshold)
    sets, linked = {}, {(x["of"], x["a"], x["b"]) for x in links.collect()}
    for x in members.collect():
        sets.setdefault(x["id"], []).append((x["of"], x["set"]))
    project = {i: p for i, p, _, _ in rows}
    near = lambda i, j: any(of == to and (of, min(a, b), max(a, b)) in linked for of, a in sets.get(i, []) for to, b in sets.get(j, []))
    apart = lambda i, j: None not in (project[i], project[j]) and project[i] != project[j]
    pairs = governance.similar_pairs(entries, threshold)
    assert {(x["a"], x["b"]) for x in pairs.collect()} == {(i, j) for i in project for j in project if i < j and apart(i, j) and near(i, j)}
    for x in governance.link_counts(members, links).collect():
        own = [j for j in project if apart(x["id"], j) and (x["of"], *sorted((x["set"], dict(sets.get(j, [])).get(x["of"], -1)))) in linked]
        assert x["links"] == len(own)
    by_set, by_pair = (sorted(map(tuple, c.collect())) for c in (governance.set_clusters(members, links), governance.clusters(entries, pairs)))
    assert by_set and by_set == by_pair


def test_growth_passes_taken_entries_once():
    """Entries taken far behind a seed are not walked through again by each later seed (it took time with their square)."""
    n = 40_000
    ids = {1: range(n), 2: range(n + 1, 2 * n + 1), 3: [n, *range(2 * n + 1, 3 * n + 1)]}
    rows = [("p%d" % s, s, i, None) for s in ids for i in ids[s]]
    rows += [(None, s, None, [{"of": 0, "set": x} for x in near]) for s, near in ((1, [2]), (2, [1, 3]), (3, [2]))]
    frame = pd.DataFrame(rows, columns=["project", "set", "id", "near"]).assign(of=0)
    began = time.process_time()
    got = governance._grow(frame)
    assert time.process_time() - began < 12
    assert sorted(zip(got["cluster"], got["id"])) == sorted((k, i) for k in range(n) for i in (k, n + 1 + k, 2 * n + 1 + k))


@pytest.mark.parametrize("step", [0, 3])
def test_growth_by_sets_only(spark, monkeypatch, step):
    """The same clusters whether near entries are looked at one by one or all are sought through their sets."""
    r = random.Random(step)
    sets = {s: [{"of": 0, "set": x} for x in r.sample(range(12), 3)] for s in range(12)}
    near = {s: {x["set"] for x in sets[s]} | {x for x in sets if any(y["set"] == s for y in sets[x])} for s in sets}
    held, project = {i: r.sample(range(12), 2) for i in range(150)}, {i: "p%d" % r.randrange(6) for i in range(150)}
    rows = [(project[i], s, i, None) for i in held for s in held[i]] + [(None, s, None, [{"of": 0, "set": x} for x in near[s]]) for s in near]
    free, want = list(held), set()
    while free:
        cluster, grew = [free.pop(0)], True
        while grew:
            grew = False
            for i in list(free):
                if project[i] not in {project[m] for m in cluster} and any(set(held[i]) & near[s] for m in cluster for s in held[m]):
                    cluster.append(i)
                    free.remove(i)
                    grew = True
        if len(cluster) > 1:
            want |= {(i, project[i], cluster[0]) for i in cluster}
    monkeypatch.setattr(governance, "_NEXT", step)
    got = governance._grow(pd.DataFrame(rows, columns=["project", "set", "id", "near"]).assign(of=0))
    assert want and set(got.itertuples(index=False, name=None)) == want


def test_sets_of_empty_tables(spark):
    members, links = governance.similar_sets(spark.createDataFrame([], "id long, project string, title string, text string"), 0.75)
    assert governance.link_counts(members, links).isEmpty() and governance.set_clusters(members, links).isEmpty()


ROSTER = "key long, root string, label string, origin string, state string, added_at timestamp_ntz, last_seen_at timestamp_ntz"


@pytest.fixture()
def workspaces(spark):
    at = datetime(2024, 1, 1)
    rows = [(1, "/w/a", "a", "registry", "live", at, at), (2, "/w/b", "mine", "cli", "live", at, at), (3, "/w/c", "c", "registry", "orphaned", at, at), (4, "/w/d", "d", "registry", "kept", at, at)]
    return spark.createDataFrame(rows, ROSTER)


def test_roster_refuses_what_it_does_not_know(spark, workspaces):
    now, one = views.now(), lambda k: spark.createDataFrame([(k,)], "key long")
    for ask in (
        lambda: roster.remove(workspaces, one(9)), lambda: roster.keep(workspaces, one(9)), lambda: roster.rename(workspaces, spark.createDataFrame([(1, "  ")], "key long, new_label string"), now),
        lambda: roster.purge(workspaces, one(1), spark.createDataFrame([], "key long, kind string"), now)[0],
    ):
        with pytest.raises(Exception, match="no such workspace|blank|no orphan"):
            ask().collect()


def test_roster_register_purge_find_and_panel(spark, workspaces):
    now = datetime(2024, 1, 31)
    seen = [(2, "/v/b", "b", "auto", now), (4, "/w/d", "d", "registry", now), (5, "/w/e", "e", "auto", now), (5, "/w/z", "z", "auto", datetime(2024, 1, 2))]
    after = {r["key"]: r for r in roster.register(workspaces, spark.createDataFrame(seen, "key long, root string, label string, origin string, at timestamp_ntz")).collect()}
    assert (after[2]["root"], after[2]["label"], after[2]["state"]) == ("/v/b", "mine", "live")
    assert after[4]["state"] == "live" and after[4]["added_at"] == datetime(2024, 1, 1) and after[5]["root"] == "/w/e" and after[1]["last_seen_at"] == datetime(2024, 1, 1)
    stored = spark.createDataFrame([(3, "kb"), (3, "other"), (1, "kb")], "key long, kind string")
    purged, moves = roster.purge(workspaces, spark.createDataFrame([(3,)], "key long"), stored, views.now())
    assert [tuple(r) for r in moves.collect()] == [(3, "kb", "kb/3", "trash/2024-01-31T00-00-00/3/kb")]
    assert {r["key"]: (r["state"], r["purged_at"]) for r in purged.collect()}[3] == ("kept", now)
    names = spark.createDataFrame([("1",), ("/w/b/",), ("\\w\\c",), ("/none",)], "name string")
    assert {r["name"]: r["key"] for r in roster.find(workspaces, names).collect()} == {"1": 1, "/w/b/": 2, "\\w\\c": 3}
    assert [r["key"] for r in roster.panel(workspaces).collect()] == [1, 3]


def test_unknown_documents_and_entries_are_not_attached(spark, data):
    e, schema = views.entries(spark, data), "id long, doc_id string, from_line int, to_line int, quote string"
    docs = spark.createDataFrame([("d-1",)], "doc_id string")
    for row in [(0, "d-2", None, None, None), (-1, "d-1", None, None, None)]:
        with pytest.raises(Exception, match="no such"):
            store.attach_docs(e, spark.createDataFrame([row], schema), docs, views.now()).collect()


def test_acts_settle_only_their_own_pending_requests(spark, data):
    e = views.entries(spark, data).filter("status = 'candidate'")
    i = e.select(F.min("id")).first()[0]
    a = spark.createDataFrame([(i, "promote", None, None), (i, "retire", None, None), (i, "promote", datetime(2024, 1, 1), "rejected")], "entry_id long, action string, resolved_at timestamp_ntz, resolution string")
    acts = spark.createDataFrame([(i, "promote", None, None), (-5, "promote", None, None), (i + 0, "paint", None, None)], "id long, action string, by string, reason string")
    after, settled, refused = store.act(e, a, acts, views.now())
    assert after.filter(F.col("id") == i).first()["status"] == "trusted"
    assert sorted((r["action"], r["resolution"]) for r in settled.fillna("open", ["resolution"]).collect()) == [("promote", "approved"), ("promote", "rejected"), ("retire", "open")]
    assert {(r["id"], r["action"]) for r in refused.collect()} == {(-5, "promote"), (i, "paint")}


def test_bound_entries_meet_queries_as_far_as_they_are_shown(spark, data, capsys):
    """A query shows 8 bound entries at most and has 24 hits, so the first 32 bound ones are enough; all of them met every query before."""
    e, q = views.entries(spark, data), views.queries(spark, data)
    files = [f"src/mod{i}.css" for i in range(50)]
    rows = lexical.bound_strata(e, q, files)
    rows.explain()
    assert "limit=32" in capsys.readouterr().out
    got, bound = {}, {r["id"] for r in lexical.visible(e).filter(F.size("bindings") > 0).collect()}
    for r in rows.collect():
        got.setdefault(r["query_id"], []).append((r["stratum"], r["rank"], r["id"]))
    hits = {}
    for r in lexical.retrieve(e, q, 24).collect():
        hits.setdefault(r["query_id"], set()).add(r["id"])
    assert len(bound) > 32 and got
    for query, shown in got.items():
        mine = hits.get(query, set())
        both = len(mine & bound)
        only = sorted(bound - mine)[: max(0, 8 - both)]
        assert [i for s, _, i in sorted(shown, key=lambda x: x[1]) if s == 1] == only
