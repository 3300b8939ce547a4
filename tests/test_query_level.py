"""Queries that SQL cannot express, each against a plain computation from the tables or from the rows below it."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import params as p
from ledgerlens.functions import text as t
from ledgerlens.operators import documents
from ledgerlens.plans.queries import QUERIES, _pages, _training, _verified

WS = " \t\n\x0b\x0c\r\xa0﻿"


@pytest.fixture(scope="module")
def pages(spark, data):
    return {r["doc_id"]: r["text"] for r in _pages(spark, data).collect()}


@pytest.fixture(scope="module")
def chunks(spark, data):
    out = defaultdict(list)
    for r in QUERIES["chunk_documents"](spark, data).collect():
        out[r["doc_id"]].append(r)
    return {d: sorted(rows, key=lambda r: r["seq"]) for d, rows in out.items()}


def _tokens(text: str) -> set[str]:
    return {w.lower() for w in re.findall(r"[A-Za-z0-9_]{2,}", text)}


def test_hash_embed(spark, data):
    rows = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = {r["key"]: r["vector_md5"] for r in QUERIES["hash_embed"](spark, data).collect()}
    assert set(got) == set(rows)
    for d, text in list(rows.items())[::10]:
        v = np.zeros(256, np.float32)
        for token in sorted(_tokens(text)):
            a, b = 0x811C9DC5, 0x9E3779B9
            for i, c in enumerate(token.encode()):
                a, b = (a ^ c) * 0x01000193 % 2**32, (b ^ (c + i)) * 0x85EBCA6B % 2**32
            v[a % 256] += 1 - 2 * (b % 2)
        v = v / np.linalg.norm(v) if v.any() else v
        shown = ",".join(f"{float(x):,.5f}" for x in v)
        assert got[d] == hashlib.md5(shown.encode()).hexdigest() or got[d] == hashlib.md5(shown.replace("-0.00000", "0.00000").encode()).hexdigest()


def test_chunks_cover_their_documents(pages, chunks):
    for d, text in pages.items():
        lines = text.rstrip("\n").split("\n")
        covered, rows = set(), chunks.get(d, [])
        assert [r["seq"] for r in rows] == list(range(1, len(rows) + 1))
        for r in rows:
            body = "\n".join(lines[r["start_line"] - 1 : r["end_line"]])
            assert r["chars"] == len(body) and (len(body) <= p.CHUNK_CHARS or r["start_line"] == r["end_line"])
            assert r["quote_anchor"] == re.sub(r"\s+", " ", body).strip()[: p.ANCHOR_CHARS]
            covered |= set(range(r["start_line"], r["end_line"] + 1))
            if r["overlap_with"] is not None:
                before = rows[r["overlap_with"] - 1]
                assert before["seq"] == r["seq"] - 1 and before["heading_path"] == r["heading_path"]
            if lines[r["start_line"] - 1].startswith("# "):
                assert r["heading_path"] == lines[r["start_line"] - 1][2:].strip()
        assert {i + 1 for i, x in enumerate(lines) if x.strip()} <= covered


def _hits(pages, chunks, redlined: bool):
    """(doc, seq) -> (score, matched, partly redlined) of each page's first 12 tokens in its own chunks."""
    out = {}
    for d, rows in chunks.items():
        terms = sorted(_tokens(pages[d]))[:12]
        red = range(2, 4) if redlined and d % 3 == 0 else range(0)
        lines = pages[d].split("\n")
        for r in rows:
            own = range(r["start_line"], r["end_line"] + 1)
            if len(red) and red[0] <= own[0] and own[-1] <= red[-1]:
                continue
            head, body = _tokens(r["heading_path"]), _tokens("\n".join(lines[i - 1] for i in own if i not in red))
            a, b = set(terms) & head, set(terms) & body
            score = np.floor((2 * len(a) + len(b)) * len(a | b) / len(terms) * 100 + 0.5) / 100 if terms else 0
            if score > 0:
                out[d, r["seq"]] = (score, ",".join(sorted(a | b)), bool(set(own) & set(red)))
    of = {(d, r["seq"]): r["overlap_with"] for d, rows in chunks.items() for r in rows}
    return {k: v for k, v in out.items() if (k[0], of[k]) not in out}


def _best(hits: dict, limit: int) -> dict:
    per = defaultdict(list)
    for (d, seq), v in hits.items():
        per[d].append((-v[0], seq))
    return {(d, seq): i + 1 for d, xs in per.items() for i, (_, seq) in enumerate(sorted(xs)[:limit])}


def test_chunk_search(spark, data, pages, chunks):
    hits = _hits(pages, chunks, True)
    want = {(d, seq, rank, *hits[d, seq]) for (d, seq), rank in _best(hits, p.RESULT_LIMIT).items()}
    got = QUERIES["chunk_search"](spark, data).collect()
    assert {(r["doc_id"], r["seq"], r["rank"], r["score"], r["matched"], r["partly_redlined"]) for r in got} == want and len(got) == len(want)


def _embedding(text: str) -> np.ndarray:
    v = np.zeros(p.EMBED_DIM)
    for token in _tokens(text):
        a, b = 0x811C9DC5, 0x9E3779B9
        for i, c in enumerate(token.encode()):
            a, b = (a ^ c) * 0x01000193 % 2**32, (b ^ (c + i)) * 0x85EBCA6B % 2**32
        v[a % p.EMBED_DIM] += 1 - 2 * (b % 2)
    return v / np.linalg.norm(v) if v.any() else v


def _word_hits(terms, rows, lines, red):
    """seq -> score, and the covered seqs, of one document's chunks under redlines (from, to)."""
    out, covered = {}, set()
    for r in rows:
        own = range(r["start_line"], r["end_line"] + 1)
        if any(a <= own[0] and own[-1] <= b for a, b in red):
            covered.add(r["seq"])
            continue
        body = _tokens("\n".join(lines[i - 1] for i in own if not any(a <= i <= b for a, b in red)))
        one, two = set(terms) & _tokens(r["heading_path"]), set(terms) & body
        if score := np.floor((2 * len(one) + len(two)) * len(one | two) / len(terms) * 100 + 0.5) / 100:
            out[r["seq"]] = score
    return out, covered


def test_chunk_search_fused(spark, data):
    """Every state of the vectors, against the definition: words in document order, cosines, fusion, covered chunks gone."""
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    cut = defaultdict(list)
    for r in sorted(documents.chunk_documents(spark.read.parquet(f"{data}/documents.parquet")).collect(), key=lambda r: (r["doc_id"], r["seq"])):
        cut[r["doc_id"]].append(r)
    got, states = defaultdict(dict), set()
    for r in QUERIES["chunk_search_fused"](spark, data).collect():
        got[r["query_id"]][r["rank"]] = (r["seq"], r["score"], r["channels"], r["state"], r["missing"])
        states.add(r["state"])
    assert states == {"used", "partial", "index-stale", "index-missing", "error"}
    for d, text in docs.items():
        lines, terms, rows = text.split("\n"), sorted(_tokens(text))[:12], cut[d]
        hits, covered = _word_hits(terms, rows, lines, [(2, 9)] if d % 3 == 0 else []) if terms else ({}, set())
        have = [r for r in rows if d % 7 not in (3, 4) and (d % 7 != 5 or r["seq"] % 2 == 1)]
        state = "index-missing" if d % 7 == 3 else "index-stale" if d % 7 == 4 else "error" if d % 11 == 0 else "partial" if len(have) < len(rows) else "used"
        if state in ("used", "partial"):
            ask = _embedding(" ".join(terms))
            cosines = [(-np.floor(float(_embedding(r["heading_path"] + "\n" + "\n".join(lines[r["start_line"] - 1 : r["end_line"]])) @ ask) * 1e6 + 0.5) / 1e6, r["seq"]) for r in have]
            ranks = defaultdict(dict)
            for i, seq in enumerate(sorted(hits), 1):
                ranks[seq]["lexical"] = i
            for i, (c, seq) in enumerate(sorted(cosines)[:20], 1):
                if c < 0:
                    ranks[seq]["vector"] = i
            score = {seq: round(sum(1 / (p.RRF_K + r) for r in x.values()), 9) for seq, x in ranks.items()}
            order = [s for s in sorted(ranks, key=lambda s: (-score[s], min(ranks[s].values()), str(s))) if s not in covered][: p.RESULT_LIMIT]  # noqa: B023
            want = {i: (s, np.floor(score[s] * 1e4 + 0.5) / 1e4, " / ".join(f"{k} #{v}" for k, v in sorted(ranks[s].items()))) for i, s in enumerate(order, 1)}
        else:
            of = {r["seq"]: r["overlap_with"] for r in rows}
            order = sorted((s for s in hits if of[s] not in hits), key=lambda s: (-hits[s], s))[: p.RESULT_LIMIT]  # noqa: B023
            want = {i: (s, hits[s], None) for i, s in enumerate(order, 1)}
        assert got.pop(d, {}) == {i: (*x, state, len(rows) - len(have)) for i, x in want.items()}, d
    assert not got


def test_redlined_chunks(spark, data):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = {(r["doc_id"], r["seq"]): (r["partly_redlined"], r["words"], r["words_md5"]) for r in QUERIES["redlined_chunks"](spark, data).collect()}
    every = [(d % 40 + 12,) * 2 for d in docs if d % 50 == 0]
    for r in documents.chunk_documents(spark.read.parquet(f"{data}/documents.parquet")).collect():
        red = [(a, a + r["doc_id"] % 6) for a in (2, 5)] + every
        own = range(r["start_line"], r["end_line"] + 1)
        if any(a <= own[0] and own[-1] <= b for a, b in red):
            continue
        lines = docs[r["doc_id"]].split("\n")
        words = sorted(_tokens("\n".join(lines[i - 1] for i in own if not any(a <= i <= b for a, b in red))))
        met = any(a <= own[-1] and own[0] <= b for a, b in red)
        assert got.pop((r["doc_id"], r["seq"])) == (met, len(words), hashlib.md5(" ".join(words).encode()).hexdigest())
    assert not got


def test_a_long_document_under_many_redlines(spark):
    """100,000 lines and 20,000 redlines of one document: no row grows with them, and only what stands is found."""
    text = "\n".join(f"word{i} filler" for i in range(1, 100_001))
    cut = documents.chunk_documents(spark.createDataFrame([(1, text)], "doc_id long, text string"), bodies=True).cache()
    red = spark.range(20_000).select(F.lit(1).cast("long").alias("doc_id"), (F.col("id") * 5 + 1).cast("int").alias("from_line"), (F.col("id") * 5 + 2).cast("int").alias("to_line"))
    found = documents.reach(spark.range(1, 100_001).select(F.col("id").cast("int").alias("line"), F.lit(1).alias("doc_id")), red, ["doc_id"])
    assert found.filter("reach <> ((line - 1) div 5) * 5 + 2").count() == 0 and found.count() == 100_000
    read = documents.read_chunks(cut, red)
    assert read.count() == cut.count() and read.filter("not partly_redlined").count() == 0
    ask = spark.createDataFrame([(1, 1, "word50001"), (2, 1, "word50003")], "query_id int, doc_id long, query string")
    assert {r["query_id"] for r in documents.search_chunks(cut, ask, red).collect()} == {2}
    cut.unpersist()


def test_chunk_browse(spark, data, chunks):
    want = set()
    for d, rows in chunks.items():
        spans = []
        for r in (r for r in rows if r["overlap_with"] is None):
            if spans and spans[-1][-1]["seq"] + 1 == r["seq"]:
                spans[-1].append(r)
            else:
                spans.append([r])
        want |= {(d, s[0]["seq"], s[0]["start_line"], max(r["end_line"] for r in s), sum(r["chars"] for r in s), len(s)) for s in spans[: p.RESULT_LIMIT]}
    got = QUERIES["chunk_browse"](spark, data).collect()
    assert {(r["doc_id"], r["seq"], r["start_line"], r["end_line"], r["chars"], r["chunks"]) for r in got} == want


def test_chunk_excerpts(spark, data, pages):
    got = {r["doc_id"]: r["excerpt"] for r in QUERIES["chunk_excerpts"](spark, data).collect()}
    for d, text in pages.items():
        lines, out, used = text.split("\n"), [], 0
        for i, line in enumerate(lines):
            line = (("✂ " if i % 3 == 2 else "") + line).rstrip(WS)
            if not line and not out:
                continue
            if used + len(line) + 1 > 200:
                if out:
                    break
                line = line[:199] + "…"
            out.append(line)
            used += len(line) + 1
        assert got[d] == "\n".join(out) + ("\n…" if len(lines) > 1 and used >= 200 else "")


def test_ltr_train_logistic(spark, data):
    rows = _training(spark, data).collect()
    x = np.array([[r["score"], r["entry_id"] % 7 / 7, 1.0] for r in rows])
    y, w = np.array([r["label"] for r in rows], float), np.zeros(3)
    for _ in range(400):
        w -= 0.1 * x.T @ (1 / (1 + np.exp(-x @ w)) - y) / len(x)
    got = {r["feature"]: r["weight"] for r in QUERIES["ltr_train_logistic"](spark, data).collect()}
    assert got == pytest.approx({"bm25ish": w[0], "freshness": w[1], "bias": w[2]}, abs=2e-6)


def test_generalize_clusters(spark, data):
    rows = sorted(_verified(spark, data).collect(), key=lambda r: r["id"])
    sets = {r["id"]: (_tokens(r["title"]), _tokens(r["title"] + " " + r["text"])) for r in rows}
    project = {r["id"]: r["project"] for r in rows}
    share = lambda a, b: len(a & b) / min(len(a), len(b)) if a and b else 0
    near = lambda i, j: max(share(a, b) for a, b in zip(sets[i], sets[j])) >= 0.75
    free, want = [r["id"] for r in rows], set()
    while free:
        cluster, grew = [free.pop(0)], True
        while grew:
            grew = False
            for i in list(free):
                if project[i] not in {project[m] for m in cluster} and any(near(i, m) for m in cluster):
                    cluster.append(i)
                    free.remove(i)
                    grew = True
        if len(cluster) > 1:
            want |= {(i, cluster[0]) for i in cluster}
    assert want and {(r["id"], r["cluster"]) for r in QUERIES["generalize_clusters"](spark, data).collect()} == want


def test_identifier_subtokens(spark, data):
    """Names such as SmallPlatedCopper_Brand12: words and numbers, each on its own, and words with their number."""
    for r in QUERIES["identifier_subtokens"](spark, data).collect():
        want = set()
        for piece in r["name"].split("_"):
            for word in re.findall(r"[A-Z][a-z0-9]*|[A-Z]+", piece):
                want |= {word.lower(), *re.findall(r"[a-z]+|[0-9]+", word.lower())}
        got = set(r["parts"].split(","))
        assert {x for x in want if len(x) >= 2} == got or all(x in r["name"].lower() for x in got) and re.search("[A-Z]{2}", r["name"])


def test_query_normalize_profiles(spark, data):
    queries = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()}
    got = {(r["query_id"], r["profile"]): r for r in QUERIES["query_normalize_profiles"](spark, data).collect()}
    assert len(got) == 3 * len(queries)
    named = ["`x.y`", "src/mod4.css", "API_KEY", "v2.1", "E401", "focus-trap"]
    for i, q in queries.items():
        words = f"see `x.y` src/mod4.css API_KEY v2.1 and {' '.join(q.split())} E401 focus-trap".split()
        assert got[i, "tool"]["lexical"] == got[i, "tool"]["semantic"] == " ".join(words) and not got[i, "tool"]["truncated"]
        plain = " ".join(w for w in words if w != "`x.y`")
        assert got[i, "pre-step"]["lexical"] == plain[:1200] and got[i, "pre-step"]["truncated"] == (len(plain) > 1200)
        rest, taken = got[i, "gate"]["semantic"].split(), got[i, "gate"]["identifiers"].split()
        assert sorted(rest + taken) == sorted(words) and set(named) <= set(taken) and "see" in rest and "and" in rest


def test_replaced_chunk_layer(spark, data, pages, chunks):
    got = {r["doc_id"]: (r["chunks"], r["lines"], r["anew"]) for r in QUERIES["replaced_chunk_layer"](spark, data).collect()}
    for d, text in pages.items():
        rows = documents.chunk("# Read anew\n" + text) if d % 9 == 0 else [tuple(r)[1:] for r in chunks.get(d, [])]
        if d % 9 == 0 or d % 10 != 1:
            assert got.pop(d, None) == ((len(rows), max(r[3] for r in rows), int(d % 9 == 0)) if rows else None)
    assert not got


def test_only_touched_folders_and_segments_are_written(spark, data, tmp_path):
    from ledgerlens.operators import lexical, segments
    from ledgerlens.sources import files, views

    names = lambda path: {str(f.relative_to(path)): f.stat().st_mtime_ns for f in path.rglob("*.parquet")}
    docs = _pages(spark, data)
    layer = tmp_path / "layer"
    files.write_layer(documents.chunk_documents(docs), str(layer))
    before, count = names(layer), spark.read.parquet(str(layer)).count()
    one = documents.chunk_documents(docs.filter("doc_id = 3"))
    files.replace_in_layer(one, str(layer))
    files.replace_in_layer(one, str(layer))
    after = names(layer)
    changed = {n.split("/")[0] for n, _ in set(before.items()) ^ set(after.items())}
    assert len(changed) == 1 and {n for n in before if n.split("/")[0] not in changed} <= set(after)
    assert spark.read.parquet(str(layer)).count() == count
    files.replace_in_layer(one.limit(0), str(layer), docs.select("doc_id"))
    assert not names(layer)

    e = lexical.visible(views.entries(spark, data)).cache()
    path = tmp_path / "index"
    assert segments.refresh(e, str(path)).filter("state <> 'new'").isEmpty()
    before = names(path)
    assert segments.refresh(e, str(path)).isEmpty() and names(path) == before
    first, last = (e.agg(f("id")).first()[0] for f in (F.min, F.max))
    edited = e.filter(F.col("id") != last).withColumn("title", F.when(F.col("id") == first, F.lit("zebra")).otherwise(F.col("title")))
    assert {(r["id"], r["state"]) for r in segments.refresh(edited, str(path)).collect()} == {(first, "changed"), (last, "gone")}
    assert before.items() <= names(path).items()
    ask = spark.createDataFrame([(1, "zebra")], "query_id int, query string")
    assert [r["id"] for r in segments.search([segments.open_tier(spark, str(path))], ask).collect()] == [first]
    assert segments.open_tier(spark, str(path)).postings.filter(f"generation = 2 and id <> {first}").isEmpty()
    e.unpersist()


def test_stable_json_at_every_depth(spark):
    import json

    a = '{"b": [{"z": 1, "a": [3, 1, {"y": null, "x": "\\u00e9"}]}, 2], "a": {"d": true, "c": {}}}'
    b = '{"a": {"c": {}, "d": true}, "b": [{"a": [3, 1, {"x": "é", "y": null}], "z": 1}, 2]}'
    rows = spark.createDataFrame([(a,), (b,), ("no json",), (None,)], "raw string").select(t.stable_json_text(F.col("raw")).alias("x")).collect()
    assert rows[0]["x"] == rows[1]["x"] == json.dumps(json.loads(a), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert rows[2]["x"] is None and rows[3]["x"] is None
    maps = spark.sql("select map('b', map('d', 1, 'c', 2), 'a', map('e', 3)) as m").select(t.stable_json(F.col("m")).alias("x")).first()
    assert maps["x"] == '{"a":{"e":3},"b":{"c":2,"d":1}}'


def test_training_beyond_the_bound_is_the_same(spark, data):
    from ledgerlens.operators import evaluation

    rows = _training(spark, data).withColumns({"bm25ish": F.col("score"), "freshness": (F.col("entry_id") % 7) / 7.0})
    one, many = (evaluation.train_logistic(rows, ["bm25ish", "freshness"], epochs=12, counted=n) for n in (10**6, 0))
    assert all(abs(one[k] - many[k]) < 1e-9 for k in one)
