"""Searches whose work grew faster than their input: small rows, plans and slices that would have shown it."""

from __future__ import annotations

import math
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from ledgerlens.functions import params as p
from ledgerlens.operators import documents, lexical, ranking
from ledgerlens.operators.leading import SLICE, Leading

ROWS = SLICE + 88
SCHEMA = "id long, title string, tags array<string>, text string, tier string, kind string, status string, needs_review boolean, redlines array<struct<`from`: int, `to`: int>>"


@pytest.fixture(scope="module")
def entries(spark):
    """One group of 300 copies, entries of different lengths, one without a title; more than a slice of them in a task."""
    of = lambda i: "copy words here" if i % 2 else f"w{i % 7} w{i % 5} w{i % 3} " * (i % 4 + 1)
    rows = [(i, None if i == 9 else f"t w{i % 3}", ["aa"], of(i), "global" if i % 5 == 0 else "project", "fact", "trusted" if i % 3 else "candidate", i % 11 == 0, []) for i in range(ROWS)]
    return spark.createDataFrame(rows, SCHEMA).coalesce(1)


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(1, "copy words"), (2, "w1 w2"), (3, "aa w3"), (4, "nothing-there"), (5, "!")], "query_id int, query string")


def _plain(entries, asked, k, scorer, frequency):
    """The definition, one pair at a time."""
    rows = [r for r in entries.collect()]
    fields = {r["id"]: [r["title"].split() if r["title"] else None, r["tags"], r["text"].split()] for r in rows}
    fields = {i: [[w for w in x if len(w) > 1] if x is not None else None for x in f] for i, f in fields.items()}
    whole = {i: f for i, f in fields.items() if None not in f}
    mean = [np.mean([len(set(f[n])) for f in fields.values() if f[n] is not None]) for n in range(3)]
    df = Counter(w for f in whole.values() for w in set(f[0] + f[1] + f[2]))
    w, out = list(p.FIELD_WEIGHTS.values()), {}
    for q in asked.collect():
        found = []
        for r in rows:
            raw = 0.0
            for token in {x for x in q["query"].replace("-", " ").split() if len(x) > 1 and x.isalnum()}:
                f = whole.get(r["id"])
                if not f or not any(token in x for x in f):
                    continue
                tf = [x.count(token) for x in f]
                rare = math.log(1 + (len(rows) - df[token] + 0.5) / (df[token] + 0.5))
                if scorer == "weights":
                    raw += sum(a for a, n in zip(w, tf) if n)
                elif frequency == "count":
                    c = sum(a * n for a, n in zip(w, tf))
                    raw += rare * (p.K1 + 1) * c / (p.K1 + c)
                else:
                    raw += rare * sum(a * (p.K1 + 1) / (1 + p.K1 * (1 - p.B + p.B * len(set(x)) / m)) for a, n, x, m in zip(w, tf, f, mean) if n)
            score = raw * p.STATUS_FACTOR[r["status"]] * p.TIER_FACTOR[r["tier"]] * (p.REVIEW_FACTOR if r["needs_review"] else 1)
            places = 100 if scorer == "weights" else 1e6
            if (score := math.floor(score * places + 0.5) / places) != 0:
                found.append((-score, r["tier"] != "project", r["id"]))
        if found:
            out[q["query_id"]] = [i for _, _, i in sorted(found)[:k]]
    return out


def _ids(rows):
    out = {}
    for r in sorted(rows.collect(), key=lambda r: r["rank"]):
        out.setdefault(r["query_id"], []).append(r["id"])
    return out


@pytest.mark.parametrize(("scorer", "frequency"), [("weights", "presence"), ("bm25", "presence"), ("bm25", "count")])
def test_retrieve_by_definition_over_slices_and_ties(entries, asked, scorer, frequency):
    assert _ids(lexical.retrieve(entries, asked, 7, scorer=scorer, frequency=frequency)) == _plain(entries, asked, 7, scorer, frequency)


@pytest.mark.parametrize("block", [1, 2])
def test_blocks_of_queries(entries, asked, block):
    found = lexical.match(entries, asked, block=block)
    assert len(found) > 1 and _ids(lexical.leading(found, asked, 7)) == _plain(entries, asked, 7, "bm25", "presence")


def test_pairs_are_not_shuffled(entries, asked, capsys):
    lexical.score(entries, asked).explain()
    plan = capsys.readouterr().out
    assert "Exchange" not in plan and "Join" not in plan and "Sort" not in plan


def test_a_task_passes_on_few_of_many_ties():
    best, taken = Leading(5, 2), []
    for _ in range(20):
        row, column = best.take(np.ones((SLICE, 2)))
        taken.append(len(row))
    assert max(taken) == 10
    best = Leading(3, 1)
    scores = np.random.default_rng(1).permutation(5_000).astype(float)[:, None]
    kept = [int(scores[at + r, 0]) for at in range(0, 5_000, 100) for r in best.take(scores[at : at + 100])[0]]
    assert {4_999, 4_998, 4_997} <= set(kept) and len(kept) < 100


def test_search_without_words(entries, asked):
    none = asked.filter("query_id = 5")
    assert lexical.retrieve(entries, none, 3).count() == 0 and lexical.score(entries, none).count() == 0


class Rows:
    """Stands for a table whose map function is wanted, to see what it holds at a time."""

    def __init__(self, **types):
        self.dtypes = list(types.items())

    def select(self, *_):
        return self

    def mapInArrow(self, run, schema):  # noqa: N802
        return run


def _peak(run, batch):
    """Rows given, and the most that Python held meanwhile in MB."""
    tracemalloc.start()
    rows = sum(b.num_rows for b in run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return rows, peak


def test_vectors_meet_queries_a_slice_at_a_time():
    r = np.random.default_rng(2)
    v = r.normal(size=(20_000, 8)).astype(np.float32)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(20_000)), pa.array(v.tolist(), pa.list_(pa.float32()))], ["key", "embedding"])
    asked = [{"query_id": i, "embedding": v[i].tolist()} for i in range(400)]
    rows, peak = _peak(ranking._best(asked, 5, 0.0, "bigint"), batch)
    assert peak < 40 and 2_000 <= rows < 60_000  # one matrix of all scores has 64 MB, and slices apart would give 80,000 rows


def test_embedder_holds_a_slice(spark):
    tokens = [[f"w{i % 50}", f"x{i % 7}"] for i in range(8_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(8_000)), pa.array(tokens)], ["key", "tokens"])
    run = ranking.hash_embed(Rows(key="bigint", text="string"), 256)
    rows, peak = _peak(run, batch)
    assert rows == 8_000 and peak < 8  # as lists of numbers the batch's vectors alone have 60 MB
    got = {k: v for b in run(iter([batch])) for k, v in zip(b.column("key").to_pylist(), b.column("embedding").to_pylist())}
    for i in (0, 511, 512, 7_999):
        want = np.zeros(256, np.float32)
        for token in tokens[i]:
            place, sign = ranking._place(token, 256)
            want[place] += sign
        assert got[i] == (want / np.linalg.norm(want)).tolist()


def test_chunks_of_few_documents_at_a_time(spark):
    text = "\n".join(f"line {i} of a text" for i in range(60))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(1_500)), pa.array([text] * 1_500)], ["doc_id", "text"])
    rows, peak = _peak(documents.chunk_documents(Rows(doc_id="bigint", text="string"), bodies=True), batch)
    assert rows >= 3_000 and peak < 3


def test_documents_meet_their_queries_in_groups(spark, monkeypatch):
    """Several documents in one call, one with vectors of two lengths, one whose query has none."""
    monkeypatch.setattr(documents, "DOCUMENTS", 4)
    r = np.random.default_rng(3)
    layer = [(d, s, r.normal(size=3 if (d, s) == (2, 1) else 4).round(2).tolist()) for d in range(10) for s in range(5)]
    asked = [(100 + d, d, None if d == 3 else r.normal(size=4).round(2).tolist()) for d in range(10)] + [(200, 4, [1.0, 0.0, 0.0, 0.0])]
    got = documents.nearest_chunks(spark.createDataFrame(layer, "doc_id long, seq int, embedding array<double>"), spark.createDataFrame(asked, "query_id long, doc_id long, embedding array<double>"), 2)
    want = set()
    for q, d, e in asked:
        cosine = sorted((-np.floor(np.dot(x, e) / np.linalg.norm(x) / np.linalg.norm(e) * 1e6 + 0.5) / 1e6, s) for o, s, x in layer if e and o == d and len(x) == len(e))
        want |= {(q, d, s, i) for i, (c, s) in enumerate(cosine[:2], 1) if c < 0}
    assert {tuple(x[c] for c in ("query_id", "doc_id", "seq", "rank")) for x in got.collect()} == want


def test_only_documents_with_ranges_are_taken_apart(spark):
    chunks = documents.chunk_documents(spark.createDataFrame([(i, "# Head\none two\nthree four\n\nfive") for i in range(4)], "doc_id long, text string"), bodies=True)
    ranges = spark.createDataFrame([(1, 2, 2)], "doc_id long, from_line int, to_line int")
    got = {r["doc_id"]: (set(r["kept"]), r["partly_redlined"]) for r in documents.read_chunks(chunks, ranges).collect()}
    every = {"head", "one", "two", "three", "four", "five"}
    assert got == {0: (every, False), 1: (every - {"one", "two"}, True), 2: (every, False), 3: (every, False)}
    own = spark.createDataFrame([(None, 3, 3)], "doc_id long, from_line int, to_line int")
    assert all(r["partly_redlined"] and "three" not in r["kept"] for r in documents.read_chunks(chunks, own).collect())
