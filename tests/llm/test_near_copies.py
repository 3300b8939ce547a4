"""Near copies against exact similarity of shingle sets."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlens.llm import common, near_copies, simhash

from .conftest import ROWS


def sets_of(texts: list[str | None]) -> list[frozenset]:
    out = []
    for text in texts:
        tokens = [w for w in (text or "").encode().lower().split() if w]
        out.append(frozenset(tuple(tokens[i : i + 5]) for i in range(len(tokens) - 4)) or frozenset({tuple(tokens)} - {()}))
    return out


def groups_of(texts: list[str | None]) -> list[int]:
    """The first place of each text's component, by comparing all sets of five words."""
    sets = sets_of(texts)
    up = list(range(len(sets)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if 5 * len(x & y) >= 4 * len(x | y) and top(i) != top(j):
                up[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(len(sets))]


def _texts() -> list[str]:
    """Copies with edits at all similarities, a line that most texts hold, a large group of edits of one text, short texts."""
    r = random.Random(5)
    word = lambda: f"w{r.randrange(5000)}"
    line = "all rights reserved by the holders of this work"
    out = []
    for _ in range(90):
        base = [word() for _ in range(r.choice([3, 8, 30, 90, 200]))]
        for _ in range(r.randint(1, 4)):
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 25))):
                copy[r.randrange(len(copy))] = word()
            out.append(" ".join(copy + line.split() * (r.random() < 0.6)))
    base = [word() for _ in range(80)]
    for _ in range(60):
        copy = list(base)
        for _ in range(r.randint(1, 3)):
            copy[r.randrange(80)] = word()
        out.append(" ".join(copy))
    return out + ["", " ", line, line.upper()]


def test_all_similar_pairs_are_linked_and_no_others(spark):
    texts = _texts()
    want = set(groups_of(texts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for hot, heavy in ((10, near_copies.HEAVY_BUCKET), (near_copies.HOT_BUCKET, 400), (near_copies.HOT_BUCKET, near_copies.HEAVY_BUCKET)):
        assert {r["doc_id"] for r in near_copies.drop_near_copies(docs, hot_bucket=hot, heavy_bucket=heavy).collect()} == want


def test_buckets_split_by_size_lose_no_meeting(spark):
    """Every two rows of a split bucket meet in one of its pieces, and no piece has rows of two buckets."""
    rows = [(key, node, n, 0) for key, many, n in ((1, 40, 10), (2, 3, 10), (3, 1, 900)) for node, n in enumerate([n] * many)]
    found = near_copies._split(spark.createDataFrame(rows, "key long, node long, n int, at int"), 100).collect()
    pieces: dict[int, set] = {}
    for r in found:
        pieces.setdefault(r["key"], set()).add((r["node"], r["n"]))
    assert len(pieces[2]) == 3 and len(pieces) > 20
    met = {frozenset((a, b)) for p in pieces.values() for a in p for b in p}
    assert all(frozenset(((a, 10), (b, 10))) in met for a in range(40) for b in range(40))
    assert max(len(p) for k, p in pieces.items() if k != 2) < 40


def test_the_bit_table_never_hides_a_wanted_row(spark, monkeypatch):
    """With a table of the given size few rows pass in vain, with a small one many; wanted ones always do."""
    rows = spark.range(4000).selectExpr("id * 977 - 1900000 as a", "cast(id % 7 as int) as b")
    wanted = rows.filter("a % 5 = 0")
    for bits, most in ((common.SIEVE_BITS, 810), (1 << 12, 4000)):
        monkeypatch.setattr(common, "SIEVE_BITS", bits)
        found = common.sieve(rows, ["a", "b"], wanted)
        hits = {(r["a"], r["b"]) for r in found.filter("hit").collect()}
        assert found.columns == ["a", "b", "hit"] and found.count() == 4000
        assert {(r["a"], r["b"]) for r in wanted.collect()} <= hits and len(hits) <= most
    assert common.sieve(rows, ["a", "b"], wanted.limit(0)).filter("hit").count() == 0


def test_repeated_and_missing_ids_lose_no_text(spark):
    """Rows are told apart by id and text: each group keeps one row, whatever ids its rows share with other groups."""
    r = random.Random(8)
    base = [" ".join(f"v{r.randrange(9000)}" for _ in range(60)) for _ in range(12)]
    edit = lambda t: " ".join(t.split()[:-1] + ["changed"])
    rows = [(i % 5 if i % 7 else None, x) for i, t in enumerate(base) for x in (t, edit(t), t)] + [(3, edit(base[0])), (3, edit(base[0])), (2, None), (None, ""), (None, None)]
    kept = near_copies.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    groups = groups_of([t for _, t in rows])
    of = {(d, t): g for (d, t), g in zip(rows, groups)}
    assert Counter(of[x["doc_id"], x["text"]] for x in kept) == Counter(set(groups))
    least = {g: min(((d is None, d or 0) for (d, _), h in zip(rows, groups) if h == g)) for g in groups}
    assert all((x["doc_id"] is None, x["doc_id"] or 0) == least[of[x["doc_id"], x["text"]]] for x in kept)


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(-(2**63), 2**63 - 1), max_size=300), st.sets(st.integers(-(2**63), 2**63 - 1), max_size=300), st.sets(st.integers(-(2**63), 2**63 - 1), max_size=300))
def test_bitmaps_never_rule_out_what_is_shared(x, y, both):
    x, y = x | both, y | both
    a, b = (near_copies.bitmap(np.array(sorted(s), np.int64)) for s in (x, y))
    assert len(x & y) <= near_copies.most_common(a, len(x), b, len(y)) <= min(len(x), len(y))


def test_on_odd_tables(odd, empty):
    kept = near_copies.drop_near_copies(odd)
    rows = kept.collect()
    assert kept.columns == odd.columns and near_copies.drop_near_copies(empty).count() == 0
    assert len(rows) == len(set(groups_of([t for _, t, *_ in ROWS])))
    assert sorted(r["doc_id"] for r in rows if r["doc_id"] is not None) == [-8, 1, 2, 5, 6, 7]
    other = odd.selectExpr("concat('x', doc_id) as doc_id", "text", "key as id", "pid as none", "u as h", "v as H1")  # ids that are no numbers, names that clash
    named = near_copies.drop_near_copies(other)
    assert named.columns == other.columns and named.count() == len(rows)


def test_small_sets_at_exactly_the_limit_are_linked(spark):
    """Texts of 1 to 40 shingles, each with one that has as many more as a similarity of 0.8 allows; one more keeps both."""
    r = random.Random(11)
    rows, want, left = [], 0, 0
    for n in range(1, 41):
        for _ in range(6):
            words = [f"q{r.randrange(10**9)}" for _ in range(n + 4)]
            more = [f"z{r.randrange(10**9)}" for _ in range(n // 4 + 1)]
            rows += [" ".join(words), " ".join(words + more[: n // 4])]  # n in common of n + n // 4
            want += 1
            far = [f"y{r.randrange(10**9)}" for _ in range(n + 4)]
            rows += [" ".join(far), " ".join(far + more)]
            left += 2
    rows += ["wjbqniy njyvfkg rtqqtli suebpee lyojyfw xtnjkzu ppqicxq zxxnyip", "wjbqniy njyvfkg rtqqtli suebpee lyojyfw xtnjkzu ppqicxq zxxnyip tantysf"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert near_copies.drop_near_copies(docs).count() == want + left + 1 == len(set(groups_of(rows)))


def test_operator_8_gives_the_first_candidates(spark):
    """The pairs that the stage tries first join whatever texts operator 8 puts into one component."""
    docs = spark.createDataFrame(list(enumerate(_texts())), "doc_id long, text string")
    keys, counts = near_copies._frequent(docs.select(common.body().cast("binary").alias("text")), 5, 42)
    sets = near_copies._sets(docs, 5, 42, keys, counts)
    least = {r["node"]: r["least"]["id"] for r in sets.collect()}
    component = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs, words=5).collect()}
    up = {d: d for d in least.values()}

    def top(d):
        while up[d] != d:
            d = up[d]
        return d

    pairs = near_copies._by_fingerprints(sets, 4).collect()
    assert all(r["u"] > r["v"] for r in pairs)
    for r in pairs:
        up[top(least[r["u"]])] = top(least[r["v"]])
    assert pairs and all((component[a] == component[b]) == (top(a) == top(b)) for a in up for b in up)


def test_texts_move_only_for_pairs_that_pass_their_bounds(spark, monkeypatch):
    r, moved = random.Random(9), []
    words = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    line = "all rights reserved by the holders"  # rare here: every text that holds it is a candidate of the others
    texts = [" ".join([*words(40), *line.split(), *words(40)]) for _ in range(30)]
    texts.append(texts[0] + " more")

    def counted(df, name):
        out = common.materialize(df, name)
        if name == "texts":
            moved.append({x["node"] for x in out.select("node").collect()})
        return out

    monkeypatch.setattr(near_copies, "materialize", counted)
    of = lambda text: near_copies.shingles(text.encode(), 5, 42)
    others = np.setdiff1d(np.concatenate([of(t) for t in texts]), of(line))
    monkeypatch.setattr(near_copies, "_frequent", lambda *_: (others, np.full(len(others), 5)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    linked = near_copies.linked_sets(docs)
    assert len(set().union(*moved)) == 2
    assert linked.select("root").distinct().count() == 30
