"""Each operator against brute force, and on odd tables."""

from __future__ import annotations

import base64
import hashlib
import io
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
import xxhash
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlens.llm import audio, chunk_dedup, decontaminate, language, mixing, pii, quality, queries, sharding, simhash, token_counts
from ledgerlens.llm.common import table

from .conftest import ROWS


@pytest.fixture(scope="module")
def docs(spark, data):
    return {r["doc_id"]: r["text"] for r in table(spark, data, "documents").collect()}


# 1
def _edits(pattern: str, text: str) -> int:
    """Least edit distance between the pattern and any part of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        last, row = row, [i]
        for j, c in enumerate(text, 1):
            row.append(min(last[j - 1] + (p != c), last[j] + 1, row[-1] + 1))
    return min(row)


@settings(max_examples=60, deadline=None)
@given(st.text("ab ", min_size=1, max_size=30), st.text("ab ", max_size=60))
def test_myers_is_the_edit_distance(pattern, text):
    masks = {c: sum(1 << i for i, p in enumerate(pattern) if p == c) for c in set(pattern)}
    want = _edits(pattern, text)
    got, end = decontaminate.myers(masks, len(pattern), text, len(pattern))
    assert got == want or (want == len(pattern) and got >= want)


def test_planted_items_with_edits_are_found():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9)))
    items = [(i, decontaminate.plain(" ".join(word() for _ in range(r.randint(1, 40))))) for i in range(30)]
    matcher = decontaminate.Matcher(items, 0.08)
    for item_id, text in items:
        for edits in range(0, int(len(text) * 0.08) + 1, 3):
            changed = list(text)
            for at in r.sample(range(len(text)), edits):
                changed[at] = r.choice(["", "z", changed[at] + "y"])
            around = decontaminate.plain(" ".join(word() for _ in range(50)) + " " + "".join(changed) + " " + " ".join(word() for _ in range(50)))
            found = {m[0]: m for m in matcher.find(around)}
            want = {i: _edits(t, around) for i, t in items if int(len(t) * 0.08)}
            assert {i: m[1] for i, m in found.items() if m[2]} == {i: e for i, e in want.items() if e <= int(len(items[i][1]) * 0.08)}
            for i, m in found.items():
                if m[2]:
                    assert _edits(items[i][1], around[m[3] : m[4]]) == m[1] and abs(m[4] - m[3] - len(items[i][1])) <= m[2]


def test_contamination_against_containment(spark, data, docs):
    found = {(r["doc_id"], r["item_id"]) for r in queries.op1_decontamination(spark, data).collect()}
    items = {r["item_id"]: decontaminate.plain(r["text"]) for r in table(spark, data, "benchmark").collect()}
    exact = {(d, i) for d, t in docs.items() for i, x in items.items() if x in decontaminate.plain(t or "")}
    assert exact and exact <= found
    blocks = decontaminate.contamination(table(spark, data, "documents"), table(spark, data, "benchmark"), 0.08, block_chars=300).collect()
    assert {(r["doc_id"], r["item_id"]) for r in blocks} == found and len(blocks) == len(found)
    kept = decontaminate.drop_contaminated(table(spark, data, "documents"), table(spark, data, "benchmark"), 0.08).collect()
    assert {r["doc_id"] for r in kept} == set(docs) - {d for d, _ in found}


def test_decontamination_on_odd_tables(spark, odd, empty):
    items = spark.createDataFrame([(1, "QUICK, brown fox!"), (2, None), (None, "日本語のテキスト"), (3, ""), (4, "x"), (4, "x")], "item_id long, text string")
    got = decontaminate.contamination(odd, items).collect()
    assert Counter((r["doc_id"], r["item_id"]) for r in got) == {(1, 1): 2, (7, 4): 2}
    kept = decontaminate.drop_contaminated(odd, items)
    assert kept.columns == odd.columns and kept.count() == len(ROWS) - 4  # the item without an id drops a document, too
    assert decontaminate.drop_contaminated(odd, items, block_chars=8).count() == len(ROWS) - 4
    assert decontaminate.contamination(empty, items).count() == 0 and decontaminate.contamination(odd, items.limit(0)).count() == 0


# 2
def _plain_tokenizer():
    """The vocabulary in the tokenizer's own words, apart from the operator's code."""
    with open("/opt/tokenizers/byte_bpe_multi_50k.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_token_counts_are_those_of_the_tokenizer(spark, data, docs):
    plain = _plain_tokenizer()
    got = {r["doc_id"]: r["tokens"] for r in token_counts.token_counts(table(spark, data, "documents"), block_tokens=97).collect()}
    assert got == {d: len(plain.encode_ordinary(t or "")) for d, t in docs.items()}


def test_long_texts_have_the_tokens_of_the_whole(spark):
    r = random.Random(4)
    some = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    texts = [some("0123456789", 250_000), some("abcdefghij", 250_000), some("ab 1\n\t\u3000", 250_000), some("漢字仮名", 120_000), "a" + " " * 150_000 + "b", "a" + "\n" * 150_000, " " * 120_000 + "\n" + "!" * 120_000, some(" \t\xa0", 130_000) + "x"]
    plain, encodings = _plain_tokenizer(), token_counts.tokenizer(token_counts.TOKENIZERS, token_counts.VOCABULARY)
    for text in texts:
        assert token_counts.encode(encodings, text) == plain.encode_ordinary(text)
    got = token_counts.token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {x["doc_id"]: x["tokens"] for x in got} == {i: len(plain.encode_ordinary(t)) for i, t in enumerate(texts)}
    assert len(token_counts.encode(encodings, " " * 3_000_000 + "x")) > 1  # more than the plain tokenizer can take


def test_stitching_across_blocks(spark):
    r = random.Random(1)
    lengths = [r.choice([0, 0, 1, 3, 40, 250]) for _ in range(300)]
    flat = np.concatenate([np.array([5] * n + [token_counts.END], np.uint16) for n in lengths])
    blocks = [(9, i // 16, flat[i : i + 16].tobytes()) for i in range(0, len(flat), 16)]
    notes = token_counts.scan(spark.createDataFrame(blocks, "file long, block long, payload binary"))
    got = sorted((x["place"], x["tokens"]) for x in token_counts.stitch(notes, group=5).collect())
    assert got == list(enumerate(lengths))


def test_token_counts_on_odd_tables(spark, odd, empty):
    plain = _plain_tokenizer()
    got = Counter((r["doc_id"], r["tokens"]) for r in token_counts.token_counts(odd).collect())
    assert got == Counter((d, len(plain.encode_ordinary(t or ""))) for d, t, *_ in ROWS)
    assert token_counts.token_counts(empty).count() == 0
    assert len(token_counts.encode(token_counts.tokenizer(token_counts.TOKENIZERS, token_counts.VOCABULARY), "<|endoftext|>")) > 1


# 3
def test_language_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op3_language_id(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(rows) > 100 and sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_by_counting_votes(spark, data, docs):
    """Family by the largest margin, then the language with the most pairwise wins, recomputed from n-gram counts."""
    rows = table(spark, data, "documents")
    model = language.fit(rows.filter(queries.bucket("doc_id", 5) != 0).filter("lang is not null"))
    got = {r["doc_id"]: r for r in language.predict(rows, model).collect()}
    assert sorted(sum(model.members.values(), [])) == ["de", "en", "es", "fr"]
    for d, text in list(docs.items())[::5]:
        words = re.findall(rb"[a-z\x80-\xff]+", (text or "").lower().encode())
        line, counts = b" " + b" ".join(words) + b" ", np.zeros(language.SIZE)
        if not words:
            assert got[d]["lang_pred"] == "und" and got[d]["score"] == 0
            continue
        for n in (2, 3, 4):
            for gram, times in Counter(line[i : i + n] for i in range(len(line) - n + 1)).items():
                key = int.from_bytes(gram, "big") * 2654435761 % 2**32 ^ (n - 1) * 40503
                counts[key >> 19] += times
        x = np.append(np.sqrt(counts) / np.linalg.norm(np.sqrt(counts)), 1)
        margins = model.split @ x
        family = model.families[int(margins.argmax())]
        wins = Counter(dict.fromkeys(model.members[family], 0))
        for (a, b), w in model.pairs.items():
            if a in wins:
                wins[a if w @ x >= 0 else b] += 1
        best = max(wins.values())
        assert got[d]["family"] == family and wins[got[d]["lang_pred"]] == best


def test_every_language_is_learned(spark):
    rows = [(f"{chr(97 + i % 26) * 5}{chr(97 + i // 26) * 4} word {j}", f"l{i}") for i in range(200) for j in range(9)]
    model = language.fit(spark.createDataFrame(rows, "text string, lang string"), sample=400)
    assert len(sum(model.members.values(), [])) == 200


def test_language_on_odd_tables(spark, odd, empty):
    assert {r["lang_pred"] for r in language.predict(odd, language.fit(empty)).collect()} == {"und"}
    model = language.fit(odd.filter("lang is not null"))
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in language.predict(odd, model).collect()]
    assert len(got) == len(ROWS) and all(l == "und" and s == 0 for d, l, s in got if d in (2, 3, 4))
    assert next(l for d, l, _ in got if d == 7) != "und"
    assert language.features("12 % 34") is None and language.features("١٢") is None
    assert language.predict(empty, model).count() == 0


# 4
def test_shards_are_contiguous_and_even(spark, data, docs):
    rows = queries.op4_sharding(spark, data).collect()
    size = {d: len((t or "").encode()) + 1 for d, t in docs.items()}
    assert {r["doc_id"]: r["size"] for r in rows} == size
    assert {r["doc_id"]: r["text_crc32"] for r in rows} == {d: zlib.crc32((t or "").encode()) for d, t in docs.items()}
    order = sorted(rows, key=lambda r: r["doc_id"])
    assert [r["shard"] for r in order] == sorted(r["shard"] for r in rows)
    total, before = sum(size.values()), 0
    for r in order:
        assert r["shard"] == min(7, (2 * before + r["size"]) * 8 // (2 * total))
        before += r["size"]
    for shard in range(8):
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))


def test_sharding_on_odd_tables(odd, empty):
    rows = sharding.shard_by_bytes(odd, 3).collect()
    assert len(rows) == len(ROWS) and sharding.shard_by_bytes(empty).count() == 0
    assert Counter(r["size"] for r in rows) == Counter(len((t or "").encode()) + 1 for _, t, *_ in ROWS)


# 5
def _share_out(children: dict[str, tuple[int, int]], budget: int) -> dict[str, int]:
    """Water filling by repeated rounds: fill whoever is short, share the rest."""
    open_, out = {k: v for k, v in children.items() if v[1] > 0}, dict.fromkeys(children, 0)
    while open_:
        w = sum(v[1] for v in open_.values())
        short = {k: v[0] for k, v in open_.items() if v[0] * w <= budget * v[1]}
        if not short:
            return out | {k: budget * v[1] // w for k, v in open_.items()}
        out |= short
        budget -= sum(short.values())
        open_ = {k: v for k, v in open_.items() if k not in short}
    return out


def _mixture(rows, domain, weights, share, max_epochs, seed):
    tree: dict = defaultdict(lambda: defaultdict(lambda: defaultdict(list)))
    tokens = lambda t: len(re.findall(r"[^ \t-\r]+", t or ""))
    for d, text, lang, source in rows:
        tree[domain(source or "")][lang or "(none)"][source or "(none)"].append((d, text))
    cap = lambda leaf: max_epochs * sum(tokens(t) for _, t in leaf)
    w = lambda *p: weights.get("/".join(p), 1)
    md5 = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:15], 16)
    total, out = sum(tokens(t) for _, t, *_ in rows), Counter()
    one = _share_out({d: (sum(cap(x) for l in ls.values() for x in l.values()), w(d)) for d, ls in tree.items()}, total * share[0] // share[1])
    for d, ls in tree.items():
        two = _share_out({l: (sum(map(cap, ss.values())), w(d, l)) for l, ss in ls.items()}, one[d])
        for l, ss in ls.items():
            three = _share_out({s: (cap(x), w(d, l, s)) for s, x in ss.items()}, two[l])
            for s, leaf in ss.items():
                have = cap(leaf) // max_epochs
                if not have:
                    continue
                full, rest = divmod(three[s], have)
                place = lambda i, t: md5(f"{seed}:{full}:{'-' if i is None else i}:{md5(t or '')}")  # noqa: E731, B023
                before, last = 0, None
                for i, t in sorted(leaf, key=lambda x: place(*x)):
                    if place(i, t) != last and before >= rest:
                        break
                    last = place(i, t)
                    out[i, d, l, s, full] += 1
                    before += tokens(t)
                for i, _ in leaf:
                    for e in range(full):
                        out[i, d, l, s, e] += 1
    return out


def _domain(source: str) -> str:
    n = int(source[3:]) if re.fullmatch("src[0-9]{1,4}", source) else 9999
    return "web" if n <= 9 else "reference" if n <= 14 else "forum"


@pytest.mark.parametrize("share", [(1, 1), (1, 7), (3, 1), (9, 1)])
def test_mixture_against_brute_force(spark, data, share):
    docs = table(spark, data, "documents")
    got = mixing.mix(docs, queries.domain_of(), queries.WEIGHTS, share, 4, 7).collect()
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect()]
    assert Counter((r["doc_id"], r["mix_domain"], r["mix_lang"], r["mix_source"], r["mix_epoch"]) for r in got) == _mixture(rows, _domain, queries.WEIGHTS, share, 4, 7)


def test_mixing_on_odd_tables(odd, empty):
    got = mixing.mix(odd, queries.domain_of(), {"web": 3, "web/en": 0}, (2, 1), 3, 1)
    assert got.columns[: len(odd.columns)] == odd.columns
    assert Counter((r["doc_id"], r["mix_domain"], r["mix_lang"], r["mix_source"], r["mix_epoch"]) for r in got.collect()) == _mixture(ROWS, _domain, {"web": 3, "web/en": 0}, (2, 1), 3, 1)
    assert mixing.mix(empty, queries.domain_of(), {}).count() == 0


# 6
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(digits: str) -> bool:
    twice = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in twice) % 10 == 0


def _base(text: str) -> list[tuple[str, int, int]]:
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and _luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text("ab1.@+-% ", max_size=40), st.text("0123456789 -+().", max_size=60), st.text("1.2 5", max_size=40)))
def test_plain_identifiers_against_the_patterns(text):
    assert pii.detect(text) == _base(text)


def test_plain_identifiers_of_the_documents(spark, data, docs):
    for r in queries.op6_personal_data(spark, data).collect():
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in _base(docs[r["doc_id"]] or ""))
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest() and set(filter(None, base.split(","))) <= set(r["spans"].split(","))


@pytest.mark.parametrize(
    ("text", "kind", "source"),
    [
        ("write to john.doe (at) example [dot] com today", "email", "john.doe (at) example [dot] com"),
        ("it is jane at mail dot example dot org.", "email", "jane at mail dot example dot org"),
        ("mаria@exаmple.com", "email", "mаria@exаmple.com"),  # Cyrillic
        ("ｊｏｅ＠ｅｘａｍｐｌｅ．ｃｏｍ", "email", "ｊｏｅ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
        ("call plus one five five five 123 four five six seven now", "phone", "plus one five five five 123 four five six seven"),
        ("jo​e@ex​ample.com", "email", "jo​e@ex​ample.com"),
        ("host one nine two dot 168 dot 0 dot 1 up", "ip", "one nine two dot 168 dot 0 dot 1"),
        ("Ѕam (at) example (dot) com", "email", "Ѕam (at) example (dot) com"),
        ("max punkt muster (at) beispiel punkt de", "email", "max punkt muster (at) beispiel punkt de"),
        ("de juan arroba correo punto es,", "email", "juan arroba correo punto es"),
        ("plus vier neun eins sieben sechs eins zwei drei vier fünf sechs!", "phone", "plus vier neun eins sieben sechs eins zwei drei vier fünf sechs"),
        ("au plus trois trois un deux trois quatre cinq six sept huit", "phone", "plus trois trois un deux trois quatre cinq six sept huit"),
        ("𝗃𝗈𝖾@ex.com ①①①", "email", "𝗃𝗈𝖾@ex.com"),
        ("card ٤111 1111 1111 1111", "card", "٤111 1111 1111 1111"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, source):
    found = [s for s in pii.find(text) if not s[3]]
    if source is None:
        assert all(text[s[1] : s[2]] for s in found)
    else:
        assert (kind, source) in [(s[0], text[s[1] : s[2]]) for s in found]


def _slow_find(text: str) -> set[tuple[str, int, int]]:
    """Spans by rewriting one piece at a time, every character carrying its place in the source."""
    marked = [(c, i, i + 1, False) for i, c in enumerate(text)]
    out, at = [], 0
    for m in pii._TRIGGER.finditer(text) if pii._HINT.search(text) else ():
        kind = m.lastgroup
        new = {"at": "@", "dot": "."}.get(kind) or (pii._WORDS[m[0].strip(" -").lower()] if kind == "word" else pii._plain_glyph(m[0]))
        if new == m[0]:
            continue
        out += marked[at : m.start()] + [(new, m.start(), m.end(), True)]
        at = m.end()
    out += marked[at:]
    form = [(c, a, b, new) for c, a, b, new in out if c or new]
    letters = [x for x in form if x[0]]
    found = {(k, a, b) for k, a, b in _base(text)}
    for k, a, b in _base("".join(x[0] for x in letters)):
        begin, end = letters[a][1], letters[b - 1][2]
        touched = any(x[3] for x in form[form.index(letters[a]) : form.index(letters[b - 1]) + 1])
        if touched and not any(k == kind and s <= begin and end <= e for kind, s, e in _base(text)):
            found.add((k, begin, end))
    return found


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["joe", "example", " (at) ", " at ", " dot ", "(punkt)", "com", "one ", "two ", "fünf ", "plus ", "555", " 123", "1.2", "ｅ", "о", "\u200b", "@", ".", " ", "+1 ", "4111", "①"]), max_size=14).map("".join))
def test_disguises_against_one_piece_at_a_time(text):
    assert {(k, a, b) for k, a, b, _ in pii.find(text)} == _slow_find(text)


def test_clean_text_stays_clean_and_work_is_linear(odd, empty):
    assert pii.find("One at a time, two dots at most; look at example.com (at noon).") == []
    for text in ("1" * 300_000, "a" * 300_000, "1." * 150_000, "+1" + " " * 300_000, " " * 300_000 + "dot", "one " * 80_000, "@" * 100_000, "1 " * 100_000):
        pii.find(text)
    assert pii.personal_data(odd).count() == len(ROWS) and pii.personal_data(empty).count() == 0


# 7
def test_media_round_trip(spark, data, docs):
    for r in queries.op7_audio_features(spark, data).collect():
        raw = (docs[r["doc_id"]] or "").encode()
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-32:])
        media = audio.to_wav(raw)
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())


def test_features_are_those_of_the_definition():
    x = np.random.default_rng(1).standard_normal(5_003).astype(np.float32)
    up = np.zeros(len(x) * audio.UP)
    up[:: audio.UP] = x
    h = audio._phases()[:, ::-1].T.ravel()
    want = np.convolve(up, h)[:: audio.DOWN][: -(-len(x) * audio.UP // audio.DOWN)]
    assert np.allclose(audio.resample(x), want, atol=1e-4)
    y = audio.resample(np.sin(2 * np.pi * 1000 * np.arange(12_000) / audio.RATE).astype(np.float32))
    mel, _ = audio.log_mel(y)
    top = np.argmax(audio._mel()[round(1000 * audio.FRAME / 8000)])
    assert abs(int(np.median(mel[2:-2].argmax(1))) - int(top)) <= 1
    stream, n = audio.tensor_stream(mel)
    batch = pa.ipc.open_stream(io.BytesIO(stream)).read_all()
    assert batch.num_rows == n and batch.schema.field("log_mel").type.shape == [audio.PATCH, audio.MELS]
    assert np.allclose(batch["log_mel"].chunk(0).to_numpy_ndarray()[0][: len(mel)], mel[: audio.PATCH])
    power = np.array([0, 0, 9, 5, 4, 0, 0, 9, 0, 0], np.float32)
    assert audio.segments(power) == [(2, 5), (7, 8)]


def test_audio_on_odd_tables(odd, empty):
    rows = audio.audio_features(audio.encode_media(odd)).collect()
    assert len(rows) == len(ROWS) and all(r["payload_bytes"] % 576 == 0 and r["payload_bytes"] > 0 for r in rows)
    assert audio.audio_features(audio.encode_media(empty)).count() == 0


# 8
def _fingerprint(text: str) -> int:
    tokens = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    grams = [" ".join(tokens[i : i + 4]) for i in range(len(tokens) - 3)] or ([" ".join(tokens)] if tokens else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _components(rows: list[tuple[int | None, int]], bits: int) -> list[int | None]:
    fps = sorted({f for _, f in rows})
    up = {f: f for f in fps}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= bits:
                up[top(a)] = top(b)
    least: dict = {}
    for d, f in rows:
        if d is not None:
            least[top(f)] = min(d, least.get(top(f), d))
    return [least.get(top(f)) for _, f in rows]


def test_simhash_against_all_pairs(spark, data, docs):
    got = {r["doc_id"]: r for r in queries.op8_simhash(spark, data).collect()}
    rows = [(d, _fingerprint(t or "")) for d, t in docs.items()]
    assert {d: r["fingerprint"] for d, r in got.items()} == {d: f"{f:016x}" for d, f in rows}
    assert [got[d]["component_id"] for d, _ in rows] == _components(rows, 4)


@pytest.mark.parametrize("hot", [8, simhash.HOT_BUCKET])
def test_links_lose_nothing(spark, hot):
    r = random.Random(5)
    fps = {0, 2**64 - 1}
    for _ in range(60):
        x = r.getrandbits(64)
        for _ in range(8):
            x ^= sum(1 << b for b in r.sample(range(64), r.randint(1, 6)))
            fps.add(x)
    for _ in range(60):  # many in one segment
        fps.add((0x1234 << 43) | r.getrandbits(18) | (r.getrandbits(4) << 22))
    rows = [(i, f) for i, f in enumerate(sorted(fps))]
    signed = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    edges = [(e["u"] & (2**64 - 1), e["v"] & (2**64 - 1)) for e in simhash.links(signed, 4, hot).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in edges)
    up = {f: f for f in fps}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        up[top(a)] = top(b)
    want = defaultdict(set)
    for (i, f), c in zip(rows, _components(rows, 4)):
        want[c].add(f)
    assert {frozenset(g) for g in want.values()} == {frozenset(f for f in fps if top(f) == t) for t in {top(f) for f in fps}}


def test_training_samples_stay_bounded(spark):
    """One group of copies, or one id, that holds most rows does not take over a training sample."""
    words = {"en": "the quick brown fox", "de": "der schnelle braune fuchs", "fr": "le vif renard brun"}
    rows = [(f"{w} {i}", lang) for lang, w in words.items() for i in range(40)] + [("the same english text", "en")] * 6000
    model = language.fit(spark.createDataFrame(rows, "text string, lang string"), sample=300)
    assert sorted(sum(model.members.values(), [])) == ["de", "en", "fr"]
    docs = spark.createDataFrame([(i % 60, f"text {i % 60} " * 20) for i in range(300)] + [(0, "copy " * 30)] * 5000, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    assert len(quality.fit(docs, labels, F.lit(True)).good) > 0


def test_simhash_on_odd_tables(odd, empty):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(ROWS) and simhash.near_duplicates(empty).count() == 0
    assert [r["component_id"] for r in sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)) if r["doc_id"] in (2, 3, 4)] == [2, 2, 2]


# 9
def test_quality_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op9_quality(spark, sf).join(table(spark, sf, "labels"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] == r["quality"] for r in held) / len(held) >= 0.93
    good = [r for r in held if r["quality"] == 1]
    assert sum(r["predicted"] for r in good) / len(good) >= 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_quality_by_compressing_again(spark, data, docs):
    """Each score from the compressed sizes of the whole text under both dictionaries, by another interface."""
    rows = table(spark, data, "documents")
    model = queries.quality_model(spark, data, rows)
    got = {r["doc_id"]: r for r in quality.score(rows, model).collect()}
    tools = []
    for raw in (model.good, model.bad):
        dictionary = zstandard.ZstdCompressionDict(raw)
        dictionary.precompute_compress(level=quality.LEVEL)
        tools.append(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False))
    for d, text in docs.items():
        data_ = (text or "").encode()
        sizes = [sum(len(tool.compress(data_[i : i + quality.CHUNK])) for i in range(0, len(data_), quality.CHUNK)) for tool in tools]
        difference = (sizes[1] - sizes[0]) / sum(sizes) if data_ else 0.0
        assert got[d]["difference"] == pytest.approx(difference, abs=1e-12)
        want = 1 / (1 + np.exp(-(model.curve[0] + model.curve[1] * got[d]["difference"])))
        assert got[d]["score"] == pytest.approx(want, abs=1e-9) and got[d]["predicted"] == (got[d]["score"] >= 0.5)
    assert model.curve[1] > 0


def test_quality_on_odd_tables(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, None), (5, 0, 0), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    usable = queries.bucket("label_id", 1) == 0
    for model in (quality.fit(odd, labels, usable), quality.fit(odd, labels.limit(0), usable), quality.fit(odd, labels.filter("quality = 1"), usable)):
        rows = quality.score(odd, model).collect()
        assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
        assert quality.score(empty, model).count() == 0 and quality.keep_good(odd, model).columns == odd.columns


# 10
def test_gear_hash_and_cuts():
    x = np.random.default_rng(2).integers(0, 256, 40_000).astype(np.uint8)
    h = chunk_dedup.gear(x)
    assert all(int(h[i]) == sum(int(chunk_dedup.GEAR[x[i - j]]) << j for j in range(16)) % 2**32 for i in (15, 99, 39_999))
    ends = chunk_dedup.cuts(x)
    want = {i + 1 for i in range(15, len(x) - 16) if h[i] > max(h[max(0, i - 16) : i], default=0) and h[i] >= max(h[i + 1 : i + 17], default=0)} | {len(x)}
    assert set(ends.tolist()) == want
    step, chunk_dedup._STEP = chunk_dedup._STEP, 1_000
    assert chunk_dedup.cuts(x).tolist() == ends.tolist()
    chunk_dedup._STEP = step
    shifted = chunk_dedup.cuts(np.concatenate([x[:77], x]))
    assert len(set((shifted - 77).tolist()) & set(ends.tolist())) >= len(ends) - 4
    assert max(np.diff(chunk_dedup.cuts(np.zeros(5_000, np.uint8)), prepend=0)) <= 256


def test_repeated_passages_against_word_windows(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, sf, "documents").collect()}
    windows = {}
    for n in (51, 60):
        grams = defaultdict(set)
        for d, text in texts.items():
            words = text.split()
            for i in range(len(words) - n + 1):
                grams[" ".join(words[i : i + n])].add(d)
        windows[n] = {d for s in grams.values() if len(s) > 1 for d in s}
    rows = chunk_dedup.repeated_passages(table(spark, sf, "documents")).collect()
    found = {r["doc_id"] for r in rows}
    assert windows[60] and windows[60] <= found <= windows[51] and len(found) >= 0.99 * len(windows[51])
    for r in rows:
        part = texts[r["doc_id"]][r["start"] : r["end"]]
        assert len(part.split()) >= r["words"] - 1 >= 50
        for d in r["drops"]:
            words = texts[r["doc_id"]][d["start"] : d["end"]].split()[1:-1]  # cuts fall inside words
            assert any(" ".join(words[i : i + 20]) in " ".join(t.split()) for i in range(0, max(1, len(words) - 20), 20) for o, t in texts.items() if o < r["doc_id"])


def test_windows_around_short_runs():
    r = random.Random(2)
    for _ in range(200):
        n = r.randint(0, 90)
        text = "".join(r.choice(" \n ") * r.randint(1, 2) + f"é{r.randrange(99)}" for _ in range(n)) + " " * r.randint(0, 1)
        spans = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
        start = r.randrange(len(text) + 1)
        end = r.randint(start, len(text))
        touched = [i for i, (x, y) in enumerate(spans) if y > start and x < end]
        want = {i: " ".join(text.split()[i : i + 51]) for i in range(n - 50) if len(set(touched) & set(range(i, i + 51))) >= max(1, min(30, len(touched)))}
        got = list(zip(*(c.tolist() for c in chunk_dedup.windows(text, [(7, start, end)], 51, 30))))
        assert {w[1]: " ".join(text[w[3] : w[4]].split()) for w in got} == want and {w[0] for w in got} <= {7}
        again = chunk_dedup.windows("some other words " + text, [(8, start + 17, end + 17)], 51, 30)
        assert {w[2] for w in got} <= set(again[2].tolist()) and len({w[2] for w in got}) == len(set(want.values()))


def test_a_short_run_meets_every_document(spark):
    """A passage of 55 words in two documents is found although its middle stands in an earlier third one."""
    r = random.Random(4)
    words = lambda n: " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(n))
    rows, want = [], set()
    for i in range(30):
        before, middle, after = words(6), words(44), words(5)
        rows += [(10 * i, f"{words(20)} {middle} {words(20)}")]
        rows += [(10 * i + k, f"{words(20)} {before} {middle} {after} {words(20)}") for k in (1, 2, 3)]
        want |= {10 * i + k for k in (1, 2, 3)}
    found = chunk_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x["doc_id"] for x in found} <= want and len({x["doc_id"] for x in found}) >= 0.8 * len(want)
    assert all(51 <= x["words"] <= 57 and x["doc_id"] // 10 == x["first_doc_id"] // 10 for x in found)


def test_ids_of_any_sign_and_none_are_kept(spark):
    r = random.Random(6)
    passage = " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(90))
    rows = [(-5, "one " + passage), (1, "two " + passage), (-2, "three " + passage), (None, "four " + passage), (-9, "alone")]
    got = {(x["doc_id"], x["first_doc_id"]) for x in chunk_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d for d, _ in got} == {-5, 1, -2, None} and len({f for _, f in got}) == 1
    clash = spark.createDataFrame([(*x, 1, 2, 3) for x in rows], "doc_id long, text string, doc int, row int, drops int")
    kept = chunk_dedup.drop_repeats(clash)
    assert kept.columns == clash.columns and sum(passage in x["text"] for x in kept.collect()) == 1


def test_repeats_are_dropped_but_for_the_first(spark, odd, empty):
    r = random.Random(9)
    words = lambda n: " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(n))
    passage = words(80)
    rows = [(i, f"{words(60)} é {passage} {words(40)}") for i in range(5)] + [(9, words(200)), (10, None), (None, passage + words(30)), (4, None)]
    docs = spark.createDataFrame([(*x, "k") for x in rows], "doc_id long, text string, row string")
    kept = {(x["doc_id"], len(x["text"] or "")): x["text"] for x in chunk_dedup.drop_repeats(docs).collect()}
    assert len(kept) == len(rows)
    whole = [d for (d, _), t in kept.items() if t and passage in t]
    assert whole in ([None], [0])  # a row without an id sorts by its text's hash
    assert (9, len(rows[5][1])) in kept and (10, 0) in kept
    assert chunk_dedup.repeated_passages(empty).count() == 0 and chunk_dedup.drop_repeats(odd).count() == len(ROWS)
    assert {x["doc_id"] for x in chunk_dedup.repeated_passages(odd).collect()} == set()
