"""Fill-in-the-middle, quality rules and phrases: plain versions, round trips, odd input."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import collocations, fill_middle, pii, quality_rules
from ledgerlens.llm import queries as q
from ledgerlens.llm.common import table


@pytest.mark.parametrize("name", ["op11_fill_middle", "op13_collocations"])
def test_against_sql(spark, data, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{data}/documents.parquet'")
    got, want = q.QUERIES[name](spark, data), con.sql(q.ORACLE_SQL[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    at = [want.columns.index(c) for c in names]
    assert Counter(tuple(r[c] for c in names) for r in got.collect()) == Counter(tuple(r[i] for i in at) for r in want.fetchall())


def plain_middle(doc_id, text: str) -> tuple:
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i * 8 : i * 8 + 8], 16) for i in range(4)]
    if not units or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_fill_in_middle_of_odd_texts(spark, odd):
    texts = ["", " ", "a", "<", "<<S", "a <P> b", "x\x0by\x0c z\r\n", "é🙂 日本 < > <M", "P>a <P", "\x1f  b"]
    more = spark.createDataFrame([(i * 31 + j, x, None, None, None) for j, x in enumerate(texts) for i in range(60)], "doc_id long, text string, lang string, source string, n_chars long")
    rows = odd.select(*more.columns).unionAll(more)
    done = fill_middle.fill_in_middle(rows).withColumn("back", fill_middle.restored(F.col("output"), F.col("form")))
    want = Counter((r["doc_id"], *plain_middle(r["doc_id"], r["text"] or ""), r["text"] or "") for r in rows.collect())
    size = lambda x: None if x is None else len(x)
    got = Counter((r["doc_id"], r["n"], r["form"], size(r["prefix"]), size(r["middle"]), r["output"], r["back"]) for r in done.collect())
    assert got == want
    assert {k[2] for k in got} == {"plain", "spm", "psm"}


def plain_statistics(text: str) -> tuple:
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_statistics_against_a_plain_count(spark, odd, data):
    rng = random.Random(4)
    made = [" ".join(rng.choice("ab") for _ in range(n)) for n in range(0, 60)] + ["a b\n\na b\n a b\nx # * $\n\n", "a\x1fb a\x1fb", "w v " * 7, "1 2 3 4 5", "1 1 1 1 1 1"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(made)], "doc_id long, text string").unionAll(odd.select("doc_id", "text")).unionAll(table(spark, data, "documents").select("doc_id", "text"))
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in quality_rules.statistics(rows).collect())
    assert got == Counter((r["doc_id"], *plain_statistics(r["text"] or "")) for r in rows.collect())


def test_rules_are_learned_in_order_and_leave_good_rows(spark):
    """Two kinds of bad rows, one a conjunction; a statistic of noise must not matter."""
    rng = random.Random(1)
    rows = []
    for i in range(3000):
        symbols, letters = rng.random() < 0.1, rng.random() < 0.3
        n, digits = rng.randint(20, 400), rng.random() < 0.3
        bad = symbols or (letters and digits)
        rows.append((i, n, n * 5, n if symbols else 0, 0, 0, rng.randint(1, 9), n // 2, n * 3 if digits else 0, n if letters else n * 4, rng.randint(0, n), rng.randint(0, n), int(not bad)))
    names = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines n_different n_digits n_letters n_capitals n_marks quality".split()
    stats = spark.createDataFrame(rows, ", ".join(f"{c} long" for c in names))
    rules = quality_rules.learn(stats.drop("quality"), stats.select("doc_id", "quality"), F.lit(True))
    assert len(rules) >= 2 and any(len(r.conditions) > 1 for r in rules)
    got = quality_rules.apply_rules(stats, rules).select("quality", "kept").collect()
    assert sum(r["kept"] == bool(r["quality"]) for r in got) >= 0.99 * len(got)
    assert all(r["kept"] for r in got if r["quality"]) or sum(not r["kept"] for r in got if r["quality"]) < 0.005 * len(got)


def test_rules_without_both_classes_or_rows(spark, odd, empty):
    stats = quality_rules.statistics(odd)
    labels = spark.createDataFrame([(1, 1), (5, 1), (None, 0)], "doc_id long, quality int")
    assert quality_rules.learn(stats, labels, F.lit(True)) == []
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.apply_rules(stats, []).collect()}
    assert not kept[2] and not kept[3] and not kept[5]
    assert quality_rules.learn(quality_rules.statistics(empty), labels, F.lit(True)) == []
    assert quality_rules.apply_rules(quality_rules.statistics(empty), []).count() == 0


def test_held_out_quality(spark):
    rows = q.op12_quality_rules(spark, "/root/testdata/sf0.01").filter("held_out and not base_failed")
    rows = rows.join(table(spark, "/root/testdata/sf0.01", "labels").select("doc_id", "quality"), "doc_id").collect()
    assert sum(r["kept"] for r in rows if r["quality"] == 1) >= 0.99 * sum(r["quality"] == 1 for r in rows)
    assert sum(not r["kept"] for r in rows if r["quality"] == 0) >= 0.8 * sum(r["quality"] == 0 for r in rows)


def plain_phrases(rows, least: int):
    n, one, many = Counter(), Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            one.update((lang, (x,)) for x in w)
            for k in (2, 3):
                many.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    f = one + many
    out = []
    for (lang, p), a in many.items():
        if a < least:
            continue
        cuts = [(1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        if any(lang2 == lang and len(x) == 3 and len(p) == 2 and p in (x[:2], x[1:]) and c >= least and 100 * c >= 50 * a for (lang2, x), c in many.items()):
            continue
        out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    return Counter(out)


def test_phrases_against_a_plain_count_across_blocks(spark, odd, monkeypatch):
    """Blocks of a few texts, so that runs go on from block to block and from batch to batch."""
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["of the", "in a", "red", "blue,", "Z.", "é\t日", "x y", "rare%d" % rng.randint(0, 999)]) for _ in range(rng.randint(0, 80))) for _ in range(150)]
    made = spark.createDataFrame([(i, x, rng.choice(["en", "de", None])) for i, x in enumerate(texts)], "doc_id long, text string, lang string")
    rows = made.unionAll(odd.select("doc_id", "text", "lang").filter("length(text) < 100000"))
    monkeypatch.setattr(collocations, "BLOCK", 500)
    got = collocations.collocations(rows, least=3, most=10_000).collect()
    want = plain_phrases([(r["lang"], r["text"]) for r in rows.collect()], 3)
    assert Counter((r["lang"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in got) == want
    for lang in ("en", "de", "und"):
        mine = sorted((r["rank"], -r["score"], -r["a"], r["phrase"].encode()) for r in got if r["lang"] == lang)
        assert [x[0] for x in mine] == list(range(1, len(mine) + 1)) and [x[1:] for x in mine] == sorted(x[1:] for x in mine)


def test_phrases_of_nothing(empty, spark):
    assert collocations.collocations(empty).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, None, None), (2, " . , ", "en")], "doc_id long, text string, lang string")).count() == 0


def test_whole_numbers_beyond_64_bits(spark):
    row = spark.range(1).select(collocations.scored(F.lit(3_000_000_000_001), F.lit(7_000_000_000_003), F.lit(5_000_000_000_009)).alias("s")).first()
    assert row["s"] == 1_000_000 * 3_000_000_000_001**2 // (7_000_000_000_003 * 5_000_000_000_009)


def test_radix_order_and_runs_over_batches():
    rng = np.random.default_rng(0)
    columns = [rng.integers(0, n, 5000) for n in (3, 70_000, 1 << 34)]
    assert (collocations._radix_order(columns) == np.lexsort(columns[::-1])).all()
    ids = np.sort(rng.integers(1, 5, (4000, 3)) * rng.integers(0, 2, (4000, 3)).clip(1), axis=0)
    ids = ids[np.lexsort(ids.T[::-1])]
    import pyarrow as pa

    keys, counts = collocations._packed(list(ids.T)), rng.integers(1, 4, len(ids))
    batches = [pa.RecordBatch.from_arrays([collocations._binary(keys[i : i + 7]), pa.array(counts[i : i + 7])], ["key", "n"]) for i in range(0, len(ids), 7)]
    found = {tuple(r[c] for c in "abc"): r["f"] for b in collocations._count_runs(5)(iter(batches)) for r in b.to_pylist()}
    want = Counter()
    for row, n in zip(ids.tolist(), counts.tolist()):
        want[tuple(row)] += n
        want[(*row[:2], 0)] += n
    assert found == {k: n for k, n in want.items() if n >= 5}


def test_every_sign_that_the_transducer_rewrites_wakes_it():
    import sys

    from ledgerlens.llm import pii

    signs = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    assert all(pii._HINT.search(c) for c in signs if (m := pii._TRIGGER.fullmatch(c)) and m.lastgroup == "glyph" and pii._plain_glyph(c) != c)
    for text, span in (("192.168.¹.¹", (0, 11)), ("192.168.².7", (0, 11)), ("192.168.⁴.⁴", (0, 11))):
        assert [(k, a, b) for k, a, b, _ in pii.find(text)] == [("ip", *span)]


def test_columns_of_any_name_stay(spark, odd):
    from ledgerlens.llm import mixing, quality

    rows = odd.select("doc_id", "text", "lang", "source", F.lit(0.5).alias("mix_tokens"), F.lit("x").alias("a.b"))
    mixed = mixing.mix(rows, q.domain_of(), {}, (1, 1), 2, 7)
    assert mixed.columns[:6] == rows.columns and "mix_tokens_" in mixed.columns
    assert {r["mix_tokens"] for r in mixed.collect()} == {0.5}
    kept = quality.keep_good(rows, quality.Model(b"", b"", (0.0, 0.0), 1.0))
    assert kept.columns == rows.columns and kept.count() == rows.count()


def test_columns_of_any_name_stay_in_filters_of_texts(spark, odd):
    from ledgerlens.llm import chunk_dedup, decontaminate, near_copies

    rows = odd.select("doc_id", F.lit("x").alias("a.b"), "text", F.lit("y").alias("h"), F.lit("z").alias("odd `name"))
    items = spark.createDataFrame([(1, "QUICK, brown fox!"), (4, "x")], "item_id long, text string")
    for kept, n in ((decontaminate.drop_contaminated(rows, items), 8), (decontaminate.drop_contaminated(rows, items, block_chars=8), 8), (chunk_dedup.drop_repeats(rows), 11), (near_copies.drop_near_copies(rows), None)):
        assert kept.columns == rows.columns
        found = kept.collect()
        assert n is None or len(found) == n
        assert found and {tuple(r)[1::2] for r in found} == {("x", "y")} and {r[4] for r in found} == {"z"}


def test_chunks_for_the_driver_are_bounded(spark):
    """However long the labelled texts are, no more bytes than asked for train a dictionary, and the order of rows does not matter."""
    from ledgerlens.llm import quality

    docs = spark.createDataFrame([(i, " ".join(f"{'good' if i % 2 else 'bad'}{j * i % 977}" for j in range(4000))) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    one, two = (quality.fit(d, labels, F.lit(True), train_bytes=20_000) for d in (docs, docs.orderBy(F.rand(3))))
    assert 0 < len(one.good) <= 10_000 and (one.good, one.bad, one.curve) == (two.good, two.bad, two.curve)
    assert len(quality.fit(docs, labels, F.lit(True)).good) > len(one.good)


@pytest.mark.parametrize(("text", "kind", "span"), [
    ("send to joe@example[dot]com today", "email", "joe@example[dot]com"),
    ("host 192(.)168(.)0(.)17 runs", "ip", "192(.)168(.)0(.)17"),
    ("call +49 170 1234     two     two", "phone", "+49 170 1234     two     two"),
    ("ask joe@fünf.de now", "email", "joe@fünf.de"),
    ("ask joe at mail.example dot com today", "email", "joe at mail.example dot com"),
])
def test_disguises_need_no_other_sign_to_be_read(text, kind, span):
    """Texts without an i (but for the last), which woke the transducer by chance (as the other case of a dotless one)."""
    assert "i" not in text.replace("mail.", "")
    assert (kind, text.index(span), text.index(span) + len(span), False) in pii.find(text)
