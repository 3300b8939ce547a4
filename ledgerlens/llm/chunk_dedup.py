"""Substring dedup by content-defined chunks.

A gear rolling hash (16 bytes, 32 bits) runs over a text's UTF-8 bytes; a chunk ends where
the hash is the largest of the 33 around it. Cuts depend on nearby bytes alone, so a passage
is cut alike wherever it stands, a few dozen bytes after its start. Text that repeats itself
has no single largest hash; there the cuts are at equal hashes, 32 bytes apart or more.

Chunks are deduplicated by digest in spans: from each chunk as many as make ``SPAN_WORDS`` words.
A span whose digest occurs in several documents stands word for word in each of them. Spans
that overlap and have the same partner (the least document that has them; for that one the
greatest) make a run. Cuts lose a few dozen bytes at a passage's ends, so of a run of fewer than ``min_words`` words every
window of ``min_words`` words that may hold one of its spans is looked up by digest among those of all runs: it is reported as far as its windows
stand in another document, whichever that is (words parted by any white space). Runs of more words are reported as they are.

The least document of each span keeps it (documents sort by doc_id; one without an id counts by
its text's hash). Rows that share a doc_id are one document; rows without one are told apart by
their text. Equal rows count once. Null and empty texts have no chunks; an empty table gives an empty
result. A doc_id that is no number counts as null. start and end count code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import body, doc_number, materialize, numbered, sieve

REACH = 16
LONGEST = 256
SPAN_WORDS = 30
#: Passages of over 50 words.
MIN_WORDS = 51
_STEP = 1 << 22
#: One random 32-bit number for each byte, from a fixed rule.
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 2024) for b in range(256)], np.uint32)
#: Factor of the windows' digests: odd, so that it has an inverse modulo 2 to the 64.
FACTOR = xxhash.xxh64_intdigest(b"windows", 2024) | 1
SPANS = "doc long, row int, digest long, start int, end int, word int, words int"


def gear(x: np.ndarray) -> np.ndarray:
    """Gear hash of the 16 bytes up to each position: the sum of GEAR[x[i - j]] << j."""
    h = GEAR[x]
    for s in (1, 2, 4, 8):
        h[s:] = h[s:] + (h[:-s] << np.uint32(s))
    return h


def cuts(x: np.ndarray) -> np.ndarray:
    """Ends of the chunks of a byte array."""
    n, found, level = len(x), [], []
    for at in range(0, n, _STEP):
        low, high = max(0, at - 3 * REACH), min(n, at + _STEP + REACH)
        h = gear(x[low:high])
        if low:
            h = h[REACH:]  # here the window is full
            low += REACH
        padded = np.concatenate([np.zeros(REACH, np.uint32), h, np.zeros(REACH, np.uint32)])
        top = padded
        for s in (1, 2, 4, 8):
            top = np.maximum(top[:-s], top[s:])  # of 16 from each position on
        before, after = top[: len(h)], top[REACH + 1 : REACH + 1 + len(h)]
        high_ = (h >= before) & (h >= after)
        for rows, peak in ((found, high_ & (h > before)), (level, high_)):
            ends = np.flatnonzero(peak[at - low : at - low + _STEP]) + at + 1
            rows.append(ends[(ends >= REACH) & (ends <= n - REACH)])  # no crumbs at the ends of a text
    ends = np.unique(np.concatenate([*found, [n]])).astype(np.int64)
    gaps = np.diff(ends, prepend=0)
    wide = gaps > 4 * REACH
    if wide.any():
        ties = np.concatenate(level)
        begin, end = (ends - gaps)[wide], ends[wide]
        spans = zip(begin.tolist(), end.tolist(), np.searchsorted(ties, begin, "right").tolist(), np.searchsorted(ties, end).tolist())
        extra = [_even(a, e, ties[i:j]) for a, e, i, j in spans if i < j or e - a > LONGEST]
        ends = np.unique(np.concatenate([ends, *extra]))
    return ends


def _even(begin: int, end: int, ties: np.ndarray) -> np.ndarray:
    """Cuts of a stretch without a peak, which is text that repeats itself: at equals of its hash's maximum, so always in the same phase."""
    out, last = [], begin
    for t in [*ties.tolist(), end]:
        while t - last > LONGEST:
            last += LONGEST
            out.append(last)
        if t < end and t - last >= 2 * REACH:
            last = t
            out.append(t)
    return np.array(out, np.int64)


def chunk(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ends in bytes, ends in code points, words begun up to each end) of a text's chunks."""
    x = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    ends = cuts(x)
    letters = np.cumsum((x & 0xC0) != 0x80, dtype=np.int64)
    dark = x > 32
    words = np.cumsum(dark & ~np.concatenate([[False], dark[:-1]]), dtype=np.int64)
    return ends, letters[ends - 1], words[ends - 1]


def text_spans(text: str, span_words: int) -> tuple[np.ndarray, ...]:
    """(digests, starts, ends, first word, words) of a text's spans, in code points; none where fewer words are left."""
    data = memoryview(text.encode("utf-8", "replace"))
    ends, letters, words = (np.r_[0, c] for c in chunk(text))
    last = np.searchsorted(words, words[:-1] + span_words)
    n = int(np.searchsorted(last, len(ends)))  # of these spans the text has enough words
    last = last[:n]
    digests = np.fromiter((xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(ends[:n].tolist(), ends[last].tolist())), np.uint64, n)
    return digests.view(np.int64), letters[:n].astype(np.int32), letters[last].astype(np.int32), words[:n].astype(np.int32), (words[last] - words[:n]).astype(np.int32)


def _marks(doc_id: str = "doc_id", text: str = "text") -> tuple[Column, Column]:
    """(doc, row) of a row: the document, and its text's hash, which is negative where there is no id."""
    number, hashed = doc_number(doc_id), F.hash(body(text)).bitwiseAND(F.lit((1 << 31) - 1))
    return F.coalesce(number, F.xxhash64(body(text))), F.when(number.isNull(), -1 - hashed).otherwise(hashed)


def spans(docs: DataFrame, span_words: int = SPAN_WORDS) -> DataFrame:
    """(doc, row, digest, start, end, word, words) of every span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc", pa.int64()), ("row", pa.int32()), ("digest", pa.int64()), *((c, pa.int32()) for c in ("start", "end", "word", "words"))])
        for b in batches:
            parts, size = [], 0
            for doc, row, t in zip(b.column("doc").to_pylist(), b.column("row").to_pylist(), b.column("text")):
                if text := t.as_py():
                    found = text_spans(text, span_words)
                    n = len(found[0])
                    parts.append((np.full(n, doc), np.full(n, row, np.int32), *found))
                    size += n
                if size > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], schema=schema)
                    parts, size = [], 0
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], schema=schema)

    doc, row = _marks()
    return docs.select(doc.alias("doc"), row.alias("row"), body().alias("text")).mapInArrow(run, SPANS)


def windows(text: str, runs: list[tuple[int, int, int]], min_words: int, span_words: int) -> list[np.ndarray]:
    """(number, at, digest, start, end) of each window of ``min_words`` words that shares ``span_words`` or more, cut ones included, with a run (number, start, end); all of a run that has fewer.

    A window's digest is the polynomial of its words' hashes, taken from prefix sums.
    """
    found = np.array([m.span() for m in re.finditer(r"\S+", text)], np.int64).reshape(-1, 2)
    starts, ends, n = found[:, 0], found[:, 1], len(found)
    if n < min_words:
        return [np.empty(0, np.int64)] * 5
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "replace")) for w in re.findall(r"\S+", text)), np.uint64, n)
    powers, back = (np.cumprod(np.r_[np.uint64(1), np.full(n, x, np.uint64)]) for x in (FACTOR, pow(FACTOR, -1, 1 << 64)))
    sums = np.r_[np.uint64(0), np.cumsum(hashes * powers[:n])]
    digests = ((sums[min_words:] - sums[:-min_words]) * back[: n - min_words + 1]).view(np.int64)
    own = np.array(runs, np.int64).reshape(-1, 3)
    first, last = np.searchsorted(ends, own[:, 1], "right"), np.searchsorted(starts, own[:, 2])  # of the words that a run touches, and behind them
    shared = np.minimum(span_words, last - first)
    low, high = np.maximum(0, first + shared - min_words), np.minimum(last - shared, n - min_words) + 1
    many = np.where(shared > 0, np.maximum(high - low, 0), 0)
    at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
    return [np.repeat(own[:, 0], many), at, digests[at], starts[at], ends[at + min_words - 1]]


def _windows(runs: DataFrame, docs: DataFrame, min_words: int, span_words: int) -> DataFrame:
    """(doc, row, number, at, digest, start, end) of the windows of the runs; only texts that have runs move."""
    doc, row = _marks()
    # a document's runs begin at different chunks, so the list is no longer than the text
    lists = runs.groupBy("doc", "row").agg(F.collect_list(F.struct("number", "start", "end")).alias("runs"))
    texts = sieve(docs.select(doc.alias("doc"), row.alias("row"), body().alias("text")), ["doc", "row"], runs.select("doc", "row"))
    texts = texts.filter("hit").drop("hit").dropDuplicates(["doc", "row"])
    names, types = ["doc", "row", "number", "at", "digest", "start", "end"], [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts, size = [], 0
            for doc, row, text, own in zip(*(b.column(c).to_pylist() for c in ("doc", "row", "text", "runs"))):
                found = windows(text, [(r["number"], r["start"], r["end"]) for r in own], min_words, span_words)
                n = len(found[0])
                parts.append((np.full(n, doc), np.full(n, row), *found))
                size += n
                if size > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(t.to_pandas_dtype())) for c, t in zip(zip(*parts), types)], names)
                    parts, size = [], 0
            if size:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(t.to_pandas_dtype())) for c, t in zip(zip(*parts), types)], names)

    return texts.join(lists, ["doc", "row"]).select("doc", "row", "text", "runs").mapInArrow(run, "doc long, row int, number long, at int, digest long, start int, end int")


def _grown(short: DataFrame, long: DataFrame, docs: DataFrame, min_words: int, span_words: int) -> DataFrame:
    """The short runs as far as their windows of ``min_words`` words stand in another document too; ``first`` is then the least document that has one."""
    short = materialize(short.withColumn("number", F.monotonically_increasing_id()), "short-runs")
    found = materialize(_windows(short, docs, min_words, span_words), "windows")
    others = _windows(long.withColumn("number", F.lit(0)), docs, min_words, span_words).select("doc", "row", "digest")
    others = sieve(others, ["digest"], found).filter("hit").drop("hit")
    shared = found.select("doc", "row", "digest").unionAll(others).groupBy("digest").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.min_by("row", "doc").alias("first_row"))
    shared = materialize(shared.filter("first <> last").drop("last"), "shared-windows")
    hits = found.select("number", "at", "start", "end", "digest").join(shared, "digest")
    island = F.col("at") - F.row_number().over(Window.partitionBy("number").orderBy("at"))
    hits = hits.withColumn("island", island).groupBy("number", "island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), (F.count("*") + min_words - 1).cast("int").alias("words"),
        F.min("first").alias("first"), F.min_by("first_row", "first").alias("first_row"),
    )
    return short.drop("start", "end", "words", "first", "first_row").join(hits, "number").select([c for c in short.columns if c != "number"])


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, span_words: int = SPAN_WORDS) -> DataFrame:
    """(doc_id, doc, row, start, end, words, first_doc_id, drops) of each repeated passage.

    A passage joins the runs that overlap; words is the longest run's. first_doc_id is the least
    document that holds a span of the passage (null if it has no id); drops lists the parts, as
    (start, end), that an earlier document keeps.
    """
    found = materialize(spans(docs, span_words), "spans")
    shared = found.groupBy("digest").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.min_by("row", "doc").alias("first_row"), F.max_by("row", "doc").alias("last_row"))
    shared = materialize(shared.filter("first <> last"), "shared-spans")  # the join then reads two plain shuffles, of which Spark splits hot digests
    is_first = F.col("doc") == F.col("first")
    hits = found.join(shared, "digest").select(
        "doc", "row", "start", "end", "word", "words", "first", "first_row",
        F.when(is_first, F.col("last")).otherwise(F.col("first")).alias("partner"), F.when(is_first, F.col("last_row")).otherwise(F.col("first_row")).alias("partner_row"),
    ).distinct()
    key = ["doc", "row", "partner", "partner_row", "first", "first_row"]
    by = Window.partitionBy("doc", "row").orderBy("start", "partner")
    apart = (F.coalesce(F.lag("partner").over(by) != F.col("partner"), F.lit(True)) | (F.lag("end").over(by) <= F.col("start"))).cast("int")
    hits = hits.withColumn("run", F.sum(apart).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    runs = hits.groupBy(*key, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), (F.max(F.col("word") + F.col("words")) - F.min("word")).alias("words"))
    dropped = F.when(F.col("first") != F.col("doc"), F.array(F.struct("start", "end"))).otherwise(F.expr("cast(array() as array<struct<start: int, end: int>>)"))
    runs = materialize(runs.drop("run").withColumn("drops", dropped), "runs")
    enough = F.col("words") > int(min_words)  # a run's last word may be cut short
    runs = runs.filter(enough).unionByName(_grown(runs.filter(~enough), runs.filter(enough), docs, int(min_words), int(span_words)))
    by = Window.partitionBy("doc", "row").orderBy("start", "end")
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("new", F.coalesce((reach <= F.col("start")).cast("int"), F.lit(1)))
    runs = runs.withColumn("passage", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    named = lambda c, row: F.when(row >= 0, c)
    out = runs.groupBy("doc", "row", "passage").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.max("words").alias("words"), F.min("first").alias("first"), F.min_by("first_row", "first").alias("first_row"),
        F.sort_array(F.flatten(F.collect_list("drops"))).alias("parts"),
    )
    merged = F.aggregate(
        "parts",
        F.expr("cast(array() as array<struct<start: int, end: int>>)"),
        lambda out, x: F.when((F.size(out) > 0) & (F.try_element_at(out, F.lit(-1))["end"] >= x["start"]),
            F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(out, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(out, F.lit(-1))["end"], x["end"]).alias("end"))))
        ).otherwise(F.concat(out, F.array(x))),
    )
    return out.select(
        named(F.col("doc"), F.col("row")).alias("doc_id"), "doc", "row", "start", "end", "words", named(F.col("first"), F.col("first_row")).alias("first_doc_id"), merged.alias("drops")
    )


def drop_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs``, all columns, without the passages that an earlier document keeps."""
    runs = repeated_passages(docs, min_words).filter("size(drops) > 0")
    drops = runs.groupBy("doc", "row").agg(F.sort_array(F.flatten(F.collect_list("drops"))).alias("drops"))
    plain = numbered(docs)
    at, columns = docs.columns.index("text"), plain.schema
    names = [plain.columns[docs.columns.index(c)] for c in ("doc_id", "text")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for t, parts in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist()):
                for d in reversed(parts or []):
                    t = t[: d["start"]] + t[d["end"] :]
                texts.append(t)
            out = b.columns[: len(columns)]
            out[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(out, names=b.schema.names[: len(columns)])

    marked = plain.withColumns(dict(zip(("doc", "row"), _marks(*names)))).join(drops, ["doc", "row"], "left")
    return marked.select(*plain.columns, "drops").mapInArrow(cut, columns).toDF(*docs.columns)
