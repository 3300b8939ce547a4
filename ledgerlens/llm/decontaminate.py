"""Benchmark decontamination by pigeonhole edit matching.

Texts are lower-cased and every run of ASCII characters other than letters and digits
becomes one space. An item of m characters may differ by k = floor(m * error_rate) edits
from what a document holds. Of any k + 1 pieces of the item one then stands there unchanged,
so a document is scanned once for all pieces (Aho-Corasick) and only the places around hits
are verified, with Myers' bit-parallel distance.

The benchmark is cut into blocks of bounded size on Spark; each block meets all documents, and
where there are several, its matches are written before the next block is fetched, so neither the
driver, a plan nor a task ever holds more than one. To drop documents, each block writes the hashes of the texts that
hold one of its items, and documents are filtered once in the end. Null or empty texts and items match nothing; an
item without a budget (k = 0) must match on word boundaries; each of several equal items is
reported. An item without an item_id (or with one that is no number) cannot be named in a match, but
documents that hold it are dropped. Repeated documents each have their rows; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import body, doc_number, id_and_text, materialize, numbered, prefix_sums, sieve

#: Characters of one block of items.
BLOCK_CHARS = 1_000_000
_PLAIN = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
MATCH = "doc_id long, item_id long, edits int, budget int, start int, end int"


def plain(text: str) -> str:
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_PLAIN).split()).decode("utf-8", "replace")


def myers(masks: dict[str, int], m: int, text: str, limit: int, anchored: bool = False) -> tuple[int, int]:
    """(distance, end) of the pattern's first best match in ``text``; distance limit + 1: none.

    ``anchored``: the match must begin where the text does.
    """
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best, at, left = full, 0, m, limit + 1, 0, len(text)
    for c in text:
        left -= 1
        eq = masks.get(c, 0)
        vertical = eq | minus
        across = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | (full & ~(across | plus)), plus & across
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) | anchored, down << 1
        plus, minus = (down | ~(vertical | up)) & full, up & vertical & full
        if score < best:
            best, at = score, len(text) - left
        elif score - left >= best:
            break
    return best, at


class Matcher:
    """One block of items, (item_id, plain text)."""

    def __init__(self, items: list[tuple[int | None, str]], error_rate: float):
        self.items, pieces = [], {}
        for item_id, text in items:
            k = int(len(text) * error_rate)
            text = text if k else f" {text} "
            masks: dict[str, int] = {}
            for i, c in enumerate(text):
                masks[c] = masks.get(c, 0) | 1 << i
            back: dict[str, int] = {}
            for i, c in enumerate(reversed(text)):
                back[c] = back.get(c, 0) | 1 << i
            n = len(self.items)
            self.items.append((item_id, text, k, masks, back))
            cuts = [len(text) * i // (k + 1) for i in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                pieces.setdefault(text[a:b], []).append((n, a))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        if pieces:
            self.automaton.make_automaton()
        self.any = bool(pieces)

    def find(self, text: str) -> Iterator[tuple[int, int, int, int, int]]:
        """(item_id, edits, budget, start, end) of each item's best match in a plain text."""
        if not self.any or not text:
            return
        text = f" {text} "
        windows: dict[int, list[tuple[int, int]]] = {}
        for end, (length, places) in self.automaton.iter(text):
            for n, at in places:
                k, begin = self.items[n][2], end + 1 - length - at
                low, high = max(0, begin - k), begin + len(self.items[n][1]) + k
                own = windows.setdefault(n, [])
                if own and low <= own[-1][1] and low >= own[-1][0]:
                    own[-1] = (own[-1][0], max(high, own[-1][1]))
                else:
                    own.append((low, high))
        for n, own in windows.items():
            item_id, item, k, masks, back = self.items[n]
            best = (k + 1, 0, 0)
            reach = -1
            for low, high in sorted(own):
                if high <= reach:
                    continue
                reach = high
                if (at := text.find(item, low, high)) >= 0:
                    best = (0, at, at + len(item))
                    break
                if k:
                    edits, end = myers(masks, len(item), text[low:high], min(k, best[0] - 1))
                    if edits < best[0] and edits <= k:
                        begin = max(0, low + end - len(item) - k)
                        _, size = myers(back, len(item), text[begin : low + end][::-1], edits, anchored=True)
                        best = (edits, low + end - size, low + end)
            if best[0] <= k:
                yield item_id, best[0], k, max(0, best[1] - 1), best[2] - 1


def item_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[tuple[list[tuple[int | None, str]], bool]]:
    """The items (item_id, plain text) in blocks of about ``block_chars`` characters, and whether there is only one; one is fetched at a time."""
    items = benchmark.select(doc_number("item_id").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text <> ''")
    sized = prefix_sums(items.withColumn("chars", F.length("text").cast("long")), [], [F.xxhash64("text"), F.col("item_id")], ["chars"], "items")
    blocks = materialize(sized.select("item_id", "text", F.expr(f"before_chars div {int(block_chars)}").alias("block")), "item-blocks")
    numbers = [r["block"] for r in blocks.select("block").distinct().orderBy("block").collect()]
    for number in numbers:
        rows = blocks.filter(F.col("block") == number).orderBy("item_id", "text").collect()
        yield [(r["item_id"], text) for r in rows if (text := plain(r["text"]))], len(numbers) == 1


def _matching(items: list[tuple[int | None, str]], error_rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(items, error_rate)
        schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), *((c, pa.int32()) for c in ("edits", "budget", "start", "end"))])
        for b in batches:
            rows = [(i.as_py(), *m) for i, t in zip(b.column("doc_id"), b.column("text")) for m in matcher.find(plain(t.as_py()))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, error_rate: float = 0.08, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, edits, budget, start, end): each item's best match in each document.

    start and end count characters of the document's plain text.
    """
    source = id_and_text(docs)
    found = docs.sparkSession.createDataFrame([], MATCH)
    for items, only in item_blocks(benchmark, block_chars):
        part = source.mapInArrow(_matching([x for x in items if x[0] is not None], error_rate), MATCH)
        found = part if only else found.unionAll(materialize(part, "matches"))
    return found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, error_rate: float = 0.08, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item. Decided by their texts, so ids may repeat or be null."""
    plain_docs = numbered(docs)
    at = docs.columns.index("text")
    text = body(plain_docs.columns[at])
    marks = [F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("h1")]
    parts = []
    for items, only in item_blocks(benchmark, block_chars):
        if only:
            return plain_docs.mapInArrow(_clean(items, error_rate, at), plain_docs.schema).toDF(*docs.columns)
        texts = plain_docs.select(*marks, text.alias("text")).mapInArrow(_holding(items, error_rate), "h long, h1 long").distinct()
        parts.append(materialize(texts, "contaminated"))
    if not parts:
        return docs
    bad = materialize(reduce(DataFrame.unionAll, parts).distinct(), "contaminated")
    rows = sieve(plain_docs.withColumns({"h": marks[0], "h1": marks[1]}), ["h", "h1"], bad)
    clean = rows.filter("hit").join(bad.hint("merge"), ["h", "h1"], "left_anti")
    return rows.filter("not hit").select(*plain_docs.columns).unionAll(clean.select(*plain_docs.columns)).toDF(*docs.columns)


def _clean(items: list[tuple[int | None, str]], error_rate: float, at: int):
    """Rows whose text, column ``at``, holds none of the items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(items, error_rate)
        for b in batches:
            yield b.filter(pa.array([next(matcher.find(plain(t.as_py() or "")), None) is None for t in b.column(at)], pa.bool_()))

    return run


def _holding(items: list[tuple[int | None, str]], error_rate: float):
    """The hashes of texts that hold one of the items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(items, error_rate)
        for b in batches:
            yield b.select(["h", "h1"]).filter(pa.array([next(matcher.find(plain(t.as_py())), None) is not None for t in b.column("text")], pa.bool_()))

    return run
