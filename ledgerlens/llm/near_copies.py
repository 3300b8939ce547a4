"""Operator 8 for texts of a stated similarity: near copies by exact similarity of word shingle sets.

A fingerprint cannot keep the promise of a similarity of 0.8: there 64 bits differ in about 10, and
variants of a few segments miss a good part of such pairs (README). So operator 8 goes first: its fingerprints and deletion variants
give candidates, which are compared by their sets; the sets' rarest shingles then find what fingerprints miss.
Two texts are linked if their sets of five-word shingles have a Jaccard similarity of 0.8 or more.
With all shingles in one fixed order, sets that similar share one among the first
n - ceil(0.8 n) + 1 of each, so those prefixes are indexed and every linked pair meets in a bucket.
The order puts frequent shingles last; it is estimated from a sample, which only moves work and never
a result. Sets of a bucket are candidates if their sizes and places in it allow a similarity of 0.8. Buckets
are read several times: in each of ``ROUNDS`` rounds every set tries two candidates of other groups, and
links join groups. In the end sets with up to ``FEW`` candidates in a bucket try them all, and the
others meet in their buckets, which yield links only, never all pairs. Bitmaps of shingles give an upper bound of what two sets share; pairs that pass
it are compared by their whole sets, and only their texts move. Joins with sets or texts are merge joins at any size, so that what a run needs
grows with its input and not by a change of plan. Before texts move, a bit table of fixed size lets those stay where they are that
the join cannot want (at worst it lets all through, and the join decides). Buckets whose sets are compared whole are first split by their true size.

Texts with equal sets are one node. Null and empty texts, and texts without a word, share the empty
set; a text shorter than a shingle is one shingle. Of each group the row with the least doc_id stays (rows
without one come last, then the text's hash decides); rows that share a doc_id count by their texts,
and of rows with equal doc_id and text one stays. A doc_id that is no number counts as null. An empty
table gives an empty result; other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import simhash
from ledgerlens.llm.common import body, connected, doc_number, materialize, numbered, sieve

#: Documents sampled for the order of shingles, at least this many or this share.
SAMPLE_ROWS, SAMPLE_SHARE = 20_000, 0.02
#: Shingles that the order tells apart by frequency: in so many sampled documents or more, and the most frequent ones.
FREQUENT, MOST_FREQUENT = 3, 1 << 16
#: Buckets that may hold more sets become one bucket for each two of their blocks.
HOT_BUCKET = 50_000
#: Buckets with more shingles than this in their sets are split likewise before the sets are compared whole: 64 MB of shingles in a task.
HEAVY_BUCKET = 8_000_000
ROUNDS = 2
FEW = 8
#: Buckets of more rows keep all of them: to look for each one's partner would take longer than to read them again.
PAIRED = 64


def shingles(text: bytes, words: int, seed: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a UTF-8 text's word shingles."""
    tokens = text.lower().split()
    if not tokens:
        return np.empty(0, np.int64)
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        digests = xxhash.xxh64_digest(joined, seed)
    else:
        ends = list(accumulate(len(t) + 1 for t in tokens))
        digests = b"".join([xxhash.xxh64_digest(joined[a : b - 1], seed) for a, b in zip([0, *ends], ends[words - 1 :])])
    return np.unique(np.frombuffer(digests, ">i8").astype(np.int64))




def bitmap(items: np.ndarray) -> bytes:
    """Which of 4 n or more places (a power of two) the shingles take."""
    bits = 1 << max(6, (4 * len(items) - 1).bit_length())
    marks = np.zeros(bits, np.uint8)
    marks[items & (bits - 1)] = 1
    return np.packbits(marks).tobytes()


def most_common(a: bytes, n: int, b: bytes, m: int) -> int:
    """An upper bound of what sets of n and m have in common: a place that one takes and the other does not holds at least one that is not."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(x), len(y))
    x, y = (np.bitwise_or.reduce(z.reshape(-1, size), axis=0) for z in (x, y))  # places modulo the smaller size
    return min(n - int(np.bitwise_count(x & ~y).sum()), m - int(np.bitwise_count(y & ~x).sum()))


def _similar_enough(common: int, n: int, m: int) -> bool:
    return 5 * common >= 4 * (n + m - common)


def _counts(items: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(items), np.int64)
    at = np.minimum(np.searchsorted(keys, items), len(keys) - 1)
    return np.where(keys[at] == items, counts[at], 0)


def _lists(items: list[np.ndarray]) -> pa.Array:
    ends = np.r_[0, np.cumsum([len(x) for x in items])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *items])))


def _frequent(texts: DataFrame, words: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted frequent shingles and about how many of ``texts`` hold each, from a sample; at most ``MOST_FREQUENT``."""
    share = min(1.0, max(SAMPLE_SHARE, SAMPLE_ROWS / max(texts.count(), 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column("text").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t, words, seed))], ["s"])

    found = texts.sample(share, seed).select("text").mapInArrow(run, "s long").groupBy("s").agg(F.count("*").alias("n"))
    top = found.filter(F.col("n") >= FREQUENT).orderBy(F.col("n").desc(), "s").limit(MOST_FREQUENT).collect()
    keys, counts = np.array([r["s"] for r in top], np.int64), np.array([r["n"] for r in top], np.float64)
    order = np.argsort(keys)
    return keys[order], (counts[order] / share).astype(np.int64)


def _marks(doc_id: str = "doc_id", text: str = "text") -> dict[str, Column]:
    """What tells rows apart: doc_id (0 for none), whether there is none, and 128 bits of the text's hash."""
    number = doc_number(doc_id)
    return dict(zip(ROW, [F.coalesce(number, F.lit(0)), number.isNull().cast("int"), F.xxhash64(body(text)), F.xxhash64(F.lit(1), body(text))]))


def _sets(docs: DataFrame, words: int, seed: int, keys: np.ndarray, counts: np.ndarray) -> DataFrame:
    """(node, n, prefix, bits, least, fp): one row for each set; least is the row that stays of it and names a text that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, sizes, firsts, bits, prints = [], [], [], [], []
            for t in b.column("text").to_pylist():
                items = shingles(t, words, seed)
                prints.append(simhash.simhash(t, words, seed))
                n = len(items)
                rare = items[np.argsort(_counts(items, keys, counts), kind="stable")]
                names.append(xxhash.xxh3_128_digest(items.tobytes()))
                sizes.append(n)
                firsts.append(rare[: n - -(-4 * n // 5) + 1])
                bits.append(bitmap(items))
            own = [pa.array(names, pa.binary()), pa.array(sizes, pa.int32()), _lists(firsts), pa.array(bits, pa.binary()), pa.array(prints, pa.int64())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ROW), *own], [*ROW, "name", "n", "prefix", "bits", "fp"])

    rows = docs.select(*(c.alias(k) for k, c in _marks().items()), body().cast("binary").alias("text"))
    rows = rows.mapInArrow(run, "id long, none int, h long, h1 long, name binary, n int, prefix array<long>, bits binary, fp long")
    rows = rows.groupBy("name").agg(F.min(F.struct("none", "id", "h", "h1")).alias("least"), *(F.first(c).alias(c) for c in ("n", "prefix", "bits")), F.min("fp").alias("fp"))
    return materialize(rows.select(F.monotonically_increasing_id().alias("node"), "n", "prefix", "bits", "least", "fp"), "sets")


def _by_fingerprints(sets: DataFrame, bits: int) -> DataFrame:
    """(u, v), u > v: sets that operator 8 links, by its index of deletion variants; sets of one fingerprint are paired with its least."""
    prints = materialize(sets.groupBy("fp").agg(F.min("node").alias("first")), "prints")
    same = sets.select("node", "fp").join(prints, "fp").filter("node <> first").select(F.col("node").alias("u"), F.col("first").alias("v"))
    ends = [prints.select(F.col("fp").alias(k), F.col("first").alias(f"{k}_first")) for k in ("u", "v")]
    other = simhash.links(prints.select("fp"), bits).join(ends[0], "u").join(ends[1], "v")
    pairs = same.unionAll(other.select(F.greatest("u_first", "v_first").alias("u"), F.least("u_first", "v_first").alias("v")))
    return materialize(pairs.distinct(), "fingerprint-pairs")


ROW = ["id", "none", "h", "h1"]


def _piece(shingle: int, a: int, b: int) -> int:
    return xxhash.xxh64_intdigest(np.array([shingle, a, b], np.int64).tobytes()) - (1 << 63)


def _index(sets: DataFrame, keys: np.ndarray, counts: np.ndarray, hot: int) -> DataFrame:
    """(key, node, n, at): a row for each prefix shingle; at is its place in the set's order.

    A bucket that may hold over ``hot`` sets becomes one for each two of its blocks, so that none lose sight of each other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prefixes = b.column("prefix")
            lengths, items = np.diff(prefixes.offsets.to_numpy()), prefixes.flatten().to_numpy()
            node, n = (np.repeat(b.column(c).to_numpy(), lengths) for c in ("node", "n"))
            at = (np.arange(len(items)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
            blocks = np.ceil(_counts(items, keys, counts) / (hot / 2)).astype(np.int64)
            whole = blocks <= 2
            parts = [[c[whole] for c in (items, node, n, at)]]
            for i in np.flatnonzero(~whole):
                own = int(node[i]) % int(blocks[i])
                pieces = [_piece(items[i], min(x, own), max(x, own)) for x in range(blocks[i]) if x != own]
                parts.append([np.array(pieces, np.int64), *(np.repeat(c[i], len(pieces)) for c in (node, n, at))])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], ["key", "node", "n", "at"])

    return sets.select("node", "n", "prefix").mapInArrow(run, "key long, node long, n int, at int")


def _may_link(n, m, i, j):
    """Whether sets of n and m may be similar, if the shingle at places i and j is their first common one: at most 1 + min(n - 1 - i, m - 1 - j) are common."""
    return 9 * np.minimum(n - i, m - j) >= 4 * (n + m)


def _buckets(columns: list[str], scan, schema: str, rows: DataFrame) -> DataFrame:
    """``scan`` of the columns of whole buckets, sorted by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            new = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            whole = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0  # the last bucket may go on
            if whole:
                yield from scan([c[:whole] for c in held])
                held = [c[whole:] for c in held]
        if held is not None and len(held[0]):
            yield from scan(held)

    return rows.select(*columns).repartition("key").sortWithinPartitions("key").mapInArrow(run, schema)


def _live(c: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows that may be similar to another one of their bucket."""
    key, node, n, at = c[0], c[1], c[2].astype(np.int64), c[3].astype(np.int64)
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    lengths = np.diff(np.r_[starts, len(key)])
    keep = np.repeat(lengths > PAIRED, lengths)
    for size in np.unique(lengths[(lengths > 1) & (lengths <= PAIRED)]):
        first = starts[lengths == size]
        for i in range(size - 1):
            for j in range(i + 1, size):
                x, y = first + i, first + j
                near = _may_link(n[x], n[y], at[x], at[y])
                keep[x[near]] = keep[y[near]] = True
    if keep.any():
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in c], ["key", "node", "n", "at"])


def _meetings(c: list[np.ndarray], behind: bool) -> Iterator[tuple[int, np.ndarray]]:
    """The place of each row that has candidates of other groups in its bucket, and theirs; only those behind it if so wished."""
    key, _, n, at, group = c
    n, at = n.astype(np.int64), at.astype(np.int64)
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    for s, e in zip(starts, np.r_[starts[1:], len(key)]):
        if (group[s:e] == group[s]).all():
            continue
        for i in range(s, e):
            first = i + 1 if behind else s
            rest = slice(first, e)
            near = (group[rest] != group[i]) & _may_link(n[rest], n[i], at[rest], at[i])
            if near.any():
                yield i, first + np.flatnonzero(near)


def _one_each(c: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """(node, other): one candidate of another group for each row that has any."""
    own, other = [], []
    for i, found in _meetings(c, behind=False):
        own.append(i)
        other.append(found[(i * 0x9E3779B1 + int(c[0][i])) % len(found)])
    if own:
        yield pa.RecordBatch.from_arrays([pa.array(c[1][own]), pa.array(c[1][other])], ["node", "other"])


class Bounds:
    """Upper bounds of what the rows of a bucket have in common, from their bitmaps."""

    def __init__(self, bits: np.ndarray, n: np.ndarray):
        self.n, self.sizes, self.place = n, np.array([len(b) for b in bits]), np.zeros(len(bits), np.int64)
        self.whole, self.folded = {}, {}
        for size in np.unique(self.sizes).tolist():
            rows = np.flatnonzero(self.sizes == size)
            self.place[rows] = np.arange(len(rows))
            self.whole[size] = np.frombuffer(b"".join(bits[rows]), np.uint8).reshape(-1, size)
            self.folded[size] = self.whole[size][:, : size // 2] | self.whole[size][:, size // 2 :]

    def possible(self, i: int, rows: np.ndarray) -> np.ndarray:
        """Those of ``rows`` that may be similar to row i. Similar sets have bitmaps of one size, or one twice the other's."""
        own, keep = int(self.sizes[i]), np.zeros(len(rows), bool)
        for size in (own // 2, own, 2 * own):
            at = np.flatnonzero(self.sizes[rows] == size)
            if len(at):
                x = (self.folded if size < own else self.whole)[own][self.place[i]]
                y = (self.folded if size > own else self.whole)[size][self.place[rows[at]]]
                m = self.n[rows[at]]
                common = np.minimum(self.n[i] - np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64), m - np.bitwise_count(y & ~x).sum(axis=1, dtype=np.int64))
                keep[at] = _similar_enough(common, self.n[i], m)
        return rows[keep]


def _few_or_many(c: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows with up to ``FEW`` candidates, once for each (other); rows with more, without."""
    rows, others = [], []
    for i, found in _meetings(c, behind=False):
        few = len(found) <= FEW
        rows += [i] * len(found) if few else [i]
        others += c[1][found].tolist() if few else [None]
    if rows:
        yield pa.RecordBatch.from_arrays([*(pa.array(x[rows]) for x in c), pa.array(others, pa.int64())], [*ENTRY, "group", "other"])


def _bounded(c: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows that may be similar to one of another group, by bitmaps too."""
    keep = []
    for bucket in _each_bucket(c):
        bounds = Bounds(bucket[5], bucket[2].astype(np.int64))
        keep += [(bucket, i) for i, found in _meetings(bucket[:5], behind=False) if len(bounds.possible(i, found))]
    if keep:
        columns = [pa.array([bucket[k][i] for bucket, i in keep], t) for k, t in enumerate(TYPES)]
        yield pa.RecordBatch.from_arrays(columns, [*ENTRY, "group", "bits"])


def _linking(c: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Links that join whatever sets of a bucket are similar, at most one fewer than there are rows."""
    u, v = [], []
    for bucket in _each_bucket(c):
        node, group, items = bucket[1], bucket[4].copy(), bucket[6]
        bounds = Bounds(bucket[5], bucket[2].astype(np.int64))
        for i, found in _meetings(bucket[:5], behind=True):
            for j in bounds.possible(i, found):
                if group[i] != group[j] and _similar_enough(len(np.intersect1d(items[i], items[j], assume_unique=True)), len(items[i]), len(items[j])):
                    u.append(max(node[i], node[j]))
                    v.append(min(node[i], node[j]))
                    group[group == group[j]] = group[i]
    if u:
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def _each_bucket(c: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
    starts = np.flatnonzero(np.r_[True, c[0][1:] != c[0][:-1]])
    for s, e in zip(starts, np.r_[starts[1:], len(c[0])]):
        yield [x[s:e] for x in c]


#: What the index keeps of a set in a bucket.
ENTRY = ["key", "node", "n", "at"]
TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
GROUPED = "key long, node long, n int, at int, group long"


def _with_both(pairs: DataFrame, of: DataFrame, *columns: str) -> DataFrame:
    """Pairs (u, v) with columns of both nodes, named with a and b before them."""
    one, two = (of.select(F.col("node").alias(k), *(F.col(c).alias(f"{side}_{c}") for c in columns)) for k, side in (("u", "a"), ("v", "b")))
    return pairs.join(one.hint("merge"), "u").join(two.hint("merge"), "v")


def _texts(nodes: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text) of ``nodes`` (node), as UTF-8. Candidates grow faster than the input and pairs that pass their bounds do not, so texts are taken for the latter, where they are read."""
    marks = materialize(sets.select("node", "least.h", "least.h1").join(nodes.distinct().hint("merge"), "node", "left_semi"), "marks")
    texts = docs.select(F.xxhash64(body()).alias("h"), F.xxhash64(F.lit(1), body()).alias("h1"), body().cast("binary").alias("text"))
    texts = sieve(texts, ["h", "h1"], marks).filter("hit").drop("hit").dropDuplicates(["h", "h1"])  # copies become few before they are dealt
    return materialize(texts.join(marks.hint("merge"), ["h", "h1"]).select("node", "text"), "texts")


def _similar(pairs: DataFrame, sets: DataFrame, docs: DataFrame, words: int, seed: int) -> DataFrame:
    """The pairs (u, v) whose sets have a similarity of 0.8 or more."""

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("a_bits", "a_n", "b_bits", "b_n")))
            keep = [_similar_enough(most_common(x, n, y, m), n, m) for x, n, y, m in rows]
            yield b.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    schema = "u long, v long"
    pairs = materialize(_with_both(pairs, sets, "n", "bits").select("u", "v", "a_n", "a_bits", "b_n", "b_bits").mapInArrow(possible, schema), "possible")

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = lru_cache(64)(lambda text: shingles(text, words, seed))
        for b in batches:
            keep = []
            for x, y in zip(b.column("a_text").to_pylist(), b.column("b_text").to_pylist()):
                x, y = items(x), items(y)
                keep.append(_similar_enough(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)))
            yield b.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    texts = _texts(pairs.select(F.explode(F.array("u", "v")).alias("node")), sets, docs)
    return materialize(_with_both(pairs, texts, "text").select("u", "v", "a_text", "b_text").mapInArrow(same, schema), "similar")


def _split(rows: DataFrame, heavy: int) -> DataFrame:
    """``rows`` of buckets, those with sets of over ``heavy`` shingles together made into one bucket for each two of their blocks."""
    sizes = rows.groupBy("key").agg(F.sum("n").alias("weight")).filter(F.col("weight") > heavy)
    sizes = sizes.select("key", F.ceil(2 * F.col("weight") / heavy).cast("long").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x != own)
    pieces = F.transform(others, lambda x: F.xxhash64("key", F.least(x, own), F.greatest(x, own)))
    keys = F.when(F.col("blocks").isNull(), F.array("key")).otherwise(pieces)
    return rows.join(sizes.hint("merge"), "key", "left").withColumn("key", F.explode(keys)).select(rows.columns)


def _last_links(grouped: DataFrame, tried: DataFrame, sets: DataFrame, docs: DataFrame, words: int, seed: int, heavy: int) -> DataFrame:
    """(u, v) that join the sets of ``grouped`` buckets as far as they are similar across groups."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("node"), _lists([shingles(t, words, seed) for t in b.column("text").to_pylist()])], ["node", "items"])

    columns = [*ENTRY, "group"]
    left = materialize(_buckets(columns, _few_or_many, f"{GROUPED}, other long", grouped), "left")
    pairs = left.filter("other is not null").select(F.greatest("node", "other").alias("u"), F.least("node", "other").alias("v")).distinct()
    links = _similar(materialize(pairs.join(tried, ["u", "v"], "left_anti"), "pairs"), sets, docs, words, seed)
    rows = _split(left.filter("other is null").drop("other"), heavy).join(sets.select("node", "bits").hint("merge"), "node")
    rows = materialize(_buckets([*columns, "bits"], _bounded, f"{GROUPED}, bits binary", rows), "bounded")
    items = _texts(rows.select("node"), sets, docs).mapInArrow(whole, "node long, items array<long>")
    return links.unionAll(materialize(_buckets([*columns, "bits", "items"], _linking, "u long, v long", rows.join(items, "node")), "links"))


def _grouped(live: DataFrame, links: DataFrame) -> DataFrame:
    groups = connected(links).select("node", F.col("root").alias("group"))
    return live.drop("group").join(groups, "node", "left").withColumn("group", F.coalesce("group", "node"))


def linked_sets(docs: DataFrame, words: int = 5, seed: int = 42, hot_bucket: int = HOT_BUCKET, heavy_bucket: int = HEAVY_BUCKET, bits: int = 4) -> DataFrame:
    """(least, root): for each different set of shingles the row that stays of it, and its group."""
    keys, counts = _frequent(docs.select(body().cast("binary").alias("text")), words, seed)
    sets = _sets(docs, words, seed, keys, counts)
    live = materialize(_buckets(["key", "node", "n", "at"], _live, "key long, node long, n int, at int", _index(sets, keys, counts, hot_bucket)), "live")
    # from here on only sets that have a candidate
    live = live.withColumn("group", F.col("node"))
    near = materialize(sets.join(live.select("node").distinct().hint("merge"), "node", "left_semi").select("node", "n", "bits", "least"), "near-sets")
    # operator 8 first: what its fingerprints link is compared by whole sets; what they miss the index of rare shingles finds
    tried = _by_fingerprints(sets, bits)
    links = _similar(tried, near, docs, words, seed)
    grouped = _grouped(live, links)
    for _ in range(ROUNDS):
        one = _buckets([*ENTRY, "group"], _one_each, "node long, other long", grouped)
        order = F.xxhash64("other", "node")
        two = one.groupBy("node").agg(F.min_by("other", order).alias("x"), F.max_by("other", order).alias("y")).select("node", F.explode(F.array("x", "y")).alias("other"))
        pairs = two.select(F.greatest("node", "other").alias("u"), F.least("node", "other").alias("v"))
        pairs = materialize(pairs.distinct().join(tried, ["u", "v"], "left_anti"), "pairs")
        tried = tried.unionAll(pairs)
        links = links.unionAll(_similar(pairs, near, docs, words, seed))
        grouped = _grouped(live, links)
    links = links.unionAll(_last_links(grouped, tried, near, docs, words, seed, heavy_bucket))
    return sets.select("node", "least").join(connected(links), "node", "left").select("least", F.coalesce("root", "node").alias("root"))


def drop_near_copies(docs: DataFrame, words: int = 5, seed: int = 42, hot_bucket: int = HOT_BUCKET, heavy_bucket: int = HEAVY_BUCKET) -> DataFrame:
    """One row of each group of near copies, all columns. Only rows that may have to go meet the list of those that stay."""
    kept = linked_sets(docs, words, seed, hot_bucket, heavy_bucket).groupBy("root").agg(F.min("least").alias("least"))
    kept = materialize(kept.select(*(F.col(f"least.{c}").alias(c) for c in ROW)), "kept")
    keys = docs.select(*(c.alias(k) for k, c in _marks().items())).groupBy(*ROW).agg(F.count("*").alias("rows"))
    once = keys.join(kept.withColumn("stays", F.lit(True)).hint("merge"), ROW, "left").filter("stays is null or rows > 1")
    doubtful = materialize(once.select(*ROW), "doubtful")
    plain = numbered(docs)
    doc_id, text = (plain.columns[docs.columns.index(c)] for c in ("doc_id", "text"))
    rows = sieve(plain.withColumns(_marks(doc_id, text)), ROW, doubtful)
    exact = rows.filter("hit").join(kept.hint("merge"), ROW, "left_semi").dropDuplicates(ROW)
    return rows.filter("not hit").select(*plain.columns).unionAll(exact.select(*plain.columns)).toDF(*docs.columns)
