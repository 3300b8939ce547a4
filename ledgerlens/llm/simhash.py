"""SimHash near-duplicates by deletion variants.

A 64-bit fingerprint is cut into three segments. If two fingerprints differ in at most four
(up to five) bits, one segment differs in at most one. Each segment is indexed once per bit
position with that bit left out, so such pairs meet in a bucket by equality; the whole
fingerprints are then compared. Buckets yield a spanning forest of their links, never all
pairs, and only distinct fingerprints are compared: copies share one.

Null or empty text has fingerprint zero and links like any other. Repeated rows and ties
give equal fingerprints and one component. An empty table gives an empty result. A component
whose rows all lack a doc_id has a null component_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import connected, id_and_text, materialize

#: (first bit, width) of each segment, from the least significant bit.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Buckets of more distinct fingerprints are split by a second pigeonhole on the other bits.
HOT_BUCKET = 50_000
_SMALL_RUN = 8
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_PLACES = np.arange(8, dtype=np.int64) * 256


def simhash(text: bytes, words: int, seed: int) -> int:
    """Signed 64-bit fingerprint of a UTF-8 text: majority bits over its word shingles."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        digests = xxhash.xxh64_digest(joined, seed)
    else:
        ends = list(accumulate(len(t) + 1 for t in tokens))
        digests = b"".join([xxhash.xxh64_digest(joined[a : b - 1], seed) for a, b in zip([0, *ends], ends[words - 1 :])])
    lanes = np.frombuffer(digests, np.uint8).reshape(-1, 8)
    ones = np.bincount((lanes + _PLACES).ravel(), minlength=8 * 256).reshape(8, 256) @ _BITS
    return int(np.packbits((2 * ones > len(lanes)).ravel()).view(">i8")[0])


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [simhash(t, words, seed) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return id_and_text(docs).withColumn("text", F.col("text").cast("binary")).mapInArrow(run, "doc_id long, fp long")


def _forest(fps: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Spanning forest, as places, of the links among one bucket's fingerprints."""
    edges: list[tuple[int, int]] = []
    rest = np.arange(len(fps))
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            a = queue.pop()
            near = np.bitwise_count(fps[rest] ^ fps[a]) <= bits
            found, rest = rest[near], rest[~near]
            edges += [(int(a), int(b)) for b in found]
            queue.extend(found)
    return edges


def _links(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def scan(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch | None:
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            lengths = np.diff(np.r_[starts, len(keys)])
            a, b = [], []
            for n in range(2, _SMALL_RUN + 1):
                at = starts[lengths == n]
                for i in range(n - 1):
                    for j in range(i + 1, n):
                        near = np.bitwise_count(fps[at + i] ^ fps[at + j]) <= bits
                        a.append(at[near] + i)
                        b.append(at[near] + j)
            for s, n in zip(starts[lengths > _SMALL_RUN], lengths[lengths > _SMALL_RUN]):
                if found := _forest(fps[s : s + n], bits):
                    pairs = np.array(found, np.int64) + s
                    a.append(pairs[:, 0])
                    b.append(pairs[:, 1])
            if not a or not sum(map(len, a)):
                return None
            u, v = fps[np.concatenate(a)].view(np.int64), fps[np.concatenate(b)].view(np.int64)
            pairs = np.unique(np.stack([np.maximum(u, v), np.minimum(u, v)], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])

        keys, fps = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in batches:
            keys = np.r_[keys, batch.column("key").to_numpy()]
            fps = np.r_[fps, batch.column("fp").to_numpy().view(np.uint64)]
            whole = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last bucket may go on
            if whole and (out := scan(keys[:whole], fps[:whole])):
                yield out
            keys, fps = keys[whole:], fps[whole:]
        if len(keys) and (out := scan(keys, fps)):
            yield out

    return run


def _variants() -> str:
    """SQL array of the 64 index keys: position above bit 32, segment less one bit below."""
    return ", ".join(f"({at + p}L << 32) | (shiftrightunsigned(fp, {at}) & {((1 << w) - 1) & ~(1 << p)}L)" for at, w in SEGMENTS for p in range(w))


def _crowded(distinct: DataFrame, hot: int) -> DataFrame | None:
    """(key, n) of the buckets that may hold over ``hot`` fingerprints, with how many; None if there are none.

    A bucket holds the fingerprints of two values of its segment at most, so the values are counted, not the buckets.
    """
    values = ", ".join(f"struct({at} as s, shiftrightunsigned(fp, {at}) & {(1 << w) - 1}L as v)" for at, w in SEGMENTS)
    crowded = distinct.select(F.explode(F.expr(f"array({values})")).alias("x")).groupBy("x.s", "x.v").agg(F.count("*").alias("n"))
    crowded = materialize(crowded.filter(F.col("n") > hot // 2), "simhash-hot")
    if crowded.isEmpty():
        return None
    keys = " ".join(f"when {at} then array({', '.join(f'({at + p}L << 32) | (v & {((1 << w) - 1) & ~(1 << p)}L)' for p in range(w))})" for at, w in SEGMENTS)
    return crowded.select(F.explode(F.expr(f"case s {keys} end")).alias("key"), "n").groupBy("key").agg(F.sum("n").alias("n"))


def _split_hot(index: DataFrame, distinct: DataFrame, bits: int, hot: int) -> DataFrame:
    """Keys of buckets that may hold over ``hot`` fingerprints, extended by a piece of the other bits.

    The other 42 or 43 bits differ in at most ``bits``, so of ``bits`` + 1 pieces one is equal.
    """
    marked = _crowded(distinct, hot)
    if marked is None:
        return index
    cases = []
    for at, w in SEGMENTS:
        other = f"(shiftrightunsigned(fp, {at + w}) << {at}) | (fp & {(1 << at) - 1}L)" if at + w < 64 else f"fp & {(1 << at) - 1}L"
        n, cuts = 64 - w, [(64 - w) * i // (bits + 1) for i in range(bits + 2)]
        assert cuts[-1] == n
        pieces = ", ".join(
            f"xxhash64(key, {i}, shiftrightunsigned({other}, {cuts[i]}) & {(1 << (cuts[i + 1] - cuts[i])) - 1}L)" for i in range(bits + 1)
        )
        cases.append(f"when key < {at + w}L << 32 then array({pieces})")
    split = F.expr(f"case when n is null then array(key) {' '.join(cases)} end")
    return index.join(marked, "key", "left").select("fp", F.explode(split).alias("key"))


def links(distinct: DataFrame, bits: int = 4, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """(u, v), u > v: links that connect whatever fingerprints differ in at most ``bits`` bits."""
    if not 0 <= bits <= 5:
        raise ValueError("three segments find at most five differing bits")
    index = distinct.select("fp", F.explode(F.expr(f"array({_variants()})")).alias("key"))
    index = _split_hot(index, distinct, bits, hot_bucket)
    return index.repartition("key").sortWithinPartitions("key").mapInArrow(_links(bits), "u long, v long").distinct()


def near_duplicates(docs: DataFrame, words: int = 4, bits: int = 4, seed: int = 42, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the least doc_id reachable."""
    fps = materialize(fingerprints(docs, words, seed), "fingerprints")
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected(links(distinct, bits, hot_bucket)).select(F.col("node").alias("fp"), "root")
    named = materialize(distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "named")
    classes = materialize(named.groupBy("root").agg(F.min("least").alias("component_id")), "roots")
    classes = materialize(named.join(classes, "root").select("fp", "component_id"), "classes")
    return fps.join(classes, "fp", "left").select("doc_id", "fp", "component_id")
