"""Chunking of documents and search inside them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import params as p
from ledgerlens.functions import text as t
from ledgerlens.operators.leading import QUERY_BLOCK
from ledgerlens.operators.lexical import top_k
from ledgerlens.operators.ranking import fuse, unit
from ledgerlens.operators.shared import write_shared

_HEADING = re.compile(r"(#{1,6})\s+(.*\S)\s*")
_FENCE = re.compile(r"\s*(`{3,}|~{3,})")
CHUNK = "doc_id {}, seq int, heading_path string, start_line int, end_line int, chars int, quote_anchor string, overlap_with int, chunker_version string"


def _windows(sizes: list[int], longest: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Line ranges [a, b) of at most ``longest`` characters; each starts ``overlap`` characters or less before the last one's end."""
    a = 0
    while a < len(sizes):
        b, size = a + 1, sizes[a]
        while b < len(sizes) and size + sizes[b] <= longest:
            size += sizes[b]
            b += 1
        yield a, b
        if b == len(sizes):
            return
        a, size = a + 1, size - sizes[a]
        while a < b and size > overlap:
            size -= sizes[a]
            a += 1


def chunk(text: str, longest: int = p.CHUNK_CHARS, step: int = p.WINDOW_STEP) -> list[tuple]:
    """Chunks (seq, heading_path, start_line, end_line, chars, quote_anchor, overlap_with), lines from 1.

    A section goes from a heading to the next one; long sections, and texts without
    headings, are cut into windows of whole lines. Fenced lines are never headings.
    """
    lines = re.sub(r"\r\n?", "\n", text).rstrip("\n").split("\n")
    if lines == [""]:
        return []
    heads, fence = [], ""
    for i, line in enumerate(lines):
        if m := _FENCE.match(line):
            fence = "" if fence == m[1][0] else fence or m[1][0]
        elif not fence and (m := _HEADING.fullmatch(line)):
            heads.append((i, len(m[1]), m[2]))
    starts = [i for i, *_ in heads]
    if not starts or starts[0]:
        starts.insert(0, 0)
    out: list[tuple] = []
    path: list[tuple[int, str]] = []
    at = {i: (level, name) for i, level, name in heads}
    for begin, end in zip(starts, [*starts[1:], len(lines)]):
        if begin in at:
            path = [*(x for x in path if x[0] < at[begin][0]), at[begin]]
        previous = None
        for a, b in _windows([len(x) + 1 for x in lines[begin:end]], longest, max(1, longest - step)):
            body = "\n".join(lines[begin + a : begin + b])
            if body.strip():
                anchor = re.sub(r"\s+", " ", body).strip()[: p.ANCHOR_CHARS]
                out.append((len(out) + 1, " > ".join(n for _, n in path), begin + a + 1, begin + b, len(body), anchor, previous))
            previous = len(out)
    return out


#: Documents that a task cuts at a time.
CUT = 32


def chunk_documents(docs: DataFrame, bodies: bool = False) -> DataFrame:
    """Chunks of (doc_id, text); with ``bodies`` each carries its own lines, joined, and nothing else of its document.

    A task holds the chunks of ``CUT`` documents at a time.
    """
    schema = CHUNK.format(dict(docs.dtypes)["doc_id"]) + (", body string" if bodies else "")
    names = [c.split()[0] for c in schema.split(", ")]
    types = [pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, CUT):
                rows = []
                for i, x in enumerate(b.column("text").slice(start, CUT).to_pylist(), start):
                    lines = re.sub(r"\r\n?", "\n", x or "").split("\n") if bodies else []
                    rows += [(i, *c, p.CHUNKER_VERSION, *(["\n".join(lines[c[2] - 1 : c[3]])] if bodies else [])) for c in chunk(x or "")]
                own, *columns = [pa.array([r[n] for r in rows], kind) for n, kind in enumerate(types[: len(names)])]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(own), *columns], names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


#: Lines to a bin when the furthest end of ranges is looked up.
REACH_BIN = 1_024


def reach(points: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, line, reach) of each different (keys, line) of ``points``: the furthest ``to_line`` of the ranges (keys, from_line, to_line) that begin at the line or before.

    One number answers three questions: a range covers lines a to b if the reach at a is b or more; one meets
    them if the reach at b is a or more; a line is inside one if its own reach is not less. Lines are ranked inside bins, each of
    which starts from the furthest end of the bins before, so neither a long document nor many ranges of one meet in one task,
    and no row holds an array.
    """
    at = F.floor(F.col("line") / REACH_BIN)
    asked = points.select(*keys, "line").distinct().select(*keys, "line", F.lit(None).cast("int").alias("to"), F.lit(2).alias("turn"))
    begun = ranges.groupBy(*keys, F.col("from_line").alias("line")).agg(F.max("to_line").cast("int").alias("to")).withColumn("turn", F.lit(1))
    rows = asked.unionByName(begun).withColumn("bin", at)
    before = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = rows.groupBy(*keys, "bin").agg(F.max("to").alias("top")).withColumn("to", F.max("top").over(before))
    bins = bins.filter("to is not null").select(*keys, (F.col("bin") * REACH_BIN).cast("int").alias("line"), "to", F.lit(0).alias("turn"), "bin")
    running = Window.partitionBy(*keys, "bin").orderBy("line", "turn").rowsBetween(Window.unboundedPreceding, 0)
    return rows.unionByName(bins).withColumn("reach", F.max("to").over(running)).filter("turn = 2").select(*keys, "line", "reach")


def read_chunks(chunks: DataFrame, redlines: DataFrame) -> DataFrame:
    """Chunks (with ``body``) as search reads them: without those that one redline covers, and without redlined lines.

    ``redlines``: (doc_id, from_line, to_line); a null doc_id means every document. Gives doc_id, seq, overlap_with,
    head and kept (tokens of the heading path and of the lines that stand), partly_redlined. Chunks of documents
    that no range names are read whole; only the others are taken apart into lines.
    """
    if redlines.filter("doc_id is null").isEmpty():
        marked = chunks.join(redlines.select("doc_id", F.lit(True).alias("named")).distinct(), "doc_id", "left")
        whole = marked.filter("named is null").select("doc_id", "seq", "overlap_with", t.tokenize(F.col("heading_path")).alias("head"), t.tokenize(F.col("body")).alias("kept"), F.lit(False).alias("partly_redlined"))
        return whole.unionByName(_read_lines(marked.filter("named").drop("named"), redlines))
    return _read_lines(chunks, redlines)


def _read_lines(chunks: DataFrame, redlines: DataFrame) -> DataFrame:
    """``read_chunks`` by lines."""
    parts = chunks.select("doc_id", "seq", "start_line", "end_line", F.posexplode(F.split("body", "\n", -1)).alias("at", "x")).withColumn("line", F.col("start_line") + F.col("at"))
    own = reach(parts, redlines.filter("doc_id is not null"), ["doc_id"])
    every = reach(parts, redlines.filter("doc_id is null"), []).withColumnRenamed("reach", "reach_all")
    parts = parts.join(own, ["doc_id", "line"], "left").join(every, "line", "left").withColumn("reach", F.greatest("reach", "reach_all"))
    stands = F.col("reach").isNull() | (F.col("reach") < F.col("line"))
    read = parts.groupBy("doc_id", "seq").agg(
        F.max(F.when(F.col("line") == F.col("start_line"), F.col("reach") >= F.col("end_line"))).alias("covered"),
        F.max(F.when(F.col("line") == F.col("end_line"), F.col("reach") >= F.col("start_line"))).alias("met"),
        F.sort_array(F.collect_list(F.when(stands, F.struct("line", "x")))).alias("lines"),
    )
    heads = chunks.select("doc_id", "seq", "overlap_with", t.tokenize(F.col("heading_path")).alias("head"))
    return read.filter("covered is null or not covered").join(heads, ["doc_id", "seq"]).select(
        "doc_id", "seq", "overlap_with", "head", t.tokenize(F.array_join(F.transform("lines", lambda l: l["x"]), "\n")).alias("kept"), F.coalesce("met", F.lit(False)).alias("partly_redlined")
    )


def chunk_hits(read: DataFrame, queries: DataFrame, heading_weight: float = 2.0, body_weight: float = 1.0) -> DataFrame:
    """Chunks of ``read_chunks`` that share words with a query (query_id, doc_id, query), with score and matched words."""
    hits = queries.select("query_id", "doc_id", t.tokenize(F.col("query")).alias("terms")).filter(F.size("terms") > 0).join(read, "doc_id")
    in_head, in_body = F.array_intersect("terms", "head"), F.array_intersect("terms", "kept")
    total = F.size(in_head) * heading_weight + F.size(in_body) * body_weight
    hits = hits.withColumn("matched", F.array_sort(F.array_union(in_head, in_body)))
    hits = hits.withColumn("score", t.round_half_up(total * F.size("matched") / F.size("terms"), 2)).filter("score > 0")
    return hits.select("query_id", "doc_id", "seq", "overlap_with", "score", "matched", "partly_redlined")


def best_chunks(hits: DataFrame, limit: int = p.RESULT_LIMIT) -> DataFrame:
    """Each query's best hits; a chunk that repeats the end of a predecessor that matches too gives way to it."""
    before = hits.select("query_id", "doc_id", F.col("seq").alias("overlap_with"), F.lit(True).alias("shown"))
    alone = hits.join(before, ["query_id", "doc_id", "overlap_with"], "left").filter("shown is null")
    return top_k(alone, limit, F.col("score").desc(), F.col("seq"), F.col("doc_id")).drop("shown")


def search_chunks(chunks: DataFrame, queries: DataFrame, redlines: DataFrame, limit: int = p.RESULT_LIMIT) -> DataFrame:
    """The best chunks of each query (query_id, doc_id, query) by words: second-level search inside one document."""
    wanted = chunks.join(queries.select("doc_id").distinct(), "doc_id", "left_semi")
    return best_chunks(chunk_hits(read_chunks(wanted, redlines), queries), limit)


def vector_state(chunks: DataFrame, layer: DataFrame, version: str) -> DataFrame:
    """(doc_id, state, missing) of each document's vectors: used, partial, index-stale (other versions only) or index-missing."""
    mine = layer.filter((F.col("version") == version) & F.col("embedding").isNotNull()).select("doc_id", "seq").distinct().withColumn("has", F.lit(1))
    other = layer.filter(F.col("version") != version).select("doc_id").distinct().withColumn("stale", F.lit(True))
    rows = chunks.select("doc_id", "seq").join(mine, ["doc_id", "seq"], "left").groupBy("doc_id").agg(F.count("*").alias("n"), F.count("has").alias("have")).join(other, "doc_id", "left")
    state = F.when((F.col("have") == 0) & F.col("stale"), "index-stale").when(F.col("have") == 0, "index-missing").when(F.col("have") < F.col("n"), "partial").otherwise("used")
    return rows.select("doc_id", state.alias("state"), (F.col("n") - F.col("have")).alias("missing"))


#: Queries, most often of one document each, whose vectors meet in one call.
DOCUMENTS = 256


def nearest_chunks(layer: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, seq, rank, cosine): the ``k`` chunks of each query's own document whose vectors (doc_id, seq, embedding) are nearest, if cosine is above 0.

    Queries (query_id, doc_id, embedding) of one document come in blocks, each of which meets the document's
    vectors as one matrix product and keeps its best before anything else is shuffled. Documents go to Python in
    groups of about ``DOCUMENTS``.
    """
    dealt = asked.groupBy("doc_id").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks"))
    groups = max(1, -(-asked.count() // DOCUMENTS))
    group = lambda c: F.pmod(F.xxhash64(c), F.lit(groups)).cast("int")
    block = F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")
    left = layer.select("doc_id", "seq", "embedding").join(dealt, "doc_id").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks").withColumn("dealt", group("doc_id"))
    right = asked.select("query_id", "doc_id", "embedding").join(dealt, "doc_id").select("query_id", F.col("doc_id").alias("of"), "embedding", block.alias("of_block"), group("doc_id").alias("of_dealt"))
    types = dict(asked.dtypes)

    def best(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        mine, theirs = vectors.column("embedding").combine_chunks(), queries.column("embedding").combine_chunks()
        docs = pc.unique(vectors.column("doc_id"))
        own, of = (pc.index_in(c, docs).fill_null(-1).to_numpy() for c in (vectors.column("doc_id"), queries.column("of")))
        size, asks = (c.value_lengths().fill_null(0).to_numpy() for c in (mine, theirs))
        seq = vectors.column("seq").to_numpy()
        found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0),)]
        for dim in sorted({*size.tolist()} & {*asks.tolist()} - {0}):
            v, q = np.flatnonzero(size == dim), np.flatnonzero((asks == dim) & (of >= 0))
            v, q = v[np.lexsort((seq[v], own[v]))], q[np.argsort(of[q], kind="stable")]
            a, b = (unit(c.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False), dim) for c, at in ((mine, v), (theirs, q)))
            for d in np.unique(of[q]):
                (v0, v1), (q0, q1) = np.searchsorted(own[v], [d, d + 1]), np.searchsorted(of[q], [d, d + 1])
                scores = np.floor(b[q0:q1] @ a[v0:v1].T * 1e6 + 0.5) / 1e6
                order = np.argsort(-scores, axis=1, kind="stable")[:, :k]  # equal scores: the earlier chunk
                value = np.take_along_axis(scores, order, axis=1)
                row, rank = np.nonzero(value > 0)
                found.append((q[q0 + row], v[v0 + order[row, rank]], rank + 1, value[row, rank]))
        q, v, rank, cosine = (np.concatenate(c) for c in zip(*found))
        columns = [queries.column("query_id").take(pa.array(q)), vectors.column("doc_id").take(pa.array(v)), vectors.column("seq").take(pa.array(v)), pa.array(rank.astype(np.int32)), pa.array(cosine)]
        return pa.Table.from_arrays(columns, ["query_id", "doc_id", "seq", "rank", "cosine"])

    found = left.groupBy("dealt", "block").cogroup(right.groupBy("of_dealt", "of_block"))
    return found.applyInArrow(best, f"query_id {types['query_id']}, doc_id {types['doc_id']}, seq int, rank int, cosine double")


def fused_chunks(lexical: DataFrame, vectors: DataFrame) -> DataFrame:
    """(query_id, doc_id, seq, position, score, channels): chunks by the fused ranks of both channels, each (query_id, doc_id, seq, rank) and of one document a query.

    A chunk that only one channel found still counts.
    """
    channel = lambda rows, name: rows.select("query_id", F.lit(name).alias("channel"), F.lit(1.0).alias("weight"), "rank", F.struct(F.col("seq").cast("string").alias("name"), "doc_id", "seq").alias("key"))
    rows = fuse(channel(lexical, "lexical").unionByName(channel(vectors, "vector")))
    names = F.array_join(F.transform(F.array_sort(F.map_entries("ranks")), lambda x: F.concat(x["key"], F.lit(" #"), x["value"].cast("string"))), " / ")
    return rows.select("query_id", "key.doc_id", "key.seq", "position", t.round_half_up(F.col("fused"), 4).alias("score"), names.alias("channels"))


def search_chunks_fused(chunks: DataFrame, queries: DataFrame, redlines: DataFrame, layer: DataFrame, asked: DataFrame, version: str, limit: int = p.RESULT_LIMIT, depth: int = 20) -> DataFrame:
    """(query_id, doc_id, seq, rank, score, channels, state, missing): chunk search by words and vectors.

    ``layer``: stored vectors (doc_id, seq, version, embedding); ``asked``: the queries' (query_id, embedding), null where
    embedding failed. Both channels meet by rank: words in the order of the document, vectors by cosine, ``depth`` deep. A document
    without vectors of this version (index-missing, index-stale) and a query without a vector (error) fall back to
    the order of words and say so; partial layers take part and say how many are missing. Covered chunks never return.
    """
    queries = queries.join(asked.select("query_id", "embedding"), "query_id", "left")
    wanted = chunks.join(queries.select("doc_id").distinct(), "doc_id", "left_semi")
    read = write_shared(read_chunks(wanted, redlines), "read-chunks")
    hits = write_shared(chunk_hits(read, queries), "chunk-hits")
    known = queries.join(vector_state(wanted, layer, version), "doc_id").filter(F.size(t.tokenize(F.col("query"))) > 0)
    known = known.withColumn("state", F.when(F.col("state").isin("used", "partial") & F.col("embedding").isNull(), "error").otherwise(F.col("state")))
    known = write_shared(known.select("query_id", "doc_id", "embedding", "state", "missing"), "chunk-queries")
    with_vectors = known.filter(F.col("state").isin("used", "partial"))
    near = nearest_chunks(layer.filter(F.col("version") == version), with_vectors, depth)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("seq"))
    words = hits.join(with_vectors.select("query_id"), "query_id", "left_semi").withColumn("rank", place)
    both = fused_chunks(words.select("query_id", "doc_id", "seq", "rank"), near.select("query_id", "doc_id", "seq", "rank")).join(read.select("doc_id", "seq"), ["doc_id", "seq"])
    both = top_k(both, limit, F.col("position")).select("query_id", "doc_id", "seq", "rank", "score", "channels")
    plain = best_chunks(hits.join(with_vectors.select("query_id"), "query_id", "left_anti"), limit).select("query_id", "doc_id", "seq", "rank", "score", F.lit(None).cast("string").alias("channels"))
    return both.unionByName(plain).join(known.select("query_id", "state", "missing"), "query_id")


def browse_chunks(chunks: DataFrame, limit: int = p.RESULT_LIMIT) -> DataFrame:
    """Chunks without a query: what overlaps its predecessor is gone, neighbours become one span."""
    first = chunks.filter("overlap_with is null")
    w = Window.partitionBy("doc_id").orderBy("seq")
    spans = first.withColumn("island", F.col("seq") - F.row_number().over(w)).groupBy("doc_id", "island").agg(
        F.min("seq").alias("seq"), F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.sum("chars").alias("chars"), F.count("*").alias("chunks")
    )
    return top_k(spans, limit, F.col("seq"), by="doc_id").drop("island", "rank")


def drift(bindings: DataFrame, files: DataFrame) -> DataFrame:
    """(id, path, state) of bindings (id, path, content_hash) whose file (path, hash) is missing or has changed."""
    rows = bindings.join(files.select("path", F.col("hash").alias("file_hash")), "path", "left")
    state = F.when(F.col("file_hash").isNull(), "missing").when(F.col("file_hash") != F.col("content_hash"), "changed")
    return rows.withColumn("state", state).filter("state is not null").select("id", "path", "state")


def pack_groups(rows: DataFrame, by: str, order: str, text: str, budget: int) -> DataFrame:
    """(by, packed): each group's lines in order as far as they fit the budget, a line costing its length and 1; one that does not fit is skipped.

    A group is never gathered whole: of its lines that fit what is left, the next budget + 1 are packed at a
    time (no more can fit, as each costs 1 or more), and only those behind them come up again.
    """
    state = write_shared(rows.select(by).distinct().select(by, F.lit(budget).alias("left"), F.lit(None).cast(dict(rows.dtypes)[order]).alias("at"), F.expr("cast(array() as array<string>)").alias("lines")), "packed")
    lines = rows.select(by, F.col(order).alias("place"), F.col(text).alias("line"))
    first = Window.partitionBy(by).orderBy("place", "line")
    while True:
        ahead = lines.join(state.select(by, "left", "at"), by).filter((F.col("at").isNull() | (F.col("place") > F.col("at"))) & (F.length("line") <= F.col("left")))
        ahead = ahead.withColumn("rn", F.row_number().over(first)).filter(F.col("rn") <= budget + 1)
        taken = ahead.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("place", "line"))).alias("xs"), F.max("place").alias("reached"))
        after = state.join(taken, by, "left").withColumn("start", F.struct(F.expr("cast(array() as array<string>)").alias("out"), F.col("left").alias("left")))
        packed = F.aggregate(
            F.coalesce("xs", F.expr("array()")), F.col("start"),
            lambda acc, x: F.when(F.length(x["line"]) <= acc["left"], F.struct(F.concat(acc["out"], F.array(x["line"])).alias("out"), (acc["left"] - F.length(x["line"]) - 1).alias("left"))).otherwise(acc),
        )
        after = after.withColumn("p", F.when(F.col("xs").isNotNull(), packed))
        moved = after.select(by, F.coalesce("p.left", "left").alias("left"), F.coalesce("reached", "at").alias("at"), F.concat("lines", F.coalesce("p.out", F.expr("cast(array() as array<string>)"))).alias("lines"), F.col("xs").isNotNull().alias("more"))
        moved = write_shared(moved, "packed")
        if moved.filter("more").isEmpty():
            return moved.select(by, F.array_join("lines", "|").alias("packed"))
        state = moved.drop("more")
