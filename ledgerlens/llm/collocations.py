"""Collocations: frequent phrases of two or three words, by packed n-grams of dictionary numbers.

1. Tasks cut their texts into blocks of one language: a local word list, and a code for each word with a break (-1)
   between pieces. Blocks are written once; all later steps read them.
2. Word counts of all blocks make the dictionary: words found ``least`` times or more, numbered from 1, the most frequent
   first. A phrase that often holds no rarer word, so rare words break pieces too (number 0).
3. A block's words meet the dictionary by a join on (lang, word), and a block takes back only its own numbers: what a
   task holds grows with its block, never with the dictionary.
4. Each block packs every pair with its next number (0: none) into a key of three numbers of five bytes, radix-sorts
   the keys and counts runs. Range partitions, whose bounds follow from the word counts, are sorted by Spark, and one pass counts
   runs of pairs and of triples over their blocks. A pair's rows are as many as blocks and next words at most.
5. Phrases meet the counts of their parts by joins; whole numbers of 38 digits give the score.

Words are of the lower-cased text (A to Z), parted by blanks and tabs, pieces by ``. , ; : ! ?`` and line ends. A null
text counts as empty, a null language as ``und``. Copies and repeated rows count as often as they occur; ties come in the
order of the phrase's bytes; an empty table gives an empty result. Only ``text`` and ``lang`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import body, materialize, prefix_sums, shuffle_partitions

#: Bytes of text to a block. A single longer text makes a longer block.
BLOCK = 8_000_000
#: Bytes of a dictionary number in a key.
WIDTH = 5
#: Rows of keys that a task hands on at a time.
BATCH = 200_000

_BREAK = 0xFF  # no byte of UTF-8
# What parts pieces, and what parts words.
_TABLE = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", bytes([_BREAK]) * 10 + b" ")
BLOCKS = "block long, lang string, word string, code int, n long, codes binary"


def _codes(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The different words of texts, and each word's place in that list with -1 between pieces and texts."""
    data = bytes([_BREAK]).join(texts).lower().translate(_TABLE).replace(bytes([_BREAK]), bytes([32, _BREAK, 32]))
    offsets = pa.py_buffer(np.array([0, len(data)], np.int64))
    whole = pa.Array.from_buffers(pa.large_string(), 1, [None, offsets, pa.py_buffer(data)])
    found = pc.ascii_split_whitespace(whole).flatten().cast(pa.large_binary()).dictionary_encode()
    words, codes = found.dictionary, found.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    keep = np.array([bool(len(w)) and w != bytes([_BREAK]) for w in words.to_pylist()], bool)
    new = np.where(keep, np.cumsum(keep) - 1, -1).astype(np.int32) if len(keep) else np.zeros(0, np.int32)
    empty = np.array([not len(w) for w in words.to_pylist()], bool)
    if empty.any():  # what an edge of white space leaves is no word
        codes = codes[~empty[codes]]
    return words.filter(pa.array(keep)), new[codes] if len(codes) else codes


def _block_rows(number: int, lang: str, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
    """A row for each different word of a block, then one row of its codes."""
    words, codes = _codes(texts)
    n = len(words)
    if not n:
        return
    counts = np.bincount(codes[codes >= 0], minlength=n).astype(np.int64)
    names = [c.split()[0] for c in BLOCKS.split(", ")]
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, number, np.int64)), pa.array([lang] * n, pa.string()), words.cast(pa.string()), pa.array(np.arange(n, dtype=np.int32)), pa.array(counts), pa.nulls(n, pa.binary())], names
    )
    yield pa.RecordBatch.from_arrays(
        [pa.array([number], pa.int64()), pa.array([lang], pa.string()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), pa.array([codes.tobytes()], pa.binary())], names
    )


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``BLOCKS``; numbers are the task's partition and a count, fixed once the table is written."""
    number = TaskContext.get().partitionId() << 32
    waiting: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text")):
            data = text.as_py().encode("utf-8", "replace")
            waiting.setdefault(lang, []).append(data)
            sizes[lang] = sizes.get(lang, 0) + len(data)
            while sum(sizes.values()) >= BLOCK:
                largest = max(sizes, key=lambda k: (sizes[k], k))
                yield from _block_rows(number, largest, waiting.pop(largest))
                number += 1
                del sizes[largest]
    for lang, texts in waiting.items():
        yield from _block_rows(number, lang, texts)
        number += 1


def _radix_order(columns: list[np.ndarray]) -> np.ndarray:
    """The order of rows by their columns, first to last: stable passes over digits of 16 bits, the last digit first."""
    order = np.arange(len(columns[0]))
    for column in reversed(columns):
        for shift in range(0, max(1, int(column.max(initial=0)).bit_length()), 16):
            order = order[np.argsort(((column[order] >> shift) & 0xFFFF).astype(np.uint16), kind="stable")]
    return order


def _packed(numbers: list[np.ndarray]) -> np.ndarray:
    """Rows of big-endian numbers of ``WIDTH`` bytes side by side, so that byte order is the order of the numbers."""
    parts = [n.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - WIDTH :] for n in numbers]
    return np.ascontiguousarray(np.concatenate(parts, axis=1))


def _binary(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * np.int32(width)), pa.py_buffer(rows.tobytes())])


def _runs(columns: list[np.ndarray]) -> np.ndarray:
    """Where runs of equal rows begin."""
    if not len(columns[0]):
        return np.zeros(0, int)
    new = np.zeros(len(columns[0]), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _keys(partitions: int, total: int):
    """A block's keys with their counts, each with its range partition."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("part", pa.int32()), ("key", pa.binary()), ("n", pa.int64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        right = right.combine_chunks()
        ids = right.column("id").to_numpy()
        rank = np.argsort(ids, kind="stable")
        ids, codes_of = ids[rank], right.column("code").to_numpy()[rank]
        start, size = (right.column(c).to_numpy()[rank].astype(float) for c in ("start", "f"))
        codes = np.concatenate([np.frombuffer(c.as_py(), np.int32) for c in left.column("codes")])
        local = np.zeros(max(int(codes.max(initial=0)), int(codes_of.max())) + 2, np.int64)  # the last place serves -1
        local[codes_of] = np.arange(1, len(ids) + 1)
        g = np.concatenate([local[codes], [0, 0]])
        at = np.flatnonzero((g[:-2] > 0) & (g[1:-1] > 0))
        columns = [g[at], g[at + 1], g[at + 2]]
        order = _radix_order(columns)
        columns = [c[order] for c in columns]
        first = _runs(columns)
        n = np.diff(np.append(first, len(order)))
        a, b, c = (x[first] for x in columns)
        ids = np.concatenate([[0], ids])
        spot = start[a - 1] + size[a - 1] * ((start[b - 1] + size[b - 1] / 2) / total)
        part = np.clip((spot / total * partitions).astype(np.int32), 0, partitions - 1)
        return pa.Table.from_arrays([pa.array(part), _binary(_packed([ids[a], ids[b], ids[c]])), pa.array(n.astype(np.int64))], schema=schema)

    return run


def _count_runs(least: int):
    """(a, b, c, f) of pairs (c is 0) and triples found ``least`` times or more, from rows (key, n) in order of key."""
    cut = 2 * WIDTH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, pair_n, key, key_n = b"", 0, b"", 0
        found: list[tuple[bytes, int]] = []

        def close(k: bytes, n: int) -> None:
            if n >= least and (len(k) == cut or any(k[cut:])):
                found.append((k, n))

        def flush() -> pa.RecordBatch:
            rows = np.frombuffer(b"".join(k.ljust(3 * WIDTH, b"\0") for k, _ in found), np.uint8).reshape(-1, 3, WIDTH)
            wide = np.zeros((len(found), 3, 8), np.uint8)
            wide[:, :, 8 - WIDTH :] = rows
            ids = wide.reshape(-1).view(">u8").astype(np.int64).reshape(-1, 3)
            out = pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(ids[:, i])) for i in range(3)), pa.array([n for _, n in found], pa.int64())], ["a", "b", "c", "f"])
            found.clear()
            return out

        for batch in batches:
            keys, counts = batch.column("key"), batch.column("n").to_numpy()
            if not len(counts):
                continue
            begin = keys.offset * 3 * WIDTH
            rows = np.frombuffer(keys.buffers()[2], np.uint8)[begin : begin + len(counts) * 3 * WIDTH].reshape(-1, 3 * WIDTH)
            differs = rows[1:] != rows[:-1]
            for width, pairs in ((3 * WIDTH, False), (cut, True)):
                first = np.append(0, np.flatnonzero(differs[:, :width].any(axis=1)) + 1)
                sums = np.add.reduceat(counts, first)
                k, n = (pair, pair_n) if pairs else (key, key_n)
                head = rows[0, :width].tobytes()
                if head == k:  # a run that goes on from the batch before
                    sums[0] += n
                else:
                    close(k, n)
                for i in np.flatnonzero(sums[:-1] >= least):
                    close(rows[first[i], :width].tobytes(), int(sums[i]))
                if pairs:
                    pair, pair_n = rows[first[-1], :width].tobytes(), int(sums[-1])
                else:
                    key, key_n = rows[first[-1], :width].tobytes(), int(sums[-1])
            if len(found) >= BATCH:
                yield flush()
        close(key, key_n)
        close(pair, pair_n)
        if found:
            yield flush()

    return run


def phrases(docs: DataFrame, least: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(dictionary, phrases, totals): (lang, word, f, id) of words and (a, b, c, f) of phrases found ``least`` times or more, and (lang, n) of all words."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), body().alias("text"))
    blocks = materialize(rows.mapInArrow(_blocks, BLOCKS), "blocks")
    words = blocks.filter("word is not null")
    counted = words.groupBy("lang", "word").agg(F.sum("n").alias("f"))
    totals = materialize(words.groupBy("lang").agg(F.sum("n").alias("n")), "word-totals")
    frequent = prefix_sums(counted.filter(F.col("f") >= least).withColumn("one", F.lit(1).cast("long")), [], [F.col("f").desc(), F.col("lang"), F.col("word")], ["one", "f"], "frequent-words")
    dictionary = materialize(frequent.select("lang", "word", "f", (F.col("before_one") + 1).alias("id"), F.col("before_f").alias("start")), "dictionary")
    total, largest = dictionary.agg(F.sum("f"), F.max("id")).first()
    if (largest or 0) >= 1 << 8 * WIDTH:
        raise ValueError("more frequent words than a key can number")
    known = words.select("block", "lang", "word", "code").join(dictionary, ["lang", "word"]).select(F.col("block").alias("of_block"), "code", "id", "f", "start")
    n = shuffle_partitions(spark)
    keys = blocks.filter("codes is not null").select("block", "codes").groupBy("block").cogroup(known.groupBy("of_block")).applyInArrow(_keys(n, total or 1), "part int, key binary, n long")
    found = keys.repartitionById(n, F.col("part")).select("key", "n").sortWithinPartitions("key").mapInArrow(_count_runs(least), "a long, b long, c long, f long")
    return dictionary.select("lang", "word", "f", "id"), materialize(found, "phrases"), totals


def scored(a, left, right):
    """floor(1,000,000 a a / (left right)), in whole numbers."""
    wide = lambda c: c.cast("decimal(19,0)")
    product = (F.lit(1_000_000).cast("decimal(7,0)") * (wide(a) * wide(a)).cast("decimal(31,0)")).cast("decimal(38,0)")
    return F.call_function("div", product, (wide(left) * wide(right)).cast("decimal(38,0)")).cast("long")


def collocations(docs: DataFrame, least: int = 10, absorb_percent: int = 50, most: int = 2_000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``most`` best phrases of each language.

    A phrase is cut where its parts make it least remarkable. One that lies inside a longer phrase of at least
    ``absorb_percent`` of its count gives way to it.
    """
    dictionary, found, totals = phrases(docs, least)
    word = lambda name: dictionary.select(F.col("id").alias(name), F.col("f").alias(f"f_{name}"), F.col("word").alias(f"word_{name}"))
    pairs, triples = found.filter("c = 0").select("a", "b", "f"), found.filter("c > 0")
    inside = triples.select("a", "b", "f").unionAll(triples.select(F.col("b").alias("a"), F.col("c").alias("b"), "f")).groupBy("a", "b").agg(F.max("f").alias("longer"))
    alone = pairs.join(inside, ["a", "b"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < absorb_percent * F.col("f"))).drop("longer")
    heads = dictionary.select(F.col("id").alias("a"), "lang", F.col("f").alias("f_a"), F.col("word").alias("word_a"))
    two = alone.join(heads, "a").join(word("b"), "b")
    two = two.select("lang", F.concat_ws(" ", "word_a", "word_b").alias("phrase"), F.col("f").alias("count"), F.col("f_a").alias("l"), F.col("f_b").alias("r"))
    three = triples.join(heads, "a").join(word("b").drop("f_b"), "b").join(word("c"), "c")
    three = three.join(pairs.select("a", "b", F.col("f").alias("f_ab")), ["a", "b"]).join(pairs.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("f").alias("f_bc")), ["b", "c"])
    early, late = scored(F.col("f"), F.col("f_a"), F.col("f_bc")), scored(F.col("f"), F.col("f_ab"), F.col("f_c"))
    three = three.select(
        "lang", F.concat_ws(" ", "word_a", "word_b", "word_c").alias("phrase"), F.col("f").alias("count"),
        F.when(early <= late, F.col("f_a")).otherwise(F.col("f_ab")).alias("l"), F.when(early <= late, F.col("f_bc")).otherwise(F.col("f_c")).alias("r"),
    )
    rows = two.unionAll(three).withColumn("score", scored(F.col("count"), F.col("l"), F.col("r")))
    best = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("count").desc(), "phrase")
    rows = rows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= most).join(totals, "lang")
    return rows.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", F.col("count").alias("a"), "l", "r", "n", "score")
