"""Token counts by scanning flat token files for their separators.

``write_flat`` packs documents into token files: 16-bit identifiers one after the other, an
end-of-document identifier behind each document, cut into blocks of equal size wherever the
cut falls. Nothing in a file says where documents begin. ``scan`` searches whole blocks at
once for the separator and notes each block's tokens, separators and the lengths between
them; prefix scans over those notes (first inside groups of blocks, then over the groups)
give the documents that go on across blocks their lengths and all documents their place.
The files' manifest then names the document at each place.

Null or empty text has no tokens; special tokens written out in a text are ordinary text.
Repeated rows each have a row; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import id_and_text, materialize

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: The vocabulary ends before this identifier, which is free.
END = 50_256
BLOCK_TOKENS = 32_768
#: Blocks whose notes are scanned in one group.
GROUP = 4_096
#: Pre-tokenisation of the published byte-level vocabularies, a fixed value.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
FLAT = "file long, block long, payload binary, place long, doc_ids array<long>"
NOTES = "file long, block long, tokens long, ends long, first_end long, last_end long, lengths array<int>"


#: White space as the pre-tokenisation counts it, a fixed value.
_SPACE = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Runs of so much white space are more than the pre-tokenisation's backtracking can take.
_LONG_SPACE = re.compile(f"{_SPACE}{{100000,}}")


@lru_cache(2)
def tokenizer(folder: str, vocabulary: str) -> tuple[tiktoken.Encoding, tiktoken.Encoding]:
    """The tokenizer, and one that takes a text as a single piece. Identifiers must leave ``END`` and 16 bits free."""
    with open(f"{folder}/{vocabulary}", "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    if max(ranks.values()) >= END:
        raise ValueError(f"{vocabulary} has identifiers of {END} or more; token files hold 16 bits and keep {END} as separator")
    return tuple(tiktoken.Encoding("flat", pat_str=p, mergeable_ranks=ranks, special_tokens={}) for p in (PATTERN, "(?s:.+)"))


def encode(encodings: tuple[tiktoken.Encoding, tiktoken.Encoding], text: str) -> list[int]:
    """The whole text's tokens.

    A long run of white space is taken out first: all of it but the last character, or all at
    the text's end, is one piece, and pieces on both sides end there whatever stands in them.
    """
    whole, piece = encodings
    out, at = [], 0
    for m in _LONG_SPACE.finditer(text):
        end = m.end() - (m.end() < len(text))
        out += whole.encode_ordinary(text[at : m.start()]) + piece.encode_ordinary(text[m.start() : end])
        at = end
    return out + whole.encode_ordinary(text[at:])


def write_flat(docs: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks (payload) and manifest (place, doc_ids) of one file for each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, file = tokenizer(folder, vocabulary), TaskContext.get().partitionId()
        rest, block, place = np.empty(0, np.uint16), 0, 0
        schema = pa.schema([("file", pa.int64()), ("block", pa.int64()), ("payload", pa.binary()), ("place", pa.int64()), ("doc_ids", pa.list_(pa.int64()))])

        def rows(*rows: tuple) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for b in batches:
            parts = [rest]
            for text in b.column("text"):
                parts.append(np.array([*encode(encoding, text.as_py()), END], np.uint16))
                if sum(map(len, parts[-64:])) >= block_tokens or len(parts) > 512:
                    flat = np.concatenate(parts)
                    whole = len(flat) // block_tokens
                    if whole:
                        yield rows(*((file, block + i, flat[i * block_tokens : (i + 1) * block_tokens].tobytes(), None, None) for i in range(whole)))
                        block += whole
                    parts = [flat[whole * block_tokens :]]
            rest = np.concatenate(parts)
            if b.num_rows:
                yield rows((file, None, None, place, b.column("doc_id").to_pylist()))
                place += b.num_rows
        for at in range(0, len(rest), block_tokens):
            yield rows((file, block, rest[at : at + block_tokens].tobytes(), None, None))
            block += 1

    return id_and_text(docs).mapInArrow(run, FLAT)


def scan(blocks: DataFrame, end: int = END) -> DataFrame:
    """Notes on each block (file, block, payload): positions count tokens from the block's start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([*((c, pa.int64()) for c in ("file", "block", "tokens", "ends", "first_end", "last_end")), ("lengths", pa.list_(pa.int32()))])
        for b in batches:
            rows = []
            for file, block, payload in zip(b.column("file").to_pylist(), b.column("block").to_pylist(), b.column("payload")):
                tokens = np.frombuffer(payload.as_buffer(), np.uint16)
                at = np.flatnonzero(tokens == end)
                first, last = (int(at[0]), int(at[-1])) if len(at) else (None, None)
                rows.append((file, block, len(tokens), len(at), first, last, (np.diff(at) - 1).astype(np.int32)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return blocks.select("file", "block", "payload").mapInArrow(run, NOTES)


def stitch(notes: DataFrame, group: int = GROUP) -> DataFrame:
    """(file, place, tokens) of every document that a separator ends."""
    notes = notes.withColumn("part", F.expr(f"block div {int(group)}"))
    inside = Window.partitionBy("file", "part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    local = notes.withColumns({"tokens_before": before("tokens", inside), "ends_before": before("ends", inside)})
    local = local.withColumn("end_at", F.col("tokens_before") + F.col("last_end")).withColumn("end_before", F.max("end_at").over(inside))
    parts = local.groupBy("file", "part").agg(F.sum("tokens").alias("t"), F.sum("ends").alias("e"), F.max("end_at").alias("x"))
    across = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.withColumns({"token_base": before("t", across), "end_base": before("e", across)})
    bases = bases.withColumn("part_end", F.max(F.col("token_base") + F.col("x")).over(across)).drop("t", "e", "x")
    placed = local.filter("ends > 0").join(bases, ["file", "part"]).withColumn(
        "open", F.coalesce(F.col("token_base") + F.col("end_before"), "part_end", F.lit(-1))
    )
    first = F.col("token_base") + F.col("tokens_before") + F.col("first_end") - F.col("open") - 1
    lengths = F.concat(F.array(first.cast("long")), F.col("lengths").cast("array<long>"))
    return placed.select("file", (F.col("end_base") + F.col("ends_before")).alias("base"), F.posexplode(lengths).alias("pos", "tokens")).select(
        "file", (F.col("base") + F.col("pos")).alias("place"), "tokens"
    )


def token_counts(docs: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(doc_id, tokens) of every row."""
    flat = materialize(write_flat(docs, folder, vocabulary, block_tokens), "token-files")
    notes = materialize(scan(flat.filter("payload is not null")), "token-notes")
    manifest = flat.filter("payload is null").select("file", "place", F.posexplode("doc_ids").alias("pos", "doc_id"))
    manifest = manifest.select("file", (F.col("place") + F.col("pos")).alias("place"), "doc_id")
    return manifest.join(stitch(notes), ["file", "place"]).select("doc_id", "tokens")
