"""Contiguous shards of near-equal bytes from global prefix sums (DataFrame operations only).

Order: ``doc_id`` (nulls first), then size, then checksum. A document goes to the shard in
which its middle byte falls when the corpus is cut at equal byte targets, so every cut lies
within half a document of its target. Rows alike in all three are interchangeable.
Null text counts as empty (size 1, checksum 0); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import body, doc_number, prefix_sums


def shard_by_bytes(docs: DataFrame, shards: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): slot counts from 0 within each shard."""
    text = body()
    rows = docs.select(
        doc_number().alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit(1).cast("long").alias("one"),
    )
    order = [F.col("doc_id").asc_nulls_first(), F.col("size"), F.col("text_crc32")]
    placed = prefix_sums(rows, [], order, ["size", "one"], "shards")
    totals = rows.select(F.sum("size").alias("t")).first()
    total = totals["t"] or 1
    middle = f"((2 * before_size + size) * {int(shards)}L) div {2 * total}L"
    placed = placed.withColumn("shard", F.expr(f"cast(least({int(shards) - 1}L, {middle}) as int)"))
    first = placed.groupBy("shard").agg(F.min("before_one").alias("first_row"))
    return placed.join(F.broadcast(first), "shard").select(  # one row per shard
        "doc_id", "size", "text_crc32", "shard", (F.col("before_one") - F.col("first_row")).alias("slot")
    )
