"""The inverted index as tables: postings sorted by token, facts of the entries, and corpus statistics.

Postings carry what scoring needs of an entry, so a search reads the row groups of its tokens
and nothing else. Tables carry a version and a fingerprint of the entries they were built from.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions import params as p
from ledgerlens.functions import text as t
from ledgerlens.operators import lexical

VERSION = f"lexical-v1:k1={p.K1:g}:b={p.B:g}"


@dataclass
class Index:
    postings: DataFrame
    facts: DataFrame
    stats: DataFrame


def projection_hash() -> Column:
    """What of an entry the index depends on, in 16 characters."""
    parts = ["title", F.array_join("tags", " "), t.redline(F.col("text"), F.col("redlines"))]
    return F.substring(F.sha2(F.concat_ws("\x00", *parts), 256), 1, 16)


def fingerprint(entries: DataFrame) -> DataFrame:
    """One row, the same for the same entries in any order: a sum of 60-bit hashes and a count."""
    h = F.conv(F.substring(F.sha2(F.concat_ws("\x00", F.col("id").cast("string"), projection_hash()), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return entries.agg(F.coalesce(F.sum(h), F.lit(0).cast("decimal(38,0)")).cast("string").alias("fingerprint"), F.count("*").alias("entries"))


def write_index(entries: DataFrame, path: str, identifiers: bool = False) -> None:
    fields = lexical.fielded(entries, identifiers)
    lengths = [f"dl_{f}" for f in lexical.FIELDS]
    postings = lexical.postings(fields, lengths)
    postings.repartitionByRange("token").sortWithinPartitions("token", "id").write.mode("overwrite").parquet(f"{path}/postings")
    entries.select("id", "status", "tier", "kind", "needs_review", projection_hash().alias("projection")).write.mode("overwrite").parquet(f"{path}/facts")
    mark = fingerprint(entries)
    lexical.corpus_stats(fields).crossJoin(mark).withColumn("version", F.lit(VERSION)).coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")


def read_index(spark: SparkSession, path: str) -> Index:
    """The index, or a ValueError if it was built by another version."""
    stats = spark.read.parquet(f"{path}/stats")
    if stats.filter(F.col("version") != VERSION).count():
        raise ValueError("the index was built by another version")
    return Index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/facts"), stats)


def is_current(index: Index, entries: DataFrame) -> bool:
    return index.stats.select("fingerprint", "entries").first() == fingerprint(entries).first()


def stale(index: Index, entries: DataFrame) -> DataFrame:
    """(id, state) of entries that are new, changed or gone since the index was built."""
    now = entries.select("id", projection_hash().alias("now"))
    both = index.facts.select("id", F.col("projection").alias("was")).join(now, "id", "full_outer")
    state = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "gone").when(F.col("was") != F.col("now"), "changed")
    return both.withColumn("state", state).filter("state is not null").select("id", "state")


def search(index: Index, queries: DataFrame, limit: int = 8, scorer: str = "bm25", frequency: str = "presence") -> DataFrame:
    stats = index.stats.drop("fingerprint", "entries", "version").first().asDict()
    found = [replace(lexical.stored_hits(index.postings, index.facts, asked), stats=stats) for asked in lexical.query_blocks(queries)]
    return lexical.leading(found, queries, limit, scorer, frequency)
