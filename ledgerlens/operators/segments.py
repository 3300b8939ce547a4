"""An inverted index that is kept up to date: one folder a tier, in segments.

A refresh writes one more segment: postings and facts of entries that are new or changed, and marks for what changed or is gone.
No older file is touched. A search reads the postings of its words only (dealt by token into buckets, so that others
are not opened), drops those that a later mark outdates, and scores hits of several tiers under one set of statistics. A segment
counts once its statistics are there, which are written last; one whose writing broke off is written anew by the next refresh.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators import lexical
from ledgerlens.operators.index import VERSION, projection_hash
from ledgerlens.operators.shared import write_shared

BUCKETS = 64
_LENGTHS = [f"{k}_{f}" for k in ("dl", "tl") for f in lexical.FIELDS]
_FACTS = ["status", "tier", "kind", "needs_review"]


@dataclass
class Tier:
    """The segments of one folder; ``dead`` says of an entry that all its rows before a generation are outdated."""

    postings: DataFrame
    facts: DataFrame
    dead: DataFrame
    stats: DataFrame
    generation: int


def _bucket(token: str) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def _schemas(id_type: str) -> dict[str, str]:
    lengths = ", ".join(f"{c} bigint" for c in _LENGTHS)
    return {
        "postings": f"token string, id {id_type}, " + ", ".join(f"dl_{f} bigint" for f in lexical.FIELDS) + ", " + ", ".join(f"tf_{f} bigint" for f in lexical.FIELDS) + ", generation int, bucket int",
        "facts": f"id {id_type}, status string, tier string, kind string, needs_review boolean, projection string, {lengths}, generation int",
        "dead": f"id {id_type}, generation int",
    }


def _committed(spark: SparkSession, path: str) -> int:
    """The last segment whose statistics are there; 0 where none is."""
    try:
        rows = spark.read.schema("version string, generation int").parquet(f"{path}/stats").filter(F.col("version") == VERSION)
    except Exception as e:  # noqa: BLE001  only a missing folder is expected
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return 0
    return rows.agg(F.max("generation")).first()[0] or 0


def open_tier(spark: SparkSession, path: str, id_type: str = "bigint") -> Tier:
    """The tier's index as of its last whole segment; a ValueError where there is none of this version."""
    last = _committed(spark, path)
    if not last:
        raise ValueError("no index of this version")
    read = lambda name: spark.read.schema(_schemas(id_type)[name]).parquet(f"{path}/{name}").filter(F.col("generation") <= last)
    stats = spark.read.parquet(f"{path}/stats").filter(F.col("generation") == last).drop("generation", "version")
    return Tier(read("postings"), read("facts"), read("dead"), stats, last)


def _standing(rows: DataFrame, dead: DataFrame) -> DataFrame:
    """Rows that no later mark outdates."""
    marks = dead.groupBy(F.col("id").alias("dead_id")).agg(F.max("generation").alias("before"))
    return rows.join(marks, (F.col("id") == F.col("dead_id")) & (F.col("generation") < F.col("before")), "left_anti")


def stale(tier: Tier | None, entries: DataFrame) -> DataFrame:
    """(id, state): entries that are new, changed (in what the index reads or in their facts) or gone."""
    now = entries.select("id", F.struct(projection_hash().alias("projection"), *_FACTS).alias("now"))
    if tier is None:
        return now.select("id", F.lit("new").alias("state"))
    was = _standing(tier.facts, tier.dead).select("id", F.struct("projection", *_FACTS).alias("was"))
    state = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "gone").when(~F.col("was").eqNullSafe(F.col("now")), "changed")
    return was.join(now, "id", "full_outer").withColumn("state", state).filter("state is not null").select("id", "state")


def refresh(entries: DataFrame, path: str) -> DataFrame:
    """Bring a tier's index up to ``entries`` and give what was (id, state); only stale entries are read for words and written."""
    spark, kind = entries.sparkSession, dict(entries.dtypes)["id"]
    last = _committed(spark, path)
    tier = open_tier(spark, path, kind) if last else None
    changes = write_shared(stale(tier, entries), "stale")
    if last and changes.isEmpty():
        return changes
    new = last + 1
    put = lambda rows, name, *by: rows.write.mode("overwrite").partitionBy(*by).parquet(f"{path}/{name}/generation={new}") if by else rows.write.mode("overwrite").parquet(f"{path}/{name}/generation={new}")
    # a first segment takes all entries where they are; of later ones the texts meet the changes once, and only what is stale is kept
    touched = write_shared(entries.join(changes.filter("state <> 'gone'").select("id").hint("shuffle_hash"), "id", "left_semi"), "touched") if last else entries
    fields = lexical.fielded(touched)
    lengths = [f"dl_{f}" for f in lexical.FIELDS]
    postings = lexical.postings(fields.withColumns({c: F.col(c).cast("bigint") for c in lengths}), lengths).withColumn("bucket", _bucket("token"))
    put(postings.repartition("bucket").sortWithinPartitions("bucket", "token", "id"), "postings", "bucket")
    put(fields.select("id", *_FACTS, projection_hash().alias("projection"), *(F.col(c).cast("bigint").alias(c) for c in _LENGTHS)), "facts")
    put(changes.filter("state <> 'new'").select("id"), "dead")
    schemas = _schemas(kind)
    read = lambda name: spark.read.schema(schemas[name]).parquet(f"{path}/{name}").filter(F.col("generation") <= new)
    live = _standing(read("facts"), read("dead"))
    put(lexical.corpus_stats(live).withColumn("version", F.lit(VERSION)).coalesce(1), "stats")
    return changes


def search(tiers: list[Tier], queries: DataFrame, limit: int = 8, scorer: str = "bm25", frequency: str = "presence") -> DataFrame:
    """The best entries of all tiers (ids differ between tiers), as if they were one."""
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(union(parts[1:]))
    facts = union([_standing(tier.facts, tier.dead) for tier in tiers]).select("id", *_FACTS)
    stats = lexical.merge_stats(union([tier.stats for tier in tiers])).first().asDict()
    found = []
    for asked in lexical.query_blocks(queries):
        words = queries.sparkSession.createDataFrame([(w,) for w in asked.words], "token string").withColumn("bucket", _bucket("token"))
        postings = union([_standing(tier.postings.join(F.broadcast(words), ["bucket", "token"]), tier.dead) for tier in tiers])
        found.append(replace(lexical.stored_hits(postings, facts, asked), stats=stats))
    return lexical.leading(found, queries, limit, scorer, frequency)
