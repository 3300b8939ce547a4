"""The driver's tables seen as the engine's inputs: entries, queries, signals, documents and so on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions import params as p

#: The clock of every registered query.
NOW = "2024-01-31 00:00:00"
ENTRY = ["id", "title", "tags", "text", "tier", "kind", "status", "needs_review", "created_at", "last_referenced_at", "bindings", "mounted_doc", "redlines", "discarded_at", "project"]


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Knowledge entries from documents and their labels."""
    return _marked(drafts(spark, sf_dir), _labels(spark, sf_dir)).select(*ENTRY)


def marks(spark: SparkSession, sf_dir: str) -> Callable[[DataFrame], DataFrame]:
    """What adds status and discarded_at to rows made of ``drafts`` (id, ...). Such rows are small, and so are those of a label: both are dealt by id at every size."""
    labels = _labels(spark, sf_dir).hint("shuffle_hash")
    return lambda rows: _marked(rows, labels)


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")


def _marked(rows: DataFrame, labels: DataFrame) -> DataFrame:
    i = F.col("id")
    return rows.join(labels, "id", "left").withColumns({
        "status": F.when(F.col("toxic") == 1, "discarded").when(F.col("quality") == 1, "trusted").when(i % 17 == 0, "expired").when(i % 23 == 0, "superseded").otherwise("candidate"),
        "discarded_at": F.when(F.col("toxic") == 1, now() - F.make_dt_interval(days=(i % 90).cast("int"))),
    }).drop("quality", "toxic")


def drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries without what their labels say: documents alone, so that texts need not meet labels."""
    docs = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    kinds = "element_at(array('asset', 'snippet', 'pitfall', 'fact', 'decision', 'map'), cast(doc_id % 6 as int) + 1)"
    ranges = "case when doc_id % 4 = 0 then array(struct(cast(doc_id % 7 + 1 as int) as `from`, cast(doc_id % 7 + 10 as int) as `to`), struct(15 as `from`, 25 as `to`)) end"
    day = lambda n: F.make_dt_interval(days=n)
    return docs.select(
        i.alias("id"),
        F.substring(F.split_part("text", F.lit("\n"), F.lit(1)), 1, 80).alias("title"),
        F.array("lang", "source").alias("tags"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.when(i % 5 == 0, "global").otherwise("project").alias("tier"),
        F.expr(kinds).alias("kind"),
        (i % 11 == 0).alias("needs_review"),
        (now() - day((i % 120).cast("int"))).alias("created_at"),
        F.when(i % 3 == 0, now() - day((i % 40).cast("int"))).alias("last_referenced_at"),
        F.when(i % 2 == 0, F.array(F.concat(F.lit("src/mod"), (i % 50).cast("string"), F.lit(".css")))).otherwise(F.expr("cast(array() as array<string>)")).alias("bindings"),
        F.when(i % 6 == 0, F.concat(F.lit("d-"), i.cast("string"))).alias("mounted_doc"),
        F.coalesce(F.expr(ranges), F.expr("cast(array() as array<struct<`from`: int, `to`: int>>)")).alias("redlines"),
        F.concat(F.lit("p"), (i % 7).cast("string")).alias("project"),
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signal ledger from the event stream."""
    return to_signals(table(spark, sf_dir, "events"))


def to_signals(events: DataFrame) -> DataFrame:
    kind = F.create_map(*(F.lit(x) for pair in (("purchase", "human-confirm"), ("signup", "evidence-pass"), ("view", "implicit-use"), ("error", "evidence-fail"), ("click", "user-reject")) for x in pair))
    out = events.withColumn("signal", F.try_element_at(kind, F.col("event_type")))
    facts = F.create_map(*(x for k, v in p.SIGNALS.items() for x in (F.lit(k), F.struct(F.lit(v[0]).alias("polarity"), F.lit(v[1]).alias("source"), F.lit(v[2]).alias("weight")))))
    fact = F.try_element_at(facts, F.col("signal"))
    return out.filter("signal is not null").select(
        "event_id", F.col("user_id").alias("entry_id"), F.col("ts").alias("at"), "signal", fact["polarity"].alias("polarity"), fact["source"].alias("source"), fact["weight"].alias("weight")
    )


def approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approval requests from orders: open, rejected or approved."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("approval_id"),
        (F.col("o_orderkey") * 2).alias("entry_id"),
        F.lit("promote").alias("action"),
        (now() - F.make_dt_interval(days=(F.col("o_orderkey") % 70 + 1).cast("int"))).alias("created_at"),
        F.when(F.col("o_orderstatus") != "O", now() - F.make_dt_interval(days=(F.col("o_orderkey") % 70).cast("int"))).alias("resolved_at"),
        F.when(F.col("o_orderstatus") == "F", "rejected").when(F.col("o_orderstatus") == "P", "approved").alias("resolution"),
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), "turn", "role", "text")


def ranklog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each candidate of a logged retrieval."""
    e = table(spark, sf_dir, "events").filter(F.col("event_type") == "view")
    return e.select(
        F.col("event_id").alias("row_id"), F.col("ts").alias("at"), (F.col("event_id") % 97).alias("query_id"),
        F.expr("element_at(array('tool', 'pre-step', 'gate'), cast(event_id % 3 as int) + 1)").alias("profile"),
        F.col("user_id").alias("entry_id"), (F.col("value") / 100).alias("score"),
    )
