"""Readers and writers of the engine's file formats, all through Spark's own sources."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.functions import text as t
from ledgerlens.operators.shared import write_shared

SIGNAL = "at string, entryId string, polarity string, source string, weight double, note string"
DOUBT = "at string, type string, kind string, key string, sessionId string, turn int, reason string, count int, action string"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Append-only ledger: blank lines are skipped, a broken line fails the read."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def append_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read_signals(spark: SparkSession, path: str) -> DataFrame:
    """Signals with a readable time; others are skipped."""
    rows = read_jsonl(spark, path, SIGNAL).withColumn("at", F.try_to_timestamp("at"))
    return rows.filter("at is not null").withColumnRenamed("entryId", "entry_id")


def read_beir(spark: SparkSession, folder: str, split: str = "test", zero_as_one: bool = True, max_queries: int | None = None) -> dict[str, DataFrame]:
    """docs, queries and qrels of a retrieval set. Only judged queries stay (the first ``max_queries`` of them); of repeated judgements the last counts; a grade of 0 or none reads as 1 unless told otherwise."""
    docs = spark.read.schema("_id string, title string, text string").json(f"{folder}/corpus.jsonl").withColumnRenamed("_id", "doc_id")
    queries = spark.read.schema("_id string, text string").json(f"{folder}/queries.jsonl").withColumnRenamed("_id", "query_id")
    raw = spark.read.csv(f"{folder}/qrels/{split}.tsv", sep="\t", header=True, schema="query_id string, doc_id string, score string")
    grade = F.try_to_number("score", F.lit("9999")).cast("double")
    grade = F.coalesce(F.when(grade != 0, grade), F.lit(1.0)) if zero_as_one else F.coalesce(grade, F.lit(1.0))
    line = F.monotonically_increasing_id()  # in the order of the file's lines, as files are read in order of their parts
    qrels = raw.withColumns({"grade": grade, "line": line}).groupBy("query_id", "doc_id").agg(F.max_by("grade", "line").alias("grade"), F.min("line").alias("line"))
    judged = qrels.groupBy("query_id").agg(F.min("line").alias("line"))
    if max_queries is not None:
        judged = judged.orderBy("line").limit(max_queries)
        qrels = qrels.join(judged.select("query_id"), "query_id", "left_semi")
    return {"docs": docs, "queries": queries.join(judged, "query_id").select(*queries.columns), "qrels": qrels.drop("line")}


def ingest_snapshots(sources: DataFrame, known: DataFrame) -> DataFrame:
    """Snapshots to append for (path, content, at): one for each new content, named by its hash, with the one it supersedes.

    ``known`` has (doc_id, path, at). Content that is already known is reused, so nothing is appended for it.
    """
    hashed = sources.withColumns({"source_hash": F.sha2("content", 256)})
    fresh = hashed.withColumn("doc_id", F.concat(F.lit("d-"), F.substring("source_hash", 1, 12))).dropDuplicates(["doc_id"])
    is_html = t.source_format(F.col("path")) == "html"
    fresh = fresh.withColumn("text", F.when(is_html, t.html_to_markdown(F.col("content"))).otherwise(F.regexp_replace("content", "\r\n?", "\n")))
    both = fresh.select("doc_id", "path", "at", F.lit(True).alias("new")).unionByName(known.select("doc_id", "path", "at", F.lit(False).alias("new")))
    first = both.groupBy("doc_id", "path").agg(F.min("at").alias("at"), F.min("new").alias("new"))
    order = Window.partitionBy("path").orderBy("at", "doc_id")
    chain = first.withColumn("supersedes", F.lag("doc_id").over(order)).filter("new").select("doc_id", "supersedes")
    lines = F.size(F.split("text", "\n"))
    return fresh.join(chain, "doc_id").select(
        "doc_id", "path", F.sha2("text", 256).alias("content_hash"), "source_hash", F.length("text").alias("size_chars"), lines.alias("line_count"), "at", "supersedes", "text"
    )


def latest_snapshots(snapshots: DataFrame) -> DataFrame:
    """The newest snapshot of each path; of equals, the least doc_id."""
    order = Window.partitionBy("path").orderBy(F.col("at").desc(), "doc_id")
    return snapshots.withColumn("rn", F.row_number().over(order)).filter("rn = 1").drop("rn")


def upsert(current: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """The rows of both, the greatest version of each key."""
    order = Window.partitionBy(key).orderBy(F.col(version).desc())
    return current.unionByName(changes).withColumn("rn", F.row_number().over(order)).filter("rn = 1").drop("rn")


RANKLOG = "v int, at string, profile string, query string, row_id long, candidates array<struct<id: string, score: double, features: map<string, double>>>"


def ranklog_tail(log: DataFrame, n: int, order: str = "row_id") -> DataFrame:
    """The last ``n`` rows of a log."""
    return log.orderBy(F.col(order).desc()).limit(n)


def read_doubts(spark: SparkSession, path: str) -> DataFrame:
    """The ledger of doubts and escalations, told apart by ``type``."""
    return read_jsonl(spark, path, DOUBT)


def replace_chunks(ledger: DataFrame, chunks: DataFrame) -> DataFrame:
    """The chunk ledger after documents were chunked anew: all old rows of these documents are gone."""
    return ledger.join(chunks.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(chunks)


def drop_chunks(ledger: DataFrame, gone: DataFrame) -> DataFrame:
    """The chunk ledger without the documents (doc_id)."""
    return ledger.join(gone.select("doc_id").distinct(), "doc_id", "left_anti")


#: Folders that a layer's documents are dealt into.
LAYER_BUCKETS = 64


def _with_bucket(rows: DataFrame) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(LAYER_BUCKETS)).cast("int"))


def write_layer(rows: DataFrame, path: str) -> None:
    """Store a layer of documents (chunks or vectors, by doc_id), in folders by a hash of the document."""
    _with_bucket(rows).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def replace_in_layer(rows: DataFrame, path: str, gone: DataFrame | None = None) -> None:
    """Put new rows of documents in place of their old ones, and drop the documents of ``gone`` (doc_id).

    Only the folders of these documents are read and written: they are staged in the shared folder, then put in place by a
    dynamic partition overwrite, which is all or nothing for each folder. A document with no rows left just goes.
    """
    spark = rows.sparkSession
    rows = write_shared(rows, "layer-rows")
    ids = rows.select("doc_id").distinct()
    ids = write_shared(ids.unionByName(gone.select("doc_id")).distinct() if gone is not None else ids, "layer-documents")
    old = spark.read.schema(_with_bucket(rows).schema).parquet(path)
    touched = _with_bucket(ids).select("bucket").distinct()
    kept = old.join(F.broadcast(touched), "bucket", "left_semi").join(ids, "doc_id", "left_anti")  # at most LAYER_BUCKETS rows
    fresh = write_shared(kept.unionByName(_with_bucket(rows)), "layer-folders")
    fresh.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    empty = touched.join(fresh.select("bucket").distinct(), "bucket", "left_anti").collect()  # at most LAYER_BUCKETS rows
    if empty:  # an overwrite leaves folders alone for which it has no rows
        root = spark._jvm.org.apache.hadoop.fs.Path(path)
        system = root.getFileSystem(spark._jsc.hadoopConfiguration())
        for r in empty:
            system.delete(spark._jvm.org.apache.hadoop.fs.Path(root, f"bucket={r['bucket']}"), True)


def write_vectors(vectors: DataFrame, path: str, version: str, dim: int) -> None:
    """Store (key, embedding) with its version; a vector of another length or a repeated key fails the write."""
    checked = F.when(F.size("embedding") == dim, F.col("embedding")).otherwise(F.raise_error(F.concat(F.lit("wrong length: "), F.col("key").cast("string"))))
    one = F.when(F.count("*").over(Window.partitionBy("key")) == 1, F.col("key")).otherwise(F.raise_error(F.concat(F.lit("repeated key: "), F.col("key").cast("string"))))
    vectors.select(one.alias("key"), checked.cast("array<float>").alias("embedding"), F.lit(version).alias("version")).write.mode("overwrite").parquet(path)


def read_vectors(spark: SparkSession, path: str, version: str, dim: int) -> DataFrame | None:
    """The stored vectors; None, which calls for a new build, where the version or a length is not the expected one."""
    rows = spark.read.parquet(path)
    bad = rows.filter((F.col("version") != version) | (F.size("embedding") != dim))
    return rows.select("key", "embedding") if bad.isEmpty() else None


def float_bytes(vector: str = "embedding"):
    """Column: a vector as little-endian 32-bit floats; ``floats`` reads them back."""

    @F.pandas_udf("binary")
    def encode(column: pd.Series) -> pd.Series:
        return column.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())

    return encode(F.col(vector))


def floats(data: str):
    @F.pandas_udf("array<float>")
    def decode(column: pd.Series) -> pd.Series:
        return column.map(lambda x: None if x is None else np.frombuffer(x, "<f4").astype(np.float32))

    return decode(F.col(data))


def roster(workspaces: DataFrame) -> DataFrame:
    """Workspaces by root, then key."""
    return workspaces.orderBy("root", "key")


def live_workspaces(workspaces: DataFrame) -> DataFrame:
    """Those that have a root which exists, and a store."""
    return roster(workspaces.filter("root <> '' and root_exists and store_exists"))
