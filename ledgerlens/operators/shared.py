"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the cluster's checkpoint folder; in a temporary one only where none is set and all runs on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='ledgerlens-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_shared(df: DataFrame, name: str) -> DataFrame:
    """Write and read back: cuts lineage and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, part): the least node of each connected part of links (u, v), by least neighbours and pointer jumping."""
    both = write_shared(links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    part = write_shared(both.groupBy(F.col("u").alias("node")).agg(F.min(F.least("u", "v")).alias("part")), "parts")
    for _ in range(rounds):
        near = both.join(part.select(F.col("node").alias("v"), "part"), "v").groupBy(F.col("u").alias("node")).agg(F.min("part").alias("near"))
        up = part.select(F.col("node").alias("part"), F.col("part").alias("up"))
        after = part.join(near, "node").join(up, "part", "left").select("node", F.least("part", "near", "up").alias("part"))
        after = write_shared(after, "parts")
        if part.join(after.select("node", F.col("part").alias("new")), "node").filter("part <> new").isEmpty():
            return after
        part = after
    raise RuntimeError("parts did not settle")
