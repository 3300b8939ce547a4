"""Helpers that the operators share: shared scratch tables and distributed prefix sums."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only where none is set and all runs on this machine (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='ledgerlens-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def body(column: str = "text") -> Column:
    """Text with null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def doc_number(column: str = "doc_id") -> Column:
    """The id as a number; null where it is none."""
    return F.col(column).try_cast("long")


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only ``doc_id`` (null where it is no number) and ``text`` (null: empty), so that no other column can clash."""
    return docs.select(doc_number().alias("doc_id"), body().alias("text"))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores as keep it apart from the columns of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(df: DataFrame) -> list[Column]:
    """All columns, whatever signs their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def numbered(df: DataFrame) -> DataFrame:
    """The same columns under plain names c0, c1, ..., as functions over Arrow batches need them."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


#: Bits of the table by which ``sieve`` tells which rows need not move: 1,024 rows of 4 KB at most.
SIEVE_BITS = 1 << 25


def sieve(rows: DataFrame, columns: list[str], wanted: DataFrame) -> DataFrame:
    """``rows`` with a column ``hit``: false where no row of ``wanted`` has the same values in ``columns``, true where one may have.

    The values' hashes mark bits of a table of ``SIEVE_BITS``, which is broadcast: its size is bound, however many rows are wanted.
    """
    place = F.pmod(F.xxhash64(*columns), F.lit(SIEVE_BITS)) + 1
    bucket, bit = F.bitmap_bucket_number(place), F.bitmap_bit_position(place)
    marks = wanted.select(bucket.alias("sieve"), bit.alias("bit")).repartition("sieve").groupBy("sieve").agg(F.bitmap_construct_agg("bit").alias("marks"))
    octet = F.conv(F.hex(F.substring("marks", (F.col("place") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(octet, F.pmod(F.col("place"), F.lit(8)).cast("int")) == 1, F.lit(False))
    joined = rows.withColumns({"sieve": bucket, "place": bit}).join(F.broadcast(marks), "sieve", "left")
    return joined.withColumn("hit", hit).drop("sieve", "place", "marks")


def prefix_sums(df: DataFrame, group: list[str], order: list[Column], values: list[str], name: str) -> DataFrame:
    """Add ``before_<v>``: the sum of each value over the rows that sort earlier in the group.

    Rows are range-partitioned by group and order, so that one hot group spreads over many
    tasks; each partition's totals give the base of the next one, and only those totals (one
    row per partition and group) meet in one place. A base joins its rows as one more row, which
    sorts first, so the sums are made where the range partitions are. Rows that tie in ``order``
    come in any order. Group columns must not be null.
    """
    spark = df.sparkSession
    n = shuffle_partitions(spark)
    parts = materialize(df.repartitionByRange(n, *group, *order).withColumn("pid", F.spark_partition_id()), name)
    keys = [*group, "pid"]
    totals = parts.groupBy(*keys).agg(*(F.sum(v).alias(v) for v in values))
    earlier = Window.partitionBy(*group).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(*keys, *(F.sum(v).over(earlier).alias(v) for v in values), F.lit(0).alias("of_row"))
    rows = parts.withColumn("of_row", F.lit(1)).unionByName(bases, allowMissingColumns=True).repartitionById(n, F.col("pid"))
    local = Window.partitionBy(*keys).orderBy("of_row", *order).rowsBetween(Window.unboundedPreceding, -1)
    sums = {f"before_{v}": F.coalesce(F.sum(v).over(local), F.lit(0)) for v in values}
    return rows.withColumns(sums).filter("of_row = 1").drop("pid", "of_row")


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the least node of each component of links (u, v), by alternating large and small stars."""
    star = materialize(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
    seen = None
    for _ in range(rounds):
        both = star.union(star.select("v", "u")).toDF("u", "v")
        # written first, so that the join reads plain shuffles, of which Spark splits the hubs of large groups
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "stars")
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large, "stars")
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "stars")
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        star = materialize(small.select("e.u", "e.v").filter("u <> v").distinct(), "stars")
        state = star.select(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == seen:
            return star.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state
    raise RuntimeError("components did not settle")
