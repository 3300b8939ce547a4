"""The roster of workspaces (key, root, label, origin, state, added_at, last_seen_at) and the answers to its orphans.

Each operator gives a new snapshot of the roster. Changes name workspaces by key, one change a key; an unknown key fails.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import text as t


def _folder(root: str) -> Column:
    return F.element_at(F.split(F.col(root), "/"), -1)


def register(roster: DataFrame, seen: DataFrame) -> DataFrame:
    """The roster after sightings (key, root, label, origin, at); of a key seen twice the latest one counts.

    A listing by the registry renews all but when the workspace was added. Any other sighting renews
    root and time, and the label unless it is only the folder's name and a given one is stored.
    """
    latest = Window.partitionBy("key").orderBy(F.col("at").desc(), "root", "label")
    new = seen.withColumn("rn", F.row_number().over(latest)).filter("rn = 1").select("key", *(F.col(c).alias(f"new_{c}") for c in ("root", "label", "origin", "at")))
    rows = roster.join(new, "key", "full_outer")
    known, met, listed = F.col("added_at").isNotNull(), F.col("new_at").isNotNull(), F.col("new_origin") == "registry"
    given = (F.col("new_label") == _folder("new_root")) & (F.col("label") != _folder("root"))
    over = lambda c, when: F.when(met & when, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c)
    return rows.select(
        "key", over("root", F.lit(True)), over("label", ~known | listed | ~given), over("origin", ~known | listed),
        F.when(met & (~known | listed), "live").otherwise(F.col("state")).alias("state"), F.coalesce("added_at", "new_at").alias("added_at"), F.coalesce("new_at", "last_seen_at").alias("last_seen_at"),
    )


def _asked(roster: DataFrame, changes: DataFrame) -> DataFrame:
    """The roster with the changes' columns and ``asked``; a change of an unknown key fails."""
    rows = roster.withColumn("known", F.lit(True)).join(changes.withColumn("asked", F.lit(True)), "key", "full_outer")
    fail = F.raise_error(F.concat(F.lit("no such workspace: "), F.col("key").cast("string")))
    return rows.withColumn("asked", F.when(F.col("known"), F.coalesce("asked", F.lit(False))).otherwise(fail.cast("boolean"))).drop("known")


def rename(roster: DataFrame, labels: DataFrame, now: Column) -> DataFrame:
    """The roster after changes (key, new_label); a blank label fails."""
    rows = _asked(roster, labels.select("key", "new_label"))
    given = F.when(F.trim(F.coalesce("new_label", F.lit(""))) == "", F.raise_error(F.lit("a label may not be blank"))).otherwise(F.trim("new_label"))
    return rows.withColumns({"label": F.when(F.col("asked"), given).otherwise(F.col("label")), "last_seen_at": F.when(F.col("asked"), now).otherwise(F.col("last_seen_at"))}).drop("asked", "new_label")


def remove(roster: DataFrame, keys: DataFrame) -> DataFrame:
    """The roster without rows (key); what a workspace stores is left alone."""
    return _asked(roster, keys.select("key").distinct()).filter("not asked").drop("asked")


def keep(roster: DataFrame, keys: DataFrame) -> DataFrame:
    """The roster after orphans (key) were answered with: keep it."""
    return _asked(roster, keys.select("key").distinct()).withColumn("state", F.when(F.col("asked"), "kept").otherwise(F.col("state"))).drop("asked")


#: What a workspace stores, as folders of the home.
STORED = ("kb", "baselines")


def purge(roster: DataFrame, keys: DataFrame, stored: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(roster, moves (key, kind, from, to)) after orphans (key) were answered with: delete it.

    Nothing is deleted: each folder that is there, by ``stored`` (key, kind), is to move into one trash
    folder of this time, and the row is kept with ``purged_at``. A workspace that is no orphan fails.
    """
    rows = _asked(roster, keys.select("key").distinct())
    orphan = F.when(F.col("state") == "orphaned", "kept").otherwise(F.raise_error(F.concat(F.lit("no orphan: "), F.col("key").cast("string"))))
    old = F.col("purged_at") if "purged_at" in roster.columns else F.lit(None).cast("timestamp_ntz")
    after = rows.withColumns({"state": F.when(F.col("asked"), orphan).otherwise(F.col("state")), "purged_at": F.when(F.col("asked"), now).otherwise(old)}).drop("asked")
    name = F.col("key").cast("string")
    trash = F.concat(F.lit("trash/"), F.date_format(now, "yyyy-MM-dd'T'HH-mm-ss"), F.lit("/"), name, F.lit("/"), "kind")
    pieces = stored.filter(F.col("kind").isin(*STORED)).join(rows.filter("asked and state = 'orphaned'").select("key"), "key")
    return after, pieces.select("key", "kind", F.concat_ws("/", "kind", name).alias("from"), trash.alias("to"))


def find(roster: DataFrame, names: DataFrame) -> DataFrame:
    """(name, key) of names that are a key, else a root in any spelling."""
    asked = names.select("name").distinct().withColumn("root", F.regexp_replace(t.posix_path(F.col("name")), "(?<=.)/+$", ""))
    by_key = asked.join(roster.select(F.col("key").cast("string").alias("name"), F.col("key").alias("own")), "name", "left")
    by_root = roster.groupBy(F.regexp_replace(t.posix_path(F.col("root")), "(?<=.)/+$", "").alias("root")).agg(F.min("key").alias("rooted"))
    return by_key.join(by_root, "root", "left").select("name", F.coalesce("own", "rooted").alias("key")).filter("key is not null")


def panel(roster: DataFrame) -> DataFrame:
    """The rows that the panel shows: live ones of the registry, then orphans that wait for an answer."""
    shown = F.when((F.col("origin") == "registry") & (F.col("state") == "live"), 0).when(F.col("state") == "orphaned", 1)
    return roster.withColumn("place", shown).filter("place is not null").orderBy("place", "label", "key")
