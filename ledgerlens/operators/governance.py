"""Signals, lifecycle, approvals, attribution and clustering of knowledge."""

from __future__ import annotations

import heapq
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import params as p
from ledgerlens.functions import text as t
from ledgerlens.operators.shared import components, write_shared


def window_scores(signals: DataFrame, now: Column, days: int = p.WINDOW_DAYS) -> DataFrame:
    """(entry_id, window_score, n, positive, negative, last_at) over signals from ``days`` ago on; the start counts, later rows too."""
    w = F.col("weight")
    return signals.filter(F.col("at") >= now - F.make_dt_interval(days=F.lit(days))).groupBy("entry_id").agg(
        F.sum("weight").alias("window_score"), F.count("*").alias("n"), F.sum(F.when(w >= 0, w).otherwise(0.0)).alias("positive"), F.sum(F.when(w < 0, w).otherwise(0.0)).alias("negative"), F.max("at").alias("last_at")
    )


def edges(spark) -> DataFrame:
    return spark.createDataFrame(p.EDGES, "from_status string, to_status string, trigger string")


def transition(entries: DataFrame, changes: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Apply (id, to_status, trigger, reason) and return (entries after, refused changes).

    A legal change sets the status, notes it in ``history`` and keeps ``discarded_at`` only for
    discarded entries. One change for each entry.
    """
    table = edges(entries.sparkSession).withColumn("legal", F.lit(True))
    asked = entries.select("id", F.col("status").alias("from_status")).join(changes, "id").join(F.broadcast(table), ["from_status", "to_status", "trigger"], "left")  # 14 rows
    refused = asked.filter("legal is null").drop("legal")
    legal = asked.filter("legal").select("id", "to_status", F.concat_ws(": ", "trigger", "reason").alias("why"))
    moved = F.col("to_status").isNotNull()
    event = F.struct(now.alias("at"), F.lit("status").alias("change"), F.col("status").alias("from_"), F.col("to_status").alias("to"), F.col("why").alias("reason"))
    past = F.col("history") if "history" in entries.columns else F.expr("cast(array() as array<struct<at: timestamp_ntz, change: string, from_: string, `to`: string, reason: string>>)")
    after = entries.join(legal, "id", "left").withColumns({
        "history": F.when(moved, F.concat(past, F.array(event))).otherwise(past),
        "discarded_at": F.when(moved, F.when(F.col("to_status") == "discarded", now)).otherwise(F.col("discarded_at")),
        "status": F.coalesce("to_status", "status"),
    }).drop("to_status", "why")
    return after, refused


def sweep(entries: DataFrame, scores: DataFrame, now: Column) -> DataFrame:
    """(id, from_status, action): discarded, expired or purged. At most one for each entry; superseded ones stay."""
    rows = entries.join(scores.select(F.col("entry_id").alias("id"), "window_score"), "id", "left")
    score = F.coalesce("window_score", F.lit(0.0))
    idle = F.coalesce("last_referenced_at", "created_at") < now - F.make_dt_interval(days=F.lit(p.EXPIRE_AFTER_DAYS))
    old = F.col("discarded_at") < now - F.make_dt_interval(days=F.lit(p.DISCARD_RETENTION_DAYS))
    status = F.col("status")
    action = (
        F.when(status.isin("candidate", "trusted", "expired") & (score <= p.DISCARD_THRESHOLD), "discarded")
        .when(status.isin("candidate", "trusted") & idle, "expired")
        .when((status == "discarded") & old, "purged")
    )
    return rows.withColumn("action", action).filter("action is not null").select("id", F.col("status").alias("from_status"), "action")


def promotions(entries: DataFrame, scores: DataFrame, approvals: DataFrame, now: Column) -> DataFrame:
    """(id, window_score) of candidates trusted by their score, without a pending request or a recent refusal."""
    promote = approvals.filter("action = 'promote'")
    pending = promote.filter("resolved_at is null").select(F.col("entry_id").alias("id"))
    refused = promote.filter((F.col("resolution") == "rejected") & (F.col("resolved_at") > now - F.make_dt_interval(days=F.lit(p.REJECTION_DAYS)))).select(F.col("entry_id").alias("id"))
    rows = entries.filter("status = 'candidate'").join(scores.select(F.col("entry_id").alias("id"), "window_score"), "id").filter(F.col("window_score") >= p.TRUST_THRESHOLD)
    return rows.join(pending, "id", "left_anti").join(refused, "id", "left_anti").select("id", "window_score")


def failure_streaks(signals: DataFrame) -> DataFrame:
    """(entry_id, streak): evidence failures at the end of each entry's ledger, without a break."""
    w = Window.partitionBy("entry_id").orderBy(F.col("at").desc(), F.col("event_id").desc())
    failed = (F.col("source") == "evidence") & (F.col("polarity") == "negative")
    rows = signals.withColumn("rn", F.row_number().over(w))
    return rows.groupBy("entry_id").agg((F.coalesce(F.min(F.when(~failed, F.col("rn"))), F.count("*") + 1) - 1).alias("streak"))


def open_doubts(ledger: DataFrame) -> DataFrame:
    """(kind, key, open): doubts since each key's last escalation; keys without any are left out."""
    after = F.when(F.col("type") == "escalated", F.col("seq"))
    last = ledger.groupBy("kind", "key").agg(F.max(after).alias("last"))
    rows = ledger.join(last, ["kind", "key"]).filter((F.col("type") == "doubt") & (F.col("last").isNull() | (F.col("seq") > F.col("last"))))
    return rows.groupBy("kind", "key").agg(F.count("*").alias("open"))


def split_entries(entries: DataFrame, drafts: DataFrame, now: Column) -> DataFrame:
    """Entries after splits (id, part, title, text): the old one is superseded, parts are new candidates that inherit no governance."""
    new = entries.drop("title", "text").join(drafts.select("id", "part", "title", "text"), "id").withColumns({
        "id": F.concat_ws("-", F.col("id").cast("string"), F.col("part").cast("string")), "status": F.lit("candidate"), "needs_review": F.lit(False),
        "created_at": now, "last_referenced_at": F.lit(None).cast("timestamp_ntz"), "discarded_at": F.lit(None).cast("timestamp_ntz"), "redlines": F.expr("cast(array() as array<struct<`from`: int, `to`: int>>)"),
    }).drop("part")
    gone = drafts.select("id").distinct().withColumn("split", F.lit(True))
    old = entries.join(gone, "id", "left").withColumn("status", F.when(F.col("split") & (F.col("status") != "discarded"), "superseded").otherwise(F.col("status"))).drop("split")
    return old.withColumn("id", F.col("id").cast("string")).unionByName(new)


def annotations() -> Column:
    """What a reader must know of an entry, in order."""
    notes = F.array(
        F.when(F.col("status") == "expired", "expired and unreviewed: not a basis for a write"),
        F.when(F.col("status") == "candidate", "candidate: not yet approved"),
        F.when(F.col("status") == "superseded", "superseded by a split"),
        F.when(F.col("needs_review"), "needs review"),
        F.when(F.col("tier") == "global", "from the global tier"),
        F.when(F.col("mounted_doc").isNotNull(), "has a document layer"),
        F.when(F.size("redlines") > 0, F.format_string("%d ranges redlined", F.size("redlines"))),
    )
    return F.filter(notes, lambda x: x.isNotNull())


def classify(changes: DataFrame, extensions: list[str], prefixes: list[str]) -> DataFrame:
    """Add ``file`` (normalised) and ``renderable`` to changes (path)."""
    file = t.posix_path(F.col("path"))
    low = F.lower(file)
    hit = F.lit(False)
    for e in extensions:
        hit = hit | low.endswith(e.lower() if e.startswith(".") else f".{e.lower()}")
    for x in prefixes:
        hit = hit | low.startswith(x.lower())
    return changes.withColumns({"file": file, "renderable": hit})


def attribute(referenced: DataFrame, outcomes: DataFrame, changed: DataFrame) -> DataFrame:
    """(worklog, id, verdict) of references (worklog, id, tier, bindings, mode): pass, fail or unattributed.

    ``outcomes``: (worklog, exit_ok); ``changed``: (worklog, file). A failure is an entry's own if a file it is
    bound to changed, or if it is global and was cited.
    """
    files = changed.groupBy("worklog").agg(F.collect_set("file").alias("files"))
    rows = referenced.join(outcomes, "worklog").join(files, "worklog", "left")
    involved = F.coalesce(F.arrays_overlap(F.transform("bindings", t.posix_path), "files"), F.lit(False))
    cited = (F.col("tier") == "global") & (F.col("mode") == "cited")
    return rows.select("worklog", "id", F.when(F.col("exit_ok"), "pass").when(involved | cited, "fail").otherwise("unattributed").alias("verdict"))


def similar_pairs(entries: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of entries of different projects, a < b: overlap of title tokens or of all tokens."""
    found = similar_across(entries, entries, threshold).filter("a <> b").filter("project_a <> project_b")
    pair = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")
    return pair.groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def _token_sets(entries: DataFrame, *keep: str) -> DataFrame:
    """(id, project, of, tokens, n) of entries, or other columns to keep: title tokens (of = 0) and all tokens (1); empty sets are similar to none."""
    tokens = F.posexplode(F.array(t.tokenize(F.col("title")), t.tokenize(F.concat_ws(" ", "title", "text")))).alias("of", "tokens")
    return entries.select(*(keep or ("id", "project")), tokens).withColumn("n", F.size("tokens")).filter("n > 0")


def similar_across(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(a, b, project_a, project_b, similarity), a of ``left`` and b of ``right``, whose overlap reaches the threshold; pairs may repeat."""
    named = lambda rows, side: _token_sets(rows).select(F.struct("id", "project").alias(side), "of", "tokens", "n").distinct()
    a, b = named(left, "a"), named(right, "b")
    both = _subsets_meet(a, "a", b, "b", threshold).unionByName(_subsets_meet(b, "b", a, "a", threshold))
    return both.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.col("a.project").alias("project_a"), F.col("b.project").alias("project_b"), "similarity")


def _subsets_meet(small: DataFrame, side: str, large: DataFrame, other: str, threshold: float) -> DataFrame:
    """(side, other, similarity) of sets (side, of, tokens, n) with sets of at least their size (other, of, tokens, n) whose overlap reaches the threshold.

    The smaller of two such sets has one of its n - ceil(threshold n) + 1 rarest tokens in the other, so
    these alone probe the index of all tokens. Frequent tokens come last and hardly ever probe.
    """
    counts = small.unionByName(large.withColumnRenamed(other, side)).select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("times"))
    key = [side, "of", "tokens", "n"]
    order = small.select(*key, F.explode("tokens").alias("token")).join(counts, "token").groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("times", "token"))).alias("order"))
    most = (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).cast("int")
    n = int(small.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few rows make many pairs: their tasks are not to be joined by their size
    probes = order.select(*key, F.explode(F.transform(F.slice("order", F.lit(1), most), lambda x: x["token"])).alias("token"))
    index = large.select(other, "of", F.col("tokens").alias("theirs"), F.col("n").alias("m"), F.explode("tokens").alias("token"))
    found = probes.repartition(n, "token", "of").join(index.repartition(n, "token", "of"), ["token", "of"]).filter("n <= m").select(side, other, t.overlap(F.col("tokens"), F.col("theirs")).alias("similarity"))
    return found.filter(F.col("similarity") >= threshold)


def similar_sets(entries: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(members (id, project, of, set), links (of, a, b, similarity)): what :func:`similar_pairs` finds, without a pair for each two entries.

    Entries with equal title tokens share one set (of = 0), so do entries with equal tokens at all (of = 1); a set is named by its
    least id. Links, a <= b, join sets whose overlap reaches the threshold if they hold entries of different
    projects; a = b says so of the entries of one set. Two entries of different projects are similar if their sets of either
    kind are linked. Entries without a project are left out. An empty table gives empty results.
    """
    filled = lambda c: F.coalesce(c, F.lit("")).alias(c)
    rows = entries.filter("project is not null").select("id", "project", filled("title"), filled("text"))
    texts = rows.groupBy("title", "text").agg(F.min("id").alias("id"), F.min("project").alias("low"), F.max("project").alias("high"))
    told = write_shared(_token_sets(texts, "title", "text", "id", "low", "high"), "texts")  # equal texts are taken apart once
    known = told.groupBy("of", "tokens", "n").agg(F.min("id").alias("set"), F.min("low").alias("low"), F.max("high").alias("high"))
    known = write_shared(known, "token-sets")
    keys = told.join(known.select("of", "tokens", "set"), ["of", "tokens"]).groupBy("title", "text").agg(F.collect_list(F.struct("of", "set")).alias("keys"))
    members = write_shared(rows.join(keys, ["title", "text"]).select("id", "project", F.inline("keys")).distinct(), "members")
    side = lambda name: known.select(F.struct("of", "set", "low", "high").alias(name), "of", "tokens", "n")
    found = _subsets_meet(side("a"), "a", side("b"), "b", threshold)
    several = F.least("a.low", "b.low") != F.greatest("a.high", "b.high")
    links = found.filter(several).groupBy(F.col("a.of").alias("of"), F.least("a.set", "b.set").alias("a"), F.greatest("a.set", "b.set").alias("b")).agg(F.max("similarity").alias("similarity"))
    return members, write_shared(links, "set-links")


def link_counts(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id, of, set, links): to how many entries of other projects each entry is linked, by sums over sets; never by pairs of entries."""
    sizes = members.groupBy("of", "set", "project").agg(F.count("*").alias("n"))
    near = links.select("of", F.col("a").alias("to"), F.col("b").alias("set")).unionByName(links.filter("a <> b").select("of", F.col("b").alias("to"), F.col("a").alias("set")))
    reach = write_shared(near.join(sizes, ["of", "set"]).groupBy("of", F.col("to").alias("set"), "project").agg(F.sum("n").alias("n")), "reach")
    every = reach.groupBy("of", "set").agg(F.sum("n").alias("every"))
    rows = members.join(every, ["of", "set"], "left").join(reach.withColumnRenamed("n", "own"), ["of", "set", "project"], "left")
    return rows.select("id", "of", "set", (F.coalesce("every", F.lit(0)) - F.coalesce("own", F.lit(0))).alias("links"))


def proposals(verified: DataFrame, clustered: DataFrame, common: DataFrame, threshold: float) -> DataFrame:
    """(cluster, id, title, tags, sources): a draft for each cluster of several projects, from its strongest entry.

    ``verified``: id, project, title, text, tags, score; ``clustered``: (id, cluster). Tags are the members' union.
    Clusters whose strongest entry is similar to a candidate or trusted entry of ``common`` are left out.
    """
    members = clustered.select("id", "cluster").join(verified, "id")
    strongest = Window.partitionBy("cluster").orderBy(F.col("score").desc(), "id")
    best = members.withColumn("rn", F.row_number().over(strongest)).filter("rn = 1").drop("rn")
    known = common.filter(F.col("status").isin("candidate", "trusted")).select("id", F.lit("").alias("project"), "title", "text")
    taken = similar_across(best.select("id", "project", "title", "text"), known, threshold).select(F.col("a").alias("id")).distinct()
    tags = members.groupBy("cluster").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("all_tags"), F.count("*").alias("sources"))
    return best.join(taken, "id", "left_anti").join(tags, "cluster").select("cluster", "id", "title", F.col("all_tags").alias("tags"), "sources")


def streak_flags(entries: DataFrame, streaks: DataFrame, least: int = p.FAILURE_STREAK) -> DataFrame:
    """(id, streak, raised) of global entries whose failures at the end of the ledger reach ``least``; raised where the flag is new."""
    rows = entries.filter("tier = 'global'").join(streaks.select(F.col("entry_id").alias("id"), "streak"), "id")
    return rows.filter(F.col("streak") >= least).select("id", "streak", (~F.col("needs_review")).alias("raised"))


def escalated_keys(ledger: DataFrame, kind: str = "module") -> DataFrame:
    """(key) of everything of a kind that was ever escalated."""
    return ledger.filter((F.col("type") == "escalated") & (F.col("kind") == kind)).select("key").distinct()


def escalate(ledger: DataFrame, threshold: int = p.DOUBT_THRESHOLD) -> DataFrame:
    """(kind, key, open, action) of keys whose open doubts reach the threshold: a module is inspected from then on, an entry gets a rejection."""
    rows = open_doubts(ledger).filter(F.col("open") >= threshold)
    return rows.withColumn("action", F.when(F.col("kind") == "module", "inspect").otherwise("user-reject"))


def new_dislikes(polls: DataFrame) -> DataFrame:
    """(session_id, message_id, poll) of negative ratings whose version differs from what the poll before saw of the message."""
    seen = F.lag("version").over(Window.partitionBy("session_id", "message_id").orderBy("poll"))
    rows = polls.withColumn("fresh", ~seen.eqNullSafe(F.col("version")))
    return rows.filter("fresh and rating = 'negative'").select("session_id", "message_id", "poll")


def clusters(verified: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, project, cluster) of :func:`set_clusters` for similar pairs (a, b) of entries: each entry is a set of its own."""
    ends = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    members = verified.join(ends, "id").select("id", "project", F.lit(0).alias("of"), F.col("id").alias("set"))
    return set_clusters(members, pairs.select(F.lit(0).alias("of"), "a", "b"))


def set_clusters(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id, project, cluster): greedy growth over linked sets (of, a, b) of members (id, project, of, set), at most one entry of a project in a cluster.

    The result depends on the order of entries (by id), but only inside a connected part of the
    links. Parts are found on Spark from the different lists of sets that entries have, and grown side by side; a task gets the ids of one part,
    as arrays of entries alike in sets and project, and the links of its sets, never pairs of entries. Rows of a repeated id are one entry.
    """
    name = lambda kind, of_set: F.struct(F.col(kind).alias("of"), F.col(of_set).alias("set"))
    linked = links.select(name("of", "a").alias("u"), name("of", "b").alias("v"))
    live = linked.select("u").union(linked.select("v")).distinct().select(F.col("u").alias("key"))
    held = members.select("id", "project", name("of", "set").alias("key")).join(live, "key")
    entries = held.groupBy("id").agg(F.min("project").alias("project"), F.array_sort(F.collect_set("key")).alias("keys"))
    alike = entries.groupBy("project", "keys", F.shiftright("id", _ALIKE)).agg(F.collect_list(F.col("id").cast("long")).alias("ids"))
    alike = write_shared(alike.select("project", "keys", "ids"), "alike")
    together = alike.select(F.col("keys")[0].alias("u"), F.explode("keys").alias("v")).distinct()
    part = components(linked.unionByName(together)).select(F.col("node").alias("key"), "part")
    near = linked.union(linked.select("v", "u")).distinct().groupBy(F.col("u").alias("key")).agg(F.collect_list("v").alias("near"))
    rows = alike.withColumn("key", F.col("keys")[0]).unionByName(near.withColumn("keys", F.array("key")), allowMissingColumns=True)
    return rows.join(part, "key").select("part", "project", "keys", "ids", "near").groupBy("part").applyInArrow(_grow_part, "id long, project string, cluster long")


#: Ids that share all but so many low bits may lie in one array: it has four million numbers at most.
_ALIKE = 22
#: So many free entries for each set that may still give one are looked at in their order before the sets are searched: a matter of speed only.
_NEXT = 1024
#: Free entries looked at in their order at once, at first and at most, and how many lie ready for that.
_LOOK, _LOOK_MOST, _READY = 256, 8192, 1 << 15


def _grow_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The clusters of one part: rows of entries alike (project, keys, ids), and of sets (keys) with their linked sets (near)."""
    names, ids, counts, projects, keys, sizes, sets, near, degrees = {}, [], [], [], [], [], [], [], []
    flat = lambda x: np.rec.fromarrays([x.flatten().field(c).to_numpy() for c in ("of", "set")], names="of,set")
    for b in batches:
        linked = b.column("near").is_valid()
        e, s = b.filter(pc.invert(linked)), b.filter(linked)
        sets.append(flat(s.column("keys")))
        near.append(flat(s.column("near")))
        degrees.append(s.column("near").value_lengths().to_numpy())
        of_project = e.column("project").dictionary_encode("encode")
        projects.append(np.array([names.setdefault(x, len(names)) for x in of_project.dictionary.to_pylist()], "int32")[of_project.indices.to_numpy()])
        keys.append(flat(e.column("keys")))
        sizes.append(e.column("keys").value_lengths().to_numpy())
        ids.append(e.column("ids").flatten().to_numpy())
        counts.append(e.column("ids").value_lengths().to_numpy())
    sets, project, sizes, ids, counts = (np.concatenate(x) for x in (sets, projects, sizes, ids, counts))
    if not len(ids):
        return
    order = np.lexsort((sets["set"], sets["of"]))
    known = {of: (at, sets["set"][order[at : at + n]]) for of, at, n in zip(*np.unique(sets["of"][order], return_index=True, return_counts=True))}

    def number(x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x), "int64")
        for of, (at, of_kind) in known.items():
            here = x["of"] == of
            out[here] = at + np.searchsorted(of_kind, x["set"][here])
        return out

    near = np.split(np.concatenate([number(x) for x in near]), np.cumsum(np.concatenate(degrees))[:-1])
    two, near = _two_sets(np.concatenate([number(x) for x in keys]), sizes, [near[i] for i in order])
    by_id = np.argsort(ids)
    ids, alike = ids[by_id], np.repeat(np.arange(len(counts), dtype="int32"), counts)[by_id]
    del by_id
    project = project[alike]
    cluster = _greedy(two[:, alike], near, project)
    found, names = np.flatnonzero(cluster >= 0), pa.array(list(names), pa.string())
    for at in range(0, len(found), 1 << 16):
        x = found[at : at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(ids[x]), names.take(pa.array(project[x])), pa.array(ids[cluster[x]])], ["id", "project", "cluster"])


def _grow(frame: pd.DataFrame) -> pd.DataFrame:
    """:func:`_grow_part` of a frame: rows of members (id, project) of sets (of, set), and of sets with their linked sets (near)."""
    linked = frame["near"].notna()
    frame = frame.assign(keys=[{"of": of, "set": s} for of, s in zip(frame["of"], frame["set"])])
    entries = frame[~linked].groupby("id").agg({"project": "first", "keys": list}).reset_index().astype({"id": "int64"})
    entries["ids"] = [[i] for i in entries.pop("id")]
    sets = frame.loc[linked, ["keys", "near"]].assign(keys=[[k] for k in frame.loc[linked, "keys"]])
    pairs = pa.list_(pa.struct([("of", pa.int32()), ("set", pa.int64())]))
    schema = pa.schema([("project", pa.string()), ("keys", pairs), ("ids", pa.list_(pa.int64())), ("near", pairs)])
    rows = pa.concat_tables(pa.Table.from_pylist(x.to_dict("records"), schema) for x in (entries, sets)).to_batches()
    return pd.concat([x.to_pandas() for x in _grow_part(iter(rows))], ignore_index=True)


def _two_sets(keys: np.ndarray, sizes: np.ndarray, near: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Two sets (none: the number of sets) for each list of ``keys``, of which they have ``sizes``, and the linked sets of each set.

    A list of more sets (of a repeated id) gets one that stands for all of them and is linked to what they are linked to.
    """
    begin, joint = np.cumsum(sizes) - sizes, {}
    more = {i: tuple(keys[begin[i] : begin[i] + sizes[i]].tolist()) for i in np.flatnonzero(sizes > 2)}
    for mine in dict.fromkeys(more.values()):
        z = joint[mine] = len(near)
        ends = np.unique(np.concatenate([near[k] for k in mine]))
        for s in ends:
            near[s] = np.append(near[s], z)
        near.append(np.append(ends, z) if np.isin(mine, ends).any() else ends)
    two = np.full((2, len(sizes)), len(near), "int32")
    two[0], two[1, sizes == 2] = keys[begin], keys[begin[sizes == 2] + 1]
    for i, mine in more.items():
        two[0, i] = joint[mine]
    return two, near


def _greedy(keys: np.ndarray, near: list[np.ndarray], project: np.ndarray) -> np.ndarray:
    """The first entry of each entry's cluster, -1 for those alone; entries in order with two sets each (``keys``), ``near``: what each set is linked to.

    A cluster passes over the free entries behind its seed and takes what is linked to a member and of a new project, until a pass takes none.
    Free entries lie ready in their order and are looked at in growing stretches. Farther ones are sought in the cells of linked sets: a cell is
    a set's entries of one project; ``alive`` has the projects whose cells in a set may hold free ones (as bits, those 64 apart share one).
    """
    n, none, projects, near = len(project), len(near), int(project.max()) + 1, [*near, np.empty(0, "int64")]
    cluster, taken, linked, wanted = np.full(n, -1, "int32"), np.zeros(n, bool), np.zeros(none + 1, bool), np.ones(projects, bool)
    places = np.concatenate([np.flatnonzero(k < none) for k in keys]).astype("int32")
    cell = np.concatenate([k[k < none] for k in keys]).astype("int64") * projects + project[places]
    order = np.lexsort((places, cell))
    places, cell = array("i", places[order].tobytes()), cell[order]
    begin = np.flatnonzero(np.diff(cell, prepend=-1))
    cell_set, cell_project = np.divmod(cell[begin], projects)
    del cell, order
    bit = np.uint64(1) << (np.arange(projects) % 64).astype("uint64")
    alive, cells = np.zeros(none, "uint64"), np.searchsorted(cell_set, np.arange(none + 1)).tolist()
    np.bitwise_or.at(alive, cell_set, bit[cell_project])
    begin, cell_project, filled = [*begin.tolist(), len(places)], cell_project.tolist(), {}
    skip = array("i", range(len(places) + 1))

    def free(c: int, behind: int) -> int | None:
        """The first free entry of a cell behind a place; taken ones are passed once, later searches jump over them."""
        at, end = bisect_right(places, behind, begin[c], begin[c + 1]), begin[c + 1]
        while True:
            while skip[at] != at:
                skip[at] = at = skip[skip[at]]
            if at >= end:
                return None
            if not taken[places[at]]:
                return places[at]
            skip[at] = at + 1

    def firsts(sets: np.ndarray, behind: int, known: set[int]) -> list[tuple[int, int]]:
        """The first free entry behind a place in each cell of a wanted project that is not yet known; empty cells are left out from then on."""
        found = []
        for s in dict.fromkeys(sets.tolist()):
            mine = filled.get(s, range(cells[s], cells[s + 1]))
            asked = [c for c in mine if wanted[cell_project[c]] and c not in known]
            empty = {c for c in asked if free(c, -1) is None}
            if empty:
                filled[s] = [c for c in mine if c not in empty]
                alive[s] = np.bitwise_or.reduce(bit[[cell_project[c] for c in filled[s]]])
            here = [(i, c) for c in asked if c not in empty and (i := free(c, behind)) is not None]
            known.update(c for _, c in here)
            found += here
        return found

    def load(at: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
        """Free entries that lie ready, their sets and projects, with so many more that they are ``least``."""
        nonlocal ahead
        while ahead < n and len(at) < least:
            more = np.arange(ahead, min(n, ahead + _READY))
            at, ahead = np.concatenate([at, more[~taken[more]]]), ahead + len(more)
        two = keys[:, at].astype("int64")
        two[:, taken[at]] = none
        return at, two[0], two[1], project[at].astype("int64")

    def take(i: int, s: int, t: int) -> None:
        taken[i] = True
        members.append(i)
        for a in (near[s], near[t]):
            linked[a] = True
            ends.append(a)

    def still(since: int) -> np.ndarray:
        """The linked sets, of members since one, that may have free entries of wanted projects."""
        sets = np.concatenate(ends[since:])
        return sets[(alive[sets] & np.bitwise_or.reduce(bit[wanted])) != 0]

    ahead = head = gone = 0
    at, one, two, of = load(np.empty(0, "int64"), _READY)
    while True:
        if head == len(at) or 4 * gone > len(at):
            head, gone = 0, 0
            at, one, two, of = load(at[~taken[at]], _READY)
            if not len(at):
                return cluster
        passed = taken[at[head : head + 64]]
        x = int(passed.argmin())
        if passed[x]:
            head += len(passed)
            continue
        head += x
        seed, members, ends, grew = int(at[head]), [], [], True
        take(seed, one[head], two[head])
        wanted[of[head]] = False
        one[head] = two[head] = none
        while grew and len(members) < projects:  # a pass; what it leaves behind it waits for the next one
            size, x, seen, patience, stretch = len(members), head + 1, 0, _NEXT, _LOOK
            while len(members) < projects:
                if seen >= patience:
                    sets = still(0)
                    patience = _NEXT * len(sets)
                    if seen >= patience:
                        known = set()
                        heap = firsts(sets, int(at[x - 1]), known)
                        heapq.heapify(heap)
                        while heap and len(members) < projects:
                            i, c = heapq.heappop(heap)
                            if wanted[cell_project[c]]:
                                since = len(ends)
                                take(i, keys[0, i], keys[1, i])
                                wanted[project[i]] = False
                                j = int(np.searchsorted(at, i))
                                if j < len(at) and at[j] == i:
                                    one[j] = two[j] = none
                                for y in firsts(still(since), i, known):
                                    heapq.heappush(heap, y)
                        break
                if x == len(at):
                    if ahead == n:
                        break
                    at, one, two, of = load(at, 2 * len(at))
                    continue
                end = min(x + stretch, len(at))
                hit = linked[one[x:end]]
                hit |= linked[two[x:end]]
                hit &= wanted[of[x:end]]
                i = int(hit.argmax())
                if hit[i]:
                    seen, x, stretch = seen + i + 1, x + i + 1, _LOOK
                    take(int(at[x - 1]), one[x - 1], two[x - 1])
                    wanted[of[x - 1]] = False
                    one[x - 1] = two[x - 1] = none
                else:
                    seen, x, stretch = seen + end - x, end, min(2 * stretch, _LOOK_MOST)
            grew = len(members) > size
        for sets in ends:
            linked[sets] = False
        wanted[project[members]] = True
        gone += len(members)
        if len(members) > 1:
            cluster[members] = seed


def sync_roster(hosts: DataFrame, roster: DataFrame) -> DataFrame:
    """(root, state, change) after a registry listing: hosts (root, title), roster (root, title, origin, state)."""
    h = hosts.dropDuplicates(["root"]).select("root", F.col("title").alias("host_title"), F.lit(True).alias("listed"))
    rows = roster.join(h, "root", "full_outer")
    known = F.col("origin").isNotNull()
    change = (
        F.when(F.col("listed") & ~known, "new")
        .when(F.col("listed") & (F.col("state") != "live"), "revived")
        .when(F.col("listed") & ((F.col("origin") != "registry") | (F.col("title") != F.col("host_title"))), "updated")
        .when(F.col("listed"), "seen")
        .when((F.col("origin") == "registry") & ~F.col("state").isin("orphaned", "kept"), "orphaned")
        .otherwise("unchanged")
    )
    state = F.when(F.col("listed"), "live").when(change == "orphaned", "orphaned").otherwise(F.col("state"))
    return rows.select("root", state.alias("state"), change.alias("change"))


def turn_summaries(turns: DataFrame, keep: int = 5) -> DataFrame:
    """The last turns of each session (session_id, turn_no, replies, chars): a turn begins with each user message."""
    w = Window.partitionBy("session_id").orderBy("turn")
    rows = turns.withColumn("turn_no", F.sum((F.col("role") == "user").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = rows.groupBy("session_id", "turn_no").agg(F.count_if(F.col("role") != "user").alias("replies"), F.sum(F.length("text")).alias("chars"))
    last = Window.partitionBy("session_id").orderBy(F.col("turn_no").desc())
    return out.withColumn("back", F.row_number().over(last)).filter(F.col("back") <= keep)


def nearest_context(turns: DataFrame, has_context: Column) -> DataFrame:
    """Add ``context_turn``: the latest turn up to each one that has context, else the session's last one that has."""
    w = Window.partitionBy("session_id").orderBy("turn")
    own = F.when(has_context, F.col("turn"))
    upto = F.last(own, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    every = F.max(own).over(Window.partitionBy("session_id"))
    return turns.withColumn("context_turn", F.coalesce(upto, every, F.max("turn").over(Window.partitionBy("session_id"))))


def gate() -> Column:
    """skip or inspect, from gate, n_changed, n_renderable, inspected, inspections, most."""
    return F.when(~F.col("gate") | (F.col("n_changed") == 0) | (F.col("n_renderable") == 0) | F.col("inspected") | (F.col("inspections") >= F.col("most")), "skip").otherwise("inspect")
