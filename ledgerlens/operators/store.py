"""Changes to entries, signals and approvals. Each is a new snapshot or rows to append; reading never writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import params as p
from ledgerlens.functions import text as t
from ledgerlens.operators import governance


def _chosen(entries: DataFrame, ids: DataFrame) -> DataFrame:
    return entries.join(ids.select("id").distinct().withColumn("chosen", F.lit(True)), "id", "left").withColumn("chosen", F.coalesce("chosen", F.lit(False)))


def flag_review(entries: DataFrame, flags: DataFrame) -> DataFrame:
    """Entries with the flags (id, reason) raised: needs_review and review_reason. A flag raised twice changes nothing."""
    rows = entries.join(flags.groupBy("id").agg(F.max("reason").alias("new_reason")), "id", "left")
    old = F.col("review_reason") if "review_reason" in entries.columns else F.lit(None).cast("string")
    return rows.withColumns({"needs_review": F.col("needs_review") | F.col("new_reason").isNotNull(), "review_reason": F.coalesce("new_reason", old)}).drop("new_reason")


def clear_review(entries: DataFrame, ids: DataFrame) -> DataFrame:
    rows = _chosen(entries, ids)
    return rows.withColumns({"needs_review": F.col("needs_review") & ~F.col("chosen"), "review_reason": F.when(~F.col("chosen"), F.col("review_reason"))}).drop("chosen")


FORMAT_VERSION = 1


def point_lookup(entries: DataFrame, ids: DataFrame, version: str = "version") -> DataFrame:
    """The entries of ids; one of another format version fails."""
    rows = entries.join(ids.select("id").distinct(), "id", "left_semi")
    if version not in entries.columns:
        return rows
    checked = F.when(F.col(version) == FORMAT_VERSION, F.col(version)).otherwise(F.raise_error(F.concat(F.lit("foreign version of entry "), F.col("id").cast("string"))))
    return rows.withColumn(version, checked)


def _event(now: Column, change: str, to: Column, reason: Column) -> Column:
    return F.struct(now.alias("at"), F.lit(change).alias("change"), F.col("status").alias("from_"), to.alias("to"), reason.alias("reason"))


def _past(entries: DataFrame) -> Column:
    none = F.expr("cast(array() as array<struct<at: timestamp_ntz, change: string, from_: string, `to`: string, reason: string>>)")
    return F.coalesce(F.col("history"), none) if "history" in entries.columns else none


def add_entries(drafts: DataFrame, files: DataFrame, now: Column) -> DataFrame:
    """New candidates of drafts (id, tier, kind, title, text, tags, bindings), with each binding's hash from files (path, hash).

    A blank title or text, a binding without a file, and a binding of a global entry fail.
    """
    fail = lambda message: F.raise_error(F.concat(F.lit(f"{message}: "), F.col("id").cast("string")))
    blank = (F.trim("title") == "") | (F.trim("text") == "")
    bound = drafts.select("id", F.posexplode("bindings").alias("n", "path")).withColumn("path", t.rooted_path(F.col("path")))
    bound = bound.join(files.select("path", "hash"), "path", "left").groupBy("id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("n", "path", "hash"))), lambda x: F.struct(x["path"].alias("path"), x["hash"].alias("content_hash"))).alias("new_bindings")
    )
    rows = drafts.join(bound, "id", "left").withColumn("new_bindings", F.coalesce("new_bindings", F.expr("cast(array() as array<struct<path: string, content_hash: string>>)")))
    missing = F.exists("new_bindings", lambda x: x["content_hash"].isNull())
    checked = F.when(blank, fail("neither title nor text may be blank")).when((F.col("tier") == "global") & (F.size("new_bindings") > 0), fail("global entries bind no files")).when(missing, fail("no such file")).otherwise(F.trim("title"))
    status = F.lit("candidate")
    return rows.withColumn("status", F.lit(None).cast("string")).select(
        "id", "tier", "kind", checked.alias("title"), "text", F.array_sort(F.array_distinct("tags")).alias("tags"), F.col("new_bindings").alias("bindings"), status.alias("status"),
        F.lit(False).alias("needs_review"), now.alias("created_at"), F.array(_event(now, "status", status, F.lit("created"))).alias("history"),
    )


def update_texts(entries: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Entries with new texts (id, text, reason), each noted in the history; an equal text changes nothing, a blank one fails."""
    new = changes.select("id", F.when(F.trim("text") == "", F.raise_error(F.lit("a text may not be blank"))).otherwise(F.col("text")).alias("new_text"), "reason")
    rows = entries.join(new, "id", "left")
    changed = F.col("new_text").isNotNull() & (F.col("new_text") != F.col("text"))
    past = _past(entries)
    event = _event(now, "text", F.lit(None).cast("string"), F.col("reason"))
    return rows.withColumns({"history": F.when(changed, F.concat(past, F.array(event))).otherwise(past), "text": F.coalesce("new_text", "text")}).drop("new_text", "reason")


def rebind(entries: DataFrame, changes: DataFrame, files: DataFrame, now: Column, clear: bool = False) -> DataFrame:
    """Entries (bindings: path, content_hash) with whole new binding sets (id, paths, reason); hashes come from files (path, hash).

    Paths without a file fail, so do paths of a global entry. The change, or that there was none, is noted; ``clear`` also takes the review flag back.
    """
    paths = changes.select("id", F.posexplode_outer("paths").alias("n", "path")).withColumn("path", t.rooted_path(F.col("path"))).join(files.select("path", "hash"), "path", "left")
    found = F.when(F.col("path").isNotNull(), F.struct("n", "path", F.coalesce("hash", F.raise_error(F.concat(F.lit("no such file: "), "path"))).alias("content_hash")))
    new = paths.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(found)), lambda x: F.struct(x["path"].alias("path"), x["content_hash"].alias("content_hash"))).alias("new_bindings"))
    rows = entries.join(new, "id", "left").join(changes.select("id", "reason"), "id", "left")
    asked = F.col("new_bindings").isNotNull()
    names = lambda c: F.when(F.size(c) > 0, F.array_join(F.transform(c, lambda x: x["path"]), ", ")).otherwise("none")
    was, now_ = names("bindings"), names("new_bindings")
    why = F.concat("reason", F.lit(" ("), F.when(was == now_, F.concat(F.lit("unchanged: "), now_)).otherwise(F.concat(was, F.lit(" -> "), now_)), F.lit(")"))
    past = _past(entries)
    kept = F.when(asked & (F.col("tier") == "global") & (F.size("new_bindings") > 0), F.raise_error(F.lit("global entries bind no files"))).otherwise(F.coalesce("new_bindings", "bindings"))
    return rows.withColumns({
        "history": F.when(asked, F.concat(past, F.array(_event(now, "rebind", F.lit(None).cast("string"), why)))).otherwise(past),
        "needs_review": F.col("needs_review") & ~(asked & F.lit(clear)), "bindings": kept,
    }).drop("new_bindings", "reason")


def reverify(entries: DataFrame, ids: DataFrame, files: DataFrame, now: Column, accept: bool = False) -> DataFrame:
    """Entries after a human check of ids: the review flag is gone; with ``accept`` project entries take their files' present hashes."""
    chosen = _chosen(entries, ids)
    if not accept:
        return chosen.withColumn("needs_review", F.col("needs_review") & ~F.col("chosen")).drop("chosen")
    again = chosen.filter("chosen and tier <> 'global'").select("id", F.transform("bindings", lambda x: x["path"]).alias("paths"), F.lit("accepted").alias("reason"))
    after = rebind(entries, again, files, now)
    return _chosen(after, ids).withColumn("needs_review", F.col("needs_review") & ~F.col("chosen")).drop("chosen")


def redline_lines(entries: DataFrame, ranges: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(document redlines (id, doc_id, from_line, to_line), ids over the proposal ratio) for ranges (id, from_line, to_line) of mounted documents (doc_id, line_count).

    Ranges end with the document; one that begins behind it, or whose entry has no document, fails. Overlaps count twice in the ratio.
    """
    rows = ranges.join(entries.select("id", F.col("mounted_doc").alias("doc_id")), "id").join(docs.select("doc_id", "line_count"), "doc_id", "left")
    ok = (F.col("from_line") >= 1) & (F.col("from_line") <= F.col("to_line")) & (F.col("from_line") <= F.col("line_count"))
    first = F.when(F.coalesce(ok, F.lit(False)), F.col("from_line")).otherwise(F.raise_error(F.concat(F.lit("no such lines: "), F.col("id").cast("string"))))
    out = rows.select("id", "doc_id", first.alias("from_line"), F.least("to_line", "line_count").alias("to_line"), "line_count")
    ratio = out.groupBy("id").agg((F.sum(F.col("to_line") - F.col("from_line") + 1) / F.max("line_count")).alias("ratio"))
    return out.drop("line_count"), ratio.filter(F.col("ratio") > p.REDLINE_PROPOSAL_RATIO)


def mounted_docs(docs: DataFrame, entries: DataFrame, vectors: DataFrame) -> DataFrame:
    """(doc_id, ..., mounted, vectors): each document with the entries that mount it and its vector layer's (doc_id, status), none where not built."""
    mounts = entries.filter("mounted_doc is not null").groupBy(F.col("mounted_doc").alias("doc_id")).agg(F.array_sort(F.collect_list("id")).alias("mounted"))
    rows = docs.join(mounts, "doc_id", "left").join(vectors.select("doc_id", F.col("status").alias("vectors")), "doc_id", "left")
    return rows.withColumns({"mounted": F.coalesce("mounted", F.expr("cast(array() as array<bigint>)")), "vectors": F.coalesce("vectors", F.lit("none"))})


def touch(entries: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Note that entries were referenced."""
    return _chosen(entries, ids).withColumn("last_referenced_at", F.when(F.col("chosen"), now).otherwise(F.col("last_referenced_at"))).drop("chosen")


def redline_text(entries: DataFrame, ranges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries with the ranges (id, from, to) added, ids whose redlined share now calls for a split or a discard)."""
    new = ranges.groupBy("id").agg(F.collect_list(F.struct("from", "to")).alias("new_ranges"))
    none = F.expr("cast(array() as array<struct<`from`: int, `to`: int>>)")
    after = entries.join(new, "id", "left").withColumn("redlines", F.concat("redlines", F.coalesce("new_ranges", none))).drop("new_ranges")
    over = after.join(new.select("id"), "id", "left_semi").withColumn("ratio", t.redline_ratio(F.col("text"), F.col("redlines"))).filter(F.col("ratio") > p.REDLINE_PROPOSAL_RATIO)
    return after, over.select("id", "ratio")


def signal_rows(inputs: DataFrame, now: Column) -> DataFrame:
    """Ledger rows for inputs (entry_id, signal, note); an unknown signal fails."""
    facts = F.create_map(*(x for k, v in p.SIGNALS.items() for x in (F.lit(k), F.struct(F.lit(v[0]).alias("polarity"), F.lit(v[1]).alias("source"), F.lit(v[2]).alias("weight")))))
    fact = F.try_element_at(facts, F.col("signal"))
    known = F.when(fact.isNull(), F.raise_error(F.concat(F.lit("unknown signal "), F.coalesce("signal", F.lit("null"))))).otherwise(fact)
    return inputs.withColumn("fact", known).select(now.alias("at"), "entry_id", "fact.polarity", "fact.source", "fact.weight", "note")


def request_approvals(approvals: DataFrame, wanted: DataFrame, now: Column) -> DataFrame:
    """Requests to append for wanted (entry_id, action, reason, score): none where the same one is pending."""
    pending = approvals.filter("resolved_at is null").select("entry_id", "action").distinct()
    new = wanted.dropDuplicates(["entry_id", "action"]).join(pending, ["entry_id", "action"], "left_anti")
    return new.select("entry_id", "action", "reason", "score", now.alias("created_at"), F.lit(None).cast("timestamp_ntz").alias("resolved_at"), F.lit(None).cast("string").alias("resolution"))


#: What an approved action does to an entry: (action, to_status, trigger).
ACTIONS = [("promote", "trusted", "approve-promote"), ("retire", "expired", "human-retire"), ("reactivate", "candidate", "reactivate"), ("rescue", "candidate", "rescue"), ("discard", "discarded", "strong-negative")]


def resolve_approvals(entries: DataFrame, approvals: DataFrame, verdicts: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entries, approvals, refused) after verdicts (entry_id, action, resolution) on pending requests."""
    asked = verdicts.select("entry_id", "action", F.col("resolution").alias("verdict"))
    open_ = F.col("resolved_at").isNull() & F.col("verdict").isNotNull()
    settled = approvals.join(asked, ["entry_id", "action"], "left").withColumns({"resolution": F.when(open_, F.col("verdict")).otherwise(F.col("resolution")), "done": open_})
    settled = settled.withColumn("resolved_at", F.when(F.col("done"), now).otherwise(F.col("resolved_at")))
    what = F.create_map(*(x for a, s, g in ACTIONS for x in (F.lit(a), F.struct(F.lit(s).alias("s"), F.lit(g).alias("g")))))
    approved = settled.filter("done and resolution = 'approved'").select(F.col("entry_id").alias("id"), F.try_element_at(what, F.col("action")).alias("w"))
    changes = approved.filter("w is not null").select("id", F.col("w.s").alias("to_status"), F.col("w.g").alias("trigger"), F.lit("approved").alias("reason")).dropDuplicates(["id"])
    after, refused = governance.transition(entries, changes, now)
    return after, settled.drop("verdict", "done"), refused


def act(entries: DataFrame, approvals: DataFrame, acts: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entries, approvals, refused) after people's own acts (id, action, by, reason): promote, retire, reactivate, rescue or discard.

    A legal act settles every pending request of its action on its entry, as approved; requests of other
    actions stay, and so does the review flag. Illegal and unknown acts, and acts on unknown entries, are
    refused (id, action) and settle nothing. One act for each entry.
    """
    what = F.create_map(*(x for a, s, g in ACTIONS for x in (F.lit(a), F.struct(F.lit(s).alias("s"), F.lit(g).alias("g")))))
    why = F.concat(F.lit("by "), F.coalesce("by", F.lit("cli")), F.when(F.trim(F.coalesce("reason", F.lit(""))) != "", F.concat(F.lit(", "), F.trim("reason"))).otherwise(""))
    asked = acts.withColumn("w", F.try_element_at(what, F.col("action")))
    known = asked.filter("w is not null").join(entries.select("id"), "id", "left_semi")
    after, illegal = governance.transition(entries, known.select("id", F.col("w.s").alias("to_status"), F.col("w.g").alias("trigger"), why.alias("reason")), now)
    done = known.join(illegal.select("id"), "id", "left_anti").select(F.col("id").alias("entry_id"), "action")
    refused = acts.select("id", "action").join(done.withColumnRenamed("entry_id", "id"), ["id", "action"], "left_anti")
    rows = approvals.join(done.withColumn("done", F.lit(True)), ["entry_id", "action"], "left")
    settles = F.col("done") & F.col("resolved_at").isNull()
    settled = rows.withColumns({"resolution": F.when(settles, "approved").otherwise(F.col("resolution")), "resolved_at": F.when(settles, now).otherwise(F.col("resolved_at"))}).drop("done")
    return after, settled, refused


def attach_docs(entries: DataFrame, mounts: DataFrame, docs: DataFrame, now: Column) -> DataFrame:
    """Entries with documents mounted by (id, doc_id, from_line, to_line, quote), noted in the history; lines may be null, a missing quote is empty.

    An unknown entry, and a document that is not among docs (doc_id), fails. One document for each entry.
    """
    ids = entries.select("id", F.lit(True).alias("is_entry"))
    new = mounts.join(docs.select("doc_id").distinct().withColumn("is_doc", F.lit(True)), "doc_id", "left").join(ids, "id", "left")
    fail = lambda what, c: F.raise_error(F.concat(F.lit(f"no such {what}: "), F.coalesce(F.col(c).cast("string"), F.lit("null"))))
    named = F.when(F.col("is_entry").isNull(), fail("entry", "id")).when(F.col("is_doc").isNull(), fail("document", "doc_id")).otherwise(F.col("doc_id"))
    lines = F.struct("from_line", "to_line", F.coalesce("quote", F.lit("")).alias("quote"))
    where = F.when(F.col("from_line").isNotNull(), F.format_string(" lines %d-%d", "from_line", "to_line")).otherwise("")
    new = new.select("id", named.alias("new_doc"), lines.alias("new_anchor"), F.concat(F.lit("document attached: "), "doc_id", where).alias("why"))
    # an outer join, so that an unknown entry is not dropped before it fails
    rows = entries.join(new, "id", "full_outer")
    asked, past = F.col("new_doc").isNotNull(), _past(entries)
    old = F.col("doc_anchor") if "doc_anchor" in entries.columns else F.lit(None).cast("struct<from_line: int, to_line: int, quote: string>")
    return rows.withColumns({
        "history": F.when(asked, F.concat(past, F.array(_event(now, "rebind", F.lit(None).cast("string"), F.col("why"))))).otherwise(past),
        "mounted_doc": F.coalesce("new_doc", "mounted_doc"), "doc_anchor": F.when(asked, F.col("new_anchor")).otherwise(old),
    }).drop("new_doc", "new_anchor", "why")


def check_docs(entries: DataFrame, docs: DataFrame, files: DataFrame) -> DataFrame:
    """Project entries' mounted documents (doc_id, path, source_hash) held against the files (path, hash) they came from.

    A missing snapshot, a missing file and a changed one raise the review flag; the status stays. Where all agrees, a flag that such
    a check raised goes, and no other. Global entries, and those without a document, stay as they are.
    """
    found = docs.select("doc_id", "path", "source_hash").join(files.select("path", "hash"), "path", "left").select(F.col("doc_id").alias("mounted_doc"), "path", "source_hash", "hash")
    rows = entries.join(found, "mounted_doc", "left")
    finding = (
        F.when((F.col("tier") == "global") | F.col("mounted_doc").isNull(), F.lit(None))
        .when(F.col("source_hash").isNull(), F.concat(F.lit("document: no snapshot "), "mounted_doc"))
        .when(F.col("hash").isNull(), F.concat(F.lit("document: no file "), "path"))
        .when(F.col("hash") != F.col("source_hash"), F.concat(F.lit("document: changed "), "path"))
    )
    old = F.col("review_reason") if "review_reason" in entries.columns else F.lit(None).cast("string")
    own = (F.col("tier") != "global") & F.col("mounted_doc").isNotNull() & F.col("needs_review") & F.coalesce(old.startswith("document: "), F.lit(False))
    rows = rows.withColumn("finding", finding)
    agrees = F.col("finding").isNull() & own
    checked = {"needs_review": (F.col("needs_review") & ~agrees) | F.col("finding").isNotNull(), "review_reason": F.when(~agrees, F.coalesce("finding", old))}
    return rows.withColumns(checked).select(*entries.columns, *([] if "review_reason" in entries.columns else ["review_reason"]))


def apply_sweep(entries: DataFrame, scores: DataFrame, now: Column) -> DataFrame:
    """Entries after a sweep: discarded and expired ones change, purged ones are gone."""
    due = governance.sweep(entries, scores, now)
    trigger = F.when(F.col("action") == "discarded", "strong-negative").otherwise("expire-idle")
    changes = due.filter("action <> 'purged'").select("id", F.col("action").alias("to_status"), trigger.alias("trigger"), F.lit("sweep").alias("reason"))
    after, _ = governance.transition(entries, changes, now)
    return after.join(due.filter("action = 'purged'").select("id"), "id", "left_anti")


def evidence_loop(references: DataFrame, project: DataFrame, common: DataFrame, outcomes: DataFrame, changed: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(signals to append, references that no tier knows) of references (worklog, id, mode).

    A reference is looked up in the project's entries, then in the global ones. Passes and own
    failures become signals; what cannot be attributed makes none.
    """
    known = project.select("id", F.lit("project").alias("tier"), "bindings").unionByName(common.join(project, "id", "left_anti").select("id", F.lit("global").alias("tier"), "bindings"))
    rows = references.join(known, "id", "left")
    missing = rows.filter("tier is null").select("worklog", "id")
    verdicts = governance.attribute(rows.filter("tier is not null"), outcomes, changed).filter("verdict <> 'unattributed'")
    signal = F.when(F.col("verdict") == "pass", "evidence-pass").otherwise("evidence-fail")
    return signal_rows(verdicts.select(F.col("id").alias("entry_id"), signal.alias("signal"), F.concat(F.lit("worklog "), F.col("worklog").cast("string")).alias("note")), now), missing


def cite(entries: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, found) of cited ids."""
    return ids.select("id").distinct().join(entries.select("id", F.lit(True).alias("found")), "id", "left").select("id", F.coalesce("found", F.lit(False)).alias("found"))


def list_entries(entries: DataFrame, tier: str | None = None, status: str | None = None, kind: str | None = None, needs_review: bool | None = None, text: str | None = None) -> DataFrame:
    """Entries by equality and a word of their title or text, newest first. An unknown status fails."""
    if status is not None and status not in p.STATUSES:
        raise ValueError(f"unknown status {status}")
    for name, value in (("tier", tier), ("status", status), ("kind", kind), ("needs_review", needs_review)):
        if value is not None:
            entries = entries.filter(F.col(name) == value)
    if text:
        entries = entries.filter(F.contains(F.lower(F.concat_ws(" ", "title", "text")), F.lit(text.lower())))
    return entries.orderBy(F.col("created_at").desc(), "id")


def stale_sources(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, state) of files (path, hash) that are new, gone or changed between two readings."""
    rows = before.select("path", F.col("hash").alias("was")).join(after.select("path", F.col("hash").alias("now")), "path", "full_outer")
    state = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "gone").when(F.col("was") != F.col("now"), "changed")
    return rows.withColumn("state", state).filter("state is not null").select("path", "state")
