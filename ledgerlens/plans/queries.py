"""The registered queries: each operator over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.functions import params as p
from ledgerlens.functions import text as t
from ledgerlens.operators import documents, evaluation, governance, hybrid, index, layout, lexical, ranking, roster, segments, shared, store
from ledgerlens.sources import files, views
from ledgerlens.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SIX = lambda c: t.round_half_up(F.col(c), 6).alias(c)
JOINED = lambda c: F.array_join(c, ",").alias(c)
CHANGED = ["src/mod4.css", "src/mod10.css", "src/mod26.css"]


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.visible(views.entries(spark, sf_dir))


@query
def tokenize_counts(spark, d):
    rows = views.entries(spark, d).select("id", F.explode(t.all_tokens(F.col("text"))).alias("token"))
    return rows.groupBy("id", "token").agg(F.count("*").alias("n"))


@query
def doc_frequency_idf(spark, d):
    f = lexical.fielded(corpus(spark, d))
    n = lexical.corpus_stats(f).select("n")
    return lexical.document_frequency(f).crossJoin(F.broadcast(n)).select("token", "df", t.round_half_up(lexical.idf(F.col("n"), F.col("df")), 6).alias("idf"))  # one row


@query
def corpus_field_stats(spark, d):
    s = lexical.corpus_stats(lexical.fielded(corpus(spark, d)))
    return s.select("n", *(SIX(c) for c in s.columns if c != "n"))


@query
def merged_tier_stats(spark, d):
    f = lexical.fielded(corpus(spark, d))
    s = lexical.merge_stats(lexical.corpus_stats(f.filter("tier = 'project'")).unionByName(lexical.corpus_stats(f.filter("tier = 'global'"))))
    return s.select("n", *(SIX(c) for c in s.columns if c != "n"))


def _top(spark, d, **how):
    e, q = views.drafts(spark, d), views.queries(spark, d)
    return lexical.with_matched(lexical.retrieve(e, q, p.RESULT_LIMIT, mark=views.marks(spark, d), **how), e, q).select("query_id", "id", "rank", "score", JOINED("matched"))


@query
def bm25f_presence_topk(spark, d):
    return _top(spark, d)


@query
def bm25f_count_topk(spark, d):
    return _top(spark, d, frequency="count")


@query
def weights_scorer_topk(spark, d):
    return _top(spark, d, scorer="weights")


@query
def bm25f_indexed_topk(spark, d):
    """The same search over a stored index instead of the texts."""
    path = shared.shared_path(spark, "lexical-index")
    e, q = views.entries(spark, d), views.queries(spark, d)
    index.write_index(lexical.visible(e), path)
    return index.search(index.read_index(spark, path), q, p.RESULT_LIMIT).select("query_id", "id", "rank", "score")


@query
def refreshed_index_topk(spark, d):
    """Search over two tiers whose stored indexes were built before entries were edited, added and removed, then refreshed."""
    q, i = views.queries(spark, d), F.col("id")
    # texts meet their labels once, here; both refreshes of both tiers read what is written
    e = lexical.visible(views.marks(spark, d)(views.drafts(spark, d))).select("id", "title", "tags", "text", "redlines", "status", "tier", "kind", "needs_review")
    e = shared.write_shared(e, "entries")
    before = e.filter("id % 13 <> 0").withColumn("text", F.when(i % 7 == 0, F.concat(F.lit("an older text "), F.reverse("text"))).otherwise(F.col("text")))
    before = before.unionByName(e.filter("id % 17 = 0").withColumn("id", -1 - i))
    tiers = []
    for tier in ("project", "global"):
        path = shared.shared_path(spark, f"index-{tier}")
        segments.refresh(before.filter(F.col("tier") == tier), path)
        segments.refresh(e.filter(F.col("tier") == tier), path)
        tiers.append(segments.open_tier(spark, path))
    return segments.search(tiers, q, p.RESULT_LIMIT).select("query_id", "id", "rank", "score")


@query
def replaced_chunk_layer(spark, d):
    """A stored chunk layer after some documents were read anew and others left."""
    docs = _pages(spark, d)
    path = shared.shared_path(spark, "chunk-layer")
    cut = documents.chunk_documents(docs)
    files.write_layer(cut, path)
    anew = docs.filter("doc_id % 9 = 0").withColumn("text", F.concat(F.lit("# Read anew\n"), "text"))
    files.replace_in_layer(documents.chunk_documents(anew), path, docs.filter("doc_id % 10 = 1").select("doc_id"))
    return spark.read.parquet(path).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.max("end_line").alias("lines"), F.max(F.col("heading_path").startswith("Read anew").cast("int")).alias("anew"))


@query
def bm25_p90_scale(spark, d):
    scored = lexical.score(views.drafts(spark, d), views.queries(spark, d), mark=views.marks(spark, d), shown=lexical.visible)
    return lexical.p90_scale(scored).select("query_id", SIX("scale"))


@query
def binding_strata(spark, d):
    return lexical.bound_strata(views.entries(spark, d), views.queries(spark, d), CHANGED).select("query_id", "id", "rank", "stratum", SIX("score"))


@query
def redline_filter(spark, d):
    e = views.entries(spark, d)
    text, ranges = F.col("text"), F.col("redlines")
    ratio = t.redline_ratio(text, ranges)
    return e.select("id", F.md5(t.redline(text, ranges)).alias("kept_md5"), t.round_half_up(ratio, 6).alias("ratio"), (ratio > p.REDLINE_PROPOSAL_RATIO).alias("proposal"))


@query
def vector_topk(spark, d):
    v = views.table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), "embedding")
    q = v.filter("key % 20 = 0").select(F.col("key").alias("query_id"), "embedding")
    return ranking.vector_topk(v, q, 10).select("query_id", "key", "score", "rank")


def _recall(spark, d):
    v = views.table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), "embedding")
    q = views.queries(spark, d)
    asked = q.select("query_id").join(v, F.col("query_id") == F.col("key")).select("query_id", "embedding")
    return hybrid.recall(views.drafts(spark, d), q, v, asked, mark=views.marks(spark, d))


@query
def rrf_hybrid(spark, d):
    return _recall(spark, d).fused.filter(F.col("position") <= 10).select("query_id", "key", "fused", "best_rank", "position")


@query
def vector_only_quota(spark, d):
    return ranking.quota(_recall(spark, d).fused, 3).select("query_id", "key", "position")


def _candidates(spark, d):
    return hybrid.candidates(_recall(spark, d))


@query
def rerank_features(spark, d):
    s = governance.window_scores(views.signals(spark, d), views.now()).select("entry_id", "window_score")
    rows = ranking.rerank(_candidates(spark, d), views.now(), s, CHANGED)
    return rows.select("query_id", "id", *(t.round_half_up(F.col("features")[k], 6).alias(k) for k in p.FEATURE_WEIGHTS))


@query
def rerank_topk(spark, d):
    s = governance.window_scores(views.signals(spark, d), views.now()).select("entry_id", "window_score")
    rows = ranking.rerank(_candidates(spark, d), views.now(), s, CHANGED)
    return lexical.top_k(rows, p.RESULT_LIMIT, F.col("score").desc(), (F.col("tier") != "project").cast("int"), F.col("id")).select("query_id", "id", "score", "rank")


@query
def rerank_explained(spark, d):
    """The absolute, calibrated settings, with the lines that explain each score."""
    rows = ranking.explain(ranking.rerank(_candidates(spark, d), views.now(), None, None, "absolute", "calibrated", "raw", "absent", 0.05))
    return lexical.top_k(rows, p.RESULT_LIMIT, F.col("score").desc(), F.col("id")).select("query_id", "id", "score", F.array_join("lines", "; ").alias("lines"))


@query
def rank_minmax_norm(spark, d):
    near = _recall(spark, d).near
    rows = ranking.semantic_norms(near.select("query_id", F.col("key").alias("id"), F.col("score").alias("semantic")))
    return rows.select("query_id", "id", SIX("semantic_by_rank"), SIX("semantic_minmax"))


@query
def query_normalize_profiles(spark, d):
    q = views.queries(spark, d).withColumn("query", F.concat(F.lit("  see `x.y` src/mod4.css API_KEY v2.1 and\n"), "query", F.lit("\t E401 focus-trap ")))
    parts = []
    for name in p.PROFILES:
        n = t.normalize_query(F.col("query"), name)
        parts.append(q.select("query_id", F.lit(name).alias("profile"), n["lexical"].alias("lexical"), n["semantic"].alias("semantic"), F.array_join(n["identifiers"], " ").alias("identifiers"), n["truncated"].alias("truncated")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def identifier_subtokens(spark, d):
    names = views.table(spark, d, "part").select(F.concat_ws("_", F.regexp_replace(F.initcap("p_type"), " ", ""), F.regexp_replace("p_brand", "[^A-Za-z0-9]", "")).alias("name")).distinct()
    return names.select("name", F.array_join(t.subtokens(F.col("name")), ",").alias("parts"))


@query
def embed_text_cache_key(spark, d):
    e = views.entries(spark, d)
    text = t.embed_text(F.col("title"), F.col("tags"), t.redline(F.col("text"), F.col("redlines")))
    return e.select("id", t.cache_key(text).alias("cache_key"))


@query
def embed_plan(spark, d):
    units = views.entries(spark, d).select(F.col("id").alias("key"), "text")
    cache = units.filter("key % 3 = 0").select(F.lit("v1").alias("version"), t.cache_key(F.col("text")).alias("cache_key"))
    return ranking.embed_plan(units, cache, "v1")


@query
def hash_embed(spark, d):
    v = ranking.hash_embed(views.entries(spark, d).select(F.col("id").alias("key"), "text"))
    return v.select("key", F.md5(F.array_join(F.transform("embedding", lambda x: F.format_number(x.cast("double"), 5)), ",")).alias("vector_md5"))


@query
def html_to_markdown(spark, d):
    return views.table(spark, d, "pages").select("page_id", t.html_to_markdown(F.col("html")).alias("text"), t.source_format(F.col("url")).alias("format"))


@query
def page_assets(spark, d):
    return views.table(spark, d, "pages").select("page_id", F.array_join(t.assets(F.col("html")), ",").alias("assets"))


def _pages(spark, d):
    return views.table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), t.html_to_markdown(F.col("html")).alias("text"))


@query
def chunk_documents(spark, d):
    return documents.chunk_documents(_pages(spark, d))


@query
def chunk_search(spark, d):
    docs = _pages(spark, d)
    red = docs.filter("doc_id % 3 = 0").select("doc_id", F.lit(2).alias("from_line"), F.lit(3).alias("to_line"))
    ask = docs.select("doc_id", F.col("doc_id").alias("query_id"), F.array_join(F.slice(t.tokenize(F.col("text")), 1, 12), " ").alias("query"))
    cut = shared.write_shared(documents.chunk_documents(docs, bodies=True), "chunks")
    return documents.search_chunks(cut, ask, red).select("query_id", "doc_id", "seq", "rank", "score", JOINED("matched"), "partly_redlined")


@query
def chunk_browse(spark, d):
    return documents.browse_chunks(documents.chunk_documents(_pages(spark, d)))


def _sources(spark, d):
    e = views.table(spark, d, "documents")
    return e.select(F.concat(F.lit("doc"), (F.col("doc_id") % 300).cast("string"), F.lit(".md")).alias("path"), F.coalesce("text", F.lit("")).alias("content"), (views.now() - F.make_dt_interval(days=(F.col("doc_id") % 50).cast("int"))).alias("at"), "doc_id")


@query
def ingest_snapshots(spark, d):
    s = _sources(spark, d)
    first = s.groupBy(F.sha2("content", 256).alias("h")).agg(F.min("doc_id").alias("doc_id"))
    s = s.join(first.select("doc_id"), "doc_id", "left_semi").drop("doc_id")
    known = spark.createDataFrame([], "doc_id string, path string, at timestamp_ntz")
    return files.ingest_snapshots(s, known).drop("text", "at")


@query
def latest_snapshot_per_path(spark, d):
    return files.latest_snapshots(_sources(spark, d).drop("content")).select("path", "doc_id", "at")


@query
def drift_flags(spark, d):
    e = views.entries(spark, d).select("id", F.explode("bindings").alias("path")).withColumn("content_hash", F.md5("path"))
    n = F.regexp_extract("path", "([0-9]+)", 1).cast("int")
    f = e.select("path").distinct().filter(n % 7 != 0).withColumn("hash", F.when(n % 5 == 0, F.lit("other")).otherwise(F.md5("path")))
    return documents.drift(e, f)


@query
def window_scores_30d(spark, d):
    return governance.window_scores(views.signals(spark, d), views.now()).select("entry_id", SIX("window_score"), "n", SIX("positive"), SIX("negative"), "last_at")


def _scores(spark, d):
    return governance.window_scores(views.signals(spark, d), views.now()).select("entry_id", "window_score")


@query
def sweep_transitions(spark, d):
    return governance.sweep(views.entries(spark, d), _scores(spark, d), views.now())


@query
def promotion_candidates(spark, d):
    return governance.promotions(views.entries(spark, d), _scores(spark, d), views.approvals(spark, d), views.now())


@query
def lifecycle_transitions(spark, d):
    """Every trigger tried on each entry: legal ones change the status, the rest are refused."""
    e = views.entries(spark, d)
    trigger = F.element_at(F.array(*(F.lit(x) for x in p.TRIGGERS)), (F.col("id") % 7 + 1).cast("int"))
    to = F.element_at(F.array(*(F.lit(x) for x in p.STATUSES)), (F.col("id") % 5 + 1).cast("int"))
    changes = e.select("id", to.alias("to_status"), trigger.alias("trigger"), F.lit("test").alias("reason"))
    after, refused = governance.transition(e, changes, views.now())
    return after.join(refused.select("id", F.lit(True).alias("refused")), "id", "left").select("id", "status", F.size("history").cast("long").alias("events"), F.coalesce("refused", F.lit(False)).alias("refused"), "discarded_at")


@query
def split_entries(spark, d):
    e = views.entries(spark, d)
    drafts = e.filter("id % 50 = 0").select("id", F.explode(F.array(F.lit(1), F.lit(2))).alias("part"), "title", "text")
    return governance.split_entries(e, drafts, views.now()).select("id", "status", "needs_review", F.length("text").alias("chars"))


@query
def failure_streak(spark, d):
    return governance.failure_streaks(views.signals(spark, d)).filter(F.col("streak") >= p.FAILURE_STREAK - 1)


def _doubts(spark, d):
    e = views.table(spark, d, "events")
    return e.filter("event_type in ('error', 'click', 'purchase')").select(
        F.col("event_id").alias("seq"), F.when(F.col("event_type") == "purchase", "escalated").otherwise("doubt").alias("type"), F.when(F.col("event_type") == "error", "module").otherwise("entry").alias("kind"), F.col("user_id").alias("key")
    )


@query
def open_doubt_counts(spark, d):
    rows = _doubts(spark, d).withColumn("kind", F.lit("entry"))
    return governance.open_doubts(rows)


@query
def tier_status_counts(spark, d):
    return views.entries(spark, d).groupBy("tier", "status").agg(F.count("*").alias("n"), F.count_if("needs_review").alias("review"))


@query
def entry_list(spark, d):
    return views.entries(spark, d).filter("status = 'candidate' and kind = 'pitfall' and not needs_review").select("id", "title", "created_at")


@query
def annotations(spark, d):
    return views.entries(spark, d).select("id", F.array_join(governance.annotations(), "; ").alias("notes"))


@query
def packed_context(spark, d):
    """Titles of each kind's entries, in order, as far as 2,000 characters reach."""
    return documents.pack_groups(views.entries(spark, d).filter("title is not null"), "kind", "id", "title", 2000)


@query
def failure_signatures(spark, d):
    """Whole sessions: what the user says counts as assertions, all else as errors."""
    said = lambda own: F.transform(F.sort_array(F.collect_list(F.when(own, F.struct("turn", "text")))), lambda x: x["text"])
    user = F.col("role") == "user"
    rows = views.turns(spark, d).groupBy("session_id").agg(said(user).alias("assertions"), said(~user).alias("errors"))
    return rows.select("session_id", t.failure_signature(F.col("assertions"), F.col("errors"), F.array(F.lit("src/a.css"))).alias("signature"))


@query
def approval_queue(spark, d):
    """The 50 requests to decide first: pending ones, the oldest first."""
    pending = F.col("resolved_at").isNotNull().cast("int")
    first = views.approvals(spark, d).orderBy(pending, "created_at", "approval_id").limit(50).withColumn("bucket", F.lit(0))
    e = views.entries(spark, d).select(F.col("id").alias("entry_id"), "title", "status")
    rows = lexical.top_k(first, 50, pending, F.col("created_at"), F.col("approval_id"), by="bucket")
    return rows.join(e, "entry_id", "left").select("approval_id", "entry_id", "status", "resolution", "rank")


@query
def ranklog_labels_7d(spark, d):
    return evaluation.labels(views.ranklog(spark, d), views.signals(spark, d)).select("row_id", "entry_id", "label", "negative")


@query
def ranklog_summary(spark, d):
    log = views.ranklog(spark, d)
    return evaluation.summary(log, evaluation.labels(log, views.signals(spark, d)))


def _training(spark, d):
    return evaluation.labels(views.ranklog(spark, d), views.signals(spark, d).filter("signal <> 'implicit-use'"))


@query
def ltr_readiness(spark, d):
    return evaluation.readiness(_training(spark, d))


@query
def ltr_evaluation(spark, d):
    return evaluation.evaluate(_training(spark, d), F.col("score")).select("queries", SIX("precision_at_1"), SIX("mrr"))


@query
def ltr_train_logistic(spark, d):
    rows = _training(spark, d).withColumns({"bm25ish": F.col("score"), "freshness": (F.col("entry_id") % 7) / 7.0})
    w = evaluation.train_logistic(rows, ["bm25ish", "freshness"])
    return spark.createDataFrame([(k, round(v, 6)) for k, v in sorted(w.items())], "feature string, weight double")


@query
def ndcg_recall_mrr(spark, d):
    q, docs = views.queries(spark, d), views.table(spark, d, "documents").select("doc_id", t.collapse(F.coalesce("text", F.lit(""))).alias("body"))
    needles = q.select("query_id", t.collapse(F.col("query")).alias("needle"))
    qrels = evaluation.containing(docs, needles).select("query_id", "doc_id", F.lit(1.0).alias("grade"))
    top = lexical.retrieve(views.drafts(spark, d), q, 10, mark=views.marks(spark, d)).select("query_id", F.col("id").alias("doc_id"), "rank")
    return evaluation.retrieval_metrics(top, qrels).select("query_id", SIX("ndcg"), SIX("recall"), SIX("rr"))


@query
def judge_metrics(spark, d):
    q = views.queries(spark, d).withColumn("b", F.when(F.col("query_id") % 3 == 0, "true").otherwise("false"))
    raw = F.format_string('Here:\n```json\n{"claims":[{"supported":true},{"supported":%s}],"relevance":%s,"passages":[{"index":1,"useful":%s},{"index":3,"useful":true}],"points":[{"index":1,"supported":true},{"index":2,"supported":%s}]}\n```', "b", (F.col("query_id") % 90).cast("string"), "b", "b")
    a = q.select(F.col("query_id").alias("id"), raw.alias("raw"), F.lit(5).alias("retrieved"), F.lit(3).alias("gold_points"))
    return evaluation.judge_metrics(a).select("id", SIX("faithfulness"), SIX("relevance"), SIX("context_precision"), SIX("context_recall"))


def _verified(spark, d):
    return views.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.concat_ws(" ", "p_type", "p_brand").alias("text"), F.concat(F.lit("p"), (F.col("p_partkey") % 11).cast("string")).alias("project"))


@query
def overlap_similar_pairs(spark, d):
    """Linked sets of equal title tokens (of = 0) or equal tokens (1), by their least ids; ``overlap_classes`` has who is in them."""
    _, links = governance.similar_sets(_verified(spark, d), 0.75)
    return links.select("of", "a", "b", SIX("similarity"))


@query
def overlap_classes(spark, d):
    """Each entry's two sets and how many entries of other projects they link it to."""
    return governance.link_counts(*governance.similar_sets(_verified(spark, d), 0.75))


@query
def generalize_clusters(spark, d):
    return governance.set_clusters(*governance.similar_sets(_verified(spark, d), 0.75))


@query
def classify_changes(spark, d):
    e = views.entries(spark, d).select(F.element_at(F.array(F.lit(".\\src\\A.CSS"), F.lit("/web/x.ts"), F.lit("./lib/y.rs"), F.lit("ui/z.go")), (F.col("id") % 4 + 1).cast("int")).alias("path"), "id")
    return governance.classify(e, ["css", ".html"], ["web/", "UI/"]).select("id", "file", "renderable")


@query
def evidence_attribution(spark, d):
    e = views.entries(spark, d)
    refs = e.select((F.col("id") % 20).alias("worklog"), "id", "tier", "bindings", F.when(F.col("id") % 3 == 0, "cited").otherwise("surfaced").alias("mode"))
    outcomes = refs.select("worklog").distinct().withColumn("exit_ok", F.col("worklog") % 4 == 0)
    changed = e.select((F.col("id") % 20).alias("worklog"), F.explode("bindings").alias("file")).filter("worklog % 3 = 0").distinct()
    return governance.attribute(refs, outcomes, changed)


@query
def roster_sync(spark, d):
    c = views.table(spark, d, "customer")
    roster = c.filter("c_custkey % 3 <> 0").select(F.concat(F.lit("/w/"), F.col("c_custkey").cast("string")).alias("root"), F.col("c_name").alias("title"), F.when(F.col("c_custkey") % 2 == 0, "registry").otherwise("cli").alias("origin"), F.element_at(F.array(F.lit("live"), F.lit("orphaned"), F.lit("kept")), (F.col("c_custkey") % 3 + 1).cast("int")).alias("state"))
    hosts = c.filter("c_custkey % 5 <> 0").select(F.concat(F.lit("/w/"), F.col("c_custkey").cast("string")).alias("root"), F.when(F.col("c_custkey") % 7 == 0, "renamed").otherwise(F.col("c_name")).alias("title"))
    return governance.sync_roster(hosts, roster)


@query
def turn_sessions(spark, d):
    return governance.turn_summaries(views.turns(spark, d)).select("session_id", "turn_no", "replies", "chars")


@query
def turn_context(spark, d):
    return governance.nearest_context(views.turns(spark, d), (F.length("text") % 3) == 0).select("session_id", "turn", "context_turn")


def _nodes(spark, d, side: str):
    o = F.col("o_orderkey")
    new = side == "after"
    rows = views.table(spark, d, "orders").filter(f"o_orderkey % {11 if new else 13} <> 0")
    flip = lambda n: (o % n == 0) if new else F.lit(False)
    return rows.select(
        F.lit(side).alias("snapshot_id"), o.alias("id"), F.col("o_custkey").alias("parent_id"), F.element_at(F.array(F.lit("marker"), F.lit("interactive"), F.lit("region"), F.lit("landmark")), (o % 4 + 1).cast("int")).alias("kind"),
        (o % 900 + F.when(flip(17), 30).otherwise(0)).cast("int").alias("x"), (o % 700).cast("int").alias("y"), (o % 50 + F.when(flip(19), 40).otherwise(0)).cast("int").alias("w"), F.lit(20).alias("h"),
        layout.grid_cell(o % 900 + F.when(flip(17), 30).otherwise(0), o % 700, F.lit(900)).alias("grid"), F.when(flip(23), "new").otherwise(F.col("o_orderpriority")).alias("text"),
        F.when(o % 3 == 0, 5.0 - F.when(flip(9), 1.0).otherwise(0.0)).alias("contrast"), (~flip(29)).alias("displayed"), (o % 700 < 500).alias("in_viewport"), flip(31).alias("occluded"), flip(37).alias("clipped"),
        (o % 4 == 1).alias("interactive"), (o % 40 == 1).alias("disabled"), (~flip(41)).alias("tabbable"), F.when(o % 10 == 0, (o % 6 + F.when(flip(50), 1).otherwise(0)).cast("int")).alias("repeat_count"), F.when((o % 4 == 3) & ~flip(43), "main").alias("module_name"),
    )


@query
def layout_diff(spark, d):
    return layout.diff(_nodes(spark, d, "before"), _nodes(spark, d, "after")).select("module_id", "kind", "severity", "detail")


@query
def layout_assertions(spark, d):
    return layout.assertions(_nodes(spark, d, "after"))


@query
def layout_assertion_flips(spark, d):
    one = lambda side: layout.assertions(_nodes(spark, d, side)).select("name", "passed")
    return layout.assertion_flips(one("before"), one("after"))


@query
def layout_runs(spark, d):
    n = views.table(spark, d, "lineitem").select((F.col("l_orderkey") % 500).alias("parent_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), "l_returnflag")
    n = n.groupBy("parent_id", "pos").agg(F.min("l_returnflag").alias("signature"))
    return layout.fold_runs(n)


@query
def sibling_relations(spark, d):
    return layout.sibling_relations(_nodes(spark, d, "before").withColumn("pos", F.col("id"))).select("id", "relation")


@query
def contrast_ratios(spark, d):
    o = F.col("p_partkey")
    rows = views.table(spark, d, "part").select(o.alias("id"), t.luminance(o % 256, o * 7 % 256, o * 13 % 256).alias("a"), t.luminance(o * 3 % 256, o * 5 % 256, o * 11 % 256).alias("b"))
    return rows.select("id", t.contrast(F.col("a"), F.col("b")).alias("ratio"))


@query
def stream_window_scores(spark, d):
    return streams.drain(streams.stream_scores(streams.signals_stream(spark, d)), f"scores_{abs(hash(d)) % 10**6}", "complete").select(F.col("window_end").cast("timestamp_ntz").alias("window_end"), "entry_id", SIX("window_score"), "n")


@query
def stream_doubt_escalations(spark, d):
    e = streams.read_events(spark, d).filter("event_type = 'error'").select(F.col("user_id").alias("key"))
    rows = streams.drain(streams.stream_doubts(e), f"doubts_{abs(hash(d)) % 10**6}", "update")
    return rows.groupBy("key").agg(F.max_by(F.struct("escalations", "open"), F.col("escalations") * 1000 + F.col("open")).alias("x")).select("key", "x.escalations", "x.open")


@query
def stream_closed_scores(spark, d):
    """Each window's scores once, when the watermark has passed its end: closed windows leave the state."""
    marks = views.to_signals(streams.read_events(spark, d, None))
    rows = streams.drain(streams.stream_scores(marks), "closed-scores", "append")
    return rows.select(F.col("window_end").cast("timestamp_ntz").alias("window_end"), "entry_id", SIX("window_score"), "n")


@query
def stream_open_doubts(spark, d):
    """Open doubts of each key, which an escalation in the ledger restarts, from keyed state."""
    e = streams.read_events(spark, d).filter("event_type in ('error', 'click', 'purchase')")
    rows = e.select(F.when(F.col("user_id") % 2 == 0, "module").otherwise("entry").alias("kind"), F.col("user_id").alias("key"), F.when(F.col("event_type") == "purchase", "escalated").otherwise("doubt").alias("type"), F.col("event_id").alias("seq"), F.col("ts").alias("at"))
    found = streams.drain(streams.track_doubts(rows, watermark=streams.span(spark, d)), "open-doubts", "update", numbered=True)
    return streams.latest(found, ["kind", "key"]).select("kind", F.col("key").cast("long").alias("key"), "open", "due")


@query
def stream_turn_sessions(spark, d):
    """The last five turns of each session, from keyed state."""
    c = streams.read_stream(spark, d, "conversations", None).select(F.col("conv_id").alias("session_id"), "turn", "role", "text")
    return streams.latest(streams.drain(streams.track_turns(c), "turns", "update", numbered=True), ["session_id"]).withColumn("session_id", F.col("session_id").cast("long"))


@query
def stream_label_join(spark, d):
    e = streams.read_events(spark, d)
    log = e.filter("event_type = 'view'").select(F.col("event_id").alias("row_id"), F.col("ts").alias("at"), F.col("user_id").alias("entry_id"))
    marks = streams.signals_stream(spark, d).filter("signal = 'human-confirm'")
    rows = streams.drain(streams.stream_labels(log, marks, watermark=streams.span(spark, d)), f"labels_{abs(hash(d)) % 10**6}", "append")
    return rows.groupBy("row_id").agg(F.count("*").alias("confirmations"))


@query
def evidence_loop_signals(spark, d):
    e = views.entries(spark, d)
    refs = e.select((F.col("id") % 20).alias("worklog"), (F.col("id") * 2).alias("id"), F.when(F.col("id") % 3 == 0, "cited").otherwise("surfaced").alias("mode"))
    outcomes = refs.select("worklog").distinct().withColumn("exit_ok", F.col("worklog") % 4 == 0)
    changed = refs.select("worklog", F.concat(F.lit("src/mod"), (F.col("id") % 50).cast("string"), F.lit(".css")).alias("file")).filter("worklog % 3 = 0").distinct()
    rows, _ = store.evidence_loop(refs, e.filter("tier = 'project'"), e.filter("tier = 'global'"), outcomes, changed, views.now())
    return rows.select("entry_id", "polarity", "source", "weight", "note")


@query
def resolved_approvals(spark, d):
    e, a = views.entries(spark, d), views.approvals(spark, d)
    verdicts = a.filter("resolved_at is null").select("entry_id", "action", F.when(F.col("entry_id") % 6 == 0, "rejected").otherwise("approved").alias("resolution"))
    after, settled, _ = store.resolve_approvals(e, a, verdicts, views.now())
    return settled.join(after.select(F.col("id").alias("entry_id"), "status"), "entry_id").select("approval_id", "entry_id", "resolution", "resolved_at", "status")


@query
def swept_entries(spark, d):
    after = store.apply_sweep(views.entries(spark, d), _scores(spark, d), views.now())
    return after.groupBy("tier", "status").agg(F.count("*").alias("n"))


@query
def redline_proposals(spark, d):
    e = views.entries(spark, d)
    more = e.filter("id % 5 = 0").select("id", F.lit(1).alias("from"), (F.col("id") % 900).cast("int").alias("to"))
    _, over = store.redline_text(e, more)
    return over.select("id", SIX("ratio"))


@query
def gate_decisions(spark, d):
    o = F.col("o_orderkey")
    rows = views.table(spark, d, "orders").select(o.alias("id"), (o % 9 != 0).alias("gate"), (o % 4).alias("n_changed"), (o % 3).alias("n_renderable"), (o % 5 == 0).alias("inspected"), (o % 6).alias("inspections"), F.lit(4).alias("most"))
    return rows.select("id", governance.gate().alias("act"))


def _ledger(spark, d):
    rows = _doubts(spark, d)
    return rows.withColumn("kind", F.when(F.col("key") % 2 == 0, "module").otherwise("entry"))


@query
def doubt_escalations(spark, d):
    return governance.escalate(_ledger(spark, d))


@query
def escalated_modules(spark, d):
    return governance.escalated_keys(_ledger(spark, d))


@query
def failure_flags(spark, d):
    return governance.streak_flags(views.entries(spark, d), governance.failure_streaks(views.signals(spark, d)))


@query
def feedback_dislikes(spark, d):
    e = views.table(spark, d, "events")
    polls = e.select((F.col("user_id") % 50).alias("session_id"), F.col("user_id").alias("message_id"), F.col("event_id").alias("poll"), F.floor(F.col("value")).cast("long").alias("version"), F.when(F.col("event_type") == "error", "negative").otherwise("positive").alias("rating"))
    return governance.new_dislikes(polls)


@query
def generalization_proposals(spark, d):
    """Drafts from parts that several projects name alike; names that the global tier knows already, by a candidate or trusted entry, make none."""
    p_, number = views.table(spark, d, "part"), F.regexp_extract("p_brand", "[0-9]+", 0)
    v = p_.select(
        F.col("p_partkey").alias("id"), F.concat(F.lit("p"), (F.col("p_partkey") % 11).cast("string")).alias("project"), F.col("p_name").alias("title"),
        F.concat(F.lit("type_"), "p_type", F.lit(" brand_"), number).alias("text"), F.array("p_type", "p_brand").alias("tags"), (F.col("p_partkey") * 7919 % 1000).cast("double").alias("score"),
    )
    known = p_.groupBy(F.col("p_name").alias("title")).agg(F.min("p_partkey").alias("id"))
    known = known.select("id", "title", F.lit("known").alias("text"), F.element_at(F.array(F.lit("trusted"), F.lit("expired"), F.lit("candidate"), F.lit("discarded")), (F.col("id") % 4 + 1).cast("int")).alias("status"))
    grown = governance.set_clusters(*governance.similar_sets(v, 0.99))
    return governance.proposals(v, grown, known, 0.99).select("cluster", "id", "title", JOINED("tags"), "sources")


@query
def relation_changes(spark, d):
    o = F.col("o_orderkey")
    rows = views.table(spark, d, "orders")
    before = rows.select(o.alias("id"), F.when(o % 3 == 0, F.array(F.lit("below nav"), F.lit("beside aside"))).otherwise(F.array(F.lit("below nav"))).alias("relations"))
    after = rows.select(o.alias("id"), F.when(o % 5 == 0, F.array(F.lit("below main"))).otherwise(F.array(F.lit("below nav"))).alias("relations"))
    return layout.relation_changes(before, after)


def _chunk_layer(spark, d):
    """Documents' chunks, and their stored vectors: some documents have none, some old ones, some not all."""
    docs = views.table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cut = shared.write_shared(documents.chunk_documents(docs, bodies=True), "chunks")
    units = cut.select(F.struct("doc_id", "seq").alias("key"), F.concat_ws("\n", "heading_path", "body").alias("text"))
    rows = ranking.hash_embed(units).select("key.doc_id", "key.seq", "embedding")
    i = F.col("doc_id") % 7
    return cut, rows.filter((i != 3) & ((i != 5) | (F.col("seq") % 2 == 1))).withColumn("version", F.when(i == 4, "v0").otherwise("v1"))


@query
def chunk_search_fused(spark, d):
    """Each document's first words asked of its own chunks, by words and by the vectors of a hash embedder; every eleventh query has no vector."""
    cut, layer = _chunk_layer(spark, d)
    layer = shared.write_shared(layer, "chunk-vectors")
    docs = views.table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ask = docs.select("doc_id", F.col("doc_id").alias("query_id"), F.array_join(F.slice(t.tokenize(F.col("text")), 1, 12), " ").alias("query"))
    vectors = ranking.hash_embed(ask.filter("query_id % 11 <> 0").select(F.col("query_id").alias("key"), F.col("query").alias("text"))).withColumnRenamed("key", "query_id")
    red = docs.filter("doc_id % 3 = 0").select("doc_id", F.lit(2).alias("from_line"), F.lit(9).alias("to_line")).unionByName(docs.limit(0).select(F.lit(None).cast("long").alias("doc_id"), F.lit(1).alias("from_line"), F.lit(1).alias("to_line")))
    return documents.search_chunks_fused(cut, ask, red, layer, vectors, "v1")


@query
def redlined_chunks(spark, d):
    """What redlines of all documents and of single ones leave of each document's chunks."""
    docs = views.table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cut = shared.write_shared(documents.chunk_documents(docs, bodies=True), "chunks")
    own = docs.select("doc_id", F.explode(F.array(F.lit(2), F.lit(5), F.lit(5))).alias("from_line")).withColumn("to_line", (F.col("from_line") + F.col("doc_id") % 6).cast("int"))
    every = docs.filter("doc_id % 50 = 0").select(F.lit(None).cast("long").alias("doc_id"), (F.col("doc_id") % 40 + 12).cast("int").alias("from_line"), (F.col("doc_id") % 40 + 12).cast("int").alias("to_line"))
    return documents.read_chunks(cut, own.unionByName(every)).select("doc_id", "seq", "partly_redlined", F.size("kept").alias("words"), F.md5(F.array_join(F.array_sort("kept"), " ")).alias("words_md5"))


@query
def stable_snapshots(spark, d):
    """Orders as nested records whose keys come in two orders: one text for one content."""
    o = views.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    inner = lambda *names: F.struct(*(F.col(n) for n in names))
    one = F.struct(F.array(F.lit(3), F.lit(1)).alias("marks"), inner("o_orderstatus", "o_custkey").alias("facts"), F.col("o_orderpriority").alias("a"))
    two = F.struct(F.col("o_orderpriority").alias("a"), inner("o_custkey", "o_orderstatus").alias("facts"), F.array(F.lit(3), F.lit(1)).alias("marks"))
    return o.select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, t.stable_json(one)).otherwise(t.stable_json(two)).alias("snapshot"))


@query
def hit_lines(spark, d):
    e = views.entries(spark, d).withColumn("notes", governance.annotations())
    return e.filter("title is not null").select("id", F.md5(t.hit_line()).alias("line_md5"))


@query
def text_updates(spark, d):
    e = views.entries(spark, d)
    new = e.filter("id % 9 = 0").select("id", F.when(F.col("id") % 2 == 0, F.col("text")).otherwise(F.concat(F.lit("new "), F.col("text"))).alias("text"), F.lit("rewritten").alias("reason")).filter("trim(text) <> ''")
    return store.update_texts(e, new, views.now()).select("id", F.length("text").alias("chars"), F.size("history").cast("long").alias("events"))


def _bound(spark, d):
    e = views.entries(spark, d)
    return e.withColumn("bindings", F.transform("bindings", lambda x: F.struct(x.alias("path"), F.lit("old").alias("content_hash")))), e.select(F.explode("bindings").alias("path")).distinct().withColumn("hash", F.md5("path"))


@query
def rebound_entries(spark, d):
    e, files_ = _bound(spark, d)
    to = e.filter("tier = 'project' and id % 4 = 0").select("id", F.array(F.concat(F.lit("\\src/mod"), (F.col("id") % 10 * 2).cast("string"), F.lit(".css"))).alias("paths"), F.lit("moved").alias("reason"))
    known = files_.unionByName(to.select(F.explode("paths").alias("path")).distinct().select(F.translate("path", "\\", "").alias("path"), F.md5(F.translate("path", "\\", "")).alias("hash"))).distinct()
    after = store.rebind(e, to, known, views.now(), clear=True)
    return after.select("id", "needs_review", F.array_join(F.transform("bindings", lambda x: F.concat_ws("=", x["path"], x["content_hash"])), ",").alias("bindings"), F.array_join(F.transform("history", lambda x: x["reason"]), ";").alias("reasons"))


@query
def reverified_entries(spark, d):
    e, files_ = _bound(spark, d)
    after = store.reverify(e, e.filter("needs_review").select("id"), files_, views.now(), accept=True)
    return after.select("id", "needs_review", F.size("history").cast("long").alias("events"), F.array_join(F.transform("bindings", lambda x: x["content_hash"]), ",").alias("hashes"))


@query
def added_entries(spark, d):
    e, files_ = _bound(spark, d)
    drafts = e.filter("title is not null and trim(title) <> '' and trim(text) <> ''").select("id", "tier", "kind", "title", "text", F.expr("filter(tags, x -> x is not null)").alias("tags"), F.when(F.col("tier") == "project", F.transform("bindings", lambda x: F.concat(F.lit("/"), x["path"]))).otherwise(F.expr("cast(array() as array<string>)")).alias("bindings"))
    after = store.add_entries(drafts, files_, views.now())
    return after.select("id", "title", "status", JOINED("tags"), F.array_join(F.transform("bindings", lambda x: x["content_hash"]), ",").alias("hashes"), F.size("history").cast("long").alias("events"))


@query
def document_redlines(spark, d):
    e = views.entries(spark, d).filter("mounted_doc is not null")
    docs = e.select(F.col("mounted_doc").alias("doc_id"), (F.col("id") % 20 + 5).cast("int").alias("line_count"))
    _, over = store.redline_lines(e, e.select("id", F.lit(2).alias("from_line"), (F.col("id") % 11 + 2).cast("int").alias("to_line")), docs)
    return over.select("id", SIX("ratio"))


@query
def documents_with_mounts(spark, d):
    docs = views.table(spark, d, "documents").select(F.concat(F.lit("d-"), (F.col("doc_id") - F.col("doc_id") % 3).cast("string")).alias("doc_id")).distinct()
    state = docs.select("doc_id", F.when(F.length("doc_id") % 2 == 0, "current").otherwise("stale").alias("status")).filter("doc_id <> 'd-0'")
    return store.mounted_docs(docs, views.entries(spark, d), state).select("doc_id", F.array_join(F.transform("mounted", lambda x: x.cast("string")), ",").alias("mounted"), "vectors")


@query
def entry_lookup(spark, d):
    e = views.entries(spark, d)
    return store.point_lookup(e, views.queries(spark, d).select(F.col("query_id").alias("id"))).select("id", "status", "kind")


@query
def ranklog_tail(spark, d):
    return files.ranklog_tail(views.ranklog(spark, d), 20).select("row_id", "entry_id", "profile")


@query
def workspace_roster(spark, d):
    c = views.table(spark, d, "customer")
    rows = c.select(F.col("c_custkey").alias("key"), F.when(F.col("c_custkey") % 13 == 0, "").otherwise(F.concat(F.lit("/w/"), "c_name")).alias("root"), (F.col("c_custkey") % 3 > 0).alias("root_exists"), (F.col("c_custkey") % 5 > 0).alias("store_exists"))
    return files.live_workspaces(rows).select("key", "root")


@query
def chunk_excerpts(spark, d):
    """The first lines of each page, every third one redlined."""
    lines = F.split("text", "\n")
    red = F.transform(lines, lambda x, i: i % 3 == 2)
    return _pages(spark, d).select("doc_id", t.excerpt(lines, red, 200).alias("excerpt"))


def _acts(e):
    action = F.element_at(F.array(F.lit("promote"), F.lit("retire"), F.lit("reactivate"), F.lit("rescue"), F.lit("discard")), (F.col("id") % 5 + 1).cast("int"))
    return e.filter("id % 2 = 0").select("id", action.alias("action"), F.when(F.col("id") % 3 == 0, "panel").alias("by"), F.when(F.col("id") % 4 == 0, " checked ").alias("reason"))


@query
def human_acts(spark, d):
    """Entries after people's own acts: status, the last note, and whether the act was refused."""
    e = views.entries(spark, d)
    after, _, refused = store.act(e, views.approvals(spark, d), _acts(e), views.now())
    rows = after.join(refused.select("id", F.lit(True).alias("refused")), "id", "left")
    return rows.select("id", "status", F.try_element_at("history", F.lit(-1))["reason"].alias("note"), F.coalesce("refused", F.lit(False)).alias("refused"))


@query
def settled_requests(spark, d):
    """Every request after people's own acts settled those of their action."""
    e = views.entries(spark, d)
    return store.act(e, views.approvals(spark, d), _acts(e), views.now())[1].select("approval_id", "entry_id", "resolution", "resolved_at")


@query
def attached_documents(spark, d):
    e = views.entries(spark, d)
    i = F.col("id")
    mounts = e.filter("id % 4 = 0").select("id", F.concat(F.lit("d-"), (i + 1).cast("string")).alias("doc_id"), F.when(i % 8 == 0, (i % 9 + 1).cast("int")).alias("from_line"), F.when(i % 8 == 0, (i % 9 + 3).cast("int")).alias("to_line"), F.when(i % 12 == 0, F.col("title")).alias("quote"))
    docs = e.select(F.concat(F.lit("d-"), (i + 1).cast("string")).alias("doc_id"))
    after = store.attach_docs(e, mounts, docs, views.now())
    return after.select("id", "mounted_doc", "doc_anchor.from_line", "doc_anchor.quote", F.try_element_at("history", F.lit(-1))["reason"].alias("note"))


@query
def checked_documents(spark, d):
    """Review flags after mounted documents were held against their files; some were flagged by an earlier check, some by hand."""
    e = views.entries(spark, d).withColumn("review_reason", F.when(F.col("needs_review"), F.when(F.col("id") % 2 == 0, "document: changed before").otherwise("by hand")))
    i = F.col("id")
    docs = e.filter("mounted_doc is not null and id % 7 <> 0").select(F.col("mounted_doc").alias("doc_id"), F.concat(F.lit("doc"), i.cast("string"), F.lit(".md")).alias("path"), F.md5("text").alias("source_hash"))
    found = e.filter("id % 9 <> 0").select(F.concat(F.lit("doc"), i.cast("string"), F.lit(".md")).alias("path"), F.when(i % 4 == 0, "other").otherwise(F.md5("text")).alias("hash"))
    return store.check_docs(e, docs, found).select("id", "needs_review", "review_reason")


def _roster(spark, d):
    k = F.col("c_custkey")
    return views.table(spark, d, "customer").filter("c_custkey % 4 <> 0").select(
        k.alias("key"), F.concat(F.lit("/w/"), "c_name").alias("root"), F.when(k % 3 == 0, "given").otherwise(F.col("c_name")).alias("label"), F.when(k % 2 == 0, "registry").otherwise("cli").alias("origin"),
        F.element_at(F.array(F.lit("live"), F.lit("orphaned"), F.lit("kept")), (k % 3 + 1).cast("int")).alias("state"), (views.now() - F.make_dt_interval(days=F.lit(9))).alias("added_at"), (views.now() - F.make_dt_interval(days=F.lit(3))).alias("last_seen_at"),
    )


@query
def registered_workspaces(spark, d):
    k = F.col("c_custkey")
    seen = views.table(spark, d, "customer").filter("c_custkey % 5 <> 0").select(k.alias("key"), F.concat(F.lit("/x/"), "c_name").alias("root"), F.when(k % 7 == 0, "new").otherwise(F.col("c_name")).alias("label"), F.when(k % 11 < 4, "registry").otherwise("auto").alias("origin"), views.now().alias("at"))
    return roster.register(_roster(spark, d), seen)


@query
def answered_orphans(spark, d):
    """The roster after renames, removals and both answers to orphans."""
    r = _roster(spark, d)
    labels = r.filter("key % 6 = 1").select("key", F.lit(" named ").alias("new_label"))
    after = roster.rename(roster.remove(r, r.filter("key % 10 = 7").select("key")), labels.filter("key % 10 <> 7"), views.now())
    orphans = after.filter("state = 'orphaned'").select("key")
    stored = r.select("key", F.explode(F.array(F.lit("kb"), F.lit("baselines"))).alias("kind")).filter("key % 2 = 1 or kind = 'kb'")
    after, moves = roster.purge(roster.keep(after, orphans.filter("key % 5 < 2")), orphans.filter("key % 5 = 2"), stored, views.now())
    moved = moves.groupBy("key").agg(F.array_join(F.sort_array(F.collect_list(F.concat("from", F.lit(" > "), "to"))), ", ").alias("moved"))
    return after.join(moved, "key", "left").select("key", "label", "state", "last_seen_at", "purged_at", "moved")


@query
def page_findings(spark, d):
    i = F.col("page_id")
    was = views.table(spark, d, "pages").select("page_id", F.lit(1280).alias("width"), F.lit(800).alias("height"), F.lit(2).alias("scale"), F.coalesce(F.length("html"), F.lit(0)).alias("page_height")).withColumn("scrolls", F.col("page_height") > 800)
    now = was.withColumns({"width": F.when(i % 5 == 0, 390).otherwise(F.col("width")), "page_height": F.col("page_height") - F.when(i % 3 == 0, 300).otherwise(0)}).withColumn("scrolls", F.col("page_height") > 800)
    return layout.page_findings(was, now)
