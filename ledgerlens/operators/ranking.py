"""Vector recall, rank fusion and deterministic reranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import params as p
from ledgerlens.functions import text as t
from ledgerlens.operators.leading import QUERY_BLOCK, SLICE, Leading, id_array
from ledgerlens.operators.lexical import factor, top_k
from ledgerlens.operators.shared import write_shared


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int = p.RECALL_DEPTH, floor: float = 0.0, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, key, score, rank): exact cosine of a stated query set against all (key, embedding).

    The queries come in blocks of about ``block``; a block goes to the tasks as one matrix, and each task
    passes on what may be among the best k of a query before anything is shuffled. Vectors of another length score 0.
    """
    types, asked = dict(vectors.dtypes), dict(queries.dtypes)
    queries = write_shared(queries.select("query_id", "embedding"), "query-vectors")
    blocks = max(1, -(-queries.count() // block))
    schema = f"query_id {asked['query_id']}, key {types['key']}, score double"
    found = queries.sparkSession.createDataFrame([], schema)
    for number in range(blocks):
        rows = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == number).collect()
        part = vectors.select("key", "embedding").mapInArrow(_best(rows, k, floor, asked["query_id"]), schema)
        found = found.unionAll(part if blocks == 1 else write_shared(top_k(part, k, F.col("score").desc(), F.col("key")).drop("rank"), "vector-hits"))
    return top_k(found, k, F.col("score").desc(), F.col("key"))


def unit(rows: list, dim: int) -> np.ndarray:
    """Rows of unit length; rows of zeros stay."""
    m = np.array(rows, np.float64).reshape(-1, dim)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _best(queries: list, k: int, floor: float, kind: str):
    """A task's rows that may be among the best k of a query, a slice of rows at a time; equal scores by key."""
    sizes = sorted({len(q["embedding"] or ()) for q in queries})
    ids = [[q["query_id"] for q in queries if len(q["embedding"] or ()) == d] for d in sizes]
    asked = [unit([q["embedding"] or () for q in queries if len(q["embedding"] or ()) == d], d) for d in sizes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Leading(k, len(names)) for names in ids]
        for whole in batches:
            whole = whole.take(pc.sort_indices(whole, [("key", "ascending")]))
            for start in range(0, whole.num_rows, SLICE):
                b = whole.slice(start, SLICE)
                lengths = b.column("embedding").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                for dim, names, q, lead in zip(sizes, ids, asked, best):
                    at = np.flatnonzero(lengths == dim)
                    if floor < 0:  # vectors of other lengths count as 0
                        at = np.arange(len(lengths))
                    if not len(at) or not len(names):
                        continue
                    own = lengths[at] == dim
                    scores = np.zeros((len(at), len(names)))
                    if own.any() and dim:
                        scores[own] = unit(b.column("embedding").take(pa.array(at[own])).flatten().to_numpy(zero_copy_only=False), dim) @ q.T
                    scores = np.floor(scores * 1e6 + 0.5) / 1e6
                    row, column = lead.take(scores, floor)
                    keys = b.column("key").take(pa.array(at[row]))
                    yield pa.RecordBatch.from_arrays([id_array(names, kind).take(pa.array(column)), keys, pa.array(scores[row, column])], ["query_id", "key", "score"])

    return run


def hash_embed(texts: DataFrame, dim: int = p.EMBED_DIM) -> DataFrame:
    """(key, embedding) of (key, text): signed hashed token counts of unit length, an embedder without semantics.

    A slice of texts is worked on at a time; each of its different tokens is hashed once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                b = whole.slice(start, SLICE)
                token = b.column("tokens").flatten().dictionary_encode()
                places = np.array([_place(x, dim) for x in token.dictionary.to_pylist()], np.int64).reshape(-1, 2)[token.indices.to_numpy()]
                row = np.repeat(np.arange(b.num_rows), b.column("tokens").value_lengths().fill_null(0).to_numpy())
                out = np.bincount(row * dim + places[:, 0], places[:, 1], b.num_rows * dim).astype(np.float32).reshape(-1, dim)
                norm = np.linalg.norm(out, axis=1, keepdims=True)
                out = np.divide(out, norm, out=out, where=norm > 0)
                ends = pa.array(np.arange(0, out.size + 1, dim, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([b.column("key"), pa.ListArray.from_arrays(ends, pa.array(out.ravel()))], ["key", "embedding"])

    kind = dict(texts.dtypes)["key"]
    return texts.select("key", t.tokenize(F.col("text")).alias("tokens")).mapInArrow(run, f"key {kind}, embedding array<float>")


# Start and factor of the two hashes, of which the first picks the place and the second the sign.
SLOT_HASH, SIGN_HASH = (0x811C9DC5, 0x01000193), (0x9E3779B9, 0x85EBCA6B)


def _place(token: str, dim: int) -> tuple[int, int]:
    """Where a token counts, and its sign."""
    slot, sign = SLOT_HASH[0], SIGN_HASH[0]
    for i, c in enumerate(map(ord, token)):
        slot = (slot ^ c) * SLOT_HASH[1] & 0xFFFFFFFF
        sign = (sign ^ (c + i)) * SIGN_HASH[1] & 0xFFFFFFFF
    return slot % dim, -1 if sign & 1 else 1


def embed_plan(units: DataFrame, cache: DataFrame, version: str) -> DataFrame:
    """(key, cache_key, cached) of units (key, text), against a cache (version, cache_key)."""
    own = cache.filter(F.col("version") == version).select("cache_key").distinct().withColumn("cached", F.lit(True))
    return units.select("key", t.cache_key(F.col("text")).alias("cache_key")).join(own, "cache_key", "left").select("key", "cache_key", F.coalesce("cached", F.lit(False)).alias("cached"))


def build_vectors(units: DataFrame, cache: DataFrame, version: str, embed: Callable[[list[str]], list[list[float]]], batch: int = 64) -> DataFrame:
    """(version, cache_key, vector) to append to the cache: each missing text once, in batches, halved where a batch fails."""
    missing = embed_plan(units, cache, version).filter("not cached").select("cache_key").distinct()
    texts = units.select(t.embed_normalize(F.col("text")).alias("text")).distinct().withColumn("cache_key", F.sha2("text", 256)).join(missing, "cache_key")

    def attempt(keys: list[str], texts: list[str], depth: int) -> list[tuple[str, list[float] | None]]:
        for _ in range(2):
            try:
                return list(zip(keys, embed(texts), strict=True))
            except Exception:  # noqa: BLE001  a port may fail in any way; what stays without a vector is reported
                continue
        if depth == 0 or len(keys) == 1:
            return [(k, None) for k in keys]
        half = len(keys) // 2
        return attempt(keys[:half], texts[:half], depth - 1) + attempt(keys[half:], texts[half:], depth - 1)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), batch):
                part = f.iloc[at : at + batch]
                done = attempt(part["cache_key"].tolist(), part["text"].tolist(), 3)
                yield pd.DataFrame({"cache_key": [k for k, _ in done], "vector": [v for _, v in done]})

    return texts.select("cache_key", "text").mapInPandas(run, "cache_key string, vector array<float>").withColumn("version", F.lit(version))


def fuse(ranked: DataFrame, k: int = p.RRF_K) -> DataFrame:
    """Reciprocal rank fusion of (query_id, channel, weight, rank, key).

    A key counts once in a channel, at its best rank. Gives fused, best_rank, each channel's
    rank (ranks) and share (shares), and the fused position.
    """
    once = ranked.groupBy("query_id", "channel", "key").agg(F.min("rank").alias("rank"), F.max("weight").alias("weight"))
    share = F.col("weight") / (k + F.col("rank"))
    out = once.groupBy("query_id", "key").agg(
        t.round_half_up(F.sum(share), 9).alias("fused"), F.min("rank").alias("best_rank"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("channel", "rank")))).alias("ranks"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("channel"), share.alias("share"))))).alias("shares"),
    )
    w = Window.partitionBy("query_id").orderBy(F.col("fused").desc(), "best_rank", "key")
    return out.withColumn("position", F.row_number().over(w))


def quota(fused: DataFrame, most: int, channel: str = "lexical") -> DataFrame:
    """Fused rows, at most ``most`` of each query that ``channel`` did not find; order is kept."""
    w = Window.partitionBy("query_id").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    alone = (~F.map_contains_key("ranks", channel)).cast("int")
    return fused.withColumn("alone", F.sum(alone).over(w)).filter((alone == 0) | (F.col("alone") <= most)).drop("alone")


def rank_share(rank: Column, pool: Column) -> Column:
    """1 for the first of a pool down to 0 for the last; 1 in a pool of one, 0 without a rank."""
    return F.when(rank.isNull() | (rank < 1), 0.0).when(pool <= 1, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - (rank - 1) / F.greatest(pool - 1, F.lit(1)))))


def semantic_norms(candidates: DataFrame) -> DataFrame:
    """Add semantic_by_rank and semantic_minmax, each over the query's candidates that have a cosine."""
    by = Window.partitionBy("query_id")
    has = F.col("semantic").isNotNull()
    n = F.count("semantic").over(by)
    rn = F.row_number().over(by.orderBy(F.col("semantic").desc_nulls_last(), "id"))
    low, high = F.min("semantic").over(by), F.max("semantic").over(by)
    return candidates.withColumns({
        "semantic_by_rank": F.when(has, rank_share(rn, n)).otherwise(0.0),
        "semantic_minmax": F.when(~has, 0.0).when(high - low <= 1e-9, 1.0).otherwise((F.col("semantic") - low) / F.nullif(high - low, F.lit(0.0))),
    })


def rerank(
    candidates: DataFrame,
    now: Column,
    scores: DataFrame | None = None,
    changed: list[str] | None = None,
    normalization: str = "candidates",
    semantic_scale: str = "raw",
    semantic_mode: str = "raw",
    missing: str = "zero",
    min_spread: float = 0.0,
    weights: dict[str, float] | None = None,
) -> DataFrame:
    """Score candidates by weighted features times governance factors, and explain it.

    ``candidates``: query_id, query, raw (lexical), n_matched, n_tokens, semantic, semantic_rank,
    fused_rank, and the entry's columns. ``scores``: (entry_id, window_score). Adds features,
    contributions and factors as maps, and score (4 places).
    """
    w = {**p.FEATURE_WEIGHTS, **(weights or {})}
    by = Window.partitionBy("query_id")
    rows = semantic_norms(candidates)
    if scores is not None:
        rows = rows.join(scores, rows.id == scores.entry_id, "left").drop("entry_id")
    else:
        rows = rows.withColumn("window_score", F.lit(None).cast("double"))
    best = F.max("raw").over(by)
    positive = F.filter(F.array_sort(F.collect_list("raw").over(by)), lambda x: x > 0)
    pool = F.when(F.size(positive) < 3, F.try_element_at(positive, F.lit(-1))).otherwise(t.percentile_discrete(positive, 0.9))
    scale = F.col("scale") if "scale" in rows.columns else pool
    bm25 = F.when(F.col("raw") <= 0, 0.0).otherwise(F.col("raw") / (F.col("raw") + F.greatest(scale, F.lit(1e-9)))) if normalization == "absolute" else F.when(best > 0, F.col("raw") / best).otherwise(0.0)
    cosine = F.coalesce("semantic", F.lit(0.0))
    scaled = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (cosine - p.SEMANTIC_FLOOR) / (p.SEMANTIC_CEIL - p.SEMANTIC_FLOOR))) if semantic_scale == "calibrated" else cosine
    semantic = {"raw": scaled, "rank": F.col("semantic_by_rank"), "minmax": F.col("semantic_minmax")}[semantic_mode]
    descending = F.reverse(F.array_sort(F.filter(F.collect_list("semantic").over(by), lambda x: x.isNotNull())))
    spread = F.try_element_at(descending, F.lit(1)) - F.try_element_at(descending, F.floor(F.size(descending) / 2).cast("int") + 1)
    gated = F.coalesce(spread < min_spread, F.lit(False)) if min_spread > 0 else F.lit(False)
    body = t.redline(F.col("text"), F.col("redlines"))
    haystack = F.lower(t.collapse(F.concat_ws(" ", "title", F.array_join("tags", " "), body)))
    age = F.greatest(F.lit(0), F.timestamp_diff("SECOND", F.coalesce("last_referenced_at", "created_at"), now)) / 86_400
    files = F.array_distinct(F.array(*(F.lit(x) for x in changed or []))) if changed else None
    involved = F.size(F.filter(F.transform("bindings", t.posix_path), lambda x: F.array_contains(files, x))) / float(len(set(changed))) if changed else F.lit(0.0)
    features = {
        "bm25ish": bm25,
        "exactPhrase": t.exact_phrase(haystack, F.col("query")),
        "semantic": F.when(gated, 0.0).otherwise(semantic),
        "specificity": F.when(F.col("n_tokens") > 0, F.col("n_matched") / F.col("n_tokens")).otherwise(0.0),
        "bindingOverlap": involved,
        "redlineRatio": t.redline_ratio(F.col("text"), F.col("redlines")),
        "freshness": F.coalesce(F.pow(F.lit(0.5), age / p.FRESHNESS_HALF_LIFE_DAYS), F.lit(0.0)),
        "signalScore": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("window_score", F.lit(0.0)) / p.TRUST_THRESHOLD)),
        "docMountBonus": F.col("mounted_doc").isNotNull().cast("double"),
        "semanticRank": rank_share(F.col("semantic_rank"), F.count("semantic_rank").over(by)),
        "fusedRank": rank_share(F.col("fused_rank"), F.count("*").over(by)),
        "semanticAbsent": F.col("semantic").isNull().cast("double"),
    }
    rows = rows.withColumns({f"f_{k}": v.cast("double") for k, v in features.items()})
    absent = {"semantic": "semantic", "semanticRank": "semantic_rank"} if missing == "absent" else {}
    term = lambda k: F.when(F.col(absent[k]).isNull(), 0.0).otherwise(F.col(f"f_{k}") * w[k]) if k in absent else F.col(f"f_{k}") * w[k]
    as_map = lambda value: F.create_map(*(x for k in features for x in (F.lit(k), value(k))))
    return rows.withColumns({
        "features": as_map(lambda k: F.col(f"f_{k}")),
        "contributions": as_map(term),
        "factors": F.create_map(F.lit("status"), F.coalesce(*(F.when(F.col("status") == s, f) for s, f in p.STATUS_FACTOR.items()), F.lit(0.0)), F.lit("tier"), F.coalesce(*(F.when(F.col("tier") == s, f) for s, f in p.TIER_FACTOR.items()), F.lit(1.0)), F.lit("review"), F.when(F.col("needs_review"), p.REVIEW_FACTOR).otherwise(1.0)),
        "score": t.round_half_up(sum((term(k) for k in features), F.lit(0.0)) * factor(), 4),
    })


def explain(reranked: DataFrame) -> DataFrame:
    """Add ``lines``: each non-zero contribution and factor in words, the strongest first."""
    shown = F.filter(F.map_entries("contributions"), lambda e: e["value"] != 0)
    shown = F.array_sort(shown, lambda a, b: F.when(F.abs(a["value"]) > F.abs(b["value"]), -1).when(F.abs(a["value"]) < F.abs(b["value"]), 1).when(a["key"] < b["key"], -1).otherwise(1))
    lines = F.transform(shown, lambda e: F.format_string("%s %+.4f", e["key"], e["value"]))
    factors = F.transform(F.filter(F.map_entries("factors"), lambda e: e["value"] != 1), lambda e: F.format_string("%s x%.2f", e["key"], e["value"]))
    return reranked.withColumn("lines", F.concat(lines, factors))


def permuted(baseline: DataFrame, answers: DataFrame) -> DataFrame:
    """A model's order (query_id, raw answer with {"order": [ids]}) over a baseline (query_id, id, rank): named ids first, the rest as they were."""
    order = F.from_json(t.lenient_json(F.col("raw")), "order array<string>")["order"]
    named = answers.select("query_id", F.posexplode(F.array_distinct(order)).alias("pos", "named_id"))
    rows = baseline.join(named, (baseline.query_id == named.query_id) & (baseline.id.cast("string") == named.named_id), "left").drop(named.query_id)
    w = Window.partitionBy("query_id").orderBy(F.col("pos").asc_nulls_last(), "rank")
    return rows.withColumn("final_rank", F.row_number().over(w)).drop("pos", "named_id")
