"""The registered queries of the numbered operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import audio, chunk_dedup, collocations, decontaminate, fill_middle, language, mixing, pii, quality, quality_rules, sharding, simhash, token_counts
from ledgerlens.llm.common import table

ERROR_RATE = 0.08
SHARDS = 8
SEED = 7
MAX_EPOCHS = 4
FIM_SEED, FIM_PERCENT, FIM_SPM_PERCENT = 42, 50, 80
#: The corpus is read once over: as many tokens as it has.
SHARE = (1, 1)
#: Weights of the mixture; 1 where none is given.
WEIGHTS = {
    "web": 5, "reference": 3, "forum": 2,
    **{f"{d}/{lang}": w for d in ("web", "reference", "forum") for lang, w in (("en", 5), ("de", 2), ("fr", 2), ("es", 1))},
}


def domain_of(source: str = "source") -> F.Column:
    """web: src0 to src9; reference: src10 to src14; forum: all others."""
    number = F.try_to_number(F.regexp_extract(F.coalesce(F.col(source), F.lit("")), "^src([0-9]{1,4})$", 1), F.lit("9999")).cast("int")
    return F.when(number <= 9, "web").when(number <= 14, "reference").otherwise("forum")


def bucket(column: str, n: int) -> F.Column:
    """crc32 of the number as text, modulo n; null numbers count as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ERROR_RATE)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.filter(bucket("doc_id", 5) != 0).filter("lang is not null"))
    return language.predict(docs, model).select("doc_id", (bucket("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "family")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), domain_of(), WEIGHTS, SHARE, MAX_EPOCHS, SEED)
    return mixed.select("doc_id", F.col("mix_domain").alias("domain"), F.col("mix_lang").alias("lang"), F.col("mix_source").alias("source"), F.col("mix_tokens").alias("tokens"), F.col("mix_epoch").alias("epoch"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    plain = F.filter("spans", lambda s: s["plain"])
    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(text(plain).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def op7_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = audio.audio_features(audio.encode_media(table(spark, sf_dir, "documents")))
    feature = F.concat_ws(";", F.concat(F.lit("tensors="), F.col("tensors").cast("string")), F.concat(F.lit("segments="), F.size("segments").cast("string")), F.concat(F.lit("sha256="), F.sha2("features", 256)))
    return found.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32",
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"),
    )


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def quality_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> quality.Model:
    return quality.fit(docs, table(spark, sf_dir, "labels"), bucket("label_id", 3) != 1)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality_model(spark, sf_dir, docs))
    return scored.select("doc_id", (bucket("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op10_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunk_dedup.repeated_passages(table(spark, sf_dir, "documents"))
    dropped = F.aggregate("drops", F.lit(0), lambda a, d: a + d["end"] - d["start"])
    return found.select("doc_id", "start", "end", "words", "first_doc_id", dropped.alias("dropped_chars"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"), FIM_SEED, FIM_PERCENT, FIM_SPM_PERCENT)
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return rows.select(
        "doc_id", "n", "form", F.char_length("prefix").cast("long").alias("prefix_chars"), F.char_length("middle").cast("long").alias("middle_chars"),
        digest(F.col("output")).alias("output_sha256"), digest(fill_middle.restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the held-out third (as in op9) are never seen."""
    stats = quality_rules.statistics(table(spark, sf_dir, "documents"))
    rules = quality_rules.learn(stats, table(spark, sf_dir, "labels"), bucket("label_id", 3) != 1)
    rows = quality_rules.apply_rules(stats, rules)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule", (bucket("doc_id", 3) == 1).alias("held_out"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontamination, op2_token_counts, op3_language_id, op4_sharding, op5_mixing, op6_personal_data, op7_audio_features, op8_simhash, op9_quality, op10_chunk_dedup,
        op11_fill_middle, op12_quality_rules, op13_collocations,
    )
}

_CASES = " ".join(f"when '{k}' then {v}" for k, v in WEIGHTS.items())


def _share_out(n: int, parent: str, name: str) -> str:
    """CTEs that share a parent's budget among its children, held to capacities."""
    by = f"partition by {parent}" if parent else "partition by 1"
    order = f"order by case when w > 0 then cap / w else 'infinity'::double end, {name}"
    return f"""
    a{n} as (select *, coalesce(sum(cap) over ({by} {order} rows between unbounded preceding and 1 preceding), 0) as cap_before,
             sum(w) over ({by}) - coalesce(sum(w) over ({by} {order} rows between unbounded preceding and 1 preceding), 0) as w_left from n{n}),
    b{n} as (select *, (w > 0 and cap::hugeint * w_left <= w::hugeint * (budget - cap_before)) as is_full from a{n}),
    c{n} as (select *, budget - coalesce(sum(case when is_full then cap end) over ({by}), 0) as rest, coalesce(sum(case when not is_full then w end) over ({by}), 0) as open_w from b{n}),
    g{n} as (select *, (case when is_full then cap when open_w = 0 then 0 else (rest::hugeint * w) // open_w end)::bigint as granted from c{n})"""


ORACLE_SQL: dict[str, str] = {
    "op4_sharding": """
    with bits as (select list(c order by i) as tab from (select i, list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from (select unnest(range(256)) as i))),
    s as (select doc_id, (octet_length(encode(coalesce(text, ''))) + 1)::bigint as size, hex(encode(coalesce(text, ''))) as h from documents),
    p as (select *, coalesce(sum(size) over (order by doc_id nulls first rows between unbounded preceding and 1 preceding), 0)::hugeint as before, sum(size) over ()::hugeint as total from s),
    w as (select *, least(7, ((2 * before + size) * 8) // (2 * total))::int as shard from p)
    select doc_id, size, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, len(h), 2), lambda i: ('0x' || h[i + 1:i + 2])::bigint)),
      lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) as text_crc32, 'bytes' as law, shard, (row_number() over (partition by shard order by doc_id nulls first) - 1)::bigint as slot, null::int as grown_shard from w, bits""",
    "op5_mixing": f"""
    with d as (select doc_id, coalesce(lang, '(none)') as l, coalesce(source, '(none)') as s, coalesce(text, '') as t,
               coalesce(try_cast(regexp_extract(coalesce(source, ''), '^src([0-9]{{1,4}})$', 1) as int), 9999) as num from documents),
    r as (select doc_id, case when num <= 9 then 'web' when num <= 14 then 'reference' else 'forum' end as d, l, s,
          len(regexp_extract_all(t, '[^ \\t-\\r]+'))::bigint as tokens, ('0x' || substr(md5(t), 1, 15))::bigint as digest from d),
    leaves as (select d, l, s, sum(tokens)::bigint as tokens, sum(tokens)::bigint * {MAX_EPOCHS} as cap from r group by all),
    n1 as (select d, sum(cap)::bigint as cap, case d {_CASES} else 1 end as w, (select sum(tokens)::bigint * {SHARE[0]} // {SHARE[1]} from leaves) as budget from leaves group by d),
    {_share_out(1, "", "d")},
    n2 as (select d, l, sum(cap)::bigint as cap, case d || '/' || l {_CASES} else 1 end as w, any_value(granted) as budget from leaves join (select d, granted from g1) using (d) group by d, l),
    {_share_out(2, "d", "l")},
    n3 as (select d, l, s, tokens, leaves.cap, case d || '/' || l || '/' || s {_CASES} else 1 end as w, granted as budget from leaves join (select d, l, granted from g2) using (d, l)),
    {_share_out(3, "d, l", "s")},
    plan as (select d, l, s, case when tokens > 0 then granted // tokens else 0 end as full_epochs, case when tokens > 0 then granted % tokens else 0 end as left_over from g3),
    k as (select r.*, full_epochs, left_over,
          ('0x' || substr(md5(concat_ws(':', '{SEED}', full_epochs::varchar, coalesce(doc_id::varchar, '-'), digest::varchar)), 1, 15))::bigint as spot from r join plan using (d, l, s)),
    q as (select *, sum(tokens) over (partition by d, l, s order by spot range between unbounded preceding and current row exclude group) as before from k),
    m as (select *, full_epochs + (case when left_over > 0 and coalesce(before, 0) < left_over then 1 else 0 end) as times from q)
    select doc_id, d as domain, l as lang, s as source, tokens, unnest(range(times::bigint))::bigint as epoch from m""",
    "op11_fill_middle": f"""
    with u as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') as units,
               sha256('{FIM_SEED}:' || coalesce(doc_id::varchar, '')) as h from documents),
    k as (select *, len(units)::bigint as n, ('0x' || substr(h, 1, 8))::bigint as h1, ('0x' || substr(h, 9, 8))::bigint as h2, ('0x' || substr(h, 17, 8))::bigint as h3, ('0x' || substr(h, 25, 8))::bigint as h4 from u),
    c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
          case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= {FIM_PERCENT} then 'plain' when h4 % 100 < {FIM_SPM_PERCENT} then 'spm' else 'psm' end as form from k),
    p as (select *, coalesce(array_to_string(units[1:a], ''), '') as pre, coalesce(array_to_string(units[a + 1:b], ''), '') as mid, coalesce(array_to_string(units[b + 1:], ''), '') as suf from c),
    o as (select *, case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end as out from p)
    select doc_id, n, form, case when form <> 'plain' then length(pre) end::bigint as prefix_chars, case when form <> 'plain' then length(mid) end::bigint as middle_chars, sha256(out) as output_sha256,
      sha256(case form when 'plain' then out when 'psm' then regexp_extract(out, '(?s)^<P>(.*)<S>(.*)<M>(.*)$', 1) || regexp_extract(out, '(?s)^<P>(.*)<S>(.*)<M>(.*)$', 3) || regexp_extract(out, '(?s)^<P>(.*)<S>(.*)<M>(.*)$', 2)
        else regexp_extract(out, '(?s)^<S>(.*)<P>(.*)<M>(.*)$', 2) || regexp_extract(out, '(?s)^<S>(.*)<P>(.*)<M>(.*)$', 3) || regexp_extract(out, '(?s)^<S>(.*)<P>(.*)<M>(.*)$', 1) end) as restored_sha256 from o""",
    "op13_collocations": """
    with pieces as (select lang, row_number() over () as piece, regexp_extract_all(p, '[^\\x20\\x09]+') as words from (select coalesce(lang, 'und') as lang,
        unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as p from documents)),
    t as (select lang, piece, unnest(words) as w1, generate_subscripts(words, 1) as i from pieces),
    g as (select lang, w1, lead(w1) over w as w2, lead(w1, 2) over w as w3 from t window w as (partition by piece order by i)),
    f1 as (select lang, w1, count(*)::hugeint as f from g group by all),
    f2 as (select lang, w1, w2, count(*)::hugeint as f from g where w2 is not null group by all),
    f3 as (select lang, w1, w2, w3, count(*)::hugeint as f from g where w3 is not null group by all having count(*) >= 10),
    totals as (select lang, sum(f)::bigint as n from f1 group by lang),
    inner2 as (select lang, w1, w2, max(f) as longer from (select lang, w1, w2, f from f3 union all select lang, w2, w3, f from f3) group by all),
    two as (select f2.lang, f2.w1 || ' ' || f2.w2 as phrase, f2.f as a, x.f as l, y.f as r from f2 join f1 x on x.lang = f2.lang and x.w1 = f2.w1 join f1 y on y.lang = f2.lang and y.w1 = f2.w2
            left join inner2 i on i.lang = f2.lang and i.w1 = f2.w1 and i.w2 = f2.w2 where f2.f >= 10 and (longer is null or 100 * longer < 50 * f2.f)),
    cuts as (select f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3 as phrase, f3.f as a, x.f as l1, yz.f as r1, xy.f as l2, z.f as r2 from f3
             join f1 x on x.lang = f3.lang and x.w1 = f3.w1 join f1 z on z.lang = f3.lang and z.w1 = f3.w3
             join f2 xy on xy.lang = f3.lang and xy.w1 = f3.w1 and xy.w2 = f3.w2 join f2 yz on yz.lang = f3.lang and yz.w1 = f3.w2 and yz.w2 = f3.w3),
    three as (select lang, phrase, a, case when early then l1 else l2 end as l, case when early then r1 else r2 end as r from (select *, (1000000 * a * a) // (l1 * r1) <= (1000000 * a * a) // (l2 * r2) as early from cuts)),
    every as (select *, (1000000 * a * a) // (l * r) as score from (select * from two union all select * from three)),
    ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from every)
    select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n, score::bigint as score from ranked join totals using (lang) where rank <= 2000""",
}
