"""Mixing sources to target weights by hierarchical budgeting (DataFrame operations only).

The corpus is a tree: domain, language, source. A token budget runs down from the root: the
children of a node share its budget by their weights, but none gets more than its capacity
(its tokens times ``max_epochs``). What a child cannot take goes to its siblings first; only
when a whole subtree is short does the rest reach the siblings of its ancestors, since a
node's budget never exceeds its subtree's capacity. Each leaf then reads its documents in
seeded epochs, each a new order, up to its budget: whole epochs take all its documents, the
last one a prefix by tokens, up to and with the document that reaches the budget.

Orders come from a hash of seed, epoch, doc_id and the text's MD5; rows that agree in
those are drawn together. Null domain, language or source is the node ``(none)``. Weights are
non-negative integers, 1 where none is given; weight 0 takes nothing. Leaves without tokens
yield nothing. Columns named ``mix_...`` are the operator's own. Shares are rounded down, so a node may leave fewer tokens than it has children.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import body, materialize, prefix_sums, quoted, unused

LEVELS = ["mix_domain", "mix_lang", "mix_source"]
#: A token, for budgets, is a run of characters other than ASCII white space.
TOKEN = r"[^ \t-\r]+"


def count_tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN)).cast("long")


def digest(text: Column) -> Column:
    """60 bits of a string's MD5."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def draw(epoch: Column, doc_id: Column, text_digest: Column, seed: int) -> Column:
    """A document's place in an epoch's order."""
    return digest(F.concat_ws(":", F.lit(str(int(seed))), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("-")), text_digest.cast("string")))


def _weight(path: Column, weights: dict[str, int]) -> Column:
    if not weights:
        return F.lit(1).cast("long")
    known = F.create_map(*(x for k, v in sorted(weights.items()) for x in (F.lit(k), F.lit(int(v)).cast("long"))))
    return F.coalesce(F.try_element_at(known, path), F.lit(1).cast("long"))


def share_out(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Add ``granted`` to nodes (parent..., name, cap, w, budget): the parent's budget by weight, held to capacities.

    In the order of capacity for a unit of weight, nodes that the remaining budget would fill
    get their capacity; the others share what is left by weight.
    """
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = [F.when(F.col("w") > 0, F.col("cap") / F.col("w")).otherwise(F.lit(float("inf"))), F.col(name)]
    before = by.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    nodes = nodes.withColumns({
        "cap_before": F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "w_left": F.sum("w").over(by) - F.coalesce(F.sum("w").over(before), F.lit(0)),
    })
    nodes = nodes.withColumn("full", F.expr("w > 0 and cast(cap as decimal(38,0)) * w_left <= cast(w as decimal(38,0)) * (budget - cap_before)"))
    nodes = nodes.withColumns({
        "rest": F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(by), F.lit(0)),
        "open_w": F.coalesce(F.sum(F.when(~F.col("full"), F.col("w"))).over(by), F.lit(0)),
    })
    granted = "case when full then cap when open_w = 0 then 0L else cast(cast(rest as decimal(38,0)) * w div open_w as bigint) end"
    return nodes.withColumn("granted", F.expr(granted)).drop("cap_before", "w_left", "full", "rest", "open_w")


def budgets(leaves: DataFrame, weights: dict[str, int], budget: int, max_epochs: int) -> DataFrame:
    """Leaves (domain, language, source, tokens) with ``granted`` tokens, ``full_epochs`` and ``rest``."""
    d, l, s = LEVELS
    leaves = leaves.withColumn("cap", F.col("tokens") * int(max_epochs))
    path = lambda n: F.concat_ws("/", *LEVELS[:n])
    level = leaves.groupBy(d).agg(F.sum("cap").alias("cap")).withColumn("w", _weight(path(1), weights)).withColumn("budget", F.lit(int(budget)).cast("long"))
    level = share_out(level, [], d).select(d, F.col("granted").alias("budget"))
    for n, name in ((2, l), (3, s)):
        up = LEVELS[: n - 1]
        nodes = leaves.groupBy(*LEVELS[:n]).agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens")).withColumn("w", _weight(path(n), weights))
        level = share_out(nodes.join(level, up), up, name).select(*LEVELS[:n], *["tokens"][: n - 2], F.col("granted").alias("budget"))
    return level.select(
        *LEVELS, "tokens", F.col("budget").alias("granted"),
        F.expr("case when tokens > 0 then budget div tokens else 0L end").alias("full_epochs"),
        F.expr("case when tokens > 0 then budget % tokens else 0L end").alias("rest"),
    )


def mix(
    docs: DataFrame,
    domain: Column,
    weights: dict[str, int],
    share: tuple[int, int] = (1, 1),
    max_epochs: int = 4,
    seed: int = 7,
    tokens: Column | None = None,
) -> DataFrame:
    """All columns of ``docs`` and mix_domain, mix_lang, mix_source, mix_tokens, mix_epoch: one row for each time a document is read.

    Where ``docs`` has a column of such a name already, it stays, and the new one has an underscore more. The budget is ``share`` (a fraction) of all tokens. ``weights`` has paths such as
    ``web``, ``web/en``, ``web/en/src0``.
    """
    text = body()
    leaf = [F.coalesce(c.cast("string"), F.lit("(none)")) for c in (domain, F.col("lang"), F.col("source"))]
    own = {**dict(zip(LEVELS, leaf)), "mix_tokens": count_tokens(text) if tokens is None else tokens.cast("long"), "mix_digest": digest(text)}
    names = dict(zip([*own, "mix_epoch", "mix_full", "mix_cut"], unused(docs, *own, "mix_epoch", "mix_full", "mix_cut")))
    marked = docs.withColumns({names[k]: v for k, v in own.items()})
    rows = materialize(marked.select(F.col("doc_id").alias("mix_id"), *(F.col(names[k]).alias(k) for k in own)), "mix-rows")
    leaves = rows.groupBy(*LEVELS).agg(F.sum("mix_tokens").alias("tokens"))
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    plan = materialize(budgets(leaves, weights, total * share[0] // share[1], max_epochs), "mix-plan")
    draws = rows.join(plan, LEVELS).filter("rest > 0").select(
        *LEVELS, "rest", draw(F.col("full_epochs"), F.col("mix_id"), F.col("mix_digest"), seed).alias("at"), "mix_tokens"
    )
    draws = draws.groupBy(*LEVELS, "at").agg(F.sum("mix_tokens").alias("size"), F.max("rest").alias("rest"))
    cuts = prefix_sums(draws, LEVELS, [F.col("at")], ["size"], "mix-draws").filter("before_size < rest").groupBy(*LEVELS).agg(F.max("at").alias("cut"))
    plan = plan.join(cuts, LEVELS, "left").select(*(F.col(k).alias(names[k]) for k in LEVELS), F.col("full_epochs").alias(names["mix_full"]), F.col("cut").alias(names["mix_cut"]))
    plan = materialize(plan, "mix-cuts")
    full, cut = F.col(names["mix_full"]), F.col(names["mix_cut"])
    last = cut.isNotNull() & (draw(full, F.col("doc_id"), F.col(names["mix_digest"]), seed) <= cut)
    times = full + last.cast("long")
    chosen = marked.join(plan, [names[k] for k in LEVELS]).withColumn(names["mix_epoch"], F.explode(F.when(times > 0, F.sequence(F.lit(0).cast("long"), times - 1))))
    return chosen.select(*quoted(docs), *(names[k] for k in (*LEVELS, "mix_tokens", "mix_epoch")))
