"""Quality rules: countable statistics of texts, fixed limits, and a learned decision list (DataFrame functions only).

``statistics`` counts words, symbols, repeated lines and windows of each text. ``learn`` grows a decision list from
labelled statistics by sequential covering: a rule is a conjunction of thresholds that picks bad rows; conditions
are added while they sharpen it on two thirds of the rows it is grown on, then dropped again while that helps on
the other third; rows that a rule covers leave, and the next rule is learned on the rest. Each step is one grouped count
over all labelled rows, of which only counts of (statistic, bin, class) come back: at most (bins + 1) x statistics x 2
numbers, whatever the number of rows. ``verdict`` is the list as one ordered conditional expression.

A null or empty text has no words and counts of 0 (ratios 0); base limits reject it. Ties between conditions
go to the earlier statistic and the lower bin. Repeated rows get equal results and each keep a row; several labels of one id
count as good if one of them is. Without rows of both classes no rule is learned. A doc_id that is no number is null and
has no label. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import doc_number, id_and_text, materialize

# Words, symbols, the width of a window, and the base limits.
WORD, SYMBOLS, WINDOW = r"[^\x20\x09-\x0D]+", "#*$%&|<>", 5
LEAST_WORDS, MOST_REPEATED_PERCENT = 10, 20

#: What rules may ask about: name and value, as expressions over the columns of ``statistics``.
FEATURES = {
    "n_words": "n_words",
    "word_length": "word_chars / n_words",
    "symbols_per_word": "n_symbols / n_words",
    "repeated_words": "n_repeat_words / n_words",
    "repeated_lines": "n_dup_lines / n_lines",
    "different_words": "n_different / n_words",
    "digits": "n_digits / word_chars",
    "letters": "n_letters / word_chars",
    "capitals": "n_capitals / word_chars",
    "marks_per_word": "n_marks / n_words",
    "words_per_line": "n_words / n_lines",
}
BINS = 64


def with_repeated_words(rows: DataFrame) -> DataFrame:
    """Add n_repeat_words: how many of ``words`` stand in windows of five that the text has twice or more, the first one included.

    Hashes of all windows show most texts to have none: equal windows have equal hashes, so if all hashes differ so do
    the windows. Of the other texts the windows themselves are sorted, and equal neighbours give the places. Each step
    is a column of its own, so that no lambda makes an array again for each element.
    """
    words, n = F.col("words"), F.size("words")
    places, five = F.sequence(F.lit(0), n - WINDOW), lambda i: [F.get(words, i + k) for k in range(WINDOW)]
    rows = rows.withColumn("hashes", F.when(n > WINDOW, F.transform(places, lambda i: F.xxhash64(*five(i)))))
    rows = rows.withColumn("again", F.size(F.array_distinct("hashes")) < F.size("hashes")).drop("hashes")
    placed = F.array_sort(F.transform(places, lambda i: F.struct(F.concat_ws(" ", *five(i)).alias("w"), i.alias("i"))))
    rows = rows.withColumn("windows", F.when(F.col("again"), placed))
    windows = F.col("windows")
    same = lambda x, j: F.coalesce(F.get(windows, j)["w"] == x["w"], F.lit(False))
    twice = F.transform(windows, lambda x, j: F.when(same(x, j - 1) | same(x, j + 1), x["i"]))
    rows = rows.withColumn("places", F.array_sort(F.array_compact(twice))).drop("windows", "again")
    places = F.col("places")
    covered = F.transform(places, lambda x, j: F.least(F.coalesce(F.get(places, j + 1) - x, F.lit(WINDOW)), F.lit(WINDOW)))
    return rows.withColumn("n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0), lambda total, x: total + x), F.lit(0)).cast("long")).drop("places")


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ...): the counts of each whole text.

    They are written: a filter on a count would else be pushed down into the steps that make it, which would then run for each word.
    """
    text = F.col("text")
    rows = id_and_text(docs).select(
        "doc_id", "text",
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"),
        F.filter(F.split(text, "\n", -1), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]"))).alias("lines"),
        F.regexp_replace(text, r"[\x20\x09-\x0D]+", "").alias("dense"),
    )
    rows = with_repeated_words(rows)
    count = lambda whole, pattern: (F.length(whole) - F.length(F.regexp_replace(whole, pattern, ""))).cast("long")
    rows = rows.withColumn("rest", F.regexp_replace("dense", r"[\p{L}\p{M}]+", ""))
    counts = rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length("dense").cast("long").alias("word_chars"),
        count(F.col("rest"), rf"[{SYMBOLS}]+").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("words")).cast("long").alias("n_different"),
        count(F.col("rest"), "[0-9]+").alias("n_digits"),
        (F.length("dense") - F.length("rest")).cast("long").alias("n_letters"),
        count(F.col("dense"), r"\p{Lu}+").alias("n_capitals"),
        count(F.col("rest"), "[.,;:!?]+").alias("n_marks"),
    )
    return materialize(counts, "statistics")


def base_failed() -> Column:
    """Too few words, or too many of them in repeated windows; exact in whole numbers."""
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))


def feature(name: str) -> Column:
    """A statistic's value; 0 where it divides by nothing."""
    top, _, bottom = FEATURES[name].partition(" / ")
    value = F.col(top).cast("double")
    return (F.coalesce(F.try_divide(value, F.col(bottom).cast("double")), F.lit(0.0)) if bottom else value).alias(name)


@dataclass(frozen=True)
class Condition:
    """``name`` above ``limit``, or at most ``limit``."""

    name: str
    above: bool
    limit: float

    def column(self) -> Column:
        value = feature(self.name)
        return value > self.limit if self.above else value <= self.limit

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.limit:.6g}"


@dataclass(frozen=True)
class Rule:
    """Rows that meet all conditions are bad; how many bad and good rows of the pruning third it covered."""

    conditions: tuple[Condition, ...]
    bad: int
    good: int

    def column(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column()
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


def _limits(rows: DataFrame, bins: int) -> dict[str, list[float]]:
    """Ascending limits of each statistic: its quantiles over the rows, and those over the bad ones."""
    shares = [(i + 1) / (bins // 2 + 1) for i in range(bins // 2)]
    ask = lambda only: [F.percentile_approx(F.when(only, feature(n)), shares, 10_000).alias(n) for n in FEATURES]
    both = [rows.select(*ask(F.lit(True))).first(), rows.select(*ask(F.col("bad") == 1)).first()]
    return {n: sorted({x for r in both for x in (r[n] or [])}) for n in FEATURES}


def _binned(rows: DataFrame, limits: dict[str, list[float]]) -> DataFrame:
    """Each statistic as the number of its limits that lie below it."""
    place = lambda n: F.size(F.filter(F.array(*map(F.lit, limits[n])), lambda x: x < feature(n))) if limits[n] else F.lit(0)
    return rows.select("bad", "prune", *(place(n).cast("int").alias(n) for n in FEATURES))


def _meets(rule: list[tuple[str, bool, int]]) -> Column:
    out = F.lit(True)
    for name, above, at in rule:
        out = out & ((F.col(name) > at) if above else (F.col(name) <= at))
    return out


def _gain(bad: int, good: int, bad_before: int, good_before: int) -> float:
    """What a condition adds: bad rows kept, times the bits that a bad row costs less."""
    if not bad:
        return 0.0
    return bad * (math.log2(bad / (bad + good)) - math.log2(bad_before / (bad_before + good_before)))


def _grow(rows: DataFrame, longest: int) -> list[tuple[str, bool, int]]:
    """A conjunction, one condition at a time, each from one grouped count."""
    rule: list[tuple[str, bool, int]] = []
    while len(rule) < longest:
        cells = rows.filter((F.col("prune") == 0) & _meets(rule)).select("bad", F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("at")) for n in FEATURES))).alias("x"))
        counts = {(r["name"], r["at"]): (r["b"], r["n"] - r["b"]) for r in cells.groupBy("x.name", "x.at").agg(F.sum("bad").alias("b"), F.count("*").alias("n")).collect()}
        first = next(iter(FEATURES))
        bad, good = (sum(v[i] for k, v in counts.items() if k[0] == first) for i in (0, 1))
        if not bad or not good:
            break
        best, chosen = 1e-9, None
        for name in FEATURES:
            below_bad = below_good = 0
            places = sorted(at for n, at in counts if n == name)
            for at in places[:-1]:
                below_bad, below_good = below_bad + counts[name, at][0], below_good + counts[name, at][1]
                for above, b, g in ((False, below_bad, below_good), (True, bad - below_bad, good - below_good)):
                    if (gain := _gain(b, g, bad, good)) > best:
                        best, chosen = gain, (name, above, at)
        if chosen is None:
            break
        rule.append(chosen)
    return rule


def _prune(rows: DataFrame, rule: list[tuple[str, bool, int]]) -> tuple[list[tuple[str, bool, int]], int, int]:
    """The first conditions, as many as tell best on the rows kept back: (bad - good) / (bad + good), the shorter rule of equals."""
    held = rows.filter("prune = 1").agg(*(c for i in range(1, len(rule) + 1) for c in (F.sum(F.when(_meets(rule[:i]), F.col("bad"))).alias(f"b{i}"), F.count_if(_meets(rule[:i])).alias(f"n{i}")))).first()
    worth = lambda i: (2 * (held[f"b{i}"] or 0) - held[f"n{i}"]) / max(1, held[f"n{i}"])
    best = max(range(1, len(rule) + 1), key=lambda i: (worth(i), -i))
    bad = held[f"b{best}"] or 0
    return rule[:best], bad, held[f"n{best}"] - bad


def learn(stats: DataFrame, labels: DataFrame, usable: Column, most_rules: int = 12, longest: int = 4, precision: float = 0.9, least: int = 3, bins: int = BINS) -> list[Rule]:
    """The decision list from all rows of ``stats`` whose ``labels.quality`` is 0 or 1; ``usable`` (over label_id) says which labels may be seen.

    Learning ends when a pruned rule covers fewer than ``least`` bad rows of the third that was kept back, or less
    than ``precision`` of what it covers there is bad.
    """
    marks = labels.select(doc_number().alias("label_id"), F.col("quality").try_cast("int").alias("quality")).filter(F.col("quality").isin(0, 1) & usable)
    marks = marks.groupBy("label_id").agg((1 - F.max("quality")).alias("bad"))
    rows = stats.filter(~base_failed()).join(marks, F.col("doc_id") == F.col("label_id"))
    rows = materialize(rows.withColumn("prune", (F.pmod(F.xxhash64("label_id", F.lit(3)), F.lit(3)) == 0).cast("int")), "labelled-statistics")
    limits = _limits(rows, bins)
    left, rules = materialize(_binned(rows, limits), "binned-statistics"), []
    while len(rules) < most_rules:
        grown = _grow(left, longest)
        if not grown:
            break
        kept, bad, good = _prune(left, grown)
        if bad < least or bad < precision * (bad + good):
            break
        rules.append(Rule(tuple(Condition(n, above, limits[n][at]) for n, above, at in kept), bad, good))
        left = left.filter(~_meets(kept))
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The number (from 1) of the first rule that rejects a row; null where none does."""
    out = None
    for i, rule in enumerate(rules, 1):
        out = F.when(rule.column(), i) if out is None else out.when(rule.column(), i)
    return F.lit(None).cast("int") if out is None else out


def apply_rules(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add base_failed, rule (the first learned rule that rejects the row, null if none or if the base limits do) and kept."""
    rows = stats.withColumn("base_failed", base_failed())
    rows = rows.withColumn("rule", F.when(~F.col("base_failed"), verdict(rules)).cast("int"))
    return rows.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
