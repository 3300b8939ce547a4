"""Text functions as column expressions. ``WS`` is white space as the data model counts it, NBSP and BOM included."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.functions import params as p

WS = r"[\t-\r \x{a0}\x{feff}]"


def words(text: Column) -> Column:
    """ASCII words of two characters or more, lower-cased, repeats kept. Only A-Z are lowered: no other letter may become one of theirs."""
    return F.regexp_extract_all(F.translate(text, ascii_uppercase, ascii_lowercase), F.lit("[a-z0-9_]{2,}"), 0)


def cjk_grams(text: Column) -> Column:
    """Two-character windows over each run of Han characters; a lone character stays."""
    runs = F.regexp_extract_all(text, F.lit(r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]+"), 0)
    grams = F.transform(
        runs,
        lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(
            F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2)))
        ),
    )
    return F.flatten(grams)


def subtokens(token: Column) -> Column:
    """Parts of an identifier: at underscores, case changes, acronym ends, and between letters and digits."""
    pieces = F.regexp_extract_all(token, F.lit(p.IDENTIFIER_PIECE), 0)
    parts = F.transform(F.concat(pieces, F.flatten(F.transform(pieces, lambda x: F.split(x, p.LETTER_DIGIT)))), F.lower)
    return F.array_sort(F.array_distinct(F.filter(parts, lambda x: (F.length(x) >= 2) & (x != F.lower(token)))))


def all_tokens(text: Column, identifiers: bool = False) -> Column:
    """Tokens with repeats, in no order that matters."""
    parts = [words(text), cjk_grams(F.lower(text))]
    if identifiers:
        raw = F.regexp_extract_all(text, F.lit("[A-Za-z0-9_]{2,}"), 0)
        parts.append(F.flatten(F.transform(raw, subtokens)))
    return F.concat(*parts)


def tokenize(text: Column, identifiers: bool = False) -> Column:
    """Sorted distinct tokens."""
    return F.array_sort(F.array_distinct(all_tokens(text, identifiers)))


def collapse(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"{WS}+", " "), "^ | $", "")


def round_half_up(x: Column, places: int) -> Column:
    scale = float(10**places)
    return F.floor(x * scale + 0.5) / scale


def exact_phrase(haystack: Column, query: Column) -> Column:
    """1 if the folded query stands in the folded text, .5 if one of its segments of 4 characters or more does."""
    needle = F.lower(collapse(query))
    segments = F.filter(F.split(needle, r"[\t-\r ,，、;；:：]+"), lambda s: F.length(s) >= 4)
    return F.when(F.length(needle) == 0, 0.0).when(F.contains(haystack, needle), 1.0).when(F.exists(segments, lambda s: F.contains(haystack, s)), 0.5).otherwise(0.0)


def redline(text: Column, ranges: Column) -> Column:
    """Text with each range (from, to; 1-based, inclusive) replaced by ``[…]``; a range inside what is gone adds nothing."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, r: Column) -> Column:
        a = F.greatest(F.lit(0), r["from"] - 1)
        b = F.least(F.length(text), r["to"])
        kept = F.when(a > acc["at"], F.substring(text, acc["at"] + 1, a - acc["at"])).otherwise("")
        new = F.struct(F.concat(acc["out"], kept, F.lit("[…]")).alias("out"), F.greatest(acc["at"], b).alias("at"))
        return F.when((b <= acc["at"]) | (a >= F.length(text)), acc).otherwise(new)

    rest = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    return F.when(F.size(ranges) > 0, F.aggregate(F.array_sort(ranges), start, step, rest)).otherwise(text)


def redline_ratio(text: Column, ranges: Column) -> Column:
    """Share of the text that ranges cover, overlaps counted twice."""
    total = F.aggregate(
        ranges, F.lit(0), lambda acc, r: acc + F.greatest(F.lit(0), F.least(F.length(text), r["to"]) - F.greatest(F.lit(0), r["from"] - 1))
    )
    return F.when(F.length(text) > 0, F.coalesce(total, F.lit(0)) / F.length(text)).otherwise(0.0)


def quote_anchor(text: Column, chars: int = p.ANCHOR_CHARS) -> Column:
    return F.substring(collapse(text), 1, chars)


def embed_normalize(text: Column) -> Column:
    """Line ends to LF, spaces folded in each line, blank runs to one blank line, trimmed."""
    lines = F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")
    lines = F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"[ \t\x{a0}]+", " ")))
    return F.trim(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n"), F.lit("\n "))


def embed_text(title: Column, tags: Column, text: Column) -> Column:
    return F.concat_ws("\n", title, F.array_join(tags, " "), text)


def cache_key(text: Column) -> Column:
    return F.sha2(embed_normalize(text), 256)


def strip_code(text: Column) -> Column:
    for pattern in ("(?s)```.*?```", "(?s)~~~.*?~~~", "`[^`\n]*`"):
        text = F.regexp_replace(text, pattern, " ")
    return text


def is_identifier(word: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(word, p.LEADING_SIGNS, ""), p.TRAILING_SIGNS, "")
    return (F.length(bare) >= 2) & F.rlike(bare, F.lit("|".join(f"(?:{x})" for x in p.IDENTIFIER_PATTERNS)))


def normalize_query(text: Column, profile: str) -> dict[str, Column]:
    """lexical, semantic, identifiers, truncated: what each channel sees of a query."""
    longest, no_code, split = p.PROFILES.get(profile, p.PROFILES["tool"])
    whole = collapse(strip_code(text) if no_code else text)
    lexical = F.substring(whole, 1, longest) if longest else whole
    terms = F.filter(F.split(lexical, " "), lambda w: w != "")
    none = F.expr("cast(array() as array<string>)")
    return {
        "lexical": lexical,
        "semantic": F.array_join(F.filter(terms, lambda w: ~is_identifier(w)), " ") if split else lexical,
        "identifiers": F.filter(terms, is_identifier) if split else none,
        "truncated": F.length(whole) > longest if longest else F.lit(False),
    }


def html_to_markdown(html: Column) -> Column:
    """Readable text of a page: headings and list items marked, cells separated, other tags gone."""
    rules = [("\r\n?", "\n"), ("(?s)<!--.*?-->", "")]
    rules += [(rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "") for tag in p.SKIPPED_TAGS]
    for tag in sorted({**p.OPENING_TAGS, **p.CLOSING_TAGS}):
        rules += [(rf"(?i)<{tag}\b[^>]*>", p.OPENING_TAGS[tag])] if tag in p.OPENING_TAGS else []
        rules += [(rf"(?i)</{tag}\s*>", p.CLOSING_TAGS[tag])] if tag in p.CLOSING_TAGS else []
    rules += [(rf"(?i)</?({'|'.join(p.BLOCK_TAGS)})\b[^>]*>", "\n"), ("<[^>]+>", "")]
    rules += [(f"(?i){entity}", sign) for entity, sign in p.ENTITIES.items()]
    for pattern, new in rules:
        html = F.regexp_replace(html, pattern, new)
    lines = F.transform(F.split(html, "\n"), lambda x: F.regexp_replace(F.regexp_replace(x, r"[ \t\x{a0}]+", " "), f"^{WS}+|{WS}+$", ""))
    return F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n"), "^\n+|\n+$", "")


def source_format(path: Column) -> Column:
    return F.when(F.rlike(F.trim(path), F.lit(r"(?i)\.html?$")), "html").otherwise("markdown")


def assets(html: Column) -> Column:
    """Local style sheets and scripts that a page names, sorted."""
    found = F.concat(
        F.regexp_extract_all(html, F.lit(r"(?i)<link\b[^>]*\bhref=[\"']([^\"'#?]+\.css)"), 1), F.regexp_extract_all(html, F.lit(r"(?i)<script\b[^>]*\bsrc=[\"']([^\"'#?]+)"), 1)
    )
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: ~F.rlike(x, F.lit("(?i)^([a-z]+:)?//|^data:")))))


def posix_path(path: Column) -> Column:
    """Relative path with forward slashes."""
    return F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^\.?/", "")


def rooted_path(path: Column) -> Column:
    """Path with forward slashes, leading ones gone; a leading ``./`` stays."""
    return F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "^/+", "")


def encode_segment(root: Column) -> Column:
    return F.regexp_replace(root, "[^A-Za-z0-9]+", "-")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different lengths or of no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def l2_normalize(a: Column) -> Column:
    norm = F.sqrt(dot(a, a))
    return F.when(norm > 0, F.transform(a, lambda x: x.cast("double") / norm)).otherwise(F.transform(a, lambda x: x.cast("double")))


def overlap(a: Column, b: Column) -> Column:
    """Overlap coefficient of two arrays of distinct values."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def percentile_discrete(values: Column, q: float) -> Column:
    """The value at floor(n * q) of a sorted array; null for an empty one."""
    n = F.size(values)
    return F.try_element_at(F.array_sort(values), F.least(n, F.floor(n * q).cast("int") + 1))


def pack(lines: Column, budget: int, used: int = 0) -> Column:
    """Lines taken in order while they fit the budget; one that does not fit is skipped. A line costs its length and 1."""
    start = F.struct(F.expr("cast(array() as array<string>)").alias("out"), F.lit(used).alias("used"))
    return F.aggregate(
        lines,
        start,
        lambda acc, x: F.when(F.length(x) <= budget - acc["used"], F.struct(F.concat(acc["out"], F.array(x)).alias("out"), (acc["used"] + F.length(x) + 1).alias("used"))).otherwise(acc),
        lambda acc: acc["out"],
    )


def failure_signature(assertions: Column, errors: Column, files: Column, facts: int = 6, longest: int = 400) -> Column:
    """The first facts (assertions, then errors, then files), each once, cut to a length."""
    lines = F.filter(F.transform(F.concat(assertions, errors, files), lambda x: F.trim(x)), lambda x: x != "")
    whole = F.array_join(F.array_distinct(F.slice(lines, 1, facts)), " ")
    return F.when(F.length(whole) > longest, F.concat(F.substring(whole, 1, longest - 1), F.lit("…"))).otherwise(whole)


def lenient_json(raw: Column) -> Column:
    """The JSON object inside a model's answer: a fenced block's, else from the first brace to the last."""
    fenced = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(.*?)```", 1)
    source = F.when(fenced != "", fenced).otherwise(raw)
    return F.regexp_extract(source, r"(?s)(\{.*\})", 1)


def as_rate(x: Column) -> Column:
    """A share from 0 to 1 out of a share, a mark out of 10, or a percentage."""
    scaled = F.when(x > 10, x / 100).when(x > 1, x / 10).otherwise(x)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled))


def luminance(r: Column, g: Column, b: Column, threshold: float = 0.03928) -> Column:
    linear = lambda c: F.when(c / 255 <= threshold, c / 255 / 12.92).otherwise(F.pow((c / 255 + 0.055) / 1.055, F.lit(2.4)))
    return linear(r) * 0.2126 + linear(g) * 0.7152 + linear(b) * 0.0722


def contrast(a: Column, b: Column) -> Column:
    return round_half_up((F.greatest(a, b) + 0.05) / (F.least(a, b) + 0.05), 1)


def hit_line(longest: int = 400) -> Column:
    """One line for a hit (id, status, needs_review, kind, title, text, notes): what it is, its text on one line, its annotations."""
    flags = F.concat_ws("|", "status", F.when(F.col("needs_review"), "needs review"))
    body = F.regexp_replace("text", f"{WS}+", " ")
    body = F.when(F.length(body) > longest, F.concat(F.substring(body, 1, longest - 1), F.lit("…"))).otherwise(body)
    notes = F.array_join(F.transform("notes", lambda x: F.concat(F.lit(" ("), x, F.lit(")"))), "")
    return F.concat(F.lit("- ["), F.col("id").cast("string"), F.lit("|"), flags, F.lit("|"), F.col("kind"), F.lit("] "), F.col("title"), F.lit(": "), body, notes)


def excerpt(lines: Column, redlined: Column, budget: int = 600) -> Column:
    """Lines as far as the budget goes, each costing its length and 1; redlined ones are marked.

    Blank lines at the start are left out. A first line that is too long is cut, at a later one the excerpt ends; an ellipsis
    closes an excerpt of several lines that took the whole budget.
    """
    start = F.struct(F.expr("cast(array() as array<string>)").alias("out"), F.lit(0).alias("used"), F.lit(False).alias("full"))
    marked = F.zip_with(lines, redlined, lambda x, r: F.regexp_replace(F.concat(F.when(r, "✂ ").otherwise(""), x), f"{WS}+$", ""))

    def step(acc: Column, x: Column) -> Column:
        none, fits = F.size(acc["out"]) == 0, acc["used"] + F.length(x) + 1 <= budget
        line = F.when(fits, x).otherwise(F.concat(F.substring(x, 1, max(0, budget - 1)), F.lit("…")))
        grown = F.struct(F.concat(acc["out"], F.array(line)).alias("out"), (acc["used"] + F.length(line) + 1).alias("used"), acc["full"].alias("full"))
        ended = F.struct(acc["out"].alias("out"), acc["used"].alias("used"), F.lit(True).alias("full"))
        return F.when(acc["full"] | (none & (x == "")), acc).when(~fits & ~none, ended).otherwise(grown)

    close = lambda acc: F.concat(F.array_join(acc["out"], "\n"), F.when((F.size(lines) > 1) & (acc["used"] >= budget), "\n…").otherwise(""))
    return F.aggregate(marked, start, step, close)


def stable_json(value: Column) -> Column:
    """JSON of a struct, map or array with keys in order at every depth, while arrays keep theirs: one text for one content, in whatever order keys came.

    A variant holds an object's fields sorted by name, so a value that goes through one comes back in order. Null fields are left out.
    """
    return F.to_json(F.parse_json(F.to_json(value)))


def stable_json_text(raw: Column) -> Column:
    """The same for JSON text; null where it is none."""
    return F.to_json(F.try_parse_json(raw))
