"""Differences between layout snapshots, and assertions on them, over flattened nodes.

A node: snapshot_id, id, path, kind, x, y, w, h, grid, text, contrast, displayed, in_viewport,
occluded, clipped, interactive, disabled, tabbable, repeat_count, module_name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONTRAST = 4.5
SEVERITY = ["error", "warn", "info"]


def _finding(kind: str, when: Column, severity: Column | str, detail: Column | str) -> Column:
    sev = F.lit(severity) if isinstance(severity, str) else severity
    text = F.lit(detail) if isinstance(detail, str) else detail
    return F.when(when, F.struct(F.lit(kind).alias("kind"), sev.alias("severity"), text.alias("detail")))


def _flip(kind: str, column: str, bad: str, good: str, severity: str) -> Column:
    """A flag that changed: ``severity`` where it is now set, info where it went."""
    now = F.col(f"n.{column}")
    return _finding(kind, F.col(f"o.{column}") != now, F.when(now, severity).otherwise("info"), F.when(now, bad).otherwise(good))


def diff(before: DataFrame, after: DataFrame, move: int = 2, resize: int = 2, epsilon: float = 0.1) -> DataFrame:
    """(module_id, kind, severity, detail); see ``worst_first`` for their order."""
    joined = before.alias("o").join(after.alias("n"), F.col("o.id") == F.col("n.id"), "full_outer")
    new, gone = F.col("o.id").isNull(), F.col("n.id").isNull()
    both = ~new & ~gone
    o, n = (lambda c: F.col(f"o.{c}")), (lambda c: F.col(f"n.{c}"))
    dx, dy, dw, dh = (n(c) - o(c) for c in ("x", "y", "w", "h"))
    area = F.greatest(F.lit(1), o("w") * o("h"))
    box = lambda s: F.format_string("%d,%d %dx%d", s("x"), s("y"), s("w"), s("h"))
    strong = lambda s: s("kind").isin("marker", "interactive")
    broke = (o("contrast") >= CONTRAST) & (n("contrast") < CONTRAST)
    findings = F.array(
        _finding("added", new, F.when(strong(n), "warn").otherwise("info"), F.concat(F.lit("added "), n("kind"), F.lit(" "), box(n))),
        _finding("removed", gone, F.when(strong(o), "error").otherwise("warn"), F.concat(F.lit("was "), box(o), F.lit(" grid "), o("grid"))),
        _finding("moved", both & ((F.abs(dx) > move) | (F.abs(dy) > move)), "warn", F.concat(box(o), F.lit(" -> "), box(n), F.when(o("grid") != n("grid"), F.concat(F.lit(" grid "), o("grid"), F.lit(" -> "), n("grid"))).otherwise(""))),
        _finding("resized", both & ((F.abs(dw) > resize) | (F.abs(dh) > resize)), F.when(F.abs(n("w") * n("h") - area) / area > 0.25, "warn").otherwise("info"), F.format_string("width %+d, height %+d", dw, dh)),
        *(F.when(both, x) for x in (
            _flip("visibility", "occluded", "newly occluded", "no longer occluded", "error"),
            _flip("visibility", "clipped", "newly clipped", "no longer clipped", "warn"),
            _flip("visibility", "in_viewport", "entered the viewport", "left the viewport", "info"),
            _finding("visibility", o("displayed") != n("displayed"), F.when(n("displayed"), "info").otherwise("error"), F.when(n("displayed"), "renders again").otherwise("no longer rendered")),
            _finding("interactive", o("interactive") & n("interactive") & (o("tabbable") != n("tabbable")), F.when(n("tabbable"), "info").otherwise("error"), F.when(n("tabbable"), "tabbable again").otherwise("fell out of tab order")),
            _finding("interactive", o("interactive") & n("interactive") & (o("disabled") != n("disabled")), "warn", F.when(n("disabled"), "became disabled").otherwise("became enabled")),
            _finding("contrast", F.abs(n("contrast") - o("contrast")) > epsilon, F.when(broke, "error").otherwise("info"), F.format_string("contrast %.1f -> %.1f", o("contrast"), n("contrast"))),
            _finding("text", ~o("text").eqNullSafe(n("text")), "info", "text changed"),
            _finding("repeat", o("repeat_count").isNotNull() & n("repeat_count").isNotNull() & (o("repeat_count") != n("repeat_count")), "info", F.format_string("count %d -> %d", o("repeat_count"), n("repeat_count"))),
            _finding("repeat", o("repeat_count").isNull() != n("repeat_count").isNull(), "warn", F.when(n("repeat_count").isNotNull(), "became a repeat group").otherwise("no longer a repeat group")),
            _finding("marker", o("module_name").isNull() != n("module_name").isNull(), "info", F.when(n("module_name").isNotNull(), "gained a marker").otherwise("lost its marker")),
        )),
    )
    rows = joined.select(F.coalesce("n.id", "o.id").alias("module_id"), F.explode(F.filter(findings, lambda x: x.isNotNull())).alias("x"))
    return rows.select("module_id", "x.kind", "x.severity", "x.detail")


def page_findings(before: DataFrame, after: DataFrame) -> DataFrame:
    """(page_id, kind, severity, detail) of pages (page_id, width, height, scale, page_height, scrolls) in both snapshots.

    Another viewport or scale warns that places cannot be compared; the page's height and whether it scrolls inform.
    """
    rows = before.alias("o").join(after.alias("n"), "page_id")
    o, n = (lambda c: F.col(f"o.{c}")), (lambda c: F.col(f"n.{c}"))
    seen = lambda s: F.format_string("%dx%d at %s", s("width"), s("height"), s("scale").cast("string"))
    other = (o("width") != n("width")) | (o("height") != n("height")) | (o("scale") != n("scale"))
    findings = F.array(
        _finding("viewport", other, "warn", F.concat(seen(o), F.lit(" -> "), seen(n), F.lit(": places do not compare"))),
        _finding("page", o("page_height") != n("page_height"), "info", F.format_string("page height %d -> %d (%+d)", o("page_height"), n("page_height"), n("page_height") - o("page_height"))),
        _finding("page", o("scrolls") != n("scrolls"), "info", F.when(n("scrolls"), "scrolls now").otherwise("scrolls no longer")),
    )
    return rows.select("page_id", F.explode(F.filter(findings, lambda x: x.isNotNull())).alias("x")).select("page_id", "x.kind", "x.severity", "x.detail")


def worst_first(findings: DataFrame) -> DataFrame:
    """Findings by severity, then kind, module and detail."""
    rank = F.array_position(F.array(*(F.lit(x) for x in SEVERITY)), F.col("severity"))
    return findings.orderBy(rank, "kind", F.coalesce(F.col("module_id").cast("string"), F.lit("")), "detail")


def relation_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(module_id, detail) of modules in both snapshots (id, relations) whose relations differ."""
    rows = before.select("id", F.col("relations").alias("was")).join(after.select("id", F.col("relations").alias("now")), "id")
    part = lambda word, xs: F.when(F.size(xs) > 0, F.concat(F.lit(f"{word} "), F.array_join(xs, ", ")))
    parts = F.concat_ws("; ", part("gained", F.array_except("now", "was")), part("lost", F.array_except("was", "now")))
    return rows.withColumn("parts", parts).filter("parts <> ''").select(F.col("id").alias("module_id"), F.concat(F.lit("relations changed: "), "parts").alias("detail"))


def assertions(nodes: DataFrame) -> DataFrame:
    """(snapshot_id, name, passed, severity) of the built-in checks."""
    check = lambda when, name, passed, severity: F.when(when, F.struct(name.alias("name"), passed.alias("passed"), severity.alias("severity")))
    named = lambda a, c, b: F.concat(F.lit(a), F.col(c), F.lit(b))
    error, warn = F.lit("error"), F.lit("warn")
    marker, active = F.col("kind") == "marker", F.col("interactive")
    checks = F.array(
        check(marker, named("marked module ", "id", " renders"), F.col("displayed"), error),
        check(marker & F.col("clipped"), named("marked module ", "id", " is not clipped"), F.lit(False), warn),
        check(active & ~F.col("disabled"), named("", "id", " can be reached by keyboard"), F.col("tabbable"), error),
        check(active, named("", "id", " is not occluded"), ~F.col("occluded"), error),
        check(F.col("contrast").isNotNull(), named("", "id", " is readable"), F.col("contrast") >= CONTRAST, F.when(F.col("contrast") >= 3, warn).otherwise(error)),
    )
    each = nodes.select("snapshot_id", F.explode(F.filter(checks, lambda x: x.isNotNull())).alias("x")).select("snapshot_id", "x.name", "x.passed", "x.severity")
    main = nodes.groupBy("snapshot_id").agg((F.count_if((F.col("kind") == "landmark") & (F.col("module_name") == "main")) == 1).alias("passed"))
    return each.unionByName(main.select("snapshot_id", F.lit("exactly one main landmark").alias("name"), "passed", F.lit("warn").alias("severity")))


def assertion_flips(before: DataFrame, after: DataFrame) -> DataFrame:
    """(name, change, severity) of assertions (name, passed)."""
    rows = before.select("name", F.col("passed").alias("was")).join(after.select("name", F.col("passed").alias("is_")), "name", "full_outer")
    change = F.when(F.col("was").isNull(), "new").when(F.col("is_").isNull(), "gone").when(F.col("was") != F.col("is_"), F.when(F.col("is_"), "now passes").otherwise("now fails"))
    severity = F.when(change == "gone", "warn").when(change == "now fails", "error").otherwise("info")
    return rows.select("name", change.alias("change"), severity.alias("severity")).filter("change is not null")


def fold_runs(nodes: DataFrame, least: int = 6) -> DataFrame:
    """(parent_id, signature, first_pos, n): runs of equal siblings (parent_id, pos, signature) long enough to fold."""
    whole, same = Window.partitionBy("parent_id").orderBy("pos"), Window.partitionBy("parent_id", "signature").orderBy("pos")
    rows = nodes.withColumn("island", F.row_number().over(whole) - F.row_number().over(same))
    return rows.groupBy("parent_id", "signature", "island").agg(F.min("pos").alias("first_pos"), F.count("*").alias("n")).filter(F.col("n") >= least).drop("island")


def sibling_relations(nodes: DataFrame) -> DataFrame:
    """Add ``relation`` to the previous sibling: beside, below or after."""
    w = Window.partitionBy("parent_id").orderBy("pos")
    px, py, pw, ph = (F.lag(c).over(w) for c in ("x", "y", "w", "h"))
    relation = F.when(px.isNull(), F.lit(None)).when((F.col("x") >= px + pw) & (F.col("y") < py + ph), "beside").when(F.col("y") >= py + ph, "below").otherwise("after")
    return nodes.withColumn("relation", relation)


def grid_cell(x: Column, y: Column, width: Column, columns: int = 12, band: int = 60) -> Column:
    """Column and row of a box's corner in a grid of 12 columns and bands of 60 pixels."""
    column = F.least(F.lit(columns), F.floor(x * columns / F.greatest(width, F.lit(1))) + 1)
    return F.format_string("c%d-r%d", column, F.floor(y / band) + 1)
