"""Boxes, lines and spans as folds over arrays: one row a document, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def group_into_lines(boxes: Column, least: float = 0.30, share: float = 0.6, floor: float = 4.0) -> Column:
    """Boxes (x, y, height, text, conf) -> lines of text from top to bottom.

    Sorted by y, a box joins the last line if it is within the tolerance of the mean
    y of the line so far, else it opens a new one. That mean moves as boxes join, so
    this is a fold and no gap in a window. Lines are read left to right.
    """
    kept = F.filter(boxes, lambda b: (F.trim(b["text"]) != "") & (b["conf"] >= least))
    kept = F.array_sort(F.transform(kept, lambda b: F.struct(b["y"].cast("double").alias("y"), b["x"].cast("double").alias("x"), b["height"].cast("double").alias("height"), b["text"].alias("text"))))
    heights = F.array_sort(F.transform(kept, lambda b: b["height"]))
    n = F.size(heights)
    at = lambda k: F.get(heights, k.cast("int"))
    median = F.when(n == 0, F.lit(10.0)).otherwise((at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2)
    reach = F.greatest(share * F.when(median == 0, F.lit(10.0)).otherwise(median), F.lit(floor))
    none = F.array().cast("array<struct<y:double,n:int,boxes:array<struct<x:double,text:string>>>>")

    def step(lines: Column, b: Column) -> Column:
        last = F.try_element_at(lines, F.lit(-1))
        own = F.struct(b["x"].alias("x"), b["text"].alias("text"))
        near = F.coalesce(F.abs(b["y"] - last["y"] / last["n"]) <= reach, F.lit(False))
        joined = F.struct((last["y"] + b["y"]).alias("y"), (last["n"] + 1).alias("n"), F.array_append(last["boxes"], own).alias("boxes"))
        fresh = F.struct(b["y"].alias("y"), F.lit(1).alias("n"), F.array(own).alias("boxes"))
        return F.when(near, F.array_append(F.slice(lines, F.lit(1), F.size(lines) - 1), joined)).otherwise(F.array_append(lines, fresh))

    lines = F.aggregate(kept, none, step)
    return F.transform(lines, lambda x: F.array_join(F.transform(F.array_sort(x["boxes"]), lambda b: b["text"]), " "))


def bounding_box(points: Column) -> Column:
    """(left, top, right, bottom) of an array of points (x, y), null if there is none."""
    pick = lambda f, k: f(F.transform(points, lambda p: p[k])).cast("int")
    return F.when(F.size(points) > 0, F.struct(pick(F.array_min, "x").alias("left"), pick(F.array_min, "y").alias("top"), pick(F.array_max, "x").alias("right"), pick(F.array_max, "y").alias("bottom")))


def tokens_in_span(tokens: Column, start: Column, end: Column) -> Column:
    """Tokens (char_start, char_end, ...) that overlap a span; none for an empty one."""
    return F.filter(tokens, lambda t: (start >= 0) & (end > start) & (start < t["char_end"]) & (end > t["char_start"]))


def place_of(tokens: Column, start: Column, end: Column) -> Column:
    """Where a span stands on the page: (``box``, ``lines``) of the tokens (char_start,
    char_end, line, points) that overlap it, lines distinct and sorted; null if none does."""
    own = tokens_in_span(tokens, start, end)
    lines = F.array_sort(F.array_distinct(F.transform(own, lambda t: t["line"])))
    return F.when(F.size(own) > 0, F.struct(bounding_box(F.flatten(F.transform(own, lambda t: t["points"]))).alias("box"), lines.alias("lines")))


def drop_overlaps(spans: Column, kind: str = "array<struct<start:int,end:int>>") -> Column:
    """Spans (start, end, ...) by start, longer first, without those that start inside one kept."""
    ordered = F.array_sort(spans, lambda a, b: F.coalesce(F.nullif(F.signum(a["start"] - b["start"]), F.lit(0.0)), F.signum((b["end"] - b["start"]) - (a["end"] - a["start"]))).cast("int"))
    free = lambda kept, s: s["start"] >= F.coalesce(F.try_element_at(kept, F.lit(-1))["end"], F.lit(-1))
    return F.aggregate(ordered, F.array().cast(kind), lambda kept, s: F.when(free(kept, s), F.array_append(kept, s)).otherwise(kept))


def apply_spans(text: Column, spans: Column, opening: str = "[[", closing: str = "]]") -> Column:
    """The text with each span between markers, overlaps dropped."""
    valid = F.transform(F.filter(spans, lambda s: (s["start"] >= 0) & (s["start"] < s["end"]) & (s["end"] <= F.length(text))), lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end")))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        before, inside = (F.substring(text, a + 1, b - a) for a, b in ((acc["at"], s["start"]), (s["start"], s["end"])))
        return F.struct(F.concat(acc["out"], before, F.lit(opening), inside, F.lit(closing)).alias("out"), s["end"].alias("at"))

    return F.aggregate(drop_overlaps(valid), start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def escape_html(c: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def highlight_html(text: Column, spans: Column) -> Column:
    """Escaped text with ``<mark>`` around entities (start, end, type, confidence)."""
    kind = "array<struct<start:int,end:int,type:string,confidence:double>>"
    valid = F.transform(F.filter(spans, lambda s: (s["start"] >= 0) & (s["end"] > s["start"])), lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"), s["type"].alias("type"), s["confidence"].cast("double").alias("confidence")))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        before, inside = (escape_html(F.substring(text, a + 1, b - a)) for a, b in ((acc["at"], s["start"]), (s["start"], s["end"])))
        name = escape_html(s["type"])
        mark = F.concat(F.lit('<mark class="ent ent-'), name, F.lit('" title="'), name, F.lit(" ("), s["confidence"].cast("decimal(4,2)").cast("string"), F.lit(')">'))
        return F.struct(F.concat(acc["out"], before, mark, inside, F.lit("</mark>")).alias("out"), s["end"].alias("at"))

    done = F.aggregate(drop_overlaps(valid, kind), start, step, lambda acc: F.concat(acc["out"], escape_html(F.substring(text, acc["at"] + 1, F.length(text)))))
    return F.replace(done, F.lit("\n"), F.lit("<br>\n"))
