"""Where a regular expression matches, natively: code-point offsets of all matches of a text.

``regexp_extract_all`` gives the matches and ``split`` the gaps between them; both walk
the same leftmost non-overlapping matches, so running sums of their lengths are the
offsets. Patterns must not match the empty string (see ``any_spans`` for those that may).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let, prefix_sums

SPAN = "struct<start:int,end:int,text:string>"
EMPTY = f"array<{SPAN}>"
#: Brackets matches of patterns that may be empty; a text's own sentinels are replaced by ``SPARE`` first.
SENTINEL, SPARE = "", ""


def span_struct(start: Column, text: Column) -> Column:
    return F.struct(start.alias("start"), (start + F.length(text)).alias("end"), text.alias("text"))


def _placed(gaps: Column, hits: Column) -> Column:
    """Spans of ``hits`` where ``gaps`` holds one text more."""
    size = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.length(g) + F.length(h))
    return F.zip_with(
        prefix_sums(size),
        F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("g"), hits.alias("h")),
        lambda before, z: span_struct(before + F.length(z["g"]), z["h"]),
    )


def safe(text: Column) -> Column:
    """``text`` without sentinels, length kept."""
    return F.translate(text, SENTINEL, SPARE)


def either(ascii_: Column, pattern: str) -> Column:
    """A ``(?U)`` pattern, for an ASCII text without that flag: it matches the same there, faster."""
    plain = pattern.replace("(?U)", "", 1) if pattern.startswith("(?U)") else pattern.replace("(?iU)", "(?i)", 1)
    return F.when(ascii_, F.lit(plain)).otherwise(F.lit(pattern))


def found(text: Column, pattern: Column, gate: Column | None = None, **tags: Column) -> Column:
    """``struct<parts, tags>`` of a ``safe`` text cut at all matches, null if there are none; ``placed`` gives their spans.

    Every second part is a match. Many of these share one ``placed``, so the plan stays small.
    """
    extra = [c.alias(name) for name, c in tags.items()]
    cut = lambda m: F.when(m.contains(SENTINEL), F.struct(F.split(m, SENTINEL, -1).alias("parts"), *extra))
    entry = let(F.regexp_replace(text, pattern, F.lit(f"{SENTINEL}$0{SENTINEL}")), cut)
    return entry if gate is None else F.when(F.coalesce(gate, F.lit(False)), entry)


#: So many parts are measured without running sums.
FEW_PARTS = 9


def placed(entry: Column) -> Column:
    """Spans of the matches in what ``found`` gives."""

    def of(parts: Column) -> Column:
        pairs = F.sequence(F.lit(0), F.floor(F.size(parts) / F.lit(2)).cast("int") - 1)
        size = F.transform(pairs, lambda i: F.length(F.get(parts, 2 * i)) + F.length(F.get(parts, 2 * i + 1)))
        many = F.zip_with(
            prefix_sums(size), pairs, lambda before, i: span_struct(before + F.length(F.get(parts, 2 * i)), F.get(parts, 2 * i + 1))
        )
        until = lambda i: F.length(F.array_join(F.slice(parts, 1, 2 * i + 1), ""))
        few = F.transform(pairs, lambda i: let(until(i), lambda start: span_struct(start, F.get(parts, 2 * i + 1))))
        return F.when(F.size(parts) <= FEW_PARTS, few).otherwise(many)

    return let(entry["parts"], of)


def match_spans(text: Column, pattern: str, gate: Column | None = None) -> Column:
    """``array<struct<start, end, text>>`` of all matches; null text gives none.

    ``gate``: a cheap condition that every text with a match meets; the default is the pattern itself.
    """
    found = let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda hits: let(F.split(text, pattern, -1), lambda gaps: _placed(gaps, hits)),
    )
    use = text.rlike(pattern) if gate is None else gate & text.rlike(pattern)
    return F.when(F.coalesce(use, F.lit(False)), found).otherwise(F.array().cast(EMPTY))


def any_spans(text: Column, pattern: str) -> Column:
    """As ``match_spans`` for any pattern; empty matches are left out."""
    marked = F.split(F.regexp_replace(safe(text), pattern, f"{SENTINEL}$0{SENTINEL}"), SENTINEL, -1)

    def of(parts: Column) -> Column:
        starts = prefix_sums(F.transform(parts, lambda p: F.length(p)))
        spans = F.zip_with(
            starts, parts, lambda s, p: F.struct(s.alias("start"), (s + F.length(p)).alias("end"), F.substring(text, s + 1, F.length(p)).alias("text"))
        )
        return F.filter(spans, lambda s, i: (i % 2 == 1) & (s["end"] > s["start"]))

    return F.when(F.coalesce(text.rlike(pattern), F.lit(False)), let(marked, of)).otherwise(F.array().cast(EMPTY))
