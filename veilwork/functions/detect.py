"""Detection, overlap resolution and masking as Column expressions; no shuffle, no Python."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import or_
from typing import Any

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .arrays import FOLD_BLOCK, fold_emitting, let
from .names import DEFAULT_NAMES, name_spans
from .patterns import CATEGORIES, FOLDS, TOKEN, unicode
from .spans import SENTINEL, any_spans, either, found, placed, safe

CUSTOM = "custom"
ONE_SPAN = "struct<start:int,neg:int,seq:int,end:int,category:string,text:string>"
SPAN = f"array<{ONE_SPAN}>"


@dataclass(frozen=True)
class ScanOptions:
    """What is looked for and what replaces it. ``categories=None``: all; an empty list: none of the built-in ones."""

    categories: list[str] | None = None
    patterns: list[str] = field(default_factory=list)
    literals: list[str] = field(default_factory=list)
    replacement: str = TOKEN
    first_names: Any = DEFAULT_NAMES

    def keys(self) -> list[str]:
        """The known categories, in the caller's order."""
        return [k for k in (list(CATEGORIES) if self.categories is None else self.categories) if k in CATEGORIES]


def escaped(text: str) -> str:
    """``text`` as a pattern that matches just it."""
    return "".join(f"\\{c}" if not c.isalnum() and c != "_" and c.isascii() and not c.isspace() else c for c in text)


def valid_pattern(pattern: str) -> bool:
    """Whether Java takes the pattern; blank ones don't count."""
    if not pattern.strip():
        return False
    jvm = SparkSession.active().sparkContext._jvm
    try:
        jvm.java.util.regex.Pattern.compile(f"(?iU){pattern}")
    except Exception:  # py4j wraps what the compiler throws
        return False
    return True


def _gate(z: Column, digit: bool, words: tuple[str, ...]) -> Column | None:
    """Whether a text may match at all: a digit, one of the words in it."""
    if not words:
        return z["digit"] if digit else None
    holds = reduce(or_, [z["low"].contains(w) for w in words], z["folds"])
    return z["digit"] & holds if digit else holds


def _tagged(s: Column, seq: Column, category: Column, text: Column | None = None) -> Column:
    return F.struct(
        s["start"].alias("start"),
        (s["start"] - s["end"]).alias("neg"),
        seq.alias("seq"),
        s["end"].alias("end"),
        category.alias("category"),
        (s["text"] if text is None else text).alias("text"),
    )


def _entry_spans(z: Column, e: Column) -> Column:
    """The spans of one pattern; their texts are the original's, if that holds sentinels, which were replaced before the scan."""
    valid = F.filter(placed(e), lambda s: ~e["digit"] | s["text"].rlike(r"(?U)\d"))

    def tagged(s: Column) -> Column:
        own = F.when(z["marked"], F.substring(z["text"], s["start"] + 1, s["end"] - s["start"])).otherwise(s["text"])
        return _tagged(s, e["seq"], e["category"], own)

    return F.transform(valid, tagged)


def all_spans(text: Column, opts: ScanOptions | None = None) -> Column:
    """Every hit of every enabled pattern, overlaps included, in the order (start, longest first, pattern)."""
    opts = opts or ScanOptions()
    custom = [p for p in opts.patterns if valid_pattern(p)]
    literals = [t.strip() for t in opts.literals if t.strip()]

    def of(z: Column) -> Column:
        t = z["text"]
        entries, arrays, seq = [], [], iter(range(1 << 20))

        def scan(pattern: str, category: str, gate: Column | None = None, digit: bool = False) -> None:
            tags = {"seq": F.lit(next(seq)), "category": F.lit(category), "digit": F.lit(digit)}
            entries.append(found(z["safe"], either(z["ascii"], pattern), gate, **tags))

        def add(spans: Column, category: str) -> None:
            k = next(seq)
            arrays.append(F.transform(spans, lambda s: _tagged(s, F.lit(k), F.lit(category))))

        for key in opts.keys():
            cat = CATEGORIES[key]
            for i, p in enumerate(cat.patterns):
                scan(unicode(p), key, _gate(z, *cat.gate(i)), cat.needs_digit)
            if key == "names":
                for spans in name_spans(t, opts.first_names, z["safe"], z["ascii"]):
                    add(spans, key)
        for p in custom:
            add(any_spans(t, f"(?iU){p}"), CUSTOM)
        for literal in literals:
            scan(rf"(?iU)\b{escaped(literal)}\b", CUSTOM)
        if entries:
            hit = F.filter(F.array(*entries), lambda e: e.isNotNull())
            arrays.append(F.flatten(F.transform(hit, lambda e: _entry_spans(z, e))))
        return F.sort_array(F.concat(*arrays)) if arrays else F.array().cast(SPAN)

    blank = F.coalesce(F.length(F.btrim(text)) == 0, F.lit(True))
    gates = F.struct(
        text.alias("text"),
        safe(text).alias("safe"),
        text.rlike(r"(?U)\d").alias("digit"),
        F.lower(text).alias("low"),
        text.rlike(f"[{FOLDS}]").alias("folds"),
        text.contains(SENTINEL).alias("marked"),
        (F.octet_length(text) == F.length(text)).alias("ascii"),
    )
    return F.when(blank, F.array().cast(SPAN)).otherwise(let(gates, of))


# ---- overlap resolution -------------------------------------------------------------------------


#: So many ends are compared with each other.
FEW = 16


def _max_before(ends: Column) -> Column:
    """The largest of the ends before each one (0 at first), in blocks."""

    def fold(a: Column) -> Column:
        grow = lambda acc, x: F.concat(acc, F.array(F.greatest(F.element_at(acc, -1), x)))
        return F.aggregate(a, F.array(F.lit(0).cast("int")), grow)

    def of(e: Column) -> Column:
        steps = F.sequence(F.lit(0), F.floor((F.size(e) - 1) / F.lit(FOLD_BLOCK)).cast("int"))
        blocks = F.transform(steps, lambda k: fold(F.slice(e, k * FOLD_BLOCK + 1, FOLD_BLOCK)))
        return let(
            blocks,
            lambda b: F.flatten(
                F.zip_with(
                    b,
                    F.slice(fold(F.transform(b, lambda x: F.element_at(x, -1))), 1, F.size(b)),
                    lambda inner, base: F.transform(F.slice(inner, 1, F.size(inner) - 1), lambda x: F.greatest(x, base)),
                )
            ),
        )

    def few(e: Column) -> Column:
        return F.transform(e, lambda _, i: F.when(i == 0, F.lit(0)).otherwise(F.array_max(F.slice(e, 1, F.greatest(i, F.lit(1))))))

    return let(ends, lambda e: F.when(F.size(e) <= FEW, few(e)).otherwise(of(e)))


def _islands(spans: Column) -> Column:
    """Groups of sorted spans that overlap in a chain."""

    def of(before: Column) -> Column:
        heads = F.filter(
            F.sequence(F.lit(0), F.size(spans) - 1), lambda i: F.get(spans, i)["start"] >= F.get(before, i)
        )
        return let(
            heads,
            lambda h: F.transform(h, lambda a, k: F.slice(spans, a + 1, F.coalesce(F.get(h, k + 1), F.size(spans)) - a)),
        )

    return let(_max_before(F.transform(spans, lambda s: s["end"])), of)


def _longest(island: Column) -> Column:
    """Left to right: an overlapping span takes the last one's place if it is longer, else it goes."""

    def step(last: Column, s: Column) -> tuple[Column, Column]:
        over = s["start"] < last["end"]
        stays = over & (s["neg"] >= last["neg"])
        return F.when(stays, last).otherwise(s), F.when(over, F.array().cast(SPAN)).otherwise(F.array(last))

    folded = fold_emitting(F.slice(island, 2, F.size(island)), F.element_at(island, 1), step, ONE_SPAN)
    return F.when(F.size(island) == 1, island).otherwise(let(folded, lambda f: F.concat(f["out"], F.array(f["state"]))))


def resolve(spans: Column, policy: str = "compat", text: Column | None = None) -> Column:
    """Sorted spans without overlaps.

    ``compat``: the longer of two overlapping spans stays, step by step from the left, so a
    chain of overlaps may leave a part in clear. ``cover``: the union of all spans (needs ``text``).
    """
    if policy not in ("compat", "cover"):
        raise ValueError(f"no such policy: {policy}")

    def of(s: Column) -> Column:
        if policy == "compat":
            return F.flatten(F.transform(_islands(s), _longest))

        def union(g: Column) -> Column:
            start, end = F.element_at(g, 1)["start"], F.array_max(F.transform(g, lambda x: x["end"]))
            return F.struct(
                start.alias("start"),
                (start - end).alias("neg"),
                F.element_at(g, 1)["seq"].alias("seq"),
                end.alias("end"),
                F.element_at(g, 1)["category"].alias("category"),
                F.substring(text, start + 1, end - start).alias("text"),
            )

        return F.transform(_islands(s), union)

    return let(spans, lambda s: F.when(F.size(s) < 2, s).otherwise(of(s)))


def detect(text: Column, opts: ScanOptions | None = None, policy: str = "compat") -> Column:
    """``array<struct<start, end, text, category>>``: what is found in a text, in order, without overlaps."""
    spans = resolve(all_spans(text, opts), policy, text)
    return F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), s["category"].alias("category")
        ),
    )


def summary(spans: Column) -> Column:
    """Map of counts by category, keys in order."""

    def of(cats: Column) -> Column:
        keys = F.sort_array(F.array_distinct(cats))
        return F.map_from_arrays(keys, F.transform(keys, lambda k: F.size(F.filter(cats, lambda c: c == k)).cast("long")))

    return let(F.transform(spans, lambda s: s["category"]), of)


# ---- masking ------------------------------------------------------------------------------------


def mask(text: Column, spans: Column, token: str | Column = TOKEN) -> Column:
    """Every span replaced by the token; spans that touch share one."""
    put = token if isinstance(token, Column) else F.lit(token)

    def of(s: Column) -> Column:
        def piece(x: Column, i: Column) -> Column:
            end = F.coalesce(F.get(s, i - 1)["end"], F.lit(0))
            gap = F.substring(text, end + 1, x["start"] - end)
            return F.concat(gap, F.when((i > 0) & (x["start"] == end), F.lit("")).otherwise(put))

        tail = F.substring(text, F.element_at(s, -1)["end"] + 1, F.length(text))
        return F.concat(F.array_join(F.transform(s, piece), ""), tail)

    return F.when(text.isNull(), text).otherwise(let(spans, lambda s: F.when(F.size(s) == 0, text).otherwise(of(s))))


def _literal(text: Column) -> Column:
    return F.regexp_replace(text, r"([^\p{L}\p{N}_\s])", r"\\$1")


def mask_by_search(text: Column, spans: Column, token: str = TOKEN) -> Column:
    """Each found text looked for again as a whole word, letters in either case, and replaced wherever it stands.

    Kept for comparison: what begins or ends with a sign other than a word character stays in clear.
    """
    put = token.replace("\\", "\\\\").replace("$", "\\$")
    return F.aggregate(
        spans,
        text,
        lambda acc, s: F.regexp_replace(acc, F.concat(F.lit(r"(?iU)\b"), _literal(s["text"]), F.lit(r"\b")), F.lit(put)),
    )


def needles(spans: Column) -> Column:
    """The different texts found, longest first."""
    texts = F.array_distinct(F.transform(spans, lambda s: s["text"]))
    return F.transform(
        F.sort_array(F.transform(texts, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))), lambda x: x["t"]
    )


def mask_needles(text: Column, spans: Column, token: str = TOKEN) -> Column:
    """Every occurrence of every found text replaced, longest first."""
    return F.aggregate(needles(spans), text, lambda acc, t: F.replace(acc, t, F.lit(token)))


def mask_runs(runs: Column, spans: Column, token: str = TOKEN) -> Column:
    """Spans of a paragraph applied to its runs (``array<string>``): the token goes where the span begins,
    later runs lose their part; edits of one run that touch are one."""

    def of(z: Column) -> Column:
        def one(run: Column, i: Column) -> Column:
            base, end = F.get(z["starts"], i), F.get(z["starts"], i) + F.length(run)
            inside = F.filter(z["spans"], lambda s: (s["end"] > base) & (s["start"] < end))

            def edit(s: Column) -> Column:
                opens = s["start"] >= base
                return F.struct(
                    F.greatest(s["start"] - base, F.lit(0)).alias("start"),
                    F.least(s["end"] - base, F.length(run)).alias("end"),
                    F.when(opens, F.lit(token)).otherwise(F.lit("")).alias("put"),
                )

            return let(inside, lambda e: F.when(F.size(e) == 0, run).otherwise(_apply(run, F.transform(e, edit))))

        return F.transform(z["runs"], one)

    from .arrays import prefix_sums

    # the optimizer may put what gives the spans in their place, which must not be inside a loop over the runs
    starts = prefix_sums(F.transform(runs, lambda r: F.length(r)))
    return let(F.struct(runs.alias("runs"), starts.alias("starts"), spans.alias("spans")), of)


def _apply(run: Column, edits: Column) -> Column:
    def of(e: Column) -> Column:
        def piece(x: Column, i: Column) -> Column:
            end = F.coalesce(F.get(e, i - 1)["end"], F.lit(0))
            joined = (i > 0) & (x["start"] == end)
            return F.concat(F.substring(run, end + 1, x["start"] - end), F.when(joined, F.lit("")).otherwise(x["put"]))

        tail = F.substring(run, F.element_at(e, -1)["end"] + 1, F.length(run))
        return F.concat(F.array_join(F.transform(e, piece), ""), tail)

    return let(edits, lambda e: F.when(F.size(e) == 0, run).otherwise(of(e)))
