"""Secret scans; DataFrame operations only.

Three base rules find spans by pattern. The method adds tokens that look random: two
character Markov models, one of random strings and one of ordinary identifiers, give
every transition a log-likelihood ratio. A token is a run of ``ALPHABET`` of at least
``MIN_TOKEN`` characters, ``MIN_KINDS`` of them different, which rules and padding aren't.
It is reported if its mean ratio, or that of a part between separators (``/ _ = -``) that
is itself as long as a token, is above ``MIN_MEAN``, unless it overlaps a base span. So a
secret behind a long name or path isn't averaged away; one that separators cut into
shorter parts has the whole run's mean only.

The models are transition counts with add-one smoothing over labelled samples: random
strings are written out by rule (digests of numbers in hex, base64 and upper case),
ordinary identifiers are the words of all documents in the shapes that names have (plain,
snake, constant, camel with a number, path), each as often as it occurs. Their counts
follow from the words' letter pairs and ends, so the shapes need not be written out; they
are scaled to the random sample's size, so that smoothing acts alike on corpora of every
size. The table of ratios has a fixed size (the alphabet squared), so it may visit the driver.

Defined cases: a null text is an empty one; rows are scanned each by itself, so null or
repeated doc_ids and equal rows do no harm; an empty table trains on the random strings
alone and returns no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.functions.arrays import let
from veilwork.functions.spans import match_spans

from .common import stash
from .quality import words

KINDS = ("assign", "access", "hex", "random")
ASSIGN = (
    r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ASSIGN_GATE = r"(?i)password|passwd|secret|token|api_?key"
MIN_VALUE = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
MIN_TOKEN = 20
TOKEN = rf"[A-Za-z0-9+/_=-]{{{MIN_TOKEN},}}"
SEPARATORS = "[/_=-]+"
MIN_KINDS = 6
MIN_MEAN = 0.5
RANDOM_STRINGS = 20_000


def base_spans(text: Column) -> Column:
    """Sorted ``array<struct<start, kind, end>>``; kind numbers follow ``KINDS``."""

    def tagged(spans: Column, kind: int) -> Column:
        return F.transform(
            spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"))
        )

    value = lambda s: F.regexp_extract(s["text"], ASSIGN, 2)
    assign = F.filter(match_spans(text, ASSIGN, text.rlike(ASSIGN_GATE)), lambda s: F.length(value(s)) >= MIN_VALUE)
    # a run that is too short can't hold a longer one, so the shortest length may stand in the pattern
    access, hexes = match_spans(text, ACCESS, text.contains("AKIA")), match_spans(text, HEX)
    return F.sort_array(F.concat(tagged(assign, 0), tagged(access, 1), tagged(hexes, 2)))


# ---- the two Markov models ----------------------------------------------------------------------


def random_samples(spark: SparkSession, n: int = RANDOM_STRINGS) -> DataFrame:
    digest = F.sha2(F.col("id").cast("string"), 256)
    b64 = F.base64(F.unhex(digest))
    shapes = F.array(F.substring(digest, 1, 40), b64, F.translate(b64, "+/=", "-_"), F.upper(F.translate(b64, "+/=", "")))
    return spark.range(n).select(F.get(shapes, (F.col("id") % 4).cast("int")).alias("token"))


def codes(token: Column) -> Column:
    """1-based places of the characters in the alphabet; 0 for others."""
    return F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))


def transitions(samples: DataFrame) -> dict[tuple[str, str], float]:
    """How often one character of the alphabet follows another in the ``token`` column."""
    step = F.zip_with("c", F.slice("c", 2, F.size("c")), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    counts = (
        samples.select(codes(F.col("token")).alias("c"))
        .select(F.inline(step))
        .where((F.col("a") > 0) & (F.col("b") > 0))
        .groupBy("a", "b")
        .count()
        .collect()  # the table's size at most
    )
    return {(ALPHABET[a - 1], ALPHABET[b - 1]): float(n) for a, b, n in counts}


def plain_words(docs: DataFrame) -> DataFrame:
    """``(w, n)``: the words of two ASCII letters or more and how often they occur, without the marks around them."""
    bare = F.regexp_replace("raw", r"^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", "")
    each = docs.select(F.explode(words(F.coalesce("text", F.lit("")))).alias("raw")).groupBy("raw").count()
    return each.select(bare.alias("w"), F.col("count").alias("n")).where(F.col("w").rlike(r"^[A-Za-z]{2,}$"))


def identifier_transitions(docs: DataFrame) -> dict[tuple[str, str], float]:
    """``transitions`` of the names made of ``plain_words``: w, w_w, W_W, wW<n % 100> and w/w-<n % 100>."""
    found = stash(plain_words(docs), "words")
    at = F.sequence(F.lit(1), F.length("w") - 1)
    pairs = found.select(F.explode(F.transform(at, lambda i: F.struct(F.col("w").substr(i, F.lit(2)).alias("p"), (i == 1).alias("head")))), "n")
    # each of these tables has a fixed size
    pairs = pairs.groupBy("col.p", "col.head").agg(F.sum("n")).collect()
    head, tail = F.substring("w", 1, 1).alias("head"), F.substring("w", -1, 1).alias("tail")
    ends = found.groupBy(head, tail).agg(F.sum("n")).collect()
    numbers = found.groupBy(tail, (F.col("n") % 100).cast("string").alias("number")).agg(F.sum("n")).collect()
    out: dict[tuple[str, str], float] = {}

    def add(a: str, b: str, n: float) -> None:
        out[a, b] = out.get((a, b), 0.0) + n

    for (x, y), first, n in pairs:
        add(x, y, 5 * n)  # w, w_w, w/w
        add(x.upper(), y.upper(), 2 * n)
        add(x.lower(), y.lower(), n)
        add(x.upper() if first else x.lower(), y.lower(), n)
    for a, z, n in ends:
        for joint in "_/":
            add(z, joint, n)
            add(joint, a, n)
        add(z.upper(), "_", n)
        add("_", a.upper(), n)
        add(z.lower(), a.upper(), n)
        add(z, "-", n)
    for z, number, n in numbers:
        add(z.lower(), number[0], n)
        add("-", number[0], n)
        if len(number) > 1:
            add(number[0], number[1], 2 * n)
    return out


def log_ratios(random: dict[tuple[str, str], float], ordinary: dict[tuple[str, str], float]) -> list[float]:
    """Ratios of all transitions, row by row of the table."""
    size = len(ALPHABET)
    most = sum(random.values())
    scale = min(1.0, most / max(1.0, sum(ordinary.values())))
    tables = [[1.0 + part * t.get((a, b), 0.0) for a in ALPHABET for b in ALPHABET] for t, part in ((ordinary, scale), (random, 1.0))]
    rows = [[sum(t[a * size : (a + 1) * size]) for a in range(size)] for t in tables]
    return [
        math.log(tables[1][k] / rows[1][k // size]) - math.log(tables[0][k] / rows[0][k // size]) for k in range(size * size)
    ]


def fit(docs: DataFrame) -> list[float]:
    return log_ratios(transitions(random_samples(docs.sparkSession)), identifier_transitions(docs))


def mean_ratio(token: Column, ratios: list[float]) -> Column:
    size = len(ALPHABET)
    table = F.split(F.lit(" ".join(f"{r:.6f}" for r in ratios)), " ").cast("array<double>")
    step = lambda c: F.zip_with(
        F.slice(c, 1, F.size(c) - 1),
        F.slice(c, 2, F.size(c)),
        lambda a, b: F.coalesce(F.get(table, (a - 1) * size + b - 1), F.lit(0.0)),
    )
    total = lambda c: F.aggregate(step(c), F.lit(0.0), lambda s, x: s + x)
    return let(codes(token), lambda c: total(c) / F.greatest(F.size(c) - 1, F.lit(1)))


def random_spans(text: Column, base: Column, ratios: list[float]) -> Column:
    """Tokens that look random, as a whole or in a long part, and overlap no base span."""

    def fits(s: Column) -> Column:
        free = ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        varied = F.size(F.array_distinct(F.split(s["text"], ""))) >= MIN_KINDS
        parts = F.filter(F.split(s["text"], SEPARATORS), lambda p: F.length(p) >= MIN_TOKEN)
        scored = F.concat(F.array(s["text"]), parts)
        return varied & free & F.exists(scored, lambda p: mean_ratio(p, ratios) > MIN_MEAN)

    found = F.filter(match_spans(text, TOKEN), fits)
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(3).alias("kind"), s["end"].alias("end")))


def listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def scan(docs: DataFrame, ratios: list[float] | None = None) -> DataFrame:
    """``(doc_id, base, spans)`` for each row of ``docs``: sorted arrays of (start, kind, end)."""
    if ratios is None:
        ratios = fit(docs)
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    based = text.withColumn("base", base_spans(F.col("text")))
    both = F.sort_array(F.concat("base", random_spans(F.col("text"), F.col("base"), ratios)))
    return based.withColumn("spans", both).select("doc_id", "base", "spans")


def report(docs: DataFrame, ratios: list[float] | None = None) -> DataFrame:
    """Counts, digest and list of spans for each row of ``docs``."""
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return scan(docs, ratios).select(
        "doc_id",
        n(0).alias("n_assign"),
        n(1).alias("n_access"),
        n(2).alias("n_hex"),
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )
