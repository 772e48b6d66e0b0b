"""Quality rules: per-document counts and cross-document line frequency; DataFrame operations only.

Lines are normalised (stripped, runs of white space made one space, A-Z lowered) and
hashed to 128 bits together with their host (``source``). A line that more than
``max_docs`` different documents of one host hold is removed there, whatever the host's
size; a document that keeps less than ``min_left`` of its words is depleted and rejected.
Documents are different if their texts are, so copies of a document don't condemn its lines.

Base rules use the document alone: too few words, or too many of them in repeated
three-word windows. Windows are compared by 64-bit hashes inside one text.

Defined cases: a null text has no words and fails the base rule; a null source is a
host of its own; null and repeated doc_ids keep one result row per input row; an empty
table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.functions.arrays import let, neighbours_equal

from .common import WS, WS_CHARS, ascii_lower, stash, strip_ws
from .line_dedup import kept_lines

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A line in more documents of one host than this is removed there.
MAX_DOCS = 20
#: Share of its words that a document must keep.
MIN_LEFT = 0.5
SYMBOLS = r"[#*$%&|<>]"
#: Bits of a packed window that hold its position; a text has fewer words than 2 ** 28.
POS_BITS = 28


def words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(WS_CHARS))
    return F.when(F.length(bare) == 0, F.array().cast("array<string>")).otherwise(F.split(bare, f"[{WS}]+", -1))


def repeat_words(all_words: Column) -> Column:
    """Words in three-word windows that occur twice or more.

    Packed (hash prefix, position) longs are sorted to find windows that may recur;
    those are compared again by their whole hashes.
    """
    low = (1 << POS_BITS) - 1

    def window(h: Column, i: Column) -> Column:
        return F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2))

    def packed(h: Column) -> Column:
        return F.transform(
            F.slice(h, 1, F.greatest(F.size(h) - 2, F.lit(0))),
            lambda _, i: F.shiftleft(window(h, i), POS_BITS).bitwiseOR(i.cast("long")),
        )

    def exact(h: Column, maybe: Column) -> Column:
        full = F.transform(
            maybe,
            lambda x: let(x.bitwiseAND(F.lit(low)).cast("int"), lambda p: F.struct(window(h, p).alias("k"), p.alias("p"))),
        )
        same = let(F.sort_array(full), lambda s: neighbours_equal(s, lambda e: e["k"]))
        return F.sort_array(F.transform(same, lambda e: e["p"]))

    def covered(p: Column) -> Column:
        step = F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3))))
        return F.aggregate(step, F.lit(0), lambda a, x: a + x)

    def of(h: Column) -> Column:
        maybe = let(F.sort_array(packed(h)), lambda s: neighbours_equal(s, lambda x: F.shiftright(x, POS_BITS)))
        return let(maybe, lambda m: F.when(F.size(m) == 0, F.lit(0)).otherwise(let(exact(h, m), covered)))

    return let(F.transform(all_words, lambda w: F.xxhash64(w)), of)


def measured(docs: DataFrame) -> DataFrame:
    """Per row: ``_row``, doc_id, text hash, base counts, and its lines as ``(pos, h1, h2, n)``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    host = [F.col("source").isNull(), F.coalesce(F.col("source"), F.lit(""))]
    parts = docs.select("doc_id", "source", text.alias("text"))
    with_word = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(f"[^{WS}]"))

    def line(x: Column, i: Column) -> Column:
        bare = F.regexp_replace(strip_ws(x), f"[{WS}]+", " ")
        return let(
            let(bare, ascii_lower),
            lambda key: F.struct(
                i.alias("pos"),
                F.xxhash64(*host, key).alias("h1"),
                F.xxhash64(F.lit("line"), *host, key).alias("h2"),
                F.when(key == "", F.lit(0))
                .otherwise(F.length(key) - F.length(F.replace(key, F.lit(" "), F.lit(""))) + 1)
                .alias("n"),
            ),
        )

    return parts.select(
        F.monotonically_increasing_id().alias("_row"),
        "doc_id",
        F.xxhash64("text").alias("_text"),
        F.length(F.regexp_replace("text", f"[{WS}]+", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(with_word, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines"),
        let(words(F.col("text")), lambda w: F.struct(F.size(w).alias("n"), repeat_words(w).alias("r"))).alias("_w"),
        F.filter(F.transform(F.split("text", "\n", -1), line), lambda x: x["n"] > 0).alias("_lines"),
    ).select(
        "_row",
        "doc_id",
        "_text",
        F.col("_w.n").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.col("_w.r").cast("long").alias("n_repeat_words"),
        "_lines",
    )


def frequent_lines(rows: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """``(h1, h2)`` of the lines above their host's limit, counted over different texts."""
    line = F.inline(F.transform("_lines", lambda x: F.struct(x["h1"].alias("h1"), x["h2"].alias("h2"))))
    often = rows.select("_text", line).groupBy("h1", "h2").agg(F.countDistinct("_text").alias("n_docs"))
    return often.where(F.col("n_docs") > max_docs).select("h1", "h2")


def rate(docs: DataFrame, max_docs: int = MAX_DOCS, min_left: float = MIN_LEFT) -> DataFrame:
    """A row per row of ``docs``: doc_id, the counts, ``n_line_words_removed``, ``dropped`` (0-based
    positions of the removed lines, null if none), ``base_failed`` and ``kept``."""
    rows = stash(measured(docs), "quality-rows")
    lines = rows.select("_row", F.inline("_lines"))
    removed = (
        lines.join(stash(frequent_lines(rows, max_docs), "frequent-lines"), ["h1", "h2"])
        .groupBy("_row")
        .agg(F.sum("n").alias("gone"), F.sort_array(F.collect_list("pos")).alias("dropped"))
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return (
        rows.drop("_lines")
        .join(removed, "_row", "left")
        .withColumn("n_line_words_removed", F.coalesce("gone", F.lit(0)).cast("long"))
        .withColumn("base_failed", failed)
        .withColumn(
            "kept",
            ~F.col("base_failed") & (F.col("n_words") - F.col("n_line_words_removed") >= min_left * F.col("n_words")),
        )
        .drop("gone")
    )


def cleaned(docs: DataFrame, **limits) -> DataFrame:
    """``(doc_id, text)`` of the documents that stay, without the lines above the limits."""
    rated = rate(docs, **limits).where("kept").groupBy("doc_id", "_text").agg(F.first("dropped").alias("_dropped"))
    text = F.coalesce(docs["text"], F.lit(""))
    both = docs.select("doc_id", text.alias("text")).join(
        rated.withColumnRenamed("doc_id", "_id"),
        F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_text")),
    )
    stay = F.array_join(kept_lines(F.split("text", "\n", -1), F.col("_dropped")), "\n")
    return both.select("doc_id", F.when(F.col("_dropped").isNull(), F.col("text")).otherwise(stay).alias("text"))
