"""Counts, reports and checks over text units ``(file_id, unit_ord, text)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.functions.detect import ScanOptions, detect, mask, summary
from veilwork.functions.patterns import CATEGORIES

BLANK_CHARS = 20
CONTEXT = 60


#: Texts that one task scans, if they aren't long.
TASK_TEXTS = 8192


def spread(df: DataFrame, *by: str | Column, rows: DataFrame | None = None, texts: int = TASK_TEXTS) -> DataFrame:
    """``df`` dealt by a key (``by``) over tasks of about so many ``texts``, at least one a core: scanning costs more than moving.

    A file's splits say little: a small one is a single split, and rows that texts are made of are short. ``rows``: a table
    that has as many rows and is quick to count.
    """
    n = (df if rows is None else rows).count()
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-n // texts)), *by)


def hits(units: DataFrame, opts: ScanOptions | None = None, policy: str = "compat") -> DataFrame:
    """One row per match: the units' other columns and ``start, end, text, category``."""
    keys = [c for c in units.columns if c != "text"]
    return units.select(*keys, F.explode(detect(F.col("text"), opts, policy)).alias("_m")).select(
        *keys, F.col("_m.start").alias("start"), F.col("_m.end").alias("end"), F.col("_m.text").alias("text"), F.col("_m.category").alias("category")
    )


def masked(units: DataFrame, opts: ScanOptions | None = None, policy: str = "compat") -> DataFrame:
    """``units`` with ``masked`` and ``hits`` (counts by category); no shuffle."""
    opts = opts or ScanOptions()
    found = units.withColumn("_s", detect(F.col("text"), opts, policy))
    return (
        found.withColumn("masked", mask(F.col("text"), F.col("_s"), opts.replacement))
        .withColumn("hits", summary(F.col("_s")))
        .drop("_s")
    )


def scan(units: DataFrame, opts: ScanOptions | None = None) -> DataFrame:
    """``(file_id, category, n)``. Only categories leave the units, and counts are combined before the shuffle."""
    found = units.select("file_id", F.explode(F.transform(detect(F.col("text"), opts), lambda s: s["category"])).alias("category"))
    return found.groupBy("file_id", "category").agg(F.count("*").alias("n"))


def report(counts: DataFrame) -> DataFrame:
    """Per file and category, per file, and in total (nulls stand for all)."""
    return counts.rollup("file_id", "category").agg(F.sum("n").alias("n"))


def labelled(counts: DataFrame) -> DataFrame:
    """``counts`` with the categories' labels; unknown keys are their own labels. The label table has 19 rows."""
    spark = counts.sparkSession
    labels = spark.createDataFrame([(c.key, c.label) for c in CATEGORIES.values()], "key string, label string")
    return counts.join(F.broadcast(labels), counts["category"] == labels["key"], "left").select(
        counts["*"], F.coalesce("label", "category").alias("label")
    )


def file_results(units: DataFrame, opts: ScanOptions | None = None) -> DataFrame:
    """``(file_id, redaction_count, per_category)`` for each file, files without a hit included."""
    per = scan(units, opts).groupBy("file_id").agg(
        F.sum("n").alias("redaction_count"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", "n")))).alias("per_category"),
    )
    files = units.select("file_id").distinct()
    empty = F.create_map().cast("map<string,bigint>")
    return files.join(per, "file_id", "left").select(
        "file_id", F.coalesce("redaction_count", F.lit(0)).alias("redaction_count"), F.coalesce("per_category", empty).alias("per_category")
    )


def file_text(units: DataFrame) -> DataFrame:
    """``(file_id, text)``: the units that aren't blank, in order, joined by line ends."""
    kept = units.where(F.length(F.btrim("text")) > 0)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("unit_ord", "text"))), lambda x: x["text"])
    return kept.groupBy("file_id").agg(F.array_join(parts, "\n").alias("text"))


def contains_any(text: Column, forbidden: list[str]) -> Column:
    """The forbidden strings that a text still holds, letters in either case."""
    low = F.lower(text)
    return F.filter(F.array(*map(F.lit, forbidden)), lambda f: F.coalesce(low.contains(F.lower(f)), F.lit(False)))


def leaks(units: DataFrame, forbidden: list[str]) -> DataFrame:
    """``(file_id, unit_ord, forbidden, context)`` for each forbidden string in a masked text; the list is part of the plan."""
    found = units.select("file_id", "unit_ord", "text", F.explode(contains_any(F.col("text"), forbidden)).alias("forbidden"))
    at = F.instr(F.lower("text"), F.lower("forbidden"))
    start = F.greatest(at - CONTEXT, F.lit(1))
    context = F.substring(F.col("text"), start, at - start + F.length("forbidden") + CONTEXT)
    return found.select("file_id", "unit_ord", "forbidden", context.alias("context"))


def image_only(units: DataFrame, least: int = BLANK_CHARS) -> DataFrame:
    """``(file_id, n_chars, image_only)``: files with hardly any text can't be checked."""
    chars = F.sum(F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s+", "")))
    return units.groupBy("file_id").agg(chars.alias("n_chars")).withColumn("image_only", F.col("n_chars") < least)


def tallies(results: DataFrame) -> DataFrame:
    """``(n_ok, n_failed)`` over result rows with an ``error`` column."""
    return results.agg(F.count_if(F.col("error").isNull()).alias("n_ok"), F.count_if(F.col("error").isNotNull()).alias("n_failed"))


def lines(results: list) -> list[str]:
    """Result rows (``file_id, per_category, error``) of one batch as text: per file, per category, in total."""
    out, total, failed = [], 0, 0
    for r in results:
        name = (r["file_id"] if "file_id" in r else r["path"]).rsplit("/", 1)[-1]
        if r["error"]:
            failed += 1
            out.append(f"{name}: failed ({r['error']})")
            continue
        counts = dict(sorted((r["per_category"] or {}).items()))
        total += sum(counts.values())
        out.append(f"{name}: {sum(counts.values())}")
        out += [f"  {CATEGORIES[k].label if k in CATEGORIES else k}: {n}" for k, n in counts.items()]
    return [*out, f"total: {total} in {len(results) - failed} files, {failed} failed"]
