"""Joins and merges of intervals: spans against runs, and overlapping spans against each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilwork.functions.arrays import let, prefix_sums


def overlaps(runs: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """Runs ``(key, run_ord, run_start, run_end)`` joined with the spans ``(key, start, end)`` that they share characters with."""
    b = spans.withColumnRenamed(key, "_key")
    on = (runs[key] == b["_key"]) & (b["end"] > runs["run_start"]) & (b["start"] < runs["run_end"])
    return runs.join(b.hint("merge"), on).drop("_key")  # estimates of what explodes are far too low: never broadcast


def touching(runs: Column, spans: Column) -> Column:
    """``array<struct<run_ord, start, end, category>>``: the spans that each run of a paragraph (``array<string>``) shares characters with.

    As ``overlaps``, where a paragraph's runs and spans stand in one row: nothing is joined or sorted.
    """

    def of(z: Column) -> Column:
        def one(run: Column, i: Column) -> Column:
            base, end = F.get(z["starts"], i), F.get(z["starts"], i) + F.length(run)
            inside = F.filter(z["spans"], lambda s: (s["end"] > base) & (s["start"] < end))
            return F.transform(inside, lambda s: F.struct(i.alias("run_ord"), s["start"].alias("start"), s["end"].alias("end"), s["category"].alias("category")))

        return F.flatten(F.transform(z["runs"], one))

    starts = prefix_sums(F.transform(runs, lambda r: F.length(r)))
    return let(F.struct(runs.alias("runs"), starts.alias("starts"), spans.alias("spans")), of)


def run_positions(runs: DataFrame, key: str) -> DataFrame:
    """Runs ``(key, run_ord, text)`` with ``run_start`` and ``run_end`` in their paragraph."""
    upto = Window.partitionBy(key).orderBy("run_ord").rowsBetween(Window.unboundedPreceding, 0)
    ends = runs.withColumn("run_end", F.sum(F.length("text")).over(upto))
    return ends.withColumn("run_start", F.col("run_end") - F.length("text"))


def merged(spans: DataFrame, key: str) -> DataFrame:
    """Union of the intervals of each key; intervals that touch become one."""
    before = Window.partitionBy(key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    new = F.coalesce((F.col("start") > F.max("end").over(before)).cast("int"), F.lit(1))
    numbered = spans.withColumn("_new", new).withColumn("_island", F.sum("_new").over(upto))
    return numbered.groupBy(key, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")
