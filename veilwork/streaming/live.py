"""Detection on streams: the same expressions, stateless per row; counts over time need a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.functions.detect import ScanOptions, detect, mask


def masked_stream(rows: DataFrame, text: str, opts: ScanOptions | None = None) -> DataFrame:
    """A stream with ``text`` masked in place; works on tables as well."""
    opts = opts or ScanOptions()
    return rows.withColumn(text, mask(F.col(text), detect(F.col(text), opts), opts.replacement))


def counts_over_time(rows: DataFrame, time: str, text: str, width: str, late: str, opts: ScanOptions | None = None) -> DataFrame:
    """``(window_start, category, n)``; rows later than ``late`` are left out by a stream, as its watermark says."""
    kind = rows.schema[time].dataType
    timed = rows.withColumn(time, F.col(time).cast("timestamp"))  # watermarks know no other type
    found = timed.withWatermark(time, late).select(
        F.col(time).alias("_t"), F.explode(F.transform(detect(F.col(text), opts), lambda s: s["category"])).alias("category")
    )
    return (
        found.groupBy(F.window("_t", width), "category")
        .agg(F.count("*").alias("n"))
        .select(F.col("window.start").cast(kind).alias("window_start"), "category", "n")
    )
