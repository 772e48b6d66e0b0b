"""Plain entry points: texts, tables and files, without building a plan by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.functions.detect import ScanOptions, detect, mask, summary
from veilwork.operators.presets import (
    all_presets,
    builtin_frame,
    builtin_presets,
    categories_of,
    category_labels,
    delete_preset,
    save_preset,
    saved_presets,
)
from veilwork.operators.redact import extract_text, masked_files, redact_file, redact_files, scan_files
from veilwork.operators.tabular import mask_cells, mask_table


def _texts(spark: SparkSession, texts: list[str | None]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(texts)), "i long, text string")


def detect_texts(spark: SparkSession, texts: list[str | None], opts: ScanOptions | None = None) -> list[list[dict]]:
    """What is found in each of a few texts; for tables use ``detect`` on a column."""
    rows = _texts(spark, texts).select("i", detect(F.col("text"), opts).alias("s")).orderBy("i").collect()
    return [[s.asDict() for s in r.s] for r in rows]


def summarise_texts(spark: SparkSession, texts: list[str | None], opts: ScanOptions | None = None) -> list[dict[str, int]]:
    """Counts by category of each of a few texts."""
    rows = _texts(spark, texts).select("i", summary(detect(F.col("text"), opts)).alias("n")).orderBy("i").collect()
    return [dict(r.n) for r in rows]


__all__ = [
    "ScanOptions",
    "all_presets",
    "builtin_frame",
    "builtin_presets",
    "categories_of",
    "category_labels",
    "delete_preset",
    "detect",
    "detect_texts",
    "extract_text",
    "mask",
    "mask_cells",
    "mask_table",
    "masked_files",
    "redact_file",
    "redact_files",
    "save_preset",
    "saved_presets",
    "scan_files",
    "summarise_texts",
    "summary",
]
