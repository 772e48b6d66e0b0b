"""Sheets and tables: which columns hold personal data by their headers, and how cells are masked.

Long form: ``cells(file_id, sheet, row_no, col_no, vtype, value)``, rows and columns from 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilwork.functions.detect import ScanOptions, detect, mask
from veilwork.functions.patterns import CATEGORIES, HEADER_CHARS, HEADER_ROWS, HEADER_RULES

SHEET = ["file_id", "sheet"]


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def header_category(label: Column, enabled=None) -> Column:
    """The category of the first enabled rule that a header label meets, else null."""
    keys = set(CATEGORIES) if not enabled else set(enabled)
    text = strip(label)
    found = F.lit(None).cast("string")
    for rule, category in reversed(HEADER_RULES):
        if category in keys:
            found = F.when(text.rlike(f"(?iU){rule}"), F.lit(category)).otherwise(found)
    return F.when((F.length(text) > 0) & (F.length(text) <= HEADER_CHARS), found)


def header_columns(cells: DataFrame, opts: ScanOptions | None = None) -> DataFrame:
    """``(file_id, sheet, col_no, header_row, category)``: the first header of each column in the first rows of a sheet."""
    opts = opts or ScanOptions()
    head = cells.where((F.col("row_no") <= HEADER_ROWS) & (F.col("vtype") == "string")).withColumn(
        "category", header_category(F.col("value"), opts.categories)
    )
    first = F.min(F.struct(F.col("row_no").alias("header_row"), "category"))
    return (
        head.where(F.col("category").isNotNull())
        .groupBy(*SHEET, "col_no")
        .agg(first.alias("h"))
        .select(*SHEET, "col_no", "h.header_row", "h.category")
    )


def mask_cells(cells: DataFrame, opts: ScanOptions | None = None) -> DataFrame:
    """``cells`` with ``masked`` and ``hits`` (map of counts by category).

    Below a header every value that isn't blank is replaced whole, whatever its type; other
    strings are scanned. An empty category list means all for headers and none for texts.
    """
    opts = opts or ScanOptions()
    heads = header_columns(cells, opts).withColumnRenamed("category", "head_category")
    wide = cells.join(heads, [*SHEET, "col_no"], "left")
    under = F.coalesce((F.col("row_no") > F.col("header_row")) & (F.length(strip(F.col("value"))) > 0), F.lit(False))
    spans = detect(F.when(~under & (F.col("vtype") == "string"), F.col("value")), opts)
    counts = F.transform(
        F.array_distinct(F.transform("spans", lambda s: s["category"])),
        lambda c: F.struct(c.alias("key"), F.size(F.filter("spans", lambda s: s["category"] == c)).cast("long").alias("value")),
    )
    return (
        wide.withColumn("under", under)
        .withColumn("spans", spans)
        .withColumn("masked", F.when(F.col("under"), F.lit(opts.replacement)).otherwise(mask(F.col("value"), F.col("spans"), opts.replacement)))
        .withColumn(
            "hits",
            F.when(F.col("under"), F.create_map(F.col("head_category"), F.lit(1).cast("long"))).otherwise(F.map_from_entries(counts)),
        )
        .drop("under", "spans", "header_row", "head_category")
    )


def mask_table(df: DataFrame, opts: ScanOptions | None = None, headers: dict[str, str] | None = None) -> DataFrame:
    """A wide table masked by its column names (or ``headers``: column to label): headed columns become
    tokens, other strings are scanned. No shuffle."""
    opts = opts or ScanOptions()
    labels = headers or {c: c for c in df.columns}
    keys = set(CATEGORIES) if not opts.categories else set(opts.categories)
    out = []
    for c, kind in df.dtypes:
        category = column_category(labels.get(c, c), keys)
        value = F.col(f"`{c}`")
        if category:
            blank = F.length(strip(value.cast("string"))) == 0
            out.append(F.when(value.isNull() | blank, value.cast("string")).otherwise(F.lit(opts.replacement)).alias(c))
        elif kind == "string":
            out.append(mask(value, detect(value, opts), opts.replacement).alias(c))
        else:
            out.append(value)
    return df.select(*out)


def column_category(label: str, keys: set[str]) -> str | None:
    """As ``header_category``, on the driver, for a column's name."""
    import re

    text = label.strip()
    if not text or len(text) > HEADER_CHARS:
        return None
    return next((cat for rule, cat in HEADER_RULES if cat in keys and re.search(rule, text, re.IGNORECASE)), None)


def numbered(df: DataFrame, key: str, name: str, parts: int = 64) -> DataFrame:
    """``df`` with its rows numbered from 1 in order of a numeric ``key``: inside ranges of the key, and by the ranges' sizes."""
    (cuts,) = df.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)])).first()
    part = sum(((F.col(key) > F.lit(c)).cast("int") for c in sorted(set(cuts or []))), F.lit(0))
    ranged = df.withColumn("_part", part)
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))  # at most ``parts`` rows
    bases = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(key))
    return ranged.join(F.broadcast(bases), "_part").withColumn(name, (inside + F.col("_base")).cast("int")).drop("_part", "_base")


def to_cells(df: DataFrame, file_id: str, key: str, columns: dict[str, str], sheet: str = "Sheet1") -> DataFrame:
    """A table as the cells of a sheet: a header row of labels, then the rows in order of ``key``.

    ``columns``: column to label; ``key`` is numeric.
    """
    rows = numbered(df.select(key, *[c for c in columns if c != key]), key, "_row").withColumn("_row", F.col("_row") + 1)
    kinds = dict(df.dtypes)
    each = [
        F.struct(
            F.lit(i).alias("col_no"),
            F.lit("string" if kinds[c] == "string" else "number").alias("vtype"),
            F.col(c).cast("string").alias("value"),
        )
        for i, c in enumerate(columns, 1)
    ]
    head = [
        F.struct(F.lit(i).alias("col_no"), F.lit("string").alias("vtype"), F.lit(label).alias("value"))
        for i, label in enumerate(columns.values(), 1)
    ]
    place = lambda row: [F.lit(file_id).alias("file_id"), F.lit(sheet).alias("sheet"), row.alias("row_no")]
    body = rows.select(*place(F.col("_row")), F.inline(F.array(*each)))
    top = df.sparkSession.range(1).select(*place(F.lit(1)), F.inline(F.array(*head)))
    return top.unionByName(body)
