"""Whole files: scan counts, masked copies, results per file.

Detection runs as Column expressions over all units of all files; Python only parses and
rewrites the archives, one file at a time. A file's units follow its content through the
same task, in their order, so nothing is shuffled and nothing is made twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from veilwork.functions.detect import ScanOptions, detect, mask, mask_runs, needles
from veilwork.sources import files as source
from veilwork.sources import ooxml, pdf

from .manifest import EXTENSIONS, SUFFIX, image_name, image_path, refused, target_path
from .report import file_text
from .tabular import header_category, strip

ROW = "file_id string, out string, redaction_count long, per_category map<string,bigint>, error string"
RESULT = ROW + ", outputs array<string>"


def _looked_at(found: DataFrame, opts: ScanOptions, contents: bool) -> DataFrame:
    """``pieces`` with what is found in each: the categories, and, with ``contents``, what takes a piece's place. No shuffle, and the same order."""
    is_unit, is_cell = F.col("kind") == "unit", F.col("kind") == "cell"
    scanned = F.when(is_unit | (is_cell & (F.col("vtype") == "string")), F.coalesce("text", F.array_join("runs", "")))
    seen = source.pieces(found, contents).withColumn("scanned", scanned).withColumn("s", detect(F.col("scanned"), opts))
    hit = F.size("s") > 0
    put = opts.replacement
    return seen.select(
        "path",
        "kind",
        "no",
        "sheet",
        "row_no",
        "col_no",
        F.when(F.col("kind") == "head", header_category(F.col("text"), opts.categories)).alias("head"),
        (is_cell & (F.length(strip(F.col("text"))) > 0)).alias("filled"),
        F.when(hit, F.transform("s", lambda s: s["category"])).alias("categories"),
        (F.when(is_unit & hit & F.col("runs").isNotNull(), mask_runs(F.col("runs"), F.col("s"), put)) if contents else F.lit(None).cast("array<string>")).alias("runs"),
        (F.when(is_unit & hit & F.col("runs").isNull(), needles(F.col("s"))) if contents else F.lit(None).cast("array<string>")).alias("needles"),
        (F.when(is_cell & hit, mask(F.col("text"), F.col("s"), put)) if contents else F.lit(None).cast("string")).alias("masked"),
        "content",
        "error",
    )


class _File:
    """What the rows of one file say, taken as they come."""

    def __init__(self, rows: Iterator[tuple], put: str):
        self.counts: dict[str, int] = {}
        self.error: str | None = None
        self.size = 0
        self._rows, self._put, self._open = rows, put, True

    def _count(self, categories: list[str]) -> None:
        for c in categories:
            self.counts[c] = self.counts.get(c, 0) + 1

    def _own(self) -> Iterator[tuple]:
        while self._open:
            _, kind, no, sheet, row, col, head, filled, categories, runs, words, masked, _, error = next(self._rows)
            if kind in ("end", "error"):
                self._open, self.size, self.error = False, no or 0, error
                return
            if categories and kind == "unit":
                self._count(categories)
            yield kind, no, sheet, row, col, head, filled, categories, runs, words, masked

    def units(self) -> Iterator[tuple[int, list[str]]]:
        """``(number, its runs or texts to find)`` of units with a hit."""
        for _, no, *_, runs, words, _ in self._own():
            if runs is not None or words is not None:
                yield no, runs if runs is not None else words

    def cells(self) -> Iterator[tuple[str, int, str]]:
        """``(sheet, number, string)`` of replaced cells: below a header each one that isn't blank."""
        heads: dict[tuple, tuple[int, str]] = {}
        for kind, no, sheet, row, col, head, filled, categories, _, _, masked in self._own():
            at = (sheet, col)
            if kind == "head":
                if head is not None:
                    heads[at] = min(heads.get(at, (row, head)), (row, head))
                continue
            if filled and at in heads and row > heads[at][0]:
                self._count([heads[at][1]])
                yield sheet, no, self._put
            elif categories:
                self._count(categories)
                yield sheet, no, masked

    def rewritten(self, path: str, raw: bytes) -> bytes:
        if path.lower().endswith(".xlsx"):
            return ooxml.xlsx_masked(raw, self.cells())
        units = {no: list(new) for no, new in self.units()}
        return ooxml.docx_masked(raw, units) if path.lower().endswith(".docx") else pdf.masked(raw, units)

    def finish(self, path: str) -> None:
        """Takes the rows that are left."""
        for _ in self.cells() if path.lower().endswith(".xlsx") else self.units():
            pass


def scan_found(found: DataFrame, opts: ScanOptions | None = None) -> DataFrame:
    """``scan_files`` of files (path, content); files without a unit or cell have no row."""
    opts = opts or ScanOptions()
    put, ddl = opts.replacement, "path string, per_category map<string,bigint>, error string"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def results() -> Iterator[tuple]:
            for path, *_ in (rows := source.rows_in(batches)):
                file = _File(rows, put)
                file.finish(path)
                if file.error is not None:
                    yield path, [], file.error
                elif file.size:
                    yield path, sorted(file.counts.items()), None

        return source.in_batches(results(), schema, lambda r: 0)

    schema = source.arrow_schema(ddl)
    return _looked_at(found, opts, False).mapInArrow(each, ddl)


def scan_files(spark: SparkSession, path: str, opts: ScanOptions | None = None) -> DataFrame:
    """``(path, per_category, error)``, by the same steps as masking, so the counts agree."""
    return scan_found(source.binary_files(spark, path), opts)


def masked_files(
    spark: SparkSession,
    path: str,
    opts: ScanOptions | None = None,
    out_dir: str | None = None,
    suffix: str = SUFFIX,
    out_path: str | dict[str, str] | None = None,
) -> DataFrame:
    """``masked_found`` of the files below ``path``."""
    return masked_found(source.binary_files(spark, path), opts, out_dir, suffix, out_path)


def masked_found(
    found: DataFrame,
    opts: ScanOptions | None = None,
    out_dir: str | None = None,
    suffix: str = SUFFIX,
    out_path: str | dict[str, str] | None = None,
    paths: DataFrame | None = None,
) -> DataFrame:
    """``(file_id, out, redaction_count, per_category, error, content)``: masked copies of the files (path, content).

    ``out_path``: where the copy goes, for a single file; for several, by the end of the source's path. ``paths``: the
    paths of the files (path), where they are known without making the files.
    """
    opts = opts or ScanOptions()
    put = opts.replacement
    plan = refused(found.select("path", "content"), found.select("path") if paths is None else paths, out_dir, suffix, out_path)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def results() -> Iterator[tuple]:
            for path, *_, content, _ in (rows := source.rows_in(batches)):
                file, done, error = _File(rows, put), None, None
                try:
                    done = file.rewritten(path, content)
                except Exception as e:  # one bad file doesn't stop the others
                    error = f"{type(e).__name__}: {e}"
                file.finish(path)
                error = file.error or error
                counts = sorted(file.counts.items()) if error is None else []
                yield path, sum(n for _, n in counts), counts, error, done if error is None else None

        return source.in_batches(results(), schema, lambda r: len(r[4] or b""))

    ddl = "file_id string, redaction_count long, per_category map<string,bigint>, error string, content binary"
    schema = source.arrow_schema(ddl)
    done = _looked_at(plan, opts, True).mapInArrow(each, ddl)
    out = target_path(F.col("file_id"), out_dir, suffix, out_path)
    return done.select("file_id", out.alias("out"), "redaction_count", "per_category", "error", "content")


def write_one(put: Callable[[str, bytes], None], out: str, content: bytes, image_format: str | None = None) -> tuple[list[str], str | None]:
    """Write one masked file, and the pages of a PDF as images if a format is given: what was written, and an error."""
    done: list[str] = []
    try:
        put(out, content)
        done.append(out)
        if image_format and out.lower().endswith(".pdf"):
            for n, shot in enumerate(pdf.rendered(content, image_format), 1):
                at = image_name(out, n, image_format)
                put(at, shot)
                done.append(at)
    except Exception as e:  # what is written already stays
        return done, f"{type(e).__name__}: {e}"
    return done, None


def put_bytes(out: str, content: bytes) -> None:
    """To a path in any file system that Arrow knows."""
    import posixpath

    from pyarrow import fs

    local = out.startswith("file:/") and not out.startswith("file:///")
    store, at = fs.FileSystem.from_uri(out.replace("file:/", "file:///", 1) if local else out)
    store.create_dir(posixpath.dirname(at), recursive=True)
    with store.open_output_stream(at) as f:
        f.write(content)


def write_files(masked: DataFrame, image_format: str | None = None) -> DataFrame:
    """Write each masked copy to its ``out`` path, in whatever file system that is; the result rows without contents.

    ``image_format``: pages of PDF files are written as images too. ``outputs`` lists what was written.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done = [
                write_one(put_bytes, out, content, image_format) if error is None else ([], error)
                for out, content, error in zip(b["out"], b["content"], b["error"])
            ]
            yield b.drop(columns="content").assign(error=[e for _, e in done], outputs=[o for o, _ in done])

    return masked.mapInPandas(each, RESULT)


def page_images(masked: DataFrame, fmt: str = "PNG") -> DataFrame:
    """``(file_id, out, error, content)``: the pages of masked PDF files as images, named after the masked file."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, out, raw in zip(b["file_id"], b["out"], b["content"]):
                try:
                    rows += [(path, out, n, None, shot) for n, shot in enumerate(pdf.rendered(raw, fmt), 1)]
                except Exception as e:  # the masked file is there all the same
                    rows.append((path, out, 0, f"{type(e).__name__}: {e}", None))
            yield pd.DataFrame(rows, columns=["file_id", "out", "page", "error", "content"])

    pages = masked.where(F.lower("out").endswith(".pdf") & F.col("content").isNotNull())
    shots = pages.select("file_id", "out", "content").mapInPandas(each, "file_id string, out string, page int, error string, content binary")
    return shots.select("file_id", image_path(F.col("out"), F.col("page"), fmt).alias("out"), "error", "content")


def extract_text(spark: SparkSession, path: str) -> DataFrame:
    """``(file_id, text, error)``: what the files below ``path`` say, blank units left out; of sheets all cells of any type."""
    found = source.binary_files(spark, path)
    units = source.read_units(found.where(~F.lower("path").endswith(".xlsx"))).select("file_id", "unit_ord", "text", "error")
    place = F.row_number().over(Window.partitionBy("file_id").orderBy(F.monotonically_increasing_id()))
    cells = source.read_cells(found, formulas=False).select("file_id", place.cast("int").alias("unit_ord"), F.col("value").alias("text"), "error")
    every = units.unionByName(cells)
    errors = every.groupBy("file_id").agg(F.max("error").alias("error"))
    return errors.join(file_text(every), "file_id", "left").select("file_id", F.coalesce("text", F.when(F.col("error").isNull(), F.lit(""))).alias("text"), "error")


def redact_files(
    spark: SparkSession,
    path: str,
    opts: ScanOptions | None = None,
    out_dir: str | None = None,
    suffix: str = SUFFIX,
    out_path: str | dict[str, str] | None = None,
    image_output: bool = False,
    image_format: str = "PNG",
) -> list:
    """Mask the files below ``path`` and write the copies; a result row per file.

    ``image_output``: the pages of masked PDF files are written as images too, in a folder named after the masked file.
    """
    masked = masked_files(spark, path, opts, out_dir, suffix, out_path)
    return write_files(masked, image_format if image_output else None).collect()


def redact_file(spark: SparkSession, path: str, opts: ScanOptions | None = None, **how):
    """``redact_files`` for one file: its result row. A kind of file that can't be read is an error in the row."""
    if not path.lower().endswith(EXTENSIONS):
        kind = path[path.rfind(".") :] if "." in path.rsplit("/", 1)[-1] else ""
        return Row(file_id=path, out=None, redaction_count=0, per_category={}, error=f"Unsupported file type: {kind.lower()}", outputs=[])
    (row,) = redact_files(spark, path, opts, **how)
    return row
