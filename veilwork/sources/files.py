"""Text units of files and tables.

Files are read as bytes and parsed on the executors; a file that can't be parsed yields
one row with an ``error`` and no text, so it doesn't stop the others.
"""

from __future__ import annotations

import importlib.util
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.functions.patterns import HEADER_ROWS

from . import ooxml, pdf

UNITS = "file_id string, unit_ord int, unit_kind string, runs array<string>, text string, error string"
CELLS = "file_id string, sheet string, row_no int, col_no int, vtype string, value string, error string"


def parser_available(extension: str) -> bool:
    """Whether files of this kind can be read here: PDF files by a library, or plain ones without."""
    return extension in (".docx", ".xlsx", ".pdf")


def renderer_available() -> bool:
    """Whether PDF pages can be drawn here."""
    return importlib.util.find_spec("fitz") is not None


def units_of(path: str, raw: bytes) -> list[tuple[str, list[str] | None, str]]:
    """``(kind, runs, text)`` of one file."""
    ext = path[path.rfind(".") :].lower()
    if ext == ".docx":
        return [(kind, runs, "".join(runs)) for kind, runs in ooxml.docx_units(raw)]
    if ext == ".xlsx":
        cells = ooxml.xlsx_cells(raw, formulas=False)
        return [("cell", None, value) for _, _, _, kind, value in cells if kind == "string" and value.strip()]
    if ext == ".pdf":
        return [("page", None, text) for text in pdf.page_texts(raw)]
    raise ValueError(f"Unsupported file type: {ext}")


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """Word, Excel and PDF files below ``path``."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{docx,xlsx,pdf,DOCX,XLSX,PDF}").load(path)


#: Rows and characters that go to the JVM at a time, roughly.
BATCH_ROWS, BATCH_CHARS = 4096, 1 << 22


def in_batches(rows: Iterable[tuple], schema: pa.Schema, weight: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of bounded size; one row may be larger."""
    held: list[tuple] = []
    size = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)

    for row in rows:
        held.append(row)
        size += weight(row)
        if len(held) >= BATCH_ROWS or size >= BATCH_CHARS:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def rows_in(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of Arrow batches as tuples."""
    for b in batches:
        step = max(1, b.num_rows * (1 << 22) // max(1, b.nbytes))
        for at in range(0, b.num_rows, step):
            part = b.slice(at, step)
            yield from zip(*[c.to_pylist() for c in part.columns])


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def _each_file(files: DataFrame, ddl: str, rows_of: Callable[..., Iterable[tuple]], weight: Callable[[tuple], int], more: Sequence[str] = (), keep: bool = False) -> DataFrame:
    """The rows that ``rows_of`` gives for each file (path, content, ``more``); no row waits for the last one of its file.

    ``keep``: the columns ``more`` are the last ones of each row, else they go to ``rows_of``.
    """
    if keep and more:
        kinds = {f.name: f.dataType.simpleString() for f in files.schema}
        ddl = ", ".join([ddl, *(f"`{k}` {kinds[k]}" for k in more)])
    schema = arrow_schema(ddl)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row + tuple(x) if keep else row for path, raw, *x in rows_in(batches) for row in (rows_of(path, raw) if keep else rows_of(path, raw, *x)))
        return in_batches(rows, schema, weight)

    return files.select("path", "content", *more).mapInArrow(each, ddl)


def read_units(files: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Units of binary files (path, content), with other columns to ``keep``."""

    def rows_of(path: str, raw: bytes) -> list[tuple]:
        try:
            return [(path, i, k, r, t, None) for i, (k, r, t) in enumerate(units_of(path, raw))]
        except Exception as e:  # one bad file is its own row
            return [(path, -1, "file", None, None, f"{type(e).__name__}: {e}")]

    return _each_file(files, UNITS, rows_of, lambda r: len(r[4] or ""), keep, True)


def read_texts(files: DataFrame) -> DataFrame:
    """``(file_id, text, error)`` of files whose units are read by ``read_units``: those that aren't blank, joined by line ends; without any, no row."""

    def rows_of(path: str, raw: bytes) -> list[tuple]:
        try:
            texts = [t for _, _, t in units_of(path, raw) if t.strip(" ")]
        except Exception as e:  # one bad file is its own row
            return [(path, None, f"{type(e).__name__}: {e}")]
        return [(path, "\n".join(texts), None)] if texts else []

    return _each_file(files, "file_id string, text string, error string", rows_of, lambda r: len(r[1] or ""))


def read_cells(files: DataFrame, formulas: bool = True) -> DataFrame:
    """Cells of Excel files; ``formulas``: a formula's text rather than its last result."""

    def rows_of(path: str, raw: bytes) -> Iterator[tuple]:
        try:
            for c in ooxml.xlsx_cells(raw, formulas):
                yield (path, *c, None)
        except Exception as e:
            yield path, None, -1, -1, None, None, f"{type(e).__name__}: {e}"

    return _each_file(files.where(F.lower("path").endswith(".xlsx")), CELLS, rows_of, lambda r: len(r[5] or ""))


#: What ``pieces`` gives; ``no`` is a unit's number or a cell's in its sheet.
PIECES = (
    "path string, kind string, no long, sheet string, row_no int, col_no int, vtype string, text string, runs array<string>, content binary, error string"
)


def pieces(files: DataFrame, contents: bool) -> DataFrame:
    """Binary files (path, content) taken apart: for each file a row of kind ``file`` (with its content, if asked for), then its units
    (a Word file's without ``text``, which is that of the ``runs``), or a sheet's strings in the first rows as ``head`` and all
    its cells, then a row of kind ``end`` with how many there were, or of kind ``error``.

    The rows of a file are neighbours, in the file's order. None of them waits for the file's end. Files with something in a
    column ``refused`` aren't read: that is their error.
    """

    def rows_of(path: str, raw: bytes, refused: str | None = None) -> Iterator[tuple]:
        row = lambda kind, no=None, cell=(None,) * 5, runs=None, content=None, error=None: (path, kind, no, *cell, runs, content, error)
        yield row("file", content=raw if contents else None)
        if refused is not None:
            yield row("error", error=refused)
            return
        n = 0
        try:
            if path.lower().endswith(".xlsx"):
                for sheet, no, *cell in ooxml.xlsx_numbered(raw, rows=HEADER_ROWS):
                    if cell[2] == "string":
                        yield row("head", no, (sheet, *cell))
                for sheet, no, *cell in ooxml.xlsx_numbered(raw):
                    yield row("cell", no, (sheet, *cell))
                    n += 1
            else:
                for _, runs, text in units_of(path, raw):
                    yield row("unit", n, (None, None, None, None, text if runs is None else None), runs)
                    n += 1
        except Exception as e:  # one bad file doesn't stop the others
            yield row("error", error=f"{type(e).__name__}: {e}")
            return
        yield row("end", n)

    weight = lambda r: len(r[7] or "") + 8 * len(r[8] or ()) + len(r[9] or b"")
    return _each_file(files, PIECES, rows_of, weight, ("refused",) if "refused" in files.columns else ())


def table_units(df: DataFrame, key: str, text: str, unit: str | None = None) -> DataFrame:
    """A table's text column as units ``(file_id, unit_ord, text)``."""
    ord_ = F.col(unit).cast("int") if unit else F.lit(0)
    return df.select(F.col(key).cast("string").alias("file_id"), ord_.alias("unit_ord"), F.col(text).alias("text"))
