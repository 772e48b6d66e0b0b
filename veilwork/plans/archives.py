"""Small Word and Excel files put together from table rows, for the registered queries over files."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.sources.files import arrow_schema, in_batches, rows_in

MAIN = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
SHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
#: Properties of every file made here; the creator is its path.
PROPERTIES = (
    '<cp:coreProperties xmlns:cp="{p}/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/">'
    "<dc:creator>{who}</dc:creator><dc:title>kept for {who}</dc:title><cp:lastModifiedBy>{who}</cp:lastModifiedBy>"
    "<dc:language>en</dc:language></cp:coreProperties>"
)


def _zipped(parts: dict[str, str], who: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
        z.writestr("docProps/core.xml", PROPERTIES.format(p=PACKAGE, who=escape(who)))
    return out.getvalue()


def docx(paragraphs: list[list[str]], who: str = "") -> bytes:
    """A Word file of paragraphs of runs; every third paragraph stands in a table, the last one in a header too."""
    run = lambda t: f'<w:r><w:t xml:space="preserve">{escape(t)}</w:t></w:r>'
    para = lambda runs: f"<w:p>{''.join(map(run, runs))}</w:p>"
    cell = lambda p: f"<w:tbl><w:tr><w:tc>{p}</w:tc></w:tr></w:tbl>"
    body = "".join(cell(para(p)) if i % 3 == 2 else para(p) for i, p in enumerate(paragraphs))
    head = f'<w:hdr xmlns:w="{MAIN}">{para(paragraphs[-1])}</w:hdr>' if paragraphs else f'<w:hdr xmlns:w="{MAIN}"/>'
    return _zipped({"word/document.xml": f'<w:document xmlns:w="{MAIN}"><w:body>{body}</w:body></w:document>', "word/header1.xml": head}, who)


def letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


#: Strings that a workbook being written looks up again; one that comes later stands in its table once more.
SHARED = 1 << 16


def xlsx(cells: Iterable[tuple[int, int, str, str]], who: str = "") -> bytes:
    """An Excel file of one sheet from ``(row_no, col_no, vtype, value)``, by rows and columns; strings are shared ones.

    Rows are written as they come; what is held is the file itself, compressed.
    """
    shared: dict[str, int] = {}
    n, packer, strings, row = 0, zlib.compressobj(1), bytearray(), None
    out, lines = io.BytesIO(), []
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(
            "xl/workbook.xml",
            f'<workbook xmlns="{SHEET}" xmlns:r="{OFFICE}"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
        )
        z.writestr(
            "xl/_rels/workbook.xml.rels",
            f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        )
        with z.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as f:
            f.write(f'<worksheet xmlns="{SHEET}"><sheetData>'.encode())
            for r, c, kind, value in cells:
                if value is None:
                    continue
                if r != row:
                    lines.append(f'</row><row r="{r}">' if row is not None else f'<row r="{r}">')
                    row = r
                if kind != "string":
                    lines.append(f'<c r="{letters(c)}{r}"><v>{value}</v></c>')
                else:
                    if (k := shared.get(value)) is None:
                        if len(shared) >= SHARED:
                            shared.clear()
                        k = shared[value] = n
                        n += 1
                        strings += packer.compress(f'<si><t xml:space="preserve">{escape(value)}</t></si>'.encode())
                    lines.append(f'<c r="{letters(c)}{r}" t="s"><v>{k}</v></c>')
                if len(lines) >= 4096:
                    f.write("".join(lines).encode())
                    lines.clear()
            f.write(("".join(lines) + "</row>" * (row is not None) + "</sheetData></worksheet>").encode())
        strings += packer.flush()
        with z.open("xl/sharedStrings.xml", "w", force_zip64=True) as f:
            f.write(f'<sst xmlns="{SHEET}">'.encode())
            unpacker = zlib.decompressobj()
            for at in range(0, len(strings), 1 << 16):
                f.write(unpacker.decompress(strings[at : at + (1 << 16)]))
            f.write(unpacker.flush() + b"</sst>")
        z.writestr("docProps/core.xml", PROPERTIES.format(p=PACKAGE, who=escape(who)))
    return out.getvalue()


def _made(rows: DataFrame, order: list[str], columns: list[str], make: Callable[[Iterator[tuple], str], bytes]) -> DataFrame:
    """``(path, content)``: a file for each ``path``, made from its rows (``columns``) in order; they aren't gathered first.

    All rows of a path must be in one partition.
    """
    schema = arrow_schema("path string, content binary")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = ((path, make((r[1:] for r in own), path)) for path, own in groupby(rows_in(batches), lambda r: r[0]))
        return in_batches(files, schema, lambda r: len(r[1]))

    return rows.sortWithinPartitions("path", *order).select("path", *columns).mapInArrow(each, "path string, content binary")


def docx_files(rows: DataFrame) -> DataFrame:
    """``(path, content)`` from ``(path, ord, runs)``, which come by path: a Word file for each."""
    return _made(rows, ["ord"], ["runs"], lambda own, path: docx([runs for (runs,) in own], path))


def xlsx_files(cells: DataFrame) -> DataFrame:
    """``(path, content)`` from cells whose ``file_id`` is the path."""
    rows = cells.withColumnRenamed("file_id", "path").repartition("path")
    return _made(rows, ["row_no", "col_no"], ["row_no", "col_no", "vtype", "value"], xlsx)


def properties(files: DataFrame) -> DataFrame:
    """``(path, creator, title, editor, language)`` of Word and Excel files (path, content)."""
    import re

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, raw in zip(b["path"], b["content"]):
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    core = z.read("docProps/core.xml").decode()
                value = lambda tag: (re.search(rf"<\w+:{tag}>([^<]*)<", core) or ["", ""])[1]  # noqa: E731, B023
                rows.append((path, value("creator"), value("title"), value("lastModifiedBy"), value("language")))
            yield pd.DataFrame(rows, columns=["path", "creator", "title", "editor", "language"])

    return files.select("path", "content").mapInPandas(each, "path string, creator string, title string, editor string, language string")


def spoiled(files: DataFrame) -> DataFrame:
    """``files`` with every content cut short, so that none can be read."""
    return files.select("path", F.expr("substring(content, 1, 20)").alias("content"))


def pdf(pages: list[list[str]], who: str = "") -> bytes:
    """A PDF file of pages of lines, in a standard font; every second page is compressed, every third line shown in parts."""

    def text(s: str) -> bytes:
        return b"(" + s.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") + b")"

    def line(i: int, s: str) -> bytes:
        return b"[" + text(s[:7]) + b" -20 " + text(s[7:]) + b"] TJ T*" if i % 3 == 2 else text(s) + b" Tj T*"

    objects = [
        b"<</Type /Catalog /Pages 2 0 R /Metadata 4 0 R>>",
        b"<</Type /Pages /Count %d /Kids [%s] /Resources <</Font <</F1 3 0 R>>>>>>"
        % (len(pages), b" ".join(b"%d 0 R" % (6 + 2 * i) for i in range(len(pages)))),
        b"<</Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding>>",
        b"<</Type /Metadata /Length %d>>\nstream\n%s\nendstream" % (len(who.encode()), who.encode()),
        b"<</Author " + text(who) + b">>",
    ]
    for i, lines in enumerate(pages):
        body = b"BT /F1 9 Tf 11 TL 40 800 Td\n" + b"\n".join(line(k, s) for k, s in enumerate(lines)) + b"\nET"
        packed = zlib.compress(body) if i % 2 else body
        objects.append(b"<</Type /Page /Parent 2 0 R /MediaBox [0 0 1200 842] /Contents %d 0 R>>" % (7 + 2 * i))
        objects.append(b"<</Length %d%s>>\nstream\n%s\nendstream" % (len(packed), b" /Filter /FlateDecode" * (i % 2), packed))
    out, places = bytearray(b"%PDF-1.4\n"), []
    for n, o in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (n, o)
    table = b"".join(b"%010d 00000 n \n" % p for p in places)
    out += b"xref\n0 %d\n0000000000 65535 f \n%strailer\n<</Size %d /Root 1 0 R /Info 5 0 R>>\nstartxref\n%d\n%%%%EOF\n" % (
        len(objects) + 1, table, len(objects) + 1, len(out)
    )
    return bytes(out)


def pdf_files(rows: DataFrame, lines: int) -> DataFrame:
    """``(path, content)`` from ``(path, ord, text)``, which come by path: a PDF file for each, so many lines a page."""

    def one(own: Iterator[tuple], path: str) -> bytes:
        texts = [text for (text,) in own]
        return pdf([texts[i : i + lines] for i in range(0, len(texts), lines)], path)

    return _made(rows, ["ord"], ["text"], one)
