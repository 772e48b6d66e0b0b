"""PDF pages, by a library that can read and rewrite them where one is installed, else plain files by ``pdf_native``."""

from __future__ import annotations

import io
from collections.abc import Iterator

from . import pdf_native

# fixed values
RENDER_DPI, JPEG_QUALITY = 150, 90


class PdfUnavailable(RuntimeError):
    """No installed library can do this."""


def _fitz():
    try:
        import fitz
    except ImportError:
        raise PdfUnavailable("rendering .pdf files needs PyMuPDF, which isn't installed") from None
    return fitz


def page_texts(raw: bytes) -> list[str]:
    """Text of each page; a page that is an image alone has none."""
    try:
        fitz = _fitz()
    except PdfUnavailable:
        try:
            from pypdf import PdfReader
        except ImportError:
            return pdf_native.page_texts(raw)
        return [page.extract_text() or "" for page in PdfReader(io.BytesIO(raw)).pages]
    with fitz.open(stream=raw, filetype="pdf") as doc:
        return [page.get_text() for page in doc]


def masked(raw: bytes, needles: dict[int, list[str]]) -> bytes:
    """The file with the given texts of each page removed under black boxes, and without metadata.

    A text that isn't found in one piece, say over a line's end, is removed word by word:
    that may take more than was meant, never less.
    """
    try:
        fitz = _fitz()
    except PdfUnavailable:
        return pdf_native.masked(raw, needles)
    with fitz.open(stream=raw, filetype="pdf") as doc:
        for number, page in enumerate(doc):
            boxes = []
            for needle in needles.get(number, ()):
                whole = page.search_for(needle)
                boxes += whole or [box for word in needle.split() for box in page.search_for(word)]
            for box in boxes:
                page.add_redact_annot(box, fill=(0, 0, 0))
            if boxes:
                page.apply_redactions(images=fitz.PDF_REDACT_IMAGE_NONE)
        doc.set_metadata({})
        doc.del_xml_metadata()
        return doc.tobytes(garbage=4, deflate=True)


def rendered(raw: bytes, fmt: str = "PNG") -> Iterator[bytes]:
    """Each page as an image."""
    fitz = _fitz()
    jpeg = fmt.upper() in ("JPG", "JPEG")
    with fitz.open(stream=raw, filetype="pdf") as doc:
        for page in doc:
            shot = page.get_pixmap(dpi=RENDER_DPI)
            yield shot.tobytes("jpeg", jpg_quality=JPEG_QUALITY) if jpeg else shot.tobytes("png")
