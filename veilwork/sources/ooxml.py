"""Text units and edits of Word and Excel files, which are zip archives of XML; standard library only.

Pure functions over bytes: they run on executors, one file at a time.
"""

from __future__ import annotations

import io
import re
import zipfile
from array import array
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree as ET
from xml.parsers import expat
from xml.sax.saxutils import escape

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
WR, WT = f"{W}r", f"{W}t"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Document properties that may name people.
SCRUBBED = {"creator", "lastModifiedBy", "title", "subject", "description", "keywords", "category"}
#: A table cell's position in its sheet.
CELL_REF = re.compile(r"([A-Z]+)(\d+)$")


def _keep_prefixes(raw: bytes) -> None:
    """The file's own namespace prefixes, so that what is written back reads as before."""
    for _, (prefix, uri) in ET.iterparse(io.BytesIO(raw), events=["start-ns"]):
        if not re.fullmatch(r"ns\d+", prefix):
            ET.register_namespace(prefix, uri)


#: A start tag with its attributes.
TAG = re.compile(rb"""<[^<>"']*(?:"[^"]*"[^<>"']*|'[^']*'[^<>"']*)*>""")


def _plain(head: bytes) -> bool:
    """Whether places in this XML are places in UTF-8 text: its first bytes name no other encoding and no entities."""
    named = re.search(rb"""encoding\s*=\s*["']([^"']*)""", head[: head.find(b"?>") + 1]) if head.lstrip(b"\xef\xbb\xbf").startswith(b"<?xml") else None
    return head[:2] not in (b"\xff\xfe", b"\xfe\xff") and b"\0" not in head and b"<!DOCTYPE" not in head and (named is None or named[1].lower() in (b"utf-8", b"us-ascii"))


def _escaped(text: str) -> bytes:
    return escape(text).replace("\r", "&#13;").encode("utf-8", "xmlcharrefreplace")


def _prefix(data: bytes, at: int) -> bytes:
    """The namespace prefix of the tag at ``at``, with its colon."""
    return re.compile(rb"</?([^\s:/>]+:)?").match(data, at)[1] or b""


def _parser(**handlers) -> expat.XMLParserType:
    p = expat.ParserCreate(namespace_separator="}")
    p.buffer_text = True
    for name, f in handlers.items():
        setattr(p, name, f)
    return p


def _parse(p: expat.XMLParserType, data: bytes, last: bool = True) -> None:
    try:
        p.Parse(data, last)
    except expat.ExpatError as e:
        raise ET.ParseError(str(e)) from None


# ---- Word ---------------------------------------------------------------------------------------


def _run_text(run: ET.Element) -> str:
    if len(run) == 1 and run[0].tag == WT:
        return run[0].text or ""
    out = []
    for x in run:
        if x.tag == WT:
            out.append(x.text or "")
        elif x.tag == f"{W}tab":
            out.append("\t")
        elif x.tag in (f"{W}br", f"{W}cr"):
            out.append("\n")
    return "".join(out)


def paragraph_runs(p: ET.Element) -> list[ET.Element]:
    """Runs in the order of the text, those in hyperlinks included."""
    runs = []
    for x in p:
        if x.tag == WR:
            runs.append(x)
        elif x.tag == f"{W}hyperlink":
            runs += [r for r in x if r.tag == WR]
    return runs


def _set_run(run: ET.Element, text: str) -> None:
    for x in list(run):
        if x.tag in (f"{W}t", f"{W}tab", f"{W}br", f"{W}cr"):
            run.remove(x)
    t = ET.SubElement(run, f"{W}t")
    t.text = text
    t.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")


def docx_parts(z: zipfile.ZipFile) -> list[str]:
    """The body, then headers and footers of all kinds."""
    more = sorted(n for n in z.namelist() if re.fullmatch(r"word/(header|footer)\d*\.xml", n))
    return ["word/document.xml", *more]


def _paragraphs(root: ET.Element) -> list[tuple[str, ET.Element]]:
    """Paragraphs outside tables first, then those of tables, nested ones too, in reading order."""
    inside = {id(p) for t in root.iter(f"{W}tbl") for p in t.iter(f"{W}p")}
    every = list(root.iter(f"{W}p"))
    return [("paragraph", p) for p in every if id(p) not in inside] + [("cell", p) for p in every if id(p) in inside]


def docx_units(raw: bytes) -> Iterator[tuple[str, list[str]]]:
    """``(kind, runs)`` for each paragraph; the order is that of ``docx_masked``."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        for part in docx_parts(z):
            for kind, p in _paragraphs(ET.fromstring(z.read(part))):
                yield kind if part == "word/document.xml" else part.split("/")[1].rstrip("0123456789.xml"), [
                    _run_text(r) for r in paragraph_runs(p)
                ]


P_, R_, T_, BREAK_, LINK_, TABLE_ = range(1, 7)
_KINDS = {W[1:] + n: k for n, k in (("p", P_), ("r", R_), ("t", T_), ("tab", BREAK_), ("br", BREAK_), ("cr", BREAK_), ("hyperlink", LINK_), ("tbl", TABLE_))}


def _run_places(data: bytes) -> list[list]:
    """Runs by paragraph, in the order of ``_paragraphs``: each ``[text, start, place of its end tag, [text elements from, to]]``."""
    outside: list[list] = []
    inside: list[list] = []
    stack: list[tuple] = [(0, None)]
    tables, texting = 0, None

    def start(name, _attrs):
        nonlocal tables, texting
        kind, texting = _KINDS.get(name, 0), None
        above, of = stack[-1]
        if kind == R_ and of is not None and (above == P_ or above == LINK_):
            run = [[], p.CurrentByteIndex, 0, []]
            of.append(run)
            stack.append((R_, run))
        elif kind in (T_, BREAK_) and above == R_ and of is not None:
            of[3].append(p.CurrentByteIndex)
            if kind == T_:
                texting = of[0]
            else:
                of[0].append("\t" if name.endswith("tab") else "\n")
            stack.append((kind, of))
        elif kind == P_:
            runs: list = []
            (inside if tables else outside).append(runs)
            stack.append((P_, runs))
        elif kind == LINK_:
            stack.append((LINK_, of if above == P_ else None))
        else:
            tables += kind == TABLE_
            stack.append((kind if kind == TABLE_ else 0, None))

    def end(_name):
        nonlocal tables, texting
        texting = None
        kind, of = stack.pop()
        if kind == R_:
            of[2] = p.CurrentByteIndex
        elif kind in (T_, BREAK_):
            of[3].append(p.CurrentByteIndex)
        elif kind == TABLE_:
            tables -= 1

    def text(s):
        if texting is not None:
            texting.append(s)

    p = _parser(StartElementHandler=start, EndElementHandler=end, CharacterDataHandler=text)
    _parse(p, data)
    return outside + inside


def _with_runs(data: bytes, runs: dict[int, list[str]], no: int) -> tuple[bytes, int]:
    """The part with the runs of some units (the first of its own is number ``no``) replaced in place, and the number after its last."""
    changed, every = [], _run_places(data)
    for k, found in enumerate(every, no):
        for run, text in zip(found, runs.get(k, ())):
            if "".join(run[0]) != text:
                changed.append((run, text))
    if not changed:
        return data, no + len(every)
    edits = []
    for (_, begins, ends, cuts), text in changed:
        for a, z in zip(cuts[::2], cuts[1::2]):
            tag = TAG.match(data, a)
            edits.append((a, tag.end() if data[tag.end() - 2] == 47 else data.index(b">", z) + 1, b""))
        prefix = _prefix(data, begins)
        edits.append((ends, ends, b"<%st xml:space=\"preserve\">%s</%st>" % (prefix, _escaped(text), prefix)))
    out, at = [], 0
    for a, z, new in sorted(edits):
        out += [data[at:a], new]
        at = z
    return b"".join([*out, data[at:]]), no + len(every)


def docx_masked(raw: bytes, runs: dict[int, list[str]]) -> bytes:
    """The file with the runs of some units (by number) replaced and its properties blanked."""

    def edit(z: zipfile.ZipFile) -> dict[str, bytes]:
        out, no = {}, 0
        for part in docx_parts(z):
            data = z.read(part)
            if _plain(data[:4096]):
                new, no = _with_runs(data, runs, no)
                if new is not data:
                    out[part] = new
                continue
            _keep_prefixes(data)
            root, dirty = ET.fromstring(data), False
            for _, p in _paragraphs(root):
                if no in runs:
                    for r, text in zip(paragraph_runs(p), runs[no]):
                        if _run_text(r) != text:
                            _set_run(r, text)
                            dirty = True
                no += 1
            if dirty:
                out[part] = ET.tostring(root, encoding="UTF-8", xml_declaration=True)
        return out

    return _rewritten(raw, edit)


def _rewritten(raw: bytes, edit) -> bytes:
    buffer = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(raw)) as z, zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as to:
        changed = edit(z)
        for n in z.namelist():
            to.writestr(n, scrubbed(z.read(n)) if n == "docProps/core.xml" else changed.get(n, None) or z.read(n))
    return buffer.getvalue()


def scrubbed(core: bytes) -> bytes:
    _keep_prefixes(core)
    root = ET.fromstring(core)
    for x in root:
        if x.tag.rpartition("}")[2] in SCRUBBED:
            x.text = ""
    return ET.tostring(root, encoding="UTF-8", xml_declaration=True)


# ---- Excel --------------------------------------------------------------------------------------


def _sheets(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """``(name, part)`` in the order of the workbook."""
    rels = {x.get("Id"): x.get("Target") for x in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for s in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{S}sheet"):
        target = rels[s.get(f"{R}id")]
        out.append((s.get("name"), target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    return out


#: Bytes of a part that are parsed at a time.
CHUNK = 1 << 18
_ROW, _C, _V, _F, _T = (S[1:] + n for n in ("row", "c", "v", "f", "t"))


class Strings:
    """Many strings in one block of bytes."""

    def __init__(self):
        self._bytes, self._ends = bytearray(), array("Q", [0])

    def append(self, text: str) -> None:
        self._bytes += text.encode("utf-8", "surrogatepass")
        self._ends.append(len(self._bytes))

    def __len__(self) -> int:
        return len(self._ends) - 1

    def __getitem__(self, i: int) -> str:
        if i < 0:
            i += len(self)
        if not 0 <= i < len(self):
            raise IndexError("list index out of range")
        return self._bytes[self._ends[i] : self._ends[i + 1]].decode("utf-8", "surrogatepass")


def _chunks(z: zipfile.ZipFile, part: str) -> Iterator[bytes]:
    with z.open(part) as f:
        while data := f.read(CHUNK):
            yield data


def _shared(z: zipfile.ZipFile) -> Strings:
    found = Strings()
    if "xl/sharedStrings.xml" not in z.namelist():
        return found
    depth, parts, texting = 0, [], False

    def start(name, _attrs):
        nonlocal depth, texting
        texting = name == _T and depth > 0
        depth += 1

    def end(_name):
        nonlocal depth, texting
        texting = False
        depth -= 1
        if depth == 1:
            found.append("".join(parts))
            parts.clear()

    def text(s):
        if texting:
            parts.append(s)

    p = _parser(StartElementHandler=start, EndElementHandler=end, CharacterDataHandler=text)
    for data in _chunks(z, "xl/sharedStrings.xml"):
        _parse(p, data, False)
    _parse(p, b"")
    return found


def column_number(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n


def _place(ref: str) -> tuple[int, int]:
    letters, row = CELL_REF.match(ref).groups()
    return int(row), column_number(letters)


def _sheet_cells(z: zipfile.ZipFile, part: str, shared: Strings, formulas: bool, rows: int | None = None) -> Iterator[tuple[int, int, int, str, str]]:
    """``(number, row_no, col_no, vtype, value)`` of the cells of a sheet that hold something; all cells have a number, from 0.

    With ``formulas`` a formula's text counts, else its last result. ``rows``: only cells of so many first rows.
    """
    found: list[tuple] = []
    number, depth, texts, into = -1, 0, None, None
    ref = kind = f = v = None

    def open_cell(name, attrs):
        nonlocal number, depth, texts, into, ref, kind, f, v
        if name == _C and texts is None:
            number += 1
            ref, kind, f, v, texts, depth, into = attrs.get("r"), attrs.get("t", "n"), None, None, [], 0, None
            if rows is not None:
                if ref is None or int(ref.lstrip("ABCDEFGHIJKLMNOPQRSTUVWXYZ") or 0) > rows:
                    texts = None
                    return
            p.EndElementHandler, p.CharacterDataHandler = end, text
        elif texts is not None:
            depth += 1
            into = None
            if name == _V and depth == 1 and v is None:
                into = v = []
            elif name == _F and depth == 1 and f is None:
                into = f = []
            elif name == _T:
                into = texts

    def end(name):
        nonlocal depth, texts, into
        into = None
        if depth:
            depth -= 1
            return
        if f and formulas:
            value = ("string", "=" + "".join(f))
        elif kind == "inlineStr":
            value = ("string", "".join(texts))
        elif not v:
            value = None
        elif kind == "s":
            value = ("string", shared[int("".join(v))])
        else:
            value = ({"str": "string", "b": "boolean", "e": "error"}.get(kind, "number"), "".join(v))
        texts = p.EndElementHandler = p.CharacterDataHandler = None
        if value:
            found.append((number, *_place(ref), *value))

    def text(s):
        if into is not None:
            into.append(s)

    p = _parser(StartElementHandler=open_cell)
    for data in _chunks(z, part):
        _parse(p, data, False)
        yield from found
        found.clear()
    _parse(p, b"")
    yield from found


def xlsx_cells(raw: bytes, formulas: bool = True) -> Iterator[tuple[str, int, int, str, str]]:
    """``(sheet, row_no, col_no, vtype, value)`` of the cells that hold something."""
    for name, _, *cell in xlsx_numbered(raw, formulas):
        yield name, *cell


def xlsx_numbered(raw: bytes, formulas: bool = True, rows: int | None = None) -> Iterator[tuple[str, int, int, int, str, str]]:
    """``xlsx_cells`` with each cell's number in its sheet: ``(sheet, number, row_no, col_no, vtype, value)``; ``rows``: of so many first rows."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        shared = _shared(z)
        for name, part in _sheets(z):
            for cell in _sheet_cells(z, part, shared, formulas, rows):
                yield name, *cell


_TYPE = re.compile(rb"""\s+t\s*=\s*(?:"[^"]*"|'[^']*')""")


def _sheet_edited(z: zipfile.ZipFile, part: str, put, edits: Iterator[tuple[int, str]], used: bytearray) -> None:
    """Copies a sheet with some cells (number, string) replaced; ``used`` marks the shared strings of the others."""
    number, depth, into = -1, -1, None
    number_due, new = next(edits, (-1, ""))
    buffer, base = bytearray(), 0  # bytes that aren't written yet, and the place of the first
    begins, shown = 0, False  # of the open cell

    def start(name, attrs):
        nonlocal number, depth, into, begins, shown
        if depth >= 0:
            depth += 1
            into = [] if shown and name == _V else None
        elif name == _C:
            number += 1
            depth, begins = 0, p.CurrentByteIndex
            shown = attrs.get("t") == "s" and number != number_due
            write_to(begins)

    def end(_name):
        nonlocal depth, into, number_due, new, base
        if depth > 0:
            depth -= 1
            if into:
                mark(int("".join(into)))
            into = None
            return
        if depth < 0:
            return
        depth = -1
        if number != number_due:
            return
        at = p.CurrentByteIndex - base
        tag = TAG.match(buffer, 0)[0]
        z_ = len(tag) if tag.endswith(b"/>") else buffer.index(b">", at) + 1
        prefix = _prefix(tag, 0)
        head = _TYPE.sub(b"", tag.rstrip(b"/>"))
        put(b'%s t="inlineStr"><%sis><%st>%s</%st></%sis></%sc>' % (head, prefix, prefix, _escaped(new), prefix, prefix, prefix))
        del buffer[:z_]
        base += z_
        number_due, new = next(edits, (-1, ""))

    def mark(i):
        if i >= len(used):
            used.extend(bytes(i + 1 - len(used)))
        used[i] = 1

    def text(s):
        if into is not None:
            into.append(s)

    def write_to(place):
        nonlocal base
        if place - base > CHUNK or number == number_due:
            put(bytes(buffer[: place - base]))
            del buffer[: place - base]
            base = place

    p = _parser(StartElementHandler=start, EndElementHandler=end, CharacterDataHandler=text)
    for data in _chunks(z, part):
        buffer += data
        _parse(p, data, False)
    _parse(p, b"")
    put(bytes(buffer))
    for _ in edits:
        raise ValueError("a cell that isn't in the sheet")


def _strings_edited(z: zipfile.ZipFile, put, used: bytearray) -> None:
    """Copies the table of strings with those blank that no cell uses."""
    buffer, base, depth, i = bytearray(), 0, 0, -1

    def start(_name, _attrs):
        nonlocal depth, i
        depth += 1
        if depth == 2:
            i += 1
            if i >= len(used) or not used[i] or p.CurrentByteIndex - base > CHUNK:
                write_to(p.CurrentByteIndex)

    def end(_name):
        nonlocal depth, base
        depth -= 1
        if depth != 1 or i < len(used) and used[i]:
            return
        at = p.CurrentByteIndex - base
        tag = TAG.match(buffer, 0)[0]
        z_ = len(tag) if tag.endswith(b"/>") else buffer.index(b">", at) + 1
        prefix, head = _prefix(tag, 0), tag.rstrip(b"/>")
        put(b"%s><%st></%st></%s>" % (head, prefix, prefix, head[1:].split()[0]))
        del buffer[:z_]
        base += z_

    def write_to(place):
        nonlocal base
        put(bytes(buffer[: place - base]))
        del buffer[: place - base]
        base = place

    p = _parser(StartElementHandler=start, EndElementHandler=end)
    for data in _chunks(z, "xl/sharedStrings.xml"):
        buffer += data
        _parse(p, data, False)
    _parse(p, b"")
    put(bytes(buffer))


def _as_utf8(z: zipfile.ZipFile, parts: list[str]) -> bytes | None:
    """The archive with these parts written anew where places in them can't be told; None if there are none such."""
    odd = {n for n in parts if not _plain(z.open(n).read(4096))}
    if not odd:
        return None
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as to:
        for n in z.namelist():
            data = z.read(n)
            if n in odd:
                _keep_prefixes(data)
                data = ET.tostring(ET.fromstring(data), encoding="UTF-8", xml_declaration=True)
            to.writestr(n, data)
    return buffer.getvalue()


def xlsx_masked(raw: bytes, values: Iterable[tuple[str, int, str]]) -> bytes:
    """The file with some cells replaced by strings and its properties blanked.

    ``values``: ``(sheet, number, string)``, in the order of ``xlsx_numbered``. Sheets are copied piece by piece.
    """
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        sheets, shared = _sheets(z), ["xl/sharedStrings.xml"] * ("xl/sharedStrings.xml" in z.namelist())
        again = _as_utf8(z, [*dict.fromkeys(part for _, part in sheets), *shared])
    if again is not None:
        raw = again
    buffer, used, due = io.BytesIO(), bytearray(), _Groups(values)
    with zipfile.ZipFile(io.BytesIO(raw)) as z, zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as to:
        done = {part for _, part in sheets} | set(shared)
        for n in z.namelist():
            if n not in done:
                to.writestr(n, scrubbed(z.read(n)) if n == "docProps/core.xml" else z.read(n))
        for name, part in sheets:
            with to.open(part, "w", force_zip64=True) as f:
                _sheet_edited(z, part, f.write, due.of(name), used)
        # masked strings must not stay behind in the table that the cells no longer point to
        for part in shared:
            with to.open(part, "w", force_zip64=True) as f:
                _strings_edited(z, f.write, used)
    return buffer.getvalue()


class _Groups:
    """Rows in groups of equal first values, taken one group after the other."""

    def __init__(self, rows: Iterable[tuple]):
        self._rows = iter(rows)
        self._next = next(self._rows, None)

    def of(self, first) -> Iterator[tuple]:
        while self._next is not None and self._next[0] == first:
            yield self._next[1:]
            self._next = next(self._rows, None)
