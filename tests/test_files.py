"""Word and Excel files from end to end, presets, streams."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from veilwork.functions.detect import ScanOptions
from veilwork.operators import manifest, presets, redact, report, runs, tabular
from veilwork.sources import files, ooxml
from veilwork.streaming import live

W_NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S_NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
R_NS = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
CORE = (
    '<cp:coreProperties xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/">'
    "<dc:creator>Jane Doe</dc:creator><cp:lastModifiedBy>Jane Doe</cp:lastModifiedBy><dc:language>en</dc:language></cp:coreProperties>"
)


def para(*runs_):
    return "<w:p>" + "".join(f"<w:r><w:rPr><w:b/></w:rPr><w:t>{r}</w:t></w:r>" for r in runs_) + "</w:p>"


def docx():
    table = f"<w:tbl><w:tr><w:tc>{para('SSN 123-45-6789')}<w:tbl><w:tr><w:tc>{para('nested 80202')}</w:tc></w:tr></w:tbl></w:tc></w:tr></w:tbl>"
    link = '<w:p><w:hyperlink><w:r><w:t>jane@</w:t></w:r></w:hyperlink><w:r><w:t>example.com</w:t><w:tab/></w:r></w:p>'
    body = f"<w:document {W_NS}><w:body>{table}{para('Mary ', 'Sto', 'ne called.')}{para('nothing here')}{link}</w:body></w:document>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", body)
        z.writestr("word/header1.xml", f"<w:hdr {W_NS}>{para('Call (303) 555-0142')}</w:hdr>")
        z.writestr("docProps/core.xml", CORE)
        z.writestr("word/other.bin", b"\x00\x01")
    return out.getvalue()


def xlsx():
    shared = ["Name", "Email", "SSN", "Mary Stone", "a@b.co", "123-45-6789", "see 123 Main St."]
    cell = lambda ref, i: f'<c r="{ref}" t="s"><v>{i}</v></c>'
    rows = "".join(f'<row r="{r + 1}">{cell(f"A{r + 1}", r)}{cell(f"B{r + 1}", r + 3)}</row>' for r in range(3))
    rows += f'<row r="4"><c r="A4"><v>42</v></c><c r="B4"><f>"x"&amp;80202</f><v>1</v></c>{cell("C4", 6)}<c r="D4" t="inlineStr"><is><t>plain</t></is></c></row>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {S_NS} {R_NS}><sheets><sheet name="One" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr(
            "xl/_rels/workbook.xml.rels",
            '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        )
        z.writestr("xl/sharedStrings.xml", f"<sst {S_NS}>" + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {S_NS}><sheetData>{rows}</sheetData></worksheet>")
        z.writestr("docProps/core.xml", CORE)
    return out.getvalue()


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.docx").write_bytes(docx())
    (tmp_path / "b.XLSX").write_bytes(xlsx())
    (tmp_path / "bad.docx").write_bytes(b"not a zip")
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "d.txt").write_text("123-45-6789")
    return tmp_path


def test_units_in_order():
    got = [(kind, "".join(r)) for kind, r in ooxml.docx_units(docx())]
    assert got == [
        ("paragraph", "Mary Stone called."), ("paragraph", "nothing here"), ("paragraph", "jane@example.com\t"),
        ("cell", "SSN 123-45-6789"), ("cell", "nested 80202"), ("header", "Call (303) 555-0142"),
    ]


def test_cells():
    got = list(ooxml.xlsx_cells(xlsx()))
    assert got[:2] == [("One", 1, 1, "string", "Name"), ("One", 1, 2, "string", "Mary Stone")]
    assert ("One", 4, 2, "string", '="x"&80202') in got and ("One", 4, 1, "number", "42") in got
    assert ("One", 4, 2, "number", "1") in list(ooxml.xlsx_cells(xlsx(), formulas=False))
    assert ooxml.column_number("AB") == 28


def test_files_are_masked(spark, folder):
    results = {r.file_id.rsplit("/", 1)[1]: r for r in redact.redact_files(spark, str(folder), out_dir=f"{folder}/out")}
    assert set(results) == {"a.docx", "b.XLSX", "bad.docx", "c.pdf"}
    word = results["a.docx"]
    assert word.error is None and word.per_category == {"addresses": 1, "emails": 1, "names": 1, "phones": 1, "ssn": 1} and word.redaction_count == 5
    raw = (folder / "out/a_REDACTED.docx").read_bytes()
    texts = [r for _, r in ooxml.docx_units(raw)]
    assert texts[0] == ["[REDACTED]", "", " called."] and texts[2] == ["[REDACTED]", "\t"] and texts[5] == ["Call [REDACTED]"]
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        assert b"Jane" not in z.read("docProps/core.xml") and z.read("word/other.bin") == b"\x00\x01" and b"<w:b" in z.read("word/document.xml")
    sheet = results["b.XLSX"]
    assert sheet.per_category == {"addresses": 2, "emails": 1, "names": 4, "ssn": 1}
    raw = (folder / "out/b_REDACTED.XLSX").read_bytes()
    values = {(r, c): v for _, r, c, _, v in ooxml.xlsx_cells(raw)}
    assert values[1, 1] == "Name" and values[2, 1] == values[3, 1] == values[4, 1] == values[1, 2] == "[REDACTED]" and values[4, 4] == "plain"
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        assert not any(x in z.read("xl/sharedStrings.xml") for x in (b"Mary", b"123-45", b"a@b.co", b"Main"))
    assert "BadZipFile" in results["bad.docx"].error and results["bad.docx"].redaction_count == 0
    assert results["c.pdf"].error and not (folder / "out/c_REDACTED.pdf").exists()
    again = {r.path.rsplit("/", 1)[1]: r.per_category for r in redact.scan_files(spark, str(folder)).collect()}
    assert again["a.docx"] == word.per_category and again["b.XLSX"] == sheet.per_category


def test_masked_copies_are_clean(spark, folder):
    redact.redact_files(spark, str(folder), out_dir=f"{folder}/out")
    units = files.read_units(files.binary_files(spark, f"{folder}/out"))
    assert report.leaks(units, ["123-45-6789", "JANE@", "mary stone", "555-0142"]).count() == 0
    assert report.file_text(units).count() == 2


def test_manifest(spark):
    rows = [("/a/x.docx",), ("/b/x.docx",), ("/a/y.txt",), ("/a/z.v2.PDF",), (".hidden",)]
    got = {r.path: (r.out, r.error) for r in manifest.manifest(spark.createDataFrame(rows, "path string"), "/out").collect()}
    assert got["/a/x.docx"][1] == got["/b/x.docx"][1] == "Output path is shared by several sources"
    assert got["/a/z.v2.PDF"] == ("/out/z.v2_REDACTED.PDF", None) and got["/a/y.txt"][1].startswith("Unsupported")
    own = manifest.manifest(spark.createDataFrame(rows[:1], "path string"), suffix="").first()
    assert own.error == "Output path equals the source"


def test_presets(spark, tmp_path):
    at = str(tmp_path / "p")
    assert presets.saved_presets(spark, at).count() == 0
    assert presets.save_preset(at, "a/b ", ["ssn"]).endswith("/ab.json")
    presets.save_preset(at, "HIPAA Only", ["emails"])
    for name, text in (("x.json", "[1]"), ("y.json", '{"name": "n"}'), ("z.json", "{")):
        (tmp_path / "p" / name).write_text(text)
    every = {r.name: r.categories for r in presets.all_presets(presets.builtin_frame(spark), presets.saved_presets(spark, at)).collect()}
    assert every["HIPAA Only"] == ["emails"] and every["a/b "] == ["ssn"] and len(every) == 4
    assert presets.delete_preset(at, "ab") and not presets.delete_preset(at, "ab")
    assert presets.categories_of("none such") == list(presets.category_labels())


def test_headers(spark):
    rows = [
        ("f", "s", 1, 1, "string", "First Name"), ("f", "s", 2, 1, "number", "42"), ("f", "s", 3, 1, "string", " "),
        ("f", "s", 7, 2, "string", "Please email me"), ("f", "s", 8, 2, "string", "x"), ("f", "s", 11, 3, "string", "email"), ("f", "s", 12, 3, "string", "x"),
        ("f", "s", 2, 4, "string", "zip"), ("f", "s", 3, 4, "string", "name"), ("f", "s", 4, 4, "string", "abc"), ("f", "s", 5, 5, "string", None),
    ]
    cells = spark.createDataFrame(rows, "file_id string, sheet string, row_no int, col_no int, vtype string, value string")
    got = {(r.row_no, r.col_no): (r.masked, dict(r.hits)) for r in tabular.mask_cells(cells, ScanOptions([])).collect()}
    assert got[2, 1] == ("[REDACTED]", {"names": 1}) and got[3, 1] == (" ", {}) and got[8, 2] == ("[REDACTED]", {"emails": 1})
    assert got[12, 3] == ("x", {}) and got[3, 4] == ("[REDACTED]", {"addresses": 1}) and got[5, 5] == (None, {})
    assert tabular.mask_cells(cells.limit(0)).collect() == []


def test_intervals(spark):
    spans = spark.createDataFrame([(1, 0, 2), (1, 2, 4), (1, 6, 9), (1, 7, 8), (2, 0, 1)], "k int, start int, end int")
    assert sorted(map(tuple, runs.merged(spans, "k").collect())) == [(1, 0, 4), (1, 6, 9), (2, 0, 1)]


def test_stream(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr("ts", "'id 5551234567 ' || event_type as text").write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema("ts timestamp_ntz, text string").parquet(str(tmp_path / "in"))
    opts = ScanOptions(["unique_ids"])
    q = live.masked_stream(rows, "text", opts).writeStream.format("memory").queryName("masked").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("masked").where(F.col("text").contains("555")).count() == 0
    q = live.counts_over_time(rows, "ts", "text", "1 hour", "1 hour", opts).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    batch = live.counts_over_time(spark.read.parquet(str(tmp_path / "in")), "ts", "text", "1 hour", "1 hour", opts)
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, batch.collect()))


def test_extracted_text(spark, folder):
    got = {r.file_id.rsplit("/", 1)[1]: r for r in redact.extract_text(spark, str(folder)).collect()}
    assert got["a.docx"].text.startswith("Mary Stone called.\nnothing here") and got["bad.docx"].text is None and got["bad.docx"].error
    assert got["b.XLSX"].text.split("\n") == ["Name", "Mary Stone", "Email", "a@b.co", "SSN", "123-45-6789", "42", "1", "see 123 Main St.", "plain"]


def test_pdf_files(spark, folder):
    from veilwork.plans import archives

    (folder / "own.pdf").write_bytes(archives.pdf([["Oscar Lindqvist, 987-65-4320"], ["page two"]], "Oscar"))
    rows = {r.file_id.rsplit("/", 1)[1]: r for r in redact.redact_files(spark, f"{folder}/*.pdf", out_dir=f"{folder}/out")}
    assert rows["own.pdf"].per_category == {"names": 1, "ssn": 1} and rows["own.pdf"].error is None
    assert rows["c.pdf"].error and rows["c.pdf"].outputs == [] and not (folder / "out/c_REDACTED.pdf").exists()
    units = files.read_units(files.binary_files(spark, f"{folder}/out"))
    assert [r.text for r in units.orderBy("unit_ord").collect()] == [", ", "page two"]
    assert redact.extract_text(spark, f"{folder}/own.pdf").first().text == "Oscar Lindqvist, 987-65-4320\npage two"
    if not files.renderer_available():
        row = redact.redact_file(spark, f"{folder}/own.pdf", out_dir=f"{folder}/out2", image_output=True)
        assert "PdfUnavailable" in row.error and len(row.outputs) == 1
        shots = redact.page_images(redact.masked_files(spark, f"{folder}/own.pdf")).collect()
        assert len(shots) == 1 and "PdfUnavailable" in shots[0].error


def test_command_line(spark, folder, capsys):
    from veilwork.__main__ import main

    assert main(["selftest", str(folder / "result")]) == 0 and (folder / "result").read_text() == "PASS"
    assert main(["scan", str(folder / "a.docx"), "--category", "ssn", "--literal", "nothing"]) == 0
    out = capsys.readouterr().out
    assert "a.docx: 2" in out and "Social Security Numbers: 1" in out and "custom: 1" in out and "total: 2 in 1 files, 0 failed" in out
    assert main(["mask", str(folder / "bad.docx"), "--json"]) == 1


def test_texts(spark):
    from veilwork import api

    assert api.summarise_texts(spark, ["80202 a@b.co", None]) == [{"addresses": 1, "emails": 1}, {}]
    (found, none) = api.detect_texts(spark, ["x 80202", ""])
    assert found == [{"start": 2, "end": 7, "text": "80202", "category": "addresses"}] and none == []


def test_explicit_outputs(spark, folder):
    row = redact.redact_file(spark, f"{folder}/a.docx", out_path=f"{folder}/deep/own name.docx")
    assert row.error is None and row.outputs == [f"{folder}/deep/own name.docx"]
    assert (folder / "deep/own name.docx").exists()
    same = redact.redact_file(spark, f"{folder}/a.docx", out_path=f"file:{folder}/a.docx")
    assert same.error == "Output path equals the source" and same.outputs == []
    assert redact.redact_file(spark, f"{folder}/d.TXT").error == "Unsupported file type: .txt"
    some = redact.redact_files(spark, str(folder), out_dir=f"{folder}/o", out_path={"/a.docx": f"{folder}/o/first.docx"})
    assert {r.file_id.rsplit("/", 1)[1]: r.outputs for r in some}["a.docx"] == [f"{folder}/o/first.docx"]
    assert (folder / "o/b_REDACTED.XLSX").exists()


def test_images_of_masked_pages(monkeypatch):
    from veilwork.sources import pdf

    monkeypatch.setattr(pdf, "rendered", lambda raw, fmt: iter([b"one", b"two"]))
    disk = {}
    assert redact.write_one(disk.__setitem__, "/o/a.v2.pdf", b"%PDF", "JPG") == (list(disk), None)
    assert disk == {"/o/a.v2.pdf": b"%PDF", "/o/a.v2_images/a.v2_p001.jpg": b"one", "/o/a.v2_images/a.v2_p002.jpg": b"two"}
    assert redact.write_one(disk.__setitem__, "/o/a.docx", b"PK", "PNG") == (["/o/a.docx"], None)
    assert redact.write_one(disk.__setitem__, "/o/b.pdf", b"%PDF") == (["/o/b.pdf"], None)

    def broken(raw, fmt):
        raise pdf.PdfUnavailable("no library")

    monkeypatch.setattr(pdf, "rendered", broken)
    done, error = redact.write_one(disk.__setitem__, "/o/c.pdf", b"%PDF", "PNG")
    assert done == ["/o/c.pdf"] and "no library" in error


def test_dropped_files(spark):
    assert manifest.dropped_paths("{/a b/x.docx} /c/y.pdf  {/d/z.txt}\n/e.xlsx {/open end") == ["/a b/x.docx", "/c/y.pdf", "/d/z.txt", "/e.xlsx", "/open end"]
    assert manifest.dropped_paths("  ") == []
    frame = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    got = manifest.queued(frame("/a.docx"), frame(*manifest.dropped_paths("/a.docx {/b c.PDF} /d.txt")))
    assert sorted(r.path for r in got.collect()) == ["/a.docx", "/b c.PDF"]
    assert manifest.image_name("x.pdf", 12) == "x_images/x_p012.png"


def test_numbered_rows(spark):
    df = spark.createDataFrame([((37 * i) % 1000, str(i)) for i in range(1000)] + [(10**12, "far")], "k long, v string")
    assert sorted((r.k, r.n) for r in tabular.numbered(df, "k", "n", 8).collect()) == [(i, i + 1) for i in range(1000)] + [(10**12, 1001)]
    assert tabular.numbered(df.limit(0), "k", "n").collect() == []


def test_files_are_made_once(spark):
    from veilwork.plans import archives

    made = spark.sparkContext.accumulator(0)

    def make(batches):
        for b in batches:
            made.add(len(b))
            yield b

    rows = [("/in/a.docx", archives.docx([["call (303) 555-01", "42"], ["none"]])), ("/in/b.xlsx", xlsx()), ("/in/c.docx", b"bad"), ("/in/d.txt", b"")]
    paths = spark.createDataFrame([(p,) for p, _ in rows], "path string")
    found = spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary").mapInPandas(make, "path string, content binary")
    got = {r.file_id: r for r in redact.masked_found(found, out_dir="/out", paths=paths).collect()}
    assert made.value == 4
    assert [r for _, r in ooxml.docx_units(got["/in/a.docx"].content)] == [["call [REDACTED]", ""], ["none"], ["none"]]
    assert got["/in/b.xlsx"].per_category == {"addresses": 2, "emails": 1, "names": 4, "ssn": 1}
    assert "BadZipFile" in got["/in/c.docx"].error and got["/in/d.txt"].error == "Unsupported file type: .txt"
    assert got["/in/d.txt"].out == "/out/d_REDACTED.txt" and got["/in/c.docx"].content is None
    same = redact.masked_found(found, out_dir="/out", out_path={"x": "/out/one"}, paths=paths).collect()
    assert sorted(str(r.error)[:11] for r in same)[-1] == "Unsupported" and sum("shared by" in str(r.error) for r in same) == 3


def test_long_sheets_are_taken_piece_by_piece():
    import tracemalloc

    from veilwork.plans import archives

    rows = 30_000
    cells = lambda: ((r, c, *(("string", f"name {r}") if c == 1 else ("number", str(r)))) for r in range(1, rows + 1) for c in (1, 2))
    tracemalloc.start()
    raw = archives.xlsx(cells())
    n = sum(1 for _ in ooxml.xlsx_cells(raw))
    done = ooxml.xlsx_masked(raw, (("Sheet1", 2 * r, "gone") for r in range(rows)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 2 * rows and peak < 24_000_000
    assert list(ooxml.xlsx_cells(done))[-2:] == [("Sheet1", rows, 1, "string", "gone"), ("Sheet1", rows, 2, "number", str(rows))]
    with zipfile.ZipFile(io.BytesIO(done)) as z:
        assert b"name" not in z.read("xl/sharedStrings.xml")


def test_sheets_with_prefixes_and_empty_cells():
    x = S_NS.replace("xmlns=", "xmlns:x=")
    sheet = (
        f"""<?xml version="1.0" encoding="ENC"?><x:worksheet {x}><x:row r="12"><x:c r='A12' t='s'><x:v>0</x:v></x:c><x:c r="B12"/><x:c r="C12"></x:c>"""
        '<x:c r="D12" t="inlineStr"><x:is><x:r><x:t>a</x:t></x:r><x:r><x:t>\xe9</x:t></x:r></x:is></x:c></x:row><x:row r="3"><x:c r="A3" t="s"><x:v>1</x:v></x:c></x:row></x:worksheet>'
    )
    for encoding in ("utf-8", "utf-16", "iso-8859-1"):
        out = io.BytesIO()
        with zipfile.ZipFile(io.BytesIO(xlsx())) as z, zipfile.ZipFile(out, "w") as to:
            for n in z.namelist():
                to.writestr(n, sheet.replace("ENC", encoding).encode(encoding) if n.endswith("sheet1.xml") else z.read(n))
        found = list(ooxml.xlsx_numbered(out.getvalue()))
        assert found == [("One", 0, 12, 1, "string", "Name"), ("One", 3, 12, 4, "string", "a\xe9"), ("One", 4, 3, 1, "string", "Email")]
        assert list(ooxml.xlsx_numbered(out.getvalue(), rows=10)) == found[2:]
        done = ooxml.xlsx_masked(out.getvalue(), [("One", 3, "<&>"), ("One", 4, "new")])
        assert [c[2:] for c in ooxml.xlsx_cells(done)] == [(1, "string", "Name"), (4, "string", "<&>"), (1, "string", "new")]


def test_runs_inside_runs_are_edited():
    inner = para("555-0142 in a box")
    body = f'<w:document {W_NS}><w:body><w:p><w:r><w:t>out</w:t><w:box>{inner}</w:box><w:tab/></w:r><w:r/></w:p></w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", body)
    assert [r for _, r in ooxml.docx_units(out.getvalue())] == [["out\t", ""], ["555-0142 in a box"]]
    done = ooxml.docx_masked(out.getvalue(), {0: ["a<b", ""], 1: ["[X] in a box"]})
    assert [r for _, r in ooxml.docx_units(done)] == [["a<b", ""], ["[X] in a box"]]


def test_short_rows_are_dealt_over_many_tasks(spark, tmp_path):
    from veilwork.plans import samples

    spark.range(40_000).selectExpr("id as o_orderkey", "id as o_custkey", "date'2024-01-02' as o_orderdate").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    got = samples.units(spark, str(tmp_path), samples.MIXED)
    sizes = got.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in sizes) == 40_000 and max(r["count"] for r in sizes) <= 2 * report.TASK_TEXTS and len(sizes) >= 5


def test_runs_and_spans_of_a_row(spark):
    run_rows = [(1, i, t) for i, t in enumerate(["abc", "", "defg", "h"])]
    spans = [(1, 1, 4, "x"), (1, 4, 5, "y"), (1, 7, 8, "z")]
    rows = runs.run_positions(spark.createDataFrame(run_rows, "k int, run_ord int, text string"), "k")
    joined = runs.overlaps(rows, spark.createDataFrame(spans, "k int, start int, end int, category string"), "k")
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
    one = spark.createDataFrame([([t for *_, t in run_rows], [x[1:] for x in spans])], "runs array<string>, s array<struct<start:int,end:int,category:string>>")
    got = one.select(F.inline(runs.touching(F.col("runs"), F.col("s"))))
    assert sorted(map(tuple, got.collect())) == sorted((r.run_ord, r.start, r.end, r.category) for r in joined.collect())
