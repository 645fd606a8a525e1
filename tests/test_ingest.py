"""Landing (replace by name), classification, quarantine, sheet cleanup."""
import os
import time
import zipfile

from pyspark.sql import functions as F

from bidscope.operators.extract import extract_records

from bidscope.sources import ingest
from tests.demo_files import write_xlsx


def test_land_keeps_names_apart_by_folder(spark, tmp_path):
    a, b = tmp_path / "r1", tmp_path / "r2"
    a.mkdir()
    b.mkdir()
    (a / "Quotation.pdf").write_bytes(b"one")
    time.sleep(1.1)
    (b / "Quotation.pdf").write_bytes(b"two")
    (a / "notes [1].txt").write_bytes(b"x")
    (a / "legacy.XLS").write_bytes(b"y")
    files = ingest.land(spark, str(tmp_path) + "/*/*")
    assert sorted(bytes(r.content) for r in files.filter("name = 'Quotation.pdf'").collect()) == [b"one", b"two"]
    assert files.count() == 4
    # one upload place for both folders: the newer copy replaces the older
    one = ingest.land(spark, str(tmp_path) + "/*/*", unit=F.lit("all"))
    assert [bytes(r.content) for r in one.filter("name = 'Quotation.pdf'").collect()] == [b"two"] and one.count() == 3
    got = {r.name: r.reason for r in ingest.quarantine(one).collect()}
    assert got == {"notes [1].txt": "unsupported type", "legacy.XLS": "legacy binary: no decoder", "Quotation.pdf": "no extracted pages"}
    stems = spark.createDataFrame([("a/b/Acme Ltd.quote.xlsx",), ("x/.hidden",), ("noext",)], "p string")
    assert [r[0] for r in stems.select(ingest.file_stem("p")).collect()] == ["Acme Ltd.quote", ".hidden", "noext"]


def _zip(path, parts):
    with zipfile.ZipFile(path, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)


_M = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def _workbook(path, rows, styles=""):
    _zip(path, {"xl/workbook.xml": f'<workbook xmlns="{_M}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>',
                "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>',
                "xl/worksheets/s.xml": f'<worksheet xmlns="{_M}"><sheetData>{rows}</sheetData></worksheet>', **({"xl/styles.xml": styles} if styles else {})})


def _text(s):
    return f'<c t="inlineStr"><is><t>{s}</t></is></c>'


_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def _word(path, body):
    _zip(path, {"word/document.xml": f'<w:document xmlns:w="{_W}"><w:body>{body}</w:body></w:document>'})


def _cell(s, props=""):
    return f"<w:tc><w:tcPr>{props}</w:tcPr><w:p><w:r><w:t>{s}</w:t></w:r></w:p></w:tc>"


def test_every_file_ends_in_one_place(spark, tmp_path):
    up = tmp_path / "up"
    up.mkdir()
    styles = (f'<styleSheet xmlns="{_M}"><numFmts><numFmt numFmtId="164" formatCode="dd\\-mmm"/><numFmt numFmtId="165" formatCode="&quot;days&quot; 0"/></numFmts>'
              '<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>')
    rows = ("<row>" + _text("Sl") + _text("Field") + _text("Value") + "</row>"
            + "<row>" + '<c r="B2" t="inlineStr"><is><t>Deadline</t></is></c><c r="C2" s="1"><v>46280</v></c></row>'
            + '<row><c r="B3" t="inlineStr"><is><t>Supplier</t></is></c><c r="C3" t="inlineStr"><is><t>Acme</t></is></c></row>'
            + '<row r="9"><c r="B9" t="inlineStr"><is><t>Other</t></is></c><c r="C9" t="b"><v>1</v></c><c r="E9" s="2"><v>46280.5</v></c><c s="3"><v>7</v></c></row>')
    _workbook(up / "dates.xlsx", rows, styles)
    _workbook(up / "bad_index.xlsx", '<row r="1"><c r="A1" t="s"><v>5</v></c></row>')
    (up / "broken.xlsx").write_bytes(b"no zip")
    (up / "broken.docx").write_bytes(b"no zip")
    _word(up / "letter.docx", "<w:p><w:pPr><w:tabs><w:tab/></w:tabs></w:pPr><w:r><w:t>Supplier: Beta</w:t><w:br/><w:t>Warranty: 1 year</w:t></w:r></w:p><w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t></w:r></w:p>"
          + "<w:tbl><w:tr>" + _cell("Item Name", '<w:gridSpan w:val="2"/>') + _cell("Qty") + "</w:tr><w:tr>" + _cell("Bolt", '<w:vMerge w:val="restart"/>') + _cell("M8") + _cell("5")
          + "</w:tr><w:tr>" + _cell("", "<w:vMerge/>") + _cell("M9") + _cell("6") + "</w:tr></w:tbl>"
          + "<w:tbl><w:tr>" + _cell("Item") + _cell("Field") + _cell("Value") + "</w:tr><w:tr>" + _cell("Nut") + _cell("x") + _cell("y") + "</w:tr></w:tbl>")
    (up / "scan.pdf").write_bytes(b"%PDF")
    (up / "read.pdf").write_bytes(b"%PDF")
    (up / "notes.txt").write_bytes(b"x")
    files = ingest.land(spark, str(up) + "/*")
    pdf = [r.path for r in files.collect() if r.name == "read.pdf"][0]
    pages = spark.createDataFrame([(pdf, "read.pdf", 0, "Supplier: Gamma", [[["Item", "Qty"], ["Rod", "3"], ["Pin", None]]]), (pdf, "read.pdf", 1, "end", None)],
                                  "doc_id string, name string, page_no int, text string, tables array<array<array<string>>>")
    text, cells, bad = ingest.decode_files(files, str(tmp_path / "out"), pages=pages)
    name = lambda p: os.path.basename(p)
    assert {name(r.doc_id) for r in text.collect()} == {"dates.xlsx", "letter.docx", "read.pdf"}
    reasons = {r.name: r.reason for r in bad.collect()}
    assert set(reasons) == {"bad_index.xlsx", "broken.xlsx", "broken.docx", "scan.pdf", "notes.txt"}
    assert reasons["broken.xlsx"].startswith("broken: BadZipFile") and reasons["bad_index.xlsx"].startswith("broken: IndexError")
    sheet = {(r.row_no, r.col_no): r.value for r in cells.collect() if name(r.doc_id) == "dates.xlsx"}
    assert sheet == {(0, 2): "Field", (0, 3): "Value", (0, 5): "Unnamed: 4", (0, 6): "Unnamed: 5", (1, 2): "Deadline", (1, 3): "2026-09-15", (2, 2): "Supplier", (2, 3): "Acme",
                     (3, 2): "Other", (3, 3): "True", (3, 5): "2026-09-15 12:00:00", (3, 6): "7"}
    letter = sorted((r.table_no, r.row_no, r.col_no, r.value) for r in cells.collect() if name(r.doc_id) == "letter.docx" and r.table_no == 0)
    assert [v for *_, v in letter] == ["Item Name", "Item Name", "Qty", "Bolt", "M8", "5", "Bolt", "M9", "6"]
    got = {name(r.doc_id): r for r in extract_records(text, cells).collect()}
    assert got["dates.xlsx"].supplier_name == "Acme" and got["dates.xlsx"].deadline_date == "2026-09-15"
    assert got["letter.docx"].supplier_name == "Beta" and got["letter.docx"].warranty == "1 year"
    assert [i.item_name for i in got["letter.docx"]["items"]] == ["M8", "M9", "Nut"] and [i.quantity for i in got["letter.docx"]["items"]] == [5.0, 6.0, None]
    assert "a\tb" in got["letter.docx"].raw_text
    assert [i.item_name for i in got["read.pdf"]["items"]] == ["Rod", "Pin"] and "[Table on page 1]\nItem | Qty" in got["read.pdf"].raw_text


def test_sheet_table_drops_empty_rows_and_columns(spark, tmp_path):
    path = os.path.join(str(tmp_path), "s.xlsx")
    write_xlsx(path, [("S", [(None, None, None), ("Item ", None, "Qty"), (None, None, None),
                             ("Bolt", None, 4), ("Nut", None, "  ")])])
    files = ingest.land(spark, str(tmp_path) + "/*.xlsx")
    t = ingest.sheet_table(ingest.workbook_cells(files))
    rows = sorted((r.row_no, r.col_no, r.value) for r in t.collect())
    assert rows == [(0, 1, "Item"), (0, 3, "Qty"), (1, 1, "Bolt"), (1, 3, "4"), (2, 1, "Nut"), (2, 3, "  ")]


def _sheets(path, sheets, shared=()):
    ids = range(1, len(sheets) + 1)
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    _zip(path, {"xl/workbook.xml": f'<workbook xmlns="{_M}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="S{i}" sheetId="{i}" r:id="r{i}"/>' for i in ids) + "</sheets></workbook>",
                "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in ids) + "</Relationships>",
                "xl/sharedStrings.xml": f'<sst xmlns="{_M}">' + "".join(f"<si><r><t>{s}</t></r></si>" for s in shared) + "</sst>",
                **{f"xl/worksheets/s{i}.xml": f'<worksheet xmlns="{_M}"><sheetData>{rows}</sheetData></worksheet>' for i, rows in zip(ids, sheets)}})


def test_sheets_of_a_workbook_are_decoded_in_tasks_of_their_own(spark, tmp_path):
    n = 25_000
    _sheets(tmp_path / "big.xlsx", ["".join(f'<row r="{r}"><c r="A{r}"><v>{r * k}</v></c><c r="C{r}" t="s"><v>{r % 3}</v></c></row>' for r in range(1, n + 1)) for k in (1, 2)] + [""], ["x", "y", "z"])
    _sheets(tmp_path / "bad.xlsx", ['<row r="1"><c r="A1"><v>1</v></c></row>', '<row r="1"><c r="A1"><v>1</v></c></row><row'])
    _sheets(tmp_path / "lost.xlsx", ['<row r="1"><c r="A1" t="s"><v>9</v></c><c r="B1"><v>1</v></c></row>'], ["only"])
    files = ingest.land(spark, str(tmp_path) + "/*")
    out = str(tmp_path / "decoded")
    got = ingest._decoded_workbooks(files, out)
    cells = {(r.table_no, r.row_no, r.col_no): r.value for r in got.filter("error IS NULL").collect()}
    assert cells == {(k - 1, r, c): v for k in (1, 2) for r in range(1, n + 1) for c, v in ((1, str(r * k)), (3, "xyz"[r % 3]))}
    errors = {os.path.basename(r.doc_id): r.error for r in got.filter("error IS NOT NULL").collect()}
    assert set(errors) == {"bad.xlsx", "lost.xlsx"} and "ParseError" in errors["bad.xlsx"] and "IndexError" in errors["lost.xlsx"]
    by_file = spark.read.parquet(f"{out}/decoded").filter("doc_id LIKE '%big.xlsx' AND table_no >= 0").groupBy(F.input_file_name().alias("f")).agg(F.collect_set("table_no").alias("t")).collect()
    assert sorted(r.t for r in by_file) == [[0], [1]]  # each sheet in a file, so in a task, of its own


def test_a_sheet_is_read_row_by_row(tmp_path):
    import tracemalloc
    peaks = []
    for n in (2_000, 40_000):
        _sheets(tmp_path / "one.xlsx", ["".join(f'<row r="{r}"><c r="A{r}"><v>{r}</v></c></row>' for r in range(1, n + 1))])
        (part,) = [p for k, *_, p in ingest._workbook_parts((tmp_path / "one.xlsx").read_bytes()) if k == 0]
        tracemalloc.start()
        assert sum(1 for _ in ingest._sheet_cells(part, set(), False)) == n
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 2 * peaks[0]


def test_page_tables_have_numbers_of_their_own(spark):
    pages = spark.createDataFrame([("d", 0, [[["a"]]] * 10_001), ("d", 1, [[["b"]]]), ("d", 214_749, [[["c"]]])], "doc_id string, page_no int, tables array<array<array<string>>>")
    got = ingest.page_cells(pages.withColumn("text", F.lit("")))
    assert got.select("table_no").distinct().count() == 10_003
    assert [r.value for r in got.orderBy("table_no").collect()][-2:] == ["b", "c"]


def test_landing_stream_picks_the_winners_of_the_batch(spark, tmp_path):
    from bidscope.streaming.incremental import land_stream, landed
    drop, store, check = tmp_path / "drop", str(tmp_path / "store"), str(tmp_path / "check")
    unit = F.regexp_extract("path", r"([^/]+)/[^/]+/[^/]+$", 1)

    def upload(rfq, upload_id, name, text):
        (drop / rfq / upload_id).mkdir(parents=True)
        (drop / rfq / upload_id / name).write_bytes(text)
        time.sleep(1.05)

    def run():
        land_stream(spark, str(drop) + "/*/*/*", store, check, unit=unit, files_a_batch=1).awaitTermination()
        want = ingest.land(spark, str(drop) + "/*/*/*", unit=unit)
        assert sorted((r.path, r.name, r.file_type, bytes(r.content)) for r in landed(spark, store).collect()) == sorted((r.path, r.name, r.file_type, bytes(r.content)) for r in want.collect())
        return {bytes(r.content) for r in landed(spark, store).collect()}

    assert landed(spark, store) is None
    upload("r1", "u1", "Quotation.pdf", b"one")
    upload("r2", "u2", "Quotation.pdf", b"two")
    assert run() == {b"one", b"two"}
    upload("r1", "u3", "Quotation.pdf", b"newer")
    upload("r1", "u4", "other.txt", b"x")
    assert run() == {b"newer", b"two", b"x"}
    assert run() == {b"newer", b"two", b"x"}


def test_another_decoder_takes_the_built_in_ones_place(spark, tmp_path):
    import pandas as pd
    write_xlsx(str(tmp_path / "a.xlsx"), [("S", [("Item", "Qty"), ("Pen", "1")])])

    def shouting(batches):
        for b in batches:
            for path in b["path"]:
                yield pd.DataFrame({"doc_id": [path] * 2, "table_no": [0, 0], "sheet": ["X", "X"], "row_no": [1, 2], "col_no": [1, 1], "value": ["HEAD", "CELL"], "error": [None, None]})
    text, cells, _ = ingest.decode_files(ingest.land(spark, str(tmp_path) + "/*.xlsx"), str(tmp_path / "out"), xlsx_decoder=shouting)
    assert sorted((r.row_no, r.value) for r in cells.collect()) == [(0, "HEAD"), (1, "CELL")] and "--- Sheet: X ---" in text.first().raw_text
