"""File ingest: land uploaded files, classify them, decode workbooks and
Word files into long cell / text tables, assemble extracted PDF pages.

Bytes are read by Spark's ``binaryFile`` source, whatever the store; decoding
runs in ``mapInPandas`` with the standard library (zip + XML). A workbook is
split into its sheets, which are decoded in tasks of their own, row by row. Every landed file ends in exactly one place: decoded,
covered by given PDF pages, or in quarantine with a reason (no decoder for
the type, or broken content).
"""
from __future__ import annotations

import io
import posixpath
import re
import zipfile
import zlib
from datetime import datetime, time, timedelta
from typing import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import col_, strip
from ..session import scratch, ship_package

# Suffix -> document type.
FILE_TYPES = {".xlsx": "excel", ".xls": "excel", ".xlsm": "excel",
              ".pdf": "pdf", ".docx": "docx", ".doc": "docx"}
# Fixed value: label of buyer documents in the search index.
RFQ_SUPPLIER_LABEL = "RFQ (Buyer requirements)"


def file_suffix(path) -> Column:
    return F.lower(F.regexp_extract(col_(path), r"(\.[^./\\]+)$", 1))


def classify(path) -> Column:
    """Document type from the lower-cased suffix; NULL when unsupported."""
    sfx = file_suffix(path)
    e = None
    for s, t in FILE_TYPES.items():
        e = F.when(sfx == s, F.lit(t)) if e is None else e.when(sfx == s, F.lit(t))
    return e


def base_name(path) -> Column:
    return F.regexp_extract(col_(path), r"([^/\\]*)$", 1)


def file_stem(path) -> Column:
    """File name without its last suffix (default supplier name)."""
    return F.regexp_extract(base_name(path), r"^(.+?)(\.[^.]*)?$", 1)


def default_supplier(supplier, path) -> Column:
    s = col_(supplier)
    return F.when(s.isNull() | (s == ""), file_stem(path)).otherwise(s)


def folder(path) -> Column:
    return F.regexp_extract(col_(path), r"^(.*)[/\\\\][^/\\\\]*$", 1)


def land(spark: SparkSession, glob: str, unit: Column | None = None) -> DataFrame:
    """Uploaded files. A name stored again in the same ``unit`` (default: the
    folder) replaces the older copy: the newest modification time wins.
    Winners are picked on path and time alone; then the bytes of these files
    are read, once, and never shuffled. The picked paths pass through the
    driver, as Spark's file listing does anyway."""
    key = unit if unit is not None else folder("path")
    listed = spark.read.format("binaryFile").load(glob).select("path", "modificationTime")
    newest = listed.groupBy(key.alias("unit"), base_name("path").alias("name")).agg(
        F.max_by("path", F.struct("modificationTime", "path")).alias("path"))
    paths = [r["path"] for r in newest.select("path").toLocalIterator()]
    if not paths:
        raw = spark.read.format("binaryFile").load(glob)
    else:
        raw = spark.read.format("binaryFile").load([re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in paths])
    return raw.withColumn("name", base_name("path")).withColumn("file_type", classify("path"))


def quarantine(files: DataFrame, decoded: DataFrame | None = None, broken: DataFrame | None = None,
               pages: DataFrame | None = None) -> DataFrame:
    """Files that nothing else covers, with a ``reason``. ``decoded(doc_id)``
    and ``pages(doc_id)`` cover files; ``broken(doc_id, error)`` names those
    whose decoding failed."""
    sfx = file_suffix("path")
    none = F.lit(None).cast("string")
    out = files.withColumn("reason", F.when(F.col("file_type").isNull(), F.lit("unsupported type"))
                           .when(sfx.isin(".xls", ".doc"), F.lit("legacy binary: no decoder"))
                           .when(sfx == ".pdf", F.lit("no extracted pages")).otherwise(none))
    if broken is not None:
        out = (out.join(broken.select(F.col("doc_id").alias("path"), "error"), "path", "left")
               .withColumn("reason", F.coalesce("reason", F.concat(F.lit("broken: "), F.col("error")))).drop("error"))
    for covered in (decoded, pages):
        if covered is not None:
            out = out.join(covered.select(F.col("doc_id").alias("path")).distinct(), "path", "left_anti")
    return out.filter(F.col("reason").isNotNull())


# ---- workbook (.xlsx) ------------------------------------------------------

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main",
       "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
       "rel": "http://schemas.openxmlformats.org/package/2006/relationships",
       "w": "http://schemas.openxmlformats.org/wordprocessingml/2006/main"}


def _col_index(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref).group(0):
        n = n * 26 + ord(ch) - 64
    return n


# Built-in number formats that show a date or time.
_DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    """Cell style numbers whose number format shows a date."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ET.fromstring(z.read("xl/styles.xml"))
    own = {}
    for f in root.iter(f"{{{_NS['m']}}}numFmt"):
        code = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", f.get("formatCode") or "")
        own[int(f.get("numFmtId"))] = bool(re.search(r"[dmyhs]", code.lower())) and "general" not in code.lower()
    xfs = root.find("m:cellXfs", _NS)
    ids = [int(x.get("numFmtId") or 0) for x in (xfs if xfs is not None else [])]
    return {i for i, n in enumerate(ids) if own.get(n, n in _DATE_FORMATS)}


def _date_text(serial: str, from_1904: bool) -> str:
    """Day (and time, if any) of a serial number; other text stays."""
    try:
        days = float(serial)
        start = datetime(1904, 1, 1) if from_1904 else datetime(1899, 12, 30)
        at = start + timedelta(days=int(days), seconds=round((days - int(days)) * 86400))
    except (ValueError, OverflowError):
        return serial
    return str(at.date()) if at.time() == time() else str(at)


def _packed(z: zipfile.ZipFile, name: str) -> bytes:
    """A member's bytes, compressed, a block at a time."""
    out, pack = [], zlib.compressobj(1)
    with z.open(name) as f:
        while block := f.read(1 << 16):
            out.append(pack.compress(block))
    return b"".join([*out, pack.flush()])


def _elements(packed: bytes, tag: str) -> Iterator[ET.Element]:
    """Whole elements of this tag in order; each leaves memory when the next is asked for."""
    parser, unpack, above, depth = ET.XMLPullParser(events=("start", "end")), zlib.decompressobj(), [], 0
    for a in range(0, len(packed) + 1, 1 << 14):
        block = unpack.decompress(packed[a:a + (1 << 14)]) if a < len(packed) else unpack.flush()
        parser.feed(block)
        if a + (1 << 14) > len(packed):
            parser.close()
        for event, el in parser.read_events():
            if event == "start":
                above.append(el)
                depth += el.tag == tag
                continue
            above.pop()
            if el.tag == tag:
                depth -= 1
                yield el
            if not depth and above:
                above[-1].remove(el)


def _workbook_parts(data: bytes) -> Iterator[tuple]:
    """(part number, sheet name, styles that show dates, whether days count from 1904, packed XML): the
    sheets in order, and the shared strings as part -1."""
    z = zipfile.ZipFile(io.BytesIO(data))
    dates = sorted(_date_styles(z))
    rels = {r.get("Id"): r.get("Target") for r in
            ET.fromstring(z.read("xl/_rels/workbook.xml.rels")).findall("rel:Relationship", _NS)}
    wb = ET.fromstring(z.read("xl/workbook.xml"))
    props = wb.find("m:workbookPr", _NS)
    from_1904 = props is not None and props.get("date1904") in ("1", "true")
    if "xl/sharedStrings.xml" in z.namelist():
        yield -1, None, dates, from_1904, _packed(z, "xl/sharedStrings.xml")
    for sheet_no, sh in enumerate(wb.find("m:sheets", _NS).findall("m:sheet", _NS)):
        target = rels[sh.get(f"{{{_NS['r']}}}id")].lstrip("/")
        target = target if target.startswith("xl/") else posixpath.join("xl", target)
        yield sheet_no, sh.get("name"), dates, from_1904, _packed(z, target)


def _shared_strings(packed: bytes) -> Iterator[tuple]:
    """(number, text) of each shared string."""
    tag = f"{{{_NS['m']}}}"
    for n, si in enumerate(_elements(packed, f"{tag}si")):
        yield n, "".join(t.text or "" for t in si.iter(f"{tag}t"))


def _sheet_cells(packed: bytes, dates: set[int], from_1904: bool) -> Iterator[tuple]:
    """(row, col, text, number of a shared string) for every non-empty cell. Dates are ISO text, booleans
    True / False; a cell without a place follows the one before it."""
    tag = f"{{{_NS['m']}}}"
    row = 0
    for r in _elements(packed, f"{tag}row"):
        row = int(r.get("r") or row + 1)
        col = 0
        for c in r.findall("m:c", _NS):
            ref, t = c.get("r"), c.get("t")
            col = _col_index(ref) if ref else col + 1
            if t == "inlineStr":
                yield row, col, "".join(x.text or "" for x in c.iter(f"{tag}t")), None
                continue
            v = c.find("m:v", _NS)
            if v is None or v.text is None:
                continue
            text = v.text
            if t == "s":
                yield row, col, None, int(text)
                continue
            if t == "b":
                text = "True" if text in ("1", "true") else "False"
            elif t in (None, "n") and int(c.get("s") or 0) in dates:
                text = _date_text(text, from_1904)
            yield row, col, text, None


CELL_SCHEMA = "doc_id string, table_no int, sheet string, row_no long, col_no int, value string, error string"


_PART_SCHEMA = "doc_id string, table_no int, sheet string, dates array<int>, from_1904 boolean, part binary, error string"
_DECODED_SCHEMA = "doc_id string, table_no int, sheet string, row_no long, col_no int, value string, shared long, error string"
_ROWS_A_FRAME = 10_000


def _split_workbooks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for each sheet and each table of shared strings, or one with the error that broke the file."""
    for b in batches:
        for path, content in zip(b["path"], b["content"]):
            try:
                for n, name, dates, from_1904, part in _workbook_parts(bytes(content)):
                    yield pd.DataFrame({"doc_id": [path], "table_no": [n], "sheet": [name], "dates": [dates], "from_1904": [from_1904], "part": [part], "error": [None]})
            except Exception as x:  # whatever malformed content raises, the file goes to quarantine
                yield pd.DataFrame({"doc_id": [path], "table_no": [-2], "sheet": [None], "dates": [None], "from_1904": [None], "part": [None], "error": [f"{type(x).__name__}: {x}"]})


def _decode_parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Cells and shared strings (table -1) of the parts, some thousand rows at a time."""
    names = ["row_no", "col_no", "value", "shared"]

    def frame(own, rows, error=None):
        out = pd.DataFrame(rows, columns=names).astype({"row_no": "Int64", "col_no": "Int32", "shared": "Int64"})
        out.insert(0, "doc_id", own[0])
        out.insert(1, "table_no", own[1])
        out.insert(2, "sheet", own[2])
        return out.assign(error=error)

    for b in batches:
        for path, n, name, dates, from_1904, part, error in b.itertuples(index=False, name=None):
            own, rows = (path, n, name), []
            if error is not None:
                yield frame(own, [(None, None, None, None)], error)
                continue
            try:
                cells = ((None, None, t, k) for k, t in _shared_strings(part)) if n < 0 else _sheet_cells(part, set(dates), from_1904)
                for row in cells:
                    rows.append(row)
                    if len(rows) == _ROWS_A_FRAME:
                        yield frame(own, rows)
                        rows = []
                yield frame(own, rows)
            except Exception as x:  # cells that came before it are dropped with the file
                yield frame(own, [(None, None, None, None)], f"{type(x).__name__}: {x}")


def _decoded_workbooks(files: DataFrame, path: str) -> DataFrame:
    """Cells of .xlsx/.xlsm files, or a row with the error of each broken one (``CELL_SCHEMA``).

    A file is split into its sheets where its bytes are; each sheet is then
    decoded in a task of its own, row by row, and the decoded table is written
    below ``path``. Shared strings meet their cells by a join, so no task
    holds a sheet's rows or a workbook's strings.
    """
    spark = files.sparkSession
    ship_package(spark)
    x = files.filter(file_suffix("path").isin(".xlsx", ".xlsm")).select("path", "content")
    parts = x.mapInPandas(_split_workbooks, _PART_SCHEMA)
    parts.write.mode("overwrite").parquet(f"{path}/parts")
    parts = spark.read.schema(_PART_SCHEMA).parquet(f"{path}/parts")
    tasks = max(1, parts.count())
    dealt = parts.repartition(tasks, "doc_id", "table_no")
    dealt.mapInPandas(_decode_parts, _DECODED_SCHEMA).write.mode("overwrite").parquet(f"{path}/decoded")
    rows = spark.read.schema(_DECODED_SCHEMA).parquet(f"{path}/decoded")
    strings = rows.filter("table_no = -1 AND error IS NULL").select("doc_id", "shared", F.col("value").alias("_text"))
    broken = rows.filter("error IS NOT NULL").groupBy("doc_id").agg(F.min("error").alias("error"))
    cells = rows.filter("table_no >= 0 AND error IS NULL").join(strings, ["doc_id", "shared"], "left")
    # a cell whose shared string is not there breaks its file, like any malformed content
    missing = cells.filter("shared IS NOT NULL AND _text IS NULL").groupBy("doc_id").agg(F.concat(F.lit("IndexError: no shared string "), F.min("shared").cast("string")).alias("error"))
    broken = broken.unionByName(missing).groupBy("doc_id").agg(F.min("error").alias("error"))
    good = cells.join(broken.select("doc_id"), "doc_id", "left_anti").select("doc_id", "table_no", "sheet", "row_no", "col_no", F.coalesce("value", "_text").alias("value"), "error")
    none = F.lit(None)
    bad = broken.select("doc_id", none.cast("int").alias("table_no"), none.cast("string").alias("sheet"), none.cast("long").alias("row_no"),
                        none.cast("int").alias("col_no"), none.cast("string").alias("value"), "error")
    return good.unionByName(bad)


def workbook_cells(files: DataFrame) -> DataFrame:
    """Raw sheet cells of .xlsx/.xlsm files (1-based sheet rows)."""
    return _decoded_workbooks(files, scratch(files.sparkSession, "workbooks")).filter("error IS NULL").drop("error")


def sheet_table(cells: DataFrame) -> DataFrame:
    """Sheet -> table: drop all-empty rows; the first remaining row is the
    header (stripped), row 0; drop columns without data below it; number the
    data rows 1..n. A data column without a header cell is named
    ``Unnamed: <position from 0>``. Empty means NULL or the empty string
    (whitespace counts as a value, as in a data-frame reader)."""
    keys = ["doc_id", "table_no"]
    filled = cells.filter(F.col("value").isNotNull() & (F.col("value") != ""))
    rows = filled.select(*keys, "row_no").distinct()
    head = rows.groupBy(*keys).agg(F.min("row_no").alias("_h"))
    cols = (filled.join(head, keys).filter(F.col("row_no") > F.col("_h"))
            .select(*keys, "col_no").distinct())
    kept = cells.join(rows, keys + ["row_no"], "left_semi").join(cols, keys + ["col_no"], "left_semi").join(head, keys)
    dr = F.dense_rank().over(Window.partitionBy(*keys).orderBy("row_no"))
    data = kept.filter(F.col("row_no") > F.col("_h")).withColumn("row_no", dr.cast("long")).drop("_h")
    titles = kept.filter(F.col("row_no") == F.col("_h")).select(*keys, "col_no", strip("value").alias("title"))
    names = (data.groupBy(*keys, "col_no").agg(F.first("sheet").alias("sheet")) if "sheet" in cells.columns
             else data.select(*keys, "col_no").distinct())
    header = names.join(titles, keys + ["col_no"], "left").withColumn(
        "value", F.when(F.coalesce(F.col("title"), F.lit("")) == "", F.concat(F.lit("Unnamed: "), (F.col("col_no") - 1).cast("string")))
        .otherwise(F.col("title"))).drop("title").withColumn("row_no", F.lit(0).cast("long"))
    return data.unionByName(header.select(*data.columns))


# ---- Word (.docx) ------------------------------------------------------------

def _docx_parts(data: bytes):
    """(paragraph texts, tables as rows of cell texts) in body order. Breaks
    are line breaks, tabs are tabs; a cell that spans columns or rows is
    repeated in each."""
    w = f"{{{_NS['w']}}}"
    body = ET.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{w}body")
    inline = {f"{w}br": "\n", f"{w}cr": "\n", f"{w}tab": "\t", f"{w}noBreakHyphen": "-"}

    def ptext(p):
        return "".join((x.text or "") if x.tag == f"{w}t" else inline.get(x.tag, "") for run in p.iter(f"{w}r") for x in run)

    def prop(cell, name):
        found = cell.find(f"{w}tcPr/{w}{name}")
        return None if found is None else found.get(f"{w}val") or "continue"

    def rows(table):
        above: list[str] = []
        for tr in table.findall(f"{w}tr"):
            row: list[str] = []
            for tc in tr.findall(f"{w}tc"):
                text = "\n".join(ptext(p) for p in tc.findall(f"{w}p")).strip()
                if prop(tc, "vMerge") == "continue" and len(row) < len(above):
                    text = above[len(row)]
                row += [text] * int(prop(tc, "gridSpan") or 1)
            above = row
            yield row

    paras, tables = [], []
    for el in body:
        if el.tag == f"{w}p":
            paras.append(ptext(el))
        elif el.tag == f"{w}tbl":
            tables.append(list(rows(el)))
    return paras, tables


WORD_SCHEMA = "kind string, doc_id string, raw_text string, table_no int, row_no long, col_no int, value string, error string"


def _decode_docx(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One frame per file: its text and table cells, or one row with the error that broke it."""
    for b in batches:
        for path, name, content in zip(b["path"], b["name"], b["content"]):
            try:
                paras, tables = _docx_parts(bytes(content))
                chunks = [f"Word file: {name}"] + [p for p in paras if p.strip()]
                chunks += [f"\n[Table {i + 1}]\n" + "\n".join(" | ".join(r) for r in t) for i, t in enumerate(tables)]
                rows = [("text", path, "\n".join(chunks), None, None, None, None, None)]
                rows += [("cell", path, None, ti, ri, ci + 1, v, None) for ti, t in enumerate(tables) for ri, r in enumerate(t) for ci, v in enumerate(r)]
            except Exception as x:  # whatever malformed content raises, the file goes to quarantine
                rows = [("error", path, None, None, None, None, None, f"{type(x).__name__}: {x}")]
            yield pd.DataFrame(rows, columns=["kind", "doc_id", "raw_text", "table_no", "row_no", "col_no", "value", "error"]).astype(
                {"table_no": "Int32", "row_no": "Int64", "col_no": "Int32"})


# ---- PDF pages ------------------------------------------------------------------

def assemble_pages(pages: DataFrame, name_col: str = "name") -> DataFrame:
    """``pages(doc_id, name, page_no, text, tables ARRAY<ARRAY<ARRAY<STRING>>>)``
    -> ``(doc_id, file_type, raw_text)``: a file marker, then per page a page
    marker and its text, then each of its tables as ' | ' lines (NULL cell
    -> '')."""
    has_tables = "tables" in pages.columns
    tbl = (F.transform(F.coalesce("tables", F.array()), lambda t, i: F.concat(
        F.lit("\n[Table on page "), (F.col("page_no") + 1).cast("string"), F.lit("]\n"),
        F.array_join(F.transform(t, lambda r: F.array_join(
            F.transform(r, lambda c: F.coalesce(c, F.lit(""))), " | ")), "\n")))
           if has_tables else F.array())
    piece = F.array_join(F.concat(F.array(F.concat(
        F.lit("\n--- Page "), (F.col("page_no") + 1).cast("string"), F.lit(" ---\n"),
        F.coalesce("text", F.lit("")))), tbl), "\n")
    per = pages.groupBy("doc_id", name_col).agg(
        F.array_sort(F.collect_list(F.struct("page_no", piece.alias("p")))).alias("_p"))
    return per.select("doc_id", F.lit("pdf").alias("file_type"),
                      F.concat(F.lit("PDF file: "), F.col(name_col), F.lit("\n"),
                               F.array_join(F.transform("_p", lambda s: s["p"]), "\n")).alias("raw_text"))


def page_cells(pages: DataFrame) -> DataFrame:
    """The tables of extracted pages as ``doc_cells``; a table's number is its
    page's (upper 32 bits) and its own on that page, so numbers never meet."""
    t = pages.filter(F.col("tables").isNotNull()).select("doc_id", "page_no", F.posexplode("tables").alias("t", "rows"))
    number = F.shiftleft(F.col("page_no").cast("long"), 32) + F.col("t")
    r = t.select("doc_id", number.alias("table_no"), F.posexplode("rows").alias("row_no", "row"))
    return r.select("doc_id", "table_no", F.col("row_no").cast("long").alias("row_no"), F.posexplode("row").alias("c", "value")).select(
        "doc_id", "table_no", "row_no", (F.col("c") + 1).cast("int").alias("col_no"), "value")


def sheet_text(cells: DataFrame, files: DataFrame) -> DataFrame:
    """Workbook text for search: a file marker, then per sheet a sheet
    marker and its rows (cells in column order, space separated). Column
    padding of a printed table is not reproduced."""
    row_txt = cells.groupBy("doc_id", "table_no", "sheet", "row_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col_no", "value"))),
                                 lambda s: s["value"]), "  ").alias("line"))
    sheets = row_txt.groupBy("doc_id", "table_no", "sheet").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "line"))),
                                 lambda s: s["line"]), "\n").alias("body"))
    per_doc = sheets.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(
        "table_no", F.concat(F.lit("\n--- Sheet: "), F.col("sheet"), F.lit(" ---\n"), F.col("body"))
        .alias("t")))).alias("_s"))
    names = files.select(F.col("path").alias("doc_id"), "name")
    return per_doc.join(names, "doc_id").select(
        "doc_id", F.lit("excel").alias("file_type"),
        F.concat(F.lit("Excel file: "), F.col("name"), F.lit("\n"),
                 F.array_join(F.transform("_s", lambda s: s["t"]), "\n")).alias("raw_text"))


def decode_files(files: DataFrame, out_dir: str, xlsx_decoder=None, docx_decoder=None,
                 pages: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Decode landed files once and store the result as parquet tables
    ``doc_text(doc_id, file_type, raw_text)``, ``doc_cells(doc_id, table_no,
    row_no, col_no, value)`` and ``quarantine(doc_id, name, reason)`` under
    ``out_dir``. ``pages`` (see ``assemble_pages``) gives the text and tables
    of PDF files.

    The written tables cut the lineage: the many later reads of the cells
    (routing, header maps, items) scan the stored table instead of
    re-decoding the files, and a lost executor never forces a re-decode.
    ``xlsx_decoder`` / ``docx_decoder`` replace the built-in decoders by a
    ``mapInPandas`` body over whole files (output: ``CELL_SCHEMA`` /
    ``WORD_SCHEMA``), e.g. to plug in another parser.
    """
    spark = files.sparkSession
    ship_package(spark)
    out = out_dir.rstrip("/")
    xl = files.filter(file_suffix("path").isin(".xlsx", ".xlsm")).select("path", "content")
    decoded = xl.mapInPandas(xlsx_decoder, CELL_SCHEMA) if xlsx_decoder else _decoded_workbooks(files, f"{out}/workbooks")
    decoded.write.mode("overwrite").parquet(f"{out}/sheet_cells")
    x = files.filter(file_suffix("path") == ".docx").select("path", "name", "content")
    x.mapInPandas(docx_decoder or _decode_docx, WORD_SCHEMA).write.mode("overwrite").parquet(f"{out}/word_parts")
    sheets, w = spark.read.parquet(f"{out}/sheet_cells"), spark.read.parquet(f"{out}/word_parts")
    raw = sheets.filter("error IS NULL").drop("error")
    columns = ["doc_id", "table_no", "row_no", "col_no", "value"]
    text = sheet_text(raw, files).unionByName(
        w.filter("kind = 'text'").select("doc_id", F.lit("docx").alias("file_type"), "raw_text"))
    cells = sheet_table(raw).select(columns).unionByName(w.filter("kind = 'cell'").select(columns)).withColumn("table_no", F.col("table_no").cast("long"))
    if pages is not None:
        text = text.unionByName(assemble_pages(pages))
        if "tables" in pages.columns:
            cells = cells.unionByName(page_cells(pages))
    text.write.mode("overwrite").parquet(f"{out}/doc_text")
    cells.write.mode("overwrite").parquet(f"{out}/doc_cells")
    stored = spark.read.parquet(f"{out}/doc_text")
    broken = sheets.filter("error IS NOT NULL").select("doc_id", "error").unionByName(
        w.filter("kind = 'error'").select("doc_id", "error"))
    kept = quarantine(files.drop("content"), stored, broken, pages)
    # a workbook without any cell has no text row: it is decoded, and empty
    kept.select(F.col("path").alias("doc_id"), "name", "reason").write.mode("overwrite").parquet(f"{out}/quarantine")
    return stored, spark.read.parquet(f"{out}/doc_cells"), spark.read.parquet(f"{out}/quarantine")
