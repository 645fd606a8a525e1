"""Hand-made demo documents (one RFQ, three quotations) written as real
.xlsx / .docx zip files with the standard library, plus the PDF quotation
as already-extracted page text."""
from __future__ import annotations

import os
import zipfile
from xml.sax.saxutils import escape

# The demo documents that the golden results belong to.
RFQ_INFO = [("Field", "Value"), ("RFQ Ref", "RFQ-2026-014"), ("Deadline", "15/09/2026"),
            ("Currency", "INR"), ("Delivery Terms Required", "FOB Delhi, within 20 days"),
            ("Payment Terms Required", "30% advance, balance on delivery")]
ITEMS = [("Corrugated Packaging Box (L)", 5000, "pcs", "Single unit box", "Bundle of 50"),
         ("Steel Rod 12mm", 2000, "kg", "Per kg bundle", "Bundle of 100kg"),
         ("Industrial Sealant Tube", 800, "pcs", "500ml tube", "Box of 24"),
         ("Pallet Wrap Film", 300, "rolls", "20kg roll", "Shrink pack of 5")]
RFQ_ITEMS = [("Item", "Required Quantity", "Unit", "Portion Spec", "Packaging Spec")] + ITEMS

A_INFO = [("Field", "Value"), ("Supplier", "Bharat Packaging Solutions Pvt Ltd"),
          ("Quotation Ref", "BPS-Q-991"), ("RFQ Ref", "RFQ-2026-014"),
          ("Delivery Terms", "FOB Delhi, within 18 days"),
          ("Payment Terms", "30% advance, balance on delivery"), ("Warranty", "6 months"),
          ("Lead Time (days)", 18)]
A_PRICES = [(18.5, 92500), (62.0, 124000), (145.0, 116000), (410.0, 123000)]
A_ITEMS = [("Item Name", "Quantity", "Unit", "Unit Price", "Total Price", "Portion", "Packaging")] + [
    (n, q, u, p, t, po, pa) for (n, q, u, po, pa), (p, t) in zip(ITEMS, A_PRICES)]

B_PARAS = ["Supplier Quotation", "Supplier: Northline Industrial Supplies",
           "Quotation Ref: NIS-2026-77", "RFQ Ref: RFQ-2026-014",
           "Delivery Terms: Ex-works Gurugram, within 25 days",
           "Payment Terms: 50% advance, balance on delivery", "Warranty: 3 months",
           "Lead Time: 25 days", "",
           "Note: Sealant tube pricing not included this cycle — to follow separately."]
B_TABLE = [["Item Name", "Quantity", "Unit", "Unit Price", "Portion", "Packaging"],
           ["Corrugated Packaging Box (L)", "5000", "pcs", "17.90", "Single unit box", "Bundle of 50"],
           ["Steel Rod 12mm", "2000", "kg", "59.50", "Per kg bundle", "Bundle of 100kg"],
           ["Pallet Wrap Film", "300", "rolls", "395.00", "20kg roll", "Shrink pack of 5"]]

C_LINES = [
    "Supplier Quotation", "", "Supplier: Swift Trade Corp", "Quotation Ref: STC-556",
    "RFQ Ref: RFQ-2026-014", "Delivery Terms: CIF Delhi, within 15 days",
    "Payment Terms: 20% advance, balance on delivery", "Warranty: 12 months",
    "Lead Time: 15 days", "", "Priced Items:",
    "Corrugated Packaging Box (L)  Qty 5000 pcs  Unit Price Rs. 19.20  Portion: Single unit box  Packaging: Bundle of 50",
    "Steel Rod 12mm  Qty 2000 kg  Unit Price Rs. 61.00  Portion: Per kg bundle  Packaging: Bundle of 100kg",
    "Industrial Sealant Tube  Qty 800 pcs  Unit Price Rs. 139.00  Portion: 500ml tube  Packaging: Box of 24",
    "Pallet Wrap Film  Qty 300 rolls  Unit Price Rs. 405.00  Portion: 20kg roll  Packaging: Shrink pack of 5",
]

_M = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def _col(i: int) -> str:
    s = ""
    while i:
        i, r = divmod(i - 1, 26)
        s = chr(65 + r) + s
    return s


def _cell(ref, v):
    if isinstance(v, (int, float)):
        return f'<c r="{ref}"><v>{v}</v></c>'
    return f'<c r="{ref}" t="inlineStr"><is><t>{escape(str(v))}</t></is></c>'


def write_xlsx(path: str, sheets: list[tuple[str, list[tuple]]]) -> None:
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml",
                   f'<workbook xmlns="{_M}" xmlns:r="{_R}"><sheets>' + "".join(
                       f'<sheet name="{escape(n)}" sheetId="{i + 1}" r:id="rId{i + 1}"/>'
                       for i, (n, _) in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels",
                   '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                   + "".join(f'<Relationship Id="rId{i + 1}" Target="worksheets/sheet{i + 1}.xml" '
                             f'Type="{_R}/worksheet"/>' for i in range(len(sheets)))
                   + "</Relationships>")
        for i, (_, rows) in enumerate(sheets):
            body = "".join(f'<row r="{r + 1}">' + "".join(
                _cell(f"{_col(c + 1)}{r + 1}", v) for c, v in enumerate(row) if v is not None)
                + "</row>" for r, row in enumerate(rows))
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml",
                       f'<worksheet xmlns="{_M}"><sheetData>{body}</sheetData></worksheet>')


def write_docx(path: str, paras: list[str], table: list[list[str]]) -> None:
    p = lambda t: f"<w:p><w:r><w:t xml:space=\"preserve\">{escape(t)}</w:t></w:r></w:p>"
    tbl = "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in row) + "</w:tr>"
                              for row in table) + "</w:tbl>"
    doc = f'<w:document xmlns:w="{_W}"><w:body>' + "".join(p(x) for x in paras) + tbl + "</w:body></w:document>"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", doc)


def write_demo(folder: str) -> dict[str, str]:
    paths = {"rfq": os.path.join(folder, "RFQ_2026-014.xlsx"),
             "a": os.path.join(folder, "Quotation_BharatPackaging.xlsx"),
             "b": os.path.join(folder, "Quotation_Northline.docx")}
    write_xlsx(paths["rfq"], [("RFQ Info", RFQ_INFO), ("Required Items", RFQ_ITEMS)])
    write_xlsx(paths["a"], [("Quotation Info", A_INFO), ("Priced Items", A_ITEMS)])
    write_docx(paths["b"], B_PARAS, B_TABLE)
    return paths
