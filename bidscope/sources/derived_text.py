"""Document-like inputs derived from the star schema, for the extraction
operators: header strings, money/date/terms strings, key:value documents,
priced item lines and table cells. Each row comes from one ``part`` or
``supplier`` row (a projection, no aggregation), so the inputs grow with
the tables. The oracle builds the same inputs in SQL.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ASCII_DIGITS, DEVANAGARI_DIGITS
from .tables import read_table

# Fixed test values: header spellings that exercise exact, prefix and
# no-match paths of both alias maps.
HEADER_VARIANTS = [
    "Item Name", "Unit Price (INR)", "Total Price (INR)", "  Lead  Time (days)",
    "Payment Terms Required", "Qty", "Remarks", "Item Code", "Description", "RATE",
    "Amount", "Portion Spec", "Packaging", "Unit", "RFQ No.", "Closing Date",
    "Supplier Name", "Vendor", "From", "Guarantee",
]

NL = "\n"


def s(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def pick(k: Column, n: int, *cases: Column) -> Column:
    e = None
    for i, c in enumerate(cases):
        e = F.when(k % n == i, c) if e is None else e.when(k % n == i, c)
    return e


def header_texts(spark: SparkSession, d: str) -> DataFrame:
    p = read_table(spark, d, "part", "p_partkey", "p_type")
    k = F.col("p_partkey")
    variant = F.element_at(F.array(*[F.lit(v) for v in HEADER_VARIANTS]),
                           (k % len(HEADER_VARIANTS) + 1).cast("int"))
    suffix = F.when(k % 3 == 0, F.concat(F.lit("  "), F.col("p_type"))).otherwise(F.lit(""))
    return p.select("p_partkey", F.concat(variant, suffix).alias("header"))


def number_texts(spark: SparkSession, d: str) -> DataFrame:
    p = read_table(spark, d, "part", "p_partkey", "p_size")
    k, z = F.col("p_partkey"), s("p_size")
    z3 = F.lpad(z, 3, "0")
    txt = pick(k, 10,
               F.concat(F.lit("Rs. "), s(k % 97), F.lit(","), z3, F.lit(".50")),
               F.concat(z, F.lit("-"), s(F.col("p_size") + 2), F.lit(" days")),
               F.concat(F.lit("₹"), s(k)),
               F.concat(F.lit("."), z),
               F.lit("n/a"),
               F.concat(F.lit("USD "), s(k), F.lit(".")),
               F.concat(F.lit("1,00,"), z3, F.lit(".25")),
               F.concat(F.lit("-"), z, F.lit(" units")),
               F.concat(F.translate(z, ASCII_DIGITS, DEVANAGARI_DIGITS), F.lit(" kg")),
               F.lit(None).cast("string"))
    return p.select("p_partkey", txt.alias("raw_value"))


def date_texts(spark: SparkSession, d: str) -> DataFrame:
    p = read_table(spark, d, "part", "p_partkey")
    k = F.col("p_partkey")
    dd, mm, yy = s(k % 28 + 1), s(k % 12 + 1), s(k % 10 + 2020)
    txt = pick(k, 8,
               F.concat_ws("/", F.lpad(dd, 2, "0"), F.lpad(mm, 2, "0"), yy),
               F.concat_ws("-", dd, mm, s(k % 10 + 20)),
               F.concat_ws("-", yy, F.lpad(mm, 2, "0"), F.lpad(dd, 2, "0")),
               F.lit("soon"),
               F.concat(dd, F.lit("/13/"), yy),
               F.concat(F.lit("by "), dd, F.lit("."), mm, F.lit("."), yy),
               F.lit(None).cast("string"),
               F.lit(""))
    return p.select("p_partkey", txt.alias("raw_value"))


def terms_texts(spark: SparkSession, d: str) -> DataFrame:
    p = read_table(spark, d, "part", "p_partkey")
    k = F.col("p_partkey")
    txt = pick(k, 8,
               F.concat(s(k % 100), F.lit("% advance, balance on delivery")),
               F.concat(s(k % 300), F.lit(" % UPFRONT")),
               F.concat(F.lit("Advance "), s(k % 50), F.lit("%")),
               F.concat(s(k % 20), F.lit(".5% advance")),
               F.concat(F.translate(s(k % 100), ASCII_DIGITS, DEVANAGARI_DIGITS), F.lit("% advance")),
               F.concat(F.lit("Net "), s(k % 60)),
               F.lit(None).cast("string"),
               F.concat(s(k % 100), F.lit("%in advance")))
    return p.select("p_partkey", txt.alias("payment_terms"))


def kv_documents(spark: SparkSession, d: str) -> DataFrame:
    """One key:value document per supplier; even keys are Word, odd PDF."""
    sp = read_table(spark, d, "supplier", "s_suppkey", "s_name", "s_nationkey")
    k, n = F.col("s_suppkey"), s("s_nationkey")
    lines = [
        F.lit("Supplier Quotation"),
        F.concat(F.lit("Supplier: "), F.col("s_name")),
        F.concat(F.lit("Quotation Ref: Q-"), s(k)),
        F.concat(F.lit("RFQ No : RFQ-"), n, F.lit("\r")),
        F.concat(F.lit("Deadline: "), F.lpad(s(k % 28 + 1), 2, "0"), F.lit("/"),
                 F.lpad(s(k % 12 + 1), 2, "0"), F.lit("/2026")),
        F.lit("Closing Date: soon"),
        F.concat(F.lit("Lead Time (days): "), n, F.lit(" days")),
        F.lit("Delivery Time: tbd"),
        F.concat(F.lit("Payment Terms: "), s(k % 5 * 10), F.lit("% advance")),
        F.concat(F.lit("Warranty:"), F.when(k % 3 == 0, F.lit("   ")).otherwise(F.lit(" 12 months"))),
        F.concat(F.lit("Currency: "), F.when(k % 4 == 0, F.lit("INR Qty 5")).otherwise(F.lit("USD"))),
        F.lit("Note: no colon issues: here"),
        F.concat(F.lit("Delivery Terms: FOB port "), n),
    ]
    return sp.select(F.col("s_suppkey").alias("doc_id"),
                     F.when(k % 2 == 0, F.lit("docx")).otherwise(F.lit("pdf")).alias("file_type"),
                     F.concat_ws(NL, *lines).alias("raw_text"))


def brand_number(c="p_brand") -> Column:
    return F.regexp_extract(c, r"(\d+)$", 1).cast("int")


def brand_document() -> Column:
    """Document of a part: its brand's, one for each thousand part numbers, so that documents are of
    bounded size and their number grows with the table."""
    return F.concat_ws("/", F.floor(F.col("p_partkey") / 1000).cast("string"), "p_brand")


def item_lines(spark: SparkSession, d: str) -> DataFrame:
    """One priced text line per part, in its document."""
    p = read_table(spark, d, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size",
                   "p_retailprice")
    k, z = F.col("p_partkey"), s("p_size")
    label = pick(k, 3, F.lit("Unit Price Rs. "), F.lit("unit price $"), F.lit("Unit Price "))
    line = F.concat(
        F.col("p_name"), F.lit("  Qty "), z,
        F.when(k % 5 == 0, F.lit("")).otherwise(F.lit(" pcs")), F.lit("  "), label,
        s(F.floor("p_retailprice")), F.lit("."), F.lpad(s(k % 100), 2, "0"),
        F.when(k % 2 == 0, F.concat(F.lit("  Portion: "), F.col("p_type"))).otherwise(F.lit("")),
        F.when(k % 7 < 4, F.concat(F.lit("  Packaging: Box of "), z)).otherwise(F.lit("")))
    line = F.when(k % 11 == 0, F.concat(F.lit("Total for "), F.col("p_name"))).otherwise(line)
    return p.select(brand_document().alias("doc_id"), F.col("p_partkey").alias("line_no"),
                    line.alias("line"))


# Fixed test values: the table layouts of the cell documents. Layouts 0 and 1
# have an item column; 2 and 3 (same data columns) have none, so their
# tables give no items and their documents take the text-line path.
TABLE_HEADERS = {
    0: ["Item Name", "Quantity", "Unit", "Unit Price", "Total Price", "Portion", "Packaging"],
    1: ["Item Code", "Qty", "Unit Price (INR)", "Rate", "Remarks", "Packaging Spec", "Unit", "Qty"],
    2: ["Line", "Quantity", "Unit", "Unit Price", "Total Price", "Portion", "Packaging"],
    3: ["Code", "Qty", "Unit Price (INR)", "Rate", "Remarks", "Packaging Spec", "Unit", "Qty"],
}


def table_cells(spark: SparkSession, d: str) -> DataFrame:
    """Long cells ``(doc_id, table_no, row_no, col_no, value)``: the
    documents of ``brand_document``, one data row per part (every part), table = part size parity,
    row 0 is the header. Brands whose number is a multiple of 3 use layouts
    with an item column; the others use the same tables without one."""
    p = read_table(spark, d, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size",
                   "p_retailprice")
    k, z, price = F.col("p_partkey"), s("p_size"), s(F.floor("p_retailprice"))
    t0 = [F.when(k % 13 == 0, F.lit("")).otherwise(F.col("p_name")), z, F.lit("pcs"),
          F.concat(F.lit("Rs. "), price, F.lit(".50")),
          F.when(k % 4 == 0, F.lit(None)).otherwise(s(F.floor("p_retailprice") * F.col("p_size"))),
          F.when(k % 5 == 0, F.lit("nan")).otherwise(F.col("p_type")),
          F.concat(F.lit("Box of "), z)]
    t1 = [F.col("p_name"), F.concat(z, F.lit(" nos")), F.concat(F.lit("INR "), price),
          F.concat(price, F.lit(".75")), F.lit("ok"),
          F.when(k % 2 == 0, F.lit("  ")).otherwise(F.lit("Carton")), F.lit("kg"),
          F.when(k % 3 == 0, F.lit("")).otherwise(s(F.col("p_size") * 2))]
    def cells(vals):
        return F.array(*[F.struct(F.lit(i + 1).alias("col_no"), v.cast("string").alias("value"))
                         for i, v in enumerate(vals)])
    tno = (F.col("p_size") % 2).cast("int")
    data = (p.select(brand_document().alias("doc_id"), tno.alias("table_no"),
                     (k + 1).alias("row_no"),
                     F.explode(F.when(tno == 0, cells(t0)).otherwise(cells(t1))).alias("c"))
             .select("doc_id", "table_no", "row_no", "c.col_no", "c.value"))
    layout = F.when(brand_number() % 3 == 0, tno).otherwise(tno + 2)
    tables = p.select(brand_document().alias("doc_id"), tno.alias("table_no"),
                      layout.alias("layout")).distinct()
    header = None
    for i, names in TABLE_HEADERS.items():
        arr = F.array(*map(F.lit, names))
        header = (F.when(F.col("layout") == i, arr) if header is None
                  else header.when(F.col("layout") == i, arr))
    heads = tables.select("doc_id", "table_no", F.lit(0).cast("bigint").alias("row_no"),
                          F.posexplode(header))
    heads = heads.select("doc_id", "table_no", "row_no", (F.col("pos") + 1).alias("col_no"),
                         F.col("col").alias("value"))
    return heads.unionByName(data)


def whole_documents(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(doc_text, doc_cells): the documents of ``brand_document``, over every part. Even
    brands are workbooks with a field/value sheet beside their tables, odd
    ones PDF texts with the priced lines; both have the tables of
    ``table_cells``. Deadlines are ISO, and in the sheet a later d/m/y row."""
    n = brand_number("doc_id")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    iso = F.concat(F.lit("2026-"), two(n % 12 + 1), F.lit("-"), two(n % 9 + 1))
    dmy = F.concat(two(n % 28 + 1), F.lit("/"), two(n % 12 + 1), F.lit("/2027"))
    maker = F.concat(F.lit("Maker "), n.cast("string"))
    lines = item_lines(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    body = F.array_join(F.transform("l", lambda x: x["line"]), NL)
    text = lines.select(
        "doc_id", F.when(n % 2 == 0, F.lit("excel")).otherwise(F.lit("pdf")).alias("file_type"),
        F.concat_ws(NL, F.concat(F.lit("Supplier: "), maker), F.concat(F.lit("Deadline: "), iso), body).alias("raw_text"))
    rows = [(F.lit("Field"), F.lit("Value")), (F.lit("Supplier"), maker), (F.lit("Deadline"), iso),
            (F.lit("Closing Date"), F.lit("soon")), (F.lit("Deadline"), dmy), (F.lit("Warranty"), F.when(n % 4 == 0, F.lit("2 years")))]
    sheet = text.filter("file_type = 'excel'").select("doc_id", F.posexplode(F.array(*[F.array(a, v) for a, v in rows])).alias("row_no", "r"))
    sheet = sheet.select("doc_id", F.lit(9).alias("table_no"), F.col("row_no").cast("long").alias("row_no"), F.posexplode("r").alias("c", "value")).select(
        "doc_id", "table_no", "row_no", (F.col("c") + 1).alias("col_no"), "value").filter("value IS NOT NULL")
    return text, table_cells(spark, d).unionByName(sheet)


def versioned_records(spark: SparkSession, d: str) -> DataFrame:
    """Extraction inputs with two quotations per supplier: (doc_id, file_type, raw_text), the second with other terms."""
    kv = kv_documents(spark, d)
    later = kv.select((F.col("doc_id") + F.lit(1 << 40)).alias("doc_id"), "file_type",
                      F.concat("raw_text", F.lit(NL + "Payment Terms: 70% advance")).alias("raw_text"))
    return kv.unionByName(later)
