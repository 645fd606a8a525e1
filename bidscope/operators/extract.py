"""Document text and table cells -> normalised quotation fields and items.

Inputs are long tables: ``doc_text(doc_id, file_type, raw_text)`` and
``doc_cells(doc_id, table_no, row_no, col_no, value)`` (row 0 = header).
Everything is expressed as explode / join / grouped aggregate, keyed by
document, so documents are processed in parallel and no document's lines
are gathered in one place except through partial aggregates. Both sides of
a join grow with the documents, and the sizes that Spark estimates for
exploded or compressed rows say little about that, so joins are shuffled
(``_by_key``): nothing is broadcast through the driver.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.aliases import (HEADER_FIELD_ALIASES, HEADER_FIELDS, ITEM_COLUMN_ALIASES,
                                 ITEM_FIELDS, with_alias_field)
from ..functions.terms import clean_number, infer_currency, normalize_date
from ..functions.text import normalize_key, strip

# What counts as a line break (Python's str.splitlines set).
LINE_BREAK = r"\r\n|[\n\r\u000B\u000C\u001C\u001D\u001E\u0085\u2028\u2029]"

# Fixed pattern: one priced item per text line (case-insensitive).
ITEM_LINE = (r"(?i)^([A-Za-z][A-Za-z0-9 /\-\.\(\)]{2,50}?)\s+"
             r"Qty\s*([\d,]+(?:\.\d+)?)\s*([A-Za-z]+)?\s+"
             r"Unit Price\s*(?:Rs\.?|₹|\$)?\s*([\d,]+(?:\.\d+)?)"
             r"(?:\s+Portion:\s*([^:]+?))?"
             r"(?:\s+Packaging:\s*(.+))?$")

# Fixed text: provenance note of heuristic extraction.
HEURISTIC_NOTE = ("Extracted with local heuristics from document structure "
                  "(no model function given) — spot-check before finalizing.")

NUMERIC_ITEM_FIELDS = ("quantity", "unit_price", "total_price")


def _by_key(df: DataFrame) -> DataFrame:
    """``df`` as a side of a shuffled join, whatever its estimated size."""
    return df.hint("merge")


def text_lines(doc_text: DataFrame) -> DataFrame:
    """``(doc_id, file_type, line_no, line)``: one row per text line."""
    return doc_text.select("doc_id", "file_type",
                           F.posexplode(F.split("raw_text", LINE_BREAK)).alias("line_no", "line"))


def kv_lines(doc_text: DataFrame) -> DataFrame:
    """``key: value`` lines whose key is a header alias and whose value is
    not blank; PDF values mentioning ``Qty`` are item lines, not headers."""
    lines = text_lines(doc_text).filter(F.instr("line", ":") > 0)
    key = F.substring_index("line", ":", 1)
    value = F.expr("substr(line, instr(line, ':') + 1)")
    kv = with_alias_field(lines.select("doc_id", "file_type", "line_no", key.alias("_key"),
                                       value.alias("value")),
                          "_key", "field", HEADER_FIELD_ALIASES).drop("_key")
    return kv.filter(F.col("field").isNotNull() & (strip("value") != "")
                     & ((F.col("file_type") != "pdf") | ~F.col("value").contains("Qty")))


def header_fields(kv: DataFrame, pos: str = "line_no") -> DataFrame:
    """``(doc_id, field, value, pos)`` -> one row per document with the nine
    header fields. Last parsable value wins for the deadline and lead time,
    last value for the others: ``max_by`` over position, pivoted on the
    fixed field list (a partial aggregate)."""
    f, v = F.col("field"), F.col("value")
    parsed = (F.when(f == "deadline_date", normalize_date(strip(v), iso_first=True))
               .when(f == "delivery_lead_time_days", clean_number(v).try_cast("int").cast("string"))
               .otherwise(strip(v)))
    rows = kv.select("doc_id", "field", F.col(pos).alias("_pos"), parsed.alias("_v")).filter(
        F.col("_v").isNotNull())
    wide = rows.groupBy("doc_id").pivot("field", HEADER_FIELDS).agg(F.max_by("_v", "_pos"))
    return wide.select("doc_id", *[
        (F.col(c).cast("int") if c == "delivery_lead_time_days" else F.col(c)).alias(c)
        for c in HEADER_FIELDS])


def kv_header_fields(doc_text: DataFrame) -> DataFrame:
    return header_fields(kv_lines(doc_text))


def line_items(lines: DataFrame) -> DataFrame:
    """``(doc_id, line_no, line)`` -> items parsed by the line grammar."""
    s = strip("line")
    g = [F.regexp_extract(s, ITEM_LINE, i) for i in range(7)]
    opt = lambda x: F.when(x != "", strip(x))
    return (lines.filter(s.rlike(ITEM_LINE))
            .select("doc_id", "line_no",
                    strip(g[1]).alias("item_name"),
                    clean_number(g[2]).alias("quantity"),
                    F.when(g[3] != "", g[3]).alias("unit"),
                    clean_number(g[4]).alias("unit_price"),
                    F.lit(None).cast("double").alias("total_price"),
                    opt(g[5]).alias("portion"),
                    opt(g[6]).alias("packaging")))


def header_map(cells: DataFrame, alias_map=ITEM_COLUMN_ALIASES) -> DataFrame:
    """Per table, header text -> field. Row-dict semantics: a repeated header
    is one key at its first position whose value is the last such column."""
    hdr = cells.filter(F.col("row_no") == 0).select(
        "doc_id", "table_no", "col_no", F.col("value").alias("header"))
    keys = hdr.groupBy("doc_id", "table_no", "header").agg(
        F.min("col_no").alias("key_pos"), F.max("col_no").alias("col_no"))
    return with_alias_field(keys, "header", "field", alias_map).filter(
        F.col("field").isNotNull())


def table_items(cells: DataFrame) -> DataFrame:
    """Table cells -> one item per data row that has an item name.

    Columns map to fields by alias; a table without an item-name column
    yields nothing; blank and 'nan' cells are skipped; money/quantity cells
    are parsed; when several columns feed one field the last non-blank wins.
    """
    keys = header_map(cells)
    with_item = keys.filter(F.col("field") == "item_name").select("doc_id", "table_no").distinct()
    keys = keys.join(_by_key(with_item), ["doc_id", "table_no"], "left_semi")
    v = F.col("value")
    data = (cells.filter(F.col("row_no") > 0)
            .join(_by_key(keys), ["doc_id", "table_no", "col_no"])
            .filter(v.isNotNull() & (strip(v) != "") & (F.lower(v) != "nan")))
    num = F.when(F.col("field").isin(*NUMERIC_ITEM_FIELDS), clean_number(v))
    txt = F.when(~F.col("field").isin(*NUMERIC_ITEM_FIELDS), strip(v))
    wide = (data.select("doc_id", "table_no", "row_no", "field", "key_pos",
                        F.struct(num.alias("n"), txt.alias("t")).alias("_v"))
            .groupBy("doc_id", "table_no", "row_no").pivot("field", ITEM_FIELDS)
            .agg(F.max_by("_v", "key_pos")))
    out = wide.select("doc_id", "table_no", "row_no", *[
        F.col(f"{f}.n" if f in NUMERIC_ITEM_FIELDS else f"{f}.t").alias(f) for f in ITEM_FIELDS])
    return out.filter(F.col("item_name").isNotNull() & (F.col("item_name") != ""))


def lines_without_tables(line_items: DataFrame, table_items: DataFrame) -> DataFrame:
    """The line items of documents whose tables gave no item."""
    return line_items.join(_by_key(table_items.select("doc_id").distinct()), "doc_id", "left_anti")


def route_tables(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split tables into (field/value tables, item tables): a table whose
    normalised headers include both 'field' and 'value' holds header fields."""
    hk = F.col("_hk")
    flags = (cells.filter(F.col("row_no") == 0).withColumn("_hk", normalize_key("value"))
             .groupBy("doc_id", "table_no")
             .agg((F.max((hk == "field").cast("int")) * F.max((hk == "value").cast("int")))
                  .alias("_kv")))
    kv_tables = flags.filter(F.col("_kv") == 1).select("doc_id", "table_no")
    return (cells.join(_by_key(kv_tables), ["doc_id", "table_no"], "left_semi"),
            cells.join(_by_key(kv_tables), ["doc_id", "table_no"], "left_anti"))


def kv_table_rows(kv_cells: DataFrame) -> DataFrame:
    """Field/value tables -> ``(doc_id, field, value, line_no)`` using the
    first two columns by position; both cells must be present."""
    cols = kv_cells.filter(F.col("row_no") == 0).groupBy("doc_id", "table_no").agg(
        F.array_sort(F.collect_list("col_no")).alias("_c"))
    c = kv_cells.filter(F.col("row_no") > 0).join(_by_key(cols), ["doc_id", "table_no"])
    pair = (c.groupBy("doc_id", "table_no", "row_no").agg(
        F.max_by("value", F.when(F.col("col_no") == F.element_at("_c", 1), F.col("col_no"))).alias("k"),
        F.max_by("value", F.when(F.col("col_no") == F.element_at("_c", 2), F.col("col_no"))).alias("v")))
    pair = pair.filter(F.col("k").isNotNull() & F.col("v").isNotNull())
    pair = with_alias_field(pair, "k", "field", HEADER_FIELD_ALIASES)
    return pair.select("doc_id", "field", F.col("v").alias("value"),
                       (F.col("table_no") * F.lit(1 << 32) + F.col("row_no")).alias("line_no")
                       ).filter(F.col("field").isNotNull())


def extract_records(doc_text: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """Heuristic extraction of whole documents -> one normalised record per
    document: header fields, ``items`` array in list order, currency
    inferred from the text when the header gave none, provenance note.

    Excel documents read header fields from field/value tables; Word and PDF
    documents from ``key: value`` lines. Item tables apply to all types; a
    PDF's text lines are parsed as items only when its tables gave none.
    """
    docs = doc_text.select("doc_id", "file_type", "raw_text")
    kv_txt = kv_lines(docs.filter(F.col("file_type").isin("docx", "pdf"))).select(
        "doc_id", "field", "value", "line_no")
    if cells is not None:
        # only workbooks have field/value sheets; all tables of other types may hold items
        excel = docs.filter(F.col("file_type") == "excel").select("doc_id")
        kv_cells, item_cells = route_tables(cells.join(_by_key(excel), "doc_id", "left_semi"))
        item_cells = item_cells.unionByName(cells.join(_by_key(excel), "doc_id", "left_anti"))
        kv_tab = kv_table_rows(kv_cells)
        kv_all = kv_txt.unionByName(kv_tab)
        titems = table_items(item_cells).select(
            "doc_id", F.col("table_no").cast("bigint").alias("_t"), F.col("row_no").alias("_r"),
            *ITEM_FIELDS)
    else:
        kv_all = kv_txt
        titems = None
    head = header_fields(kv_all)
    lines = text_lines(docs.filter(F.col("file_type") == "pdf")).select("doc_id", "line_no", "line")
    litems = line_items(lines)
    if titems is not None:
        litems = lines_without_tables(litems, titems)
    litems = litems.select("doc_id", F.lit(1 << 40).cast("bigint").alias("_t"),
                           F.col("line_no").cast("bigint").alias("_r"), *ITEM_FIELDS)
    allitems = litems if titems is None else titems.unionByName(litems)
    packed = allitems.groupBy("doc_id").agg(F.array_sort(F.collect_list(
        F.struct("_t", "_r", *ITEM_FIELDS))).alias("_items"))
    rec = docs.join(_by_key(head), "doc_id", "left").join(_by_key(packed), "doc_id", "left")
    items = F.transform(F.coalesce("_items", F.array()),
                        lambda x: F.struct(*[x[f].alias(f) for f in ITEM_FIELDS]))
    return rec.select(
        "doc_id", "file_type",
        *[F.col(f) for f in HEADER_FIELDS if f != "currency"],
        F.coalesce(F.col("currency"), infer_currency("raw_text")).alias("currency"),
        items.alias("items"),
        F.lit(HEURISTIC_NOTE).alias("notes"), "raw_text")


def link_records(records: DataFrame, rfqs: DataFrame, order: str = "doc_id", folder=None) -> tuple[DataFrame, DataFrame]:
    """Extracted quotations -> (linked, unmatched).

    A record belongs to the RFQ whose ``rfq_ref`` equals its own (stripped,
    case-insensitive), else to the RFQ of its landing ``folder`` (a Column of
    ``records``; ``rfqs`` then has a ``folder`` column). ``quote_seq`` numbers
    an RFQ's records from 0 by ``order``, a unique number such as the upload
    time; it is ranked in value ranges, so no RFQ is gathered in one task.
    """
    from .hot_window import split_rank
    ref = lambda c: F.lower(strip(c))
    by_ref = rfqs.filter(ref("rfq_ref") != "").groupBy(ref("rfq_ref").alias("_ref")).agg(F.min("rfq_id").alias("_by_ref"))
    out = records.withColumn("_ref", ref("rfq_ref")).join(by_ref, "_ref", "left")
    found = F.col("_by_ref")
    if folder is not None:
        by_folder = rfqs.filter(F.col("folder").isNotNull()).groupBy(F.col("folder").alias("_folder")).agg(F.min("rfq_id").alias("_by_folder"))
        out = out.withColumn("_folder", folder).join(by_folder, "_folder", "left")
        found = F.coalesce(found, F.col("_by_folder"))
    out = out.withColumn("rfq_id", found).select(*records.columns, "rfq_id")
    ranked = split_rank(out.filter(F.col("rfq_id").isNotNull()), ["rfq_id"], order, "_rank")
    return (ranked.withColumn("quote_seq", (F.col("_rank") - 1).cast("long")).select(*records.columns, "rfq_id", "quote_seq"),
            out.filter(F.col("rfq_id").isNull()).drop("rfq_id"))


def explode_items(records: DataFrame, keys=("rfq_id", "quote_seq", "supplier_name")) -> DataFrame:
    """Nested records -> long quote lines with their list position."""
    keep = [k for k in keys if k in records.columns]
    return records.select(*keep, F.posexplode("items").alias("item_pos", "it")).select(
        *keep, "item_pos", *[F.col(f"it.{f}").alias(f) for f in ITEM_FIELDS])


# ---- model output (JSON) -> record -------------------------------------------

# Fixed text: note on a record whose model output was not JSON.
NON_JSON_NOTE = "LLM returned non-JSON output; raw response saved."

RECORD_JSON_SCHEMA = (
    "supplier_name string, quotation_ref string, rfq_ref string, deadline_date string, "
    "currency string, items array<struct<item_name string, quantity string, unit string, "
    "unit_price string, total_price string, portion string, packaging string>>, "
    "delivery_terms string, delivery_lead_time_days string, payment_terms string, "
    "warranty string, notes string, _corrupt string")


def coerce_json(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Model output text -> the record's fields. Only known keys are kept;
    a non-list ``items`` becomes empty; text that is not a JSON object gives
    an empty record with a note, and the raw text is kept in ``raw_output``.
    Scalar values stay text, as the model wrote them."""
    t = F.col(text_col)
    valid = F.json_object_keys(t).isNotNull()
    p = F.from_json(t, RECORD_JSON_SCHEMA, {"columnNameOfCorruptRecord": "_corrupt"})
    fields = [f for f in HEADER_FIELDS] + ["notes"]
    cols = {f: F.when(valid, p[f]) for f in fields}
    cols["notes"] = F.when(valid, p["notes"]).otherwise(F.lit(NON_JSON_NOTE))
    items = F.when(valid, F.coalesce(p["items"], F.array())).otherwise(F.array())
    return df.select("*", *[c.alias(n) for n, c in cols.items()],
                     items.alias("items"), valid.alias("is_valid"),
                     F.when(~valid, t).alias("raw_output"))


def quote_tables(records: DataFrame, rfq_id: str = "rfq_id", seq: str = "quote_seq"):
    """Extracted quotation records -> (quotations, quote_items) in the model
    the analytics read. A blank supplier takes the file-name stem when the
    record has a ``source`` column."""
    from ..sources.ingest import default_supplier
    recs = records
    if "source" in recs.columns:
        recs = recs.withColumn("supplier_name", default_supplier("supplier_name", "source"))
    quotes = recs.select(rfq_id, seq, *HEADER_FIELDS)
    items = explode_items(recs.select(rfq_id, seq, "supplier_name", "items"),
                          keys=(rfq_id, seq, "supplier_name"))
    return quotes, items


# Fixed value: characters of document text in one model prompt.
PROMPT_CHARS = 12000


def text_parts(text):
    """Consecutive parts of at most 12,000 characters; together the whole text."""
    t = F.col(text)
    n = F.greatest(F.lit(1), F.ceil(F.length(t) / PROMPT_CHARS).cast("int"))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(t, i * PROMPT_CHARS + 1, F.lit(PROMPT_CHARS)))


# Fixed text: note on a record that stands in for a failed model call.
MODEL_FAILED_NOTE = "The model call failed; extracted with local heuristics instead — spot-check before finalizing."

_ITEMS_TYPE = ("array<struct<item_name:string,quantity:double,unit:string,unit_price:double,"
               "total_price:double,portion:string,packaging:string>>")


def _stored_answers(parts: DataFrame, model_fn, store: str) -> DataFrame:
    """Answers of ``parts(doc_id, part_no, part)`` from the store; prompts it does not hold are sent first, each once."""
    import pandas as pd

    from .versions import Table, newest_by

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"prompt": b["prompt"], "model_output": model_fn(list(b["part"]))})

    table = Table(parts.sparkSession, store, "prompt")
    keyed = parts.withColumn("prompt", F.sha2(F.col("part").cast("binary"), 256))
    new, known = keyed.groupBy("prompt").agg(F.first("part").alias("part")), table.read()
    if known is not None:
        new = new.join(known.select("prompt"), "prompt", "left_anti")
    # failed calls are not stored, so they are sent again next time
    sent = new.mapInPandas(run, "prompt string, model_output string").filter("model_output IS NOT NULL")
    table.upsert(sent, newest_by("prompt"))
    known = table.read()
    if known is None:
        return keyed.select("doc_id", "part_no", F.lit(None).cast("string").alias("model_output"))
    return keyed.join(known, "prompt", "left").select("doc_id", "part_no", "model_output")


def extract_with_model(doc_text: DataFrame, model_fn, cells: DataFrame | None = None, store: str | None = None) -> DataFrame:
    """Plug point for a model-based extractor.

    ``model_fn(list[str]) -> list[str | None]`` turns a batch of prompts
    (consecutive parts of at most 12,000 characters, so the whole text is
    read) into JSON strings; it runs inside ``mapInPandas`` on the executors.
    The answers are written once under the shared folder, so each part is
    sent once however the result is used. A document's parts are merged:
    the first part that gives a header field wins, items follow in order.
    Output that is not a JSON object is kept in ``raw_output`` with a note;
    a document with a failed call (``None``) takes its heuristic record, and
    its note says so. With ``store``, a folder, answers are kept by digest of
    the prompt: a later run sends only prompts that have no answer yet.
    """
    import pandas as pd

    from ..session import scratch, ship_package

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "part_no": b["part_no"],
                                "model_output": model_fn(list(b["part"]))})

    spark = doc_text.sparkSession
    ship_package(spark)
    id_type = dict(doc_text.dtypes)["doc_id"]
    parts = doc_text.select("doc_id", F.coalesce("raw_text", F.lit("")).alias("raw_text")).select(
        "doc_id", F.posexplode(text_parts("raw_text")).alias("part_no", "part"))
    schema = f"doc_id {id_type}, part_no int, model_output string"
    if store:
        answers = _stored_answers(parts, model_fn, store)
    else:
        path = scratch(spark, "model_answers")
        parts.mapInPandas(run, schema).write.parquet(path)
        answers = spark.read.schema(schema).parquet(path)

    c = coerce_json(answers, "model_output")
    c = c.withColumn("delivery_lead_time_days", clean_number("delivery_lead_time_days").try_cast("int"))
    c = c.withColumn("items", F.transform("items", lambda x: F.struct(
        x["item_name"].alias("item_name"), clean_number(x["quantity"]).alias("quantity"),
        x["unit"].alias("unit"), clean_number(x["unit_price"]).alias("unit_price"),
        clean_number(x["total_price"]).alias("total_price"), x["portion"].alias("portion"),
        x["packaging"].alias("packaging"))).cast(_ITEMS_TYPE))

    def first(f):
        return F.min_by(f, F.when(F.col(f).isNotNull(), F.col("part_no"))).alias(f)

    def in_order(f):
        return F.transform(F.array_sort(F.collect_list(F.struct("part_no", f))), lambda s: s[f])

    merged = c.groupBy("doc_id").agg(
        F.max(F.col("model_output").isNull()).alias("_failed"), *[first(f) for f in HEADER_FIELDS], first("notes"),
        F.flatten(in_order("items")).alias("items"),
        F.when(F.count("raw_output") > 0, F.array_join(in_order("raw_output"), "\n")).alias("raw_output"))
    model = F.struct(*HEADER_FIELDS, "items", "notes", "raw_output")
    heuristic = extract_records(doc_text, cells).select("doc_id", F.struct(
        *HEADER_FIELDS, F.col("items").cast(_ITEMS_TYPE).alias("items"), F.lit(MODEL_FAILED_NOTE).alias("notes"),
        F.lit(None).cast("string").alias("raw_output")).alias("_heuristic"))
    rec = heuristic.join(merged.select("doc_id", F.when(~F.col("_failed"), model).alias("_model")), "doc_id", "left")
    best = F.coalesce("_model", "_heuristic")
    return rec.select("doc_id", *[best[f].alias(f) for f in [*HEADER_FIELDS, "items", "notes", "raw_output"]])
