"""Batch email drafts (gap follow-up and award) in English or Hindi, plus
UI label lookup. Drafts are never sent: every row carries
``status = 'draft_only'``.

Lists are passed as arrays (not re-split from joined text), so item names
containing commas stay whole.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import col_

# Own wording of the two drafts, per language (subject prefix is "RFQ <ref> - ").
TEXTS = {
    "en": {
        "gap_subject": "Please complete your quotation",
        "greeting": "Dear {},",
        "gap_intro": "Thank you for your quotation. Some information is still missing:",
        "missing_items": "- Items not quoted: ",
        "missing_fields": "- Details not provided: ",
        "deadline": "Please send the revised quotation by {}.",
        "signoff": "Regards,\nPurchasing Team",
        "award_subject": "Quotation selected",
        "award_body": ("We are glad to tell you that your quotation for RFQ {} has been selected. "
                       "Our team will send the purchase order and delivery schedule soon."),
    },
    "hi": {
        "gap_subject": "कृपया अपना कोटेशन पूरा करें",
        "greeting": "नमस्ते {},",
        "gap_intro": "आपके कोटेशन के लिए धन्यवाद। कुछ जानकारी अभी बाकी है:",
        "missing_items": "- जिन आइटम का मूल्य नहीं मिला: ",
        "missing_fields": "- जो विवरण नहीं मिले: ",
        "deadline": "कृपया संशोधित कोटेशन {} तक भेजें।",
        "signoff": "सादर,\nक्रय टीम",
        "award_subject": "कोटेशन चुना गया",
        "award_body": ("आपको बताते हुए खुशी है कि RFQ {} के लिए आपका कोटेशन चुना गया है। "
                       "हमारी टीम जल्द ही खरीद आदेश और डिलीवरी कार्यक्रम भेजेगी।"),
    },
}


def _t(lang: Column, key: str, *args: Column) -> Column:
    """Text for ``key`` in ``lang`` ('hi' -> Hindi, anything else English),
    with ``{}`` slots filled by columns."""
    def fill(tpl: str) -> Column:
        parts = tpl.split("{}")
        out = [F.lit(parts[0])]
        for a, p in zip(args, parts[1:]):
            out += [a, F.lit(p)]
        return F.concat(*out)
    return F.when(lang == "hi", fill(TEXTS["hi"][key])).otherwise(fill(TEXTS["en"][key]))


def _subject(lang: Column, ref: Column, key: str) -> Column:
    return F.concat(F.lit("RFQ "), F.coalesce(ref, F.lit("")), F.lit(" - "), _t(lang, key))


def gap_email(df: DataFrame, lang="lang", supplier="supplier_name", rfq_ref="rfq_ref",
              items="missing_item_list", fields="missing_field_list",
              deadline="deadline_date") -> DataFrame:
    """Adds ``subject, body, status`` to rows that carry the supplier,
    RFQ reference, missing item / field arrays and the RFQ deadline."""
    lg, it, fl, dl = col_(lang), col_(items), col_(fields), col_(deadline)
    nonempty = lambda a: a.isNotNull() & (F.size(a) > 0)
    body = F.concat_ws(
        "",
        _t(lg, "greeting", col_(supplier)), F.lit("\n\n"), _t(lg, "gap_intro"), F.lit("\n"),
        F.when(nonempty(it), F.concat(_t(lg, "missing_items"), F.array_join(it, ", "), F.lit("\n"))),
        F.when(nonempty(fl), F.concat(_t(lg, "missing_fields"), F.array_join(fl, ", "), F.lit("\n"))),
        F.when(dl.isNotNull() & (dl != ""), F.concat(F.lit("\n"), _t(lg, "deadline", dl), F.lit("\n"))),
        F.lit("\n"), _t(lg, "signoff"))
    return df.withColumns({"subject": _subject(lg, col_(rfq_ref), "gap_subject"),
                           "body": body, "status": F.lit("draft_only")})


def award_email(df: DataFrame, lang="lang", supplier="supplier_name",
                rfq_ref="rfq_ref") -> DataFrame:
    lg, ref = col_(lang), col_(rfq_ref)
    body = F.concat(_t(lg, "greeting", col_(supplier)), F.lit("\n\n"),
                    _t(lg, "award_body", F.coalesce(ref, F.lit(""))), F.lit("\n\n"),
                    _t(lg, "signoff"))
    return df.withColumns({"subject": _subject(lg, ref, "award_subject"),
                           "body": body, "status": F.lit("draft_only")})


# Dashboard labels per language (unknown language -> English,
# unknown key -> the key itself).
UI_LABELS = {
    "en": {
        "app_title": "Supplier Quotation Management",
        "app_subtitle": "Upload RFQs and supplier quotations (Excel / PDF / Word) to compare, analyze, and decide.",
        "upload_rfq": "1. Upload the RFQ (what you asked for)",
        "upload_quotes": "2. Upload supplier quotations (responses)",
        "process_button": "Process documents",
        "cost_comparison": "Cost Comparison",
        "item_wise": "Item-wise price comparison",
        "total_cost": "Total quoted cost per supplier",
        "cheapest_per_item": "Cheapest supplier per item",
        "investment": "Investment / Cash Outlay",
        "gap_analysis": "Gap Analysis",
        "query_bot": "Ask a question",
        "query_placeholder": "e.g. Which supplier offers the earliest delivery for packaging material?",
        "send_email": "Send / Draft Email",
        "language": "Language",
        "no_data": "No documents processed yet. Upload files above to get started.",
        "final_recommendation": "Final Recommendation",
    },
    "hi": {
        "app_title": "आपूर्तिकर्ता कोटेशन प्रबंधन",
        "app_subtitle": "तुलना, विश्लेषण और निर्णय के लिए RFQ और आपूर्तिकर्ता कोटेशन (Excel / PDF / Word) अपलोड करें।",
        "upload_rfq": "1. RFQ अपलोड करें (आपने क्या माँगा था)",
        "upload_quotes": "2. आपूर्तिकर्ता कोटेशन अपलोड करें (प्रतिक्रियाएँ)",
        "process_button": "दस्तावेज़ प्रोसेस करें",
        "cost_comparison": "लागत तुलना",
        "item_wise": "आइटम-वार मूल्य तुलना",
        "total_cost": "प्रति आपूर्तिकर्ता कुल कोटेड लागत",
        "cheapest_per_item": "प्रत्येक आइटम के लिए सबसे सस्ता आपूर्तिकर्ता",
        "investment": "निवेश / नकद व्यय",
        "gap_analysis": "गैप विश्लेषण",
        "query_bot": "प्रश्न पूछें",
        "query_placeholder": "जैसे: पैकेजिंग सामग्री की सबसे जल्दी डिलीवरी कौन सा आपूर्तिकर्ता देता है?",
        "send_email": "ईमेल भेजें / ड्राफ्ट करें",
        "language": "भाषा",
        "no_data": "अभी तक कोई दस्तावेज़ प्रोसेस नहीं हुआ। शुरू करने के लिए ऊपर फ़ाइलें अपलोड करें।",
        "final_recommendation": "अंतिम सिफारिश",
    },
}
UI_KEYS = list(UI_LABELS["en"])


def labels_table(spark: SparkSession) -> DataFrame:
    rows = [(lang, k, txt) for lang, m in UI_LABELS.items() for k, txt in m.items()]
    return spark.createDataFrame(rows, "lang string, key string, text string")


def localize(df: DataFrame, key="key", lang="lang") -> DataFrame:
    """Adds ``text``: the label of ``key`` in ``lang``. The label table is a
    fixed 34-row constant, so it is broadcast by construction."""
    lbl = F.broadcast(labels_table(df.sparkSession)).select(
        F.col("lang").alias("_l"), F.col("key").alias("_k"), F.col("text").alias("_txt"))
    eff = F.when(col_(lang).isin(*UI_LABELS), col_(lang)).otherwise(F.lit("en"))
    j = df.withColumn("_eff", eff).join(
        lbl, (F.col("_eff") == F.col("_l")) & (col_(key) == F.col("_k")), "left")
    return j.withColumn("text", F.coalesce("_txt", col_(key))).drop("_eff", "_l", "_k", "_txt")
