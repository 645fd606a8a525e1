"""Model plug point: JSON answers, non-JSON answers and failed calls."""
import sys

from pyspark import cloudpickle

from bidscope.operators.extract import extract_with_model
from bidscope.operators.retrieve import qa_context

# the fake model is shipped to the Python workers by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def fake_model(texts):
    out = []
    for t in texts:
        if "alpha" in t:
            out.append('{"supplier_name": "Alpha Ltd", "delivery_lead_time_days": "18.5", '
                       '"items": [{"item_name": "Bolt", "quantity": 4, "unit_price": "Rs. 1,200"}]}')
        elif "beta" in t:
            out.append("sorry, no json")
        else:
            out.append(None)
    return out


def test_extract_with_model(spark):
    docs = spark.createDataFrame([(1, "pdf", "alpha quote"), (2, "pdf", "beta quote"),
                                  (3, "docx", "Supplier: Gamma Co\nWarranty: 1 year")],
                                 "doc_id long, file_type string, raw_text string")
    r = {x.doc_id: x for x in extract_with_model(docs, fake_model).collect()}
    assert r[1].supplier_name == "Alpha Ltd" and r[1].delivery_lead_time_days == 18
    assert r[1]["items"][0].unit_price == 1200.0 and r[1]["items"][0].quantity == 4.0
    assert r[2].supplier_name is None and r[2].raw_output == "sorry, no json"
    assert r[2].notes.startswith("LLM returned non-JSON")
    assert r[3].supplier_name == "Gamma Co" and r[3].warranty == "1 year"


def test_each_part_is_sent_once_and_parts_are_merged(spark, tmp_path):
    log = str(tmp_path / "calls")

    def model(texts):
        with open(log, "a") as f:
            f.writelines(f"{len(t)}\n" for t in texts)
        return [f'{{"supplier_name": {"null" if "x" in t else chr(34) + t[:3] + chr(34)}, "items": [{{"item_name": "{t[:1]}"}}]}}' for t in texts]

    docs = spark.createDataFrame([(1, "pdf", "x" * 12000 + "abc" + "y" * 11997 + "z"), (2, "pdf", "def"), (3, "pdf", None), (4, "pdf", "ghi")],
                                 "doc_id long, file_type string, raw_text string")
    out = extract_with_model(docs, model)
    r = {x.doc_id: x for x in out.collect()}
    assert out.count() == 4
    assert sorted(open(log).read().split()) == sorted(["12000", "12000", "1", "3", "0", "3"])
    assert r[1].supplier_name == "abc" and [i.item_name for i in r[1]["items"]] == ["x", "a", "z"]


def test_failed_call_is_noted(spark):
    docs = spark.createDataFrame([(1, "pdf", "Supplier: Gamma Co")], "doc_id long, file_type string, raw_text string")
    r = extract_with_model(docs, fake_model).collect()[0]
    assert r.supplier_name == "Gamma Co" and r.notes.startswith("The model call failed")


def test_qa_context(spark):
    hits = spark.createDataFrame([(1, 2, "two", None, "b.pdf"), (1, 1, "one", "Acme", None)],
                                 "query_id long, rank int, text string, supplier_name string, source string")
    assert qa_context(hits).collect()[0].context == "[Acme]\none\n\n[b.pdf]\ntwo"
