"""Steps whose memory must not grow with the input: no broadcast of rows that grow, bounded batches in Python."""
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from bidscope.operators import chunking, extract, gaps, recommend, retrieve
from bidscope.operators.hot_window import positions
from bidscope.plans import queries


def _ran(df) -> tuple[list, str]:
    """The rows, and the plan as it ran."""
    rows = df.collect()
    return rows, df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def cells(spark):
    rows = [("a", 0, 0, 1, "Item Name"), ("a", 0, 0, 2, "Qty"), ("a", 0, 0, 3, "Qty"),
            ("a", 0, 5, 1, "Bolt"), ("a", 0, 5, 2, "7"), ("a", 0, 5, 3, " "),
            ("b", 1, 0, 1, "Line"), ("b", 1, 0, 2, "Qty"), ("b", 1, 4, 1, "Nut"), ("b", 1, 4, 2, "3"),
            ("c", 9, 0, 1, "Field"), ("c", 9, 0, 2, "Value"), ("c", 9, 1, 1, "Supplier"), ("c", 9, 1, 2, "Maker")]
    return spark.createDataFrame(rows, "doc_id string, table_no int, row_no long, col_no int, value string")


def test_table_items_broadcast_nothing(cells):
    rows, plan = _ran(extract.table_items(cells))
    assert "Broadcast" not in plan
    assert [(r.doc_id, r.row_no, r.item_name, r.quantity) for r in rows] == [("a", 5, "Bolt", None)]


def test_lines_without_tables_broadcast_nothing(spark, cells):
    lines = spark.createDataFrame([("a", 1, "Bolt Qty 2 pcs Unit Price 3"), ("b", 1, "Nut Qty 2 pcs Unit Price 3")], "doc_id string, line_no long, line string")
    rows, plan = _ran(extract.lines_without_tables(extract.line_items(lines), extract.table_items(cells)))
    assert "Broadcast" not in plan
    assert [(r.doc_id, r.item_name, r.unit_price) for r in rows] == [("b", "Nut", 3.0)]


def test_extract_records_broadcast_nothing(spark, cells):
    docs = spark.createDataFrame([("a", "pdf", "Vendor: V"), ("b", "pdf", "Nut Qty 2 pcs Unit Price 3"), ("c", "excel", None)], "doc_id string, file_type string, raw_text string")
    rows, plan = _ran(extract.extract_records(docs, cells))
    assert "Broadcast" not in plan
    assert sorted((x.doc_id, x.supplier_name, len(x["items"])) for x in rows) == [("a", "V", 1), ("b", None, 1), ("c", "Maker", 0)]


def test_chunks_leave_in_bounded_batches():
    text = "word " * 20_000
    docs = pa.RecordBatch.from_pylist([{"doc_id": i, "raw_text": text, "source": "s", "file_type": "t", "supplier_name": None} for i in range(64)])
    seen = []
    for out in chunking._chunk_batches(800, 120)(iter([docs])):
        assert sum(map(len, out.column("text").to_pylist())) <= chunking.BATCH_CHARS + 800
        seen += list(zip(out.column("doc_id").to_pylist(), out.column("chunk_index").to_pylist(), out.column("start").to_pylist(), out.column("text").to_pylist()))
    want = [(at + 1, c) for at, c in chunking.recursive_spans(text)]
    assert seen == [(d, i, *w) for d in range(64) for i, w in enumerate(want)]


def test_spans_come_one_by_one():
    spans = chunking.iter_spans("x " * 1_000_000)
    tracemalloc.start()
    first = [next(spans) for _ in range(3)]
    used = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [len(c) for _, c in first] == [799, 799, 799] and used < 1_000_000


def test_vector_blocks_from_batches_of_any_size():
    rows = [{"a": i, "b": -i, "v": [float(i)] * (2 + i % 2)} for i in range(25)]
    batches = [pa.RecordBatch.from_pylist(rows[i:j]) for i, j in ((0, 3), (3, 20), (20, 25))]
    got, sizes = [], []
    for out in retrieve._to_blocks(["a", "b"], "v", 4)(iter(batches)):
        for ids, vectors, n in zip(*(out.column(c).to_pylist() for c in ("ids", "vectors", "n"))):
            sizes.append(n)
            got += zip(map(tuple, np.frombuffer(ids, "<i8").reshape(n, 2).tolist()), np.frombuffer(vectors, "<f8").reshape(n, -1).tolist())
    assert max(sizes) == 4 and sum(s < 4 for s in sizes) <= 2
    assert sorted(got) == sorted(((r["a"], r["b"]), r["v"]) for r in rows)
    with pytest.raises(ValueError):
        list(retrieve._to_blocks(["a"], "v", 4)(iter([pa.RecordBatch.from_pylist([{"a": None, "v": [1.0]}, {"a": 1, "v": [1.0]}])])))


@pytest.mark.parametrize("whole", [0, 3, 100])
def test_only_long_lists_are_placed_over_all_tasks(spark, monkeypatch, whole):
    rows = [("r", 1, "a", i % 3, f"e{i}") for i in range(8)] + [("r", 2, "a", 0, "x"), ("r", 2, "a", None, None), (None, 2, "b", 1, "y"), ("r", None, "b", 0, "z")] + [(None, 5, "b", i, "same") for i in range(6)]
    entries = spark.createDataFrame(rows, "rfq_id string, quote_seq long, kind string, place long, entry string")
    sent = []
    monkeypatch.setattr(gaps, "positions", lambda df, *a: sent.append(df.count()) or positions(df, *a))
    got = {(r.rfq_id, r.quote_seq, r.kind, r.segment): (r.n_entries, r.text) for r in gaps.list_segments(entries, 2, whole).collect()}
    assert sent == {0: [len(rows)], 3: [14], 100: []}[whole]
    want = {}
    for g in {r[:3] for r in rows}:
        own = sorted(((r[3] is not None, r[3], r[4]) for r in rows if r[:3] == g), key=lambda x: (x[0], x[1] or 0, x[2] or ""))
        for at in range(0, len(own), 2):
            want[(*g, at // 2)] = (len(own[at:at + 2]), ", ".join(x[2] for x in own[at:at + 2] if x[2] is not None))
    assert got == want


def test_views_store_no_list_texts(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, 1, 1, 1, 2.0, 10.0, 0.0, "N", "O"), (2, 2, 2, 1, 1.0, 9.0, 0.1, "R", "F"), (3, 1, 2, 7, 1.0, 5.0, 0.0, "N", "F")],
                          "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "p", "Brand#11", "T", 3), (2, "q", "Brand#11", "U", 4)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(1, "S1", 1), (2, "S2", 2)], "s_suppkey long, s_name string, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    stored = []
    monkeypatch.setattr(recommend, "positions", lambda df, *a: stored.append(set(df.columns)) or positions(df, *a))
    rows = queries.q_presentation_order(spark, str(tmp_path)).collect()
    assert all(c <= {"rfq_id", "supplier_name", "quote_seq", "total_quoted_cost", "gap_score", "composite_score"} for c in stored) and len(stored) == 3
    assert sorted((r.view, r.supplier_name, r.quote_seq, r.position) for r in rows) == [
        ("composite", "S1", None, 1), ("composite", "S2", None, 2), ("gap", "S1", 1, 2), ("gap", "S2", 2, 1), ("total", "S1", None, 1), ("total", "S2", None, 2)]
