"""Positions over all tasks, wide blocks, list segments, alias tables, stored answers."""
import random
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from bidscope.functions.aliases import HEADER_FIELD_ALIASES, match_alias_table, match_alias
from bidscope.operators import compare, gaps, recommend
from bidscope.operators.extract import extract_with_model
from bidscope.operators.hot_window import positions
from bidscope.sources import star_adapter as star

SF = "/root/testdata/sf0.001"
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def test_positions_split_hot_groups_and_equal_rows(spark):
    rows = [("hot", i % 700, "x") for i in range(2100)] + [("a", 5, "y"), ("a", None, "z"), (None, 1, "n"), (None, 0, "m")] + [("same", 1, "s")] * 300
    df = spark.createDataFrame(rows, "g string, v int, t string").repartition(6)
    got = [tuple(r) for r in positions(df, ["g"], [F.col("v").asc_nulls_last()]).collect()]
    assert sorted(map(str, (r[:3] for r in got))) == sorted(map(str, rows))
    for g in {r[0] for r in rows}:
        own = sorted((r for r in got if r[0] == g), key=lambda r: r[3])
        assert [r[3] for r in own] == list(range(len(own)))
        assert [r[1] for r in own] == sorted((r[1] for r in own), key=lambda v: (v is None, v or 0))
    assert positions(df.limit(0), ["g"], [F.col("v")]).count() == 0


@pytest.mark.parametrize("columns", [3, 100])
def test_price_blocks_hold_every_cell_of_the_long_matrix(spark, columns):
    items = compare.item_comparison(star.quote_items(spark, SF)).unionByName(
        spark.createDataFrame([("Brand#11", 1, 1, "own item", None, 1.0, "pcs", 2.0, 2.0, None, None)], star.quote_items(spark, SF).select(*compare.ITEM_COLUMNS).schema))
    catalogue = compare.supplier_catalogue(items, columns)
    names = {(r.rfq_id, r.block, r.position): r.supplier_name for r in catalogue.collect()}
    assert len(names) == items.filter("unit_price IS NOT NULL AND item_name IS NOT NULL").select("rfq_id", "supplier_name").distinct().count()
    wide = compare.price_blocks(items, catalogue, columns)
    assert len(wide.columns) == 3 + columns
    cells = {(r.rfq_id, r.item_name, names[r.rfq_id, r.block, i]): r[f"p{i}"] for r in wide.collect() for i in range(columns) if r[f"p{i}"] is not None}
    assert cells == {(r.rfq_id, r.item_name, r.supplier_name): r.unit_price for r in compare.price_matrix(items).collect()}


@pytest.mark.parametrize("n", [2, 1000])
def test_segments_make_up_the_lists(spark, n):
    parts = star.rfq_items(spark, SF), star.quotations(spark, SF), star.quote_items(spark, SF)
    seg = gaps.list_segments(gaps.gap_entries(*parts), n).collect()
    assert all(r.n_entries <= n for r in seg)
    joined = {}
    for r in sorted(seg, key=lambda r: r.segment):
        joined.setdefault((r.rfq_id, r.quote_seq, r.kind), []).append(r.text)
    for r in gaps.gap_analysis(star.rfqs(spark, SF), *parts).collect():
        for kind in ("missing_items", "items_missing_packaging", "items_missing_portion"):
            assert ", ".join(joined.get((r.rfq_id, r.quote_seq, kind), ["None"])) == r[kind]


def test_position_is_the_place_in_the_sorted_view(spark):
    df = spark.createDataFrame([("r", "b", 2.0), ("r", "a", 2.0), ("r", "c", None), ("r", "d", 1.0), ("q", "x", None)], "rfq_id string, supplier_name string, v double")
    want = {}
    for r in recommend.ordered(df, "v", "supplier_name").collect():
        want.setdefault(r.rfq_id, []).append(r.supplier_name)
    got = {(r.rfq_id, r.supplier_name): r.position for r in recommend.with_position(df, "v", "supplier_name").collect()}
    assert got == {(q, s): i + 1 for q, names in want.items() for i, s in enumerate(names)}


def test_alias_table_equals_the_fixed_map(spark):
    texts = [a + s for al in HEADER_FIELD_ALIASES.values() for a in al for s in ("", " x", "s", ":")] + ["", "zzz", None, " RFQ  No 7", "supplier name"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    table = spark.createDataFrame([(a, f, i) for i, (f, al) in enumerate(HEADER_FIELD_ALIASES.items()) for a in al], "alias string, field string, field_order int")
    for longest in (False, True):
        got = {r.i: r.f for r in match_alias_table(df, "t", "f", table, longest).collect()}
        assert got == {r.i: r.f for r in df.select("i", match_alias("t", HEADER_FIELD_ALIASES, longest).alias("f")).collect()}


def test_a_hundred_thousand_aliases(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randint(3, 14))) for _ in range(100_000)]
    table = spark.createDataFrame([(w, f"f{i % 997}", i % 997) for i, w in enumerate(words)], "alias string, field string, field_order int")
    texts = [rng.choice(words) + rng.choice(["", "a", "bcd", " x"]) for _ in range(300)]
    order = {}
    for i, w in enumerate(words):
        order[w] = min(order.get(w, 10**9), i % 997)

    def slow(t):
        if t in order:
            return f"f{order[t]}"
        met = [order[t[:n]] for n in range(len(t) + 1) if t[:n] in order]
        return f"f{min(met)}" if met else None
    got = match_alias_table(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string"), "t", "f", table).collect()
    assert {r.i: r.f for r in got} == {i: slow(t) for i, t in enumerate(texts)}


def test_stored_answers_are_not_asked_again(spark, tmp_path):
    log, store = tmp_path / "calls", str(tmp_path / "answers")

    def model(fail):
        def call(texts):
            with open(log, "a") as f:
                f.writelines(f"{t[:3]}\n" for t in texts)
            return [None if fail and t.startswith("bad") else f'{{"supplier_name": "{t[:3]}"}}' for t in texts]
        return call

    def calls():
        out = sorted(log.read_text().split()) if log.exists() else []
        log.unlink(missing_ok=True)
        return out

    docs = spark.createDataFrame([(1, "pdf", "abc quote"), (2, "pdf", "bad quote"), (3, "pdf", "abc quote"), (4, "pdf", "b" * 12000 + "tail")], "doc_id long, file_type string, raw_text string")
    first = {r.doc_id: r for r in extract_with_model(docs, model(True), store=store).collect()}
    assert calls() == ["abc", "bad", "bbb", "tai"]  # equal prompts once
    assert first[1].supplier_name == first[3].supplier_name == "abc" and first[2].notes.startswith("The model call failed")
    again = {r.doc_id: r for r in extract_with_model(docs, model(False), store=store).collect()}
    assert calls() == ["bad"] and again[2].supplier_name == "bad"
    extract_with_model(docs, model(False), store=store).collect()
    assert calls() == []
