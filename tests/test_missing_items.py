"""Output-sensitive missing items equal a brute-force set difference, across
many key blocks, with a hot RFQ, blank names and duplicate lines."""
import random


from bidscope.operators import gaps


def _fixture(spark):
    rnd = random.Random(11)
    rfq_items, quotes, lines = [], [], []
    sizes = {"hot": 300, "r1": 7, "r2": 1, "empty": 0}
    for r, n in sizes.items():
        for i in range(n):
            name = f"  Item {i}  " if i % 5 == 0 else f"item {i}"
            rfq_items.append((r, i, name))
        if n:
            rfq_items.append((r, n, "   "))          # whitespace-only name: key ''
            rfq_items.append((r, n + 1, ""))         # empty name: ignored
    seq = 0
    for r, n in list(sizes.items()) + [("no_rfq", 0)]:
        for _ in range(12 if r == "hot" else 3):
            seq += 1
            quotes.append((r, seq, f"s{seq}"))
            pick = [i for i in range(max(n, 1) + 3) if rnd.random() < 0.6]
            for pos, i in enumerate(pick):
                lines.append((r, seq, pos, f"ITEM {i}" if i % 7 == 0 else f"item {i}"))
                if i % 4 == 0:
                    lines.append((r, seq, 1000 + pos, f"item {i}"))   # duplicate line
    ri = spark.createDataFrame(rfq_items, "rfq_id string, item_pos int, item_name string")
    qs = spark.createDataFrame(quotes, "rfq_id string, quote_seq int, supplier_name string")
    qi = spark.createDataFrame(lines, "rfq_id string, quote_seq int, item_pos int, item_name string")
    return rfq_items, quotes, lines, ri, qs, qi


def _brute(rfq_items, quotes, lines):
    req = {}
    for r, _, name in rfq_items:
        if name:                                   # truthy raw name, then the key
            req.setdefault(r, set()).add(name.strip().lower())
    got = {}
    for r, s, _, name in lines:
        got.setdefault((r, s), set()).add(name.strip().lower())
    return {(r, s): sorted(req.get(r, set()) - got.get((r, s), set())) for r, s, _ in quotes}


def test_missing_items_blocks_equal_brute_force(spark):
    rfq_items, quotes, lines, ri, qs, qi = _fixture(spark)
    want = _brute(rfq_items, quotes, lines)
    for block in (1, 4, 64, 4096):
        long = gaps.missing_items(ri, qs, qi, block=block)
        got = {}
        for row in long.collect():
            got.setdefault((row.rfq_id, row.quote_seq), []).append(row.item_key)
        assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}
        lists = {(r.rfq_id, r.quote_seq): r.missing_item_list
                 for r in gaps.missing_item_lists(ri, qs, qi, block=block).collect()}
        assert lists == want
    counts = {(r.rfq_id, r.quote_seq): r.n_missing
              for r in gaps.missing_item_counts(ri, qs, qi).collect()}
    assert counts == {k: len(v) for k, v in want.items()}
