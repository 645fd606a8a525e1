"""Benchmark decontamination with Aho-Corasick automata over words.

Benchmark items are cut into windows of ``window`` consecutive normalised
words (an item with fewer words is one window). The windows of a block of
items form one automaton over word numbers, and every document's word
sequence is scanned once per block. A document word inside any occurrence of
a window is hit; the hit runs are mapped back to offsets in the original text.

The items are a stated query set. One block holds items of at most
``block_bytes`` of text, so what is broadcast and the automaton are bounded.
Larger sets take several blocks whose runs are merged per document, with the
same rows as from one block.

Defined cases: null text or a text without words has no words and no hits;
items without words have no window; a null ``item_id`` marks hits but is no
item; repeated document rows give a row each; empty tables give no hits.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import with_columns

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Lower-cases A-Z and turns every byte outside of words into a space.
_NORMAL = bytes(b if WORD.fullmatch(bytes([b])) else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_SCAN = "n_words long, runs array<struct<first:long,last:long>>, spans array<struct<start:long,end:long>>, items array<string>"


def words(text: str | None) -> list[bytes]:
    """Normalised words of a text (UTF-8 bytes)."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_NORMAL).split()


def item_windows(item_words: list[bytes], window: int) -> list[tuple[bytes, ...]]:
    if not item_words:
        return []
    return [tuple(item_words[i:i + window]) for i in range(max(1, len(item_words) - window + 1))]


class Automaton:
    """Aho-Corasick automaton over word numbers; 0 is any word outside the items."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        import ahocorasick

        self.vocabulary: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            for w in item_windows(words(text), window):
                key = tuple(self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in w)
                owners.setdefault(key, set()).update([] if item is None else [item])
        self.trie = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, own in owners.items():
            self.trie.add_word(key, (len(key), sorted(own)))
        if owners:
            self.trie.make_automaton()
        self.empty = not owners

    def scan(self, doc_words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged runs of hit words [first, last] and the items that occur."""
        runs: list[list[int]] = []
        items: set[str] = set()
        if self.empty or not doc_words:
            return [], items
        number = self.vocabulary.get
        found = [(end - n + 1, end, own) for end, (n, own) in self.trie.iter(tuple([number(w, 0) for w in doc_words]))]
        for first, last, own in sorted(found, key=lambda x: x[:2]):
            items.update(own)
            if runs and first <= runs[-1][1] + 1:
                runs[-1][1] = max(runs[-1][1], last)
            else:
                runs.append([first, last])
        return [(a, b) for a, b in runs], items


def spans_of(text: str, runs: list[tuple[int, int]]) -> list[dict]:
    """Code point offsets [start, end) of runs of words in the original text."""
    if not runs:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in WORD.finditer(raw.translate(_NORMAL))]
    points = lambda b: len(raw[:b].decode("utf-8", "surrogatepass"))
    return [{"start": points(at[a][0]), "end": points(at[b][1])} for a, b in runs]


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple[str | None, str | None]]]:
    """The query set in blocks of at most ``block_bytes`` (or one item), read one after the other; at least one block."""
    block, size = [], 0
    for row in items.toLocalIterator():
        n = len((row["t"] or "").encode("utf-8", "surrogatepass"))
        if block and size + n > block_bytes:
            yield block
            block, size = [], 0
        block.append((row["i"], row["t"]))
        size += n
    yield block


def contamination(docs: DataFrame, bench: DataFrame, *, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", window: int = 10,
                  block_bytes: int = 1 << 20) -> DataFrame:
    """Per document row: ``doc_id, n_words, runs, spans, items`` (items sorted as strings)."""
    spark = docs.sparkSession
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    items = bench.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t"))
    # once broadcast, a block leaves the driver's Python
    shared = [spark.sparkContext.broadcast(block) for block in _blocks(items, block_bytes)]
    keep = ["doc_id"]
    if len(shared) > 1:
        source, keep = source.withColumn("sha", F.sha2(F.coalesce("text", F.lit("")), 256)), ["doc_id", "sha"]
    parts = [with_columns(source, keep, _SCAN, lambda own=own: _scan(Automaton(own.value, window))) for own in shared]
    return parts[0] if len(parts) == 1 else _merged(parts)


def without_contaminated(docs: DataFrame, bench: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text",
                         window: int = 10, block_bytes: int = 1 << 20) -> DataFrame:
    """``docs`` without the rows that hold a window of any item; all columns stay, and no row is shuffled."""
    spark, columns = docs.sparkSession, docs.columns
    flag = "hit" + "_" * max(len(c) for c in columns)
    for block in _blocks(bench.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")), block_bytes):
        shared = spark.sparkContext.broadcast(block)

        def start(shared=shared):
            automaton = Automaton(shared.value, window)

            def step(c):
                return None, {flag: [bool(automaton.scan(words(t))[0]) for t in c[text]]}
            step.reads = (text,)
            return step

        docs = with_columns(docs, columns, f"`{flag}` boolean", start).where(~F.col(flag)).select(*[F.col(f"`{c}`") for c in columns])
    return docs


def _scan(automaton: Automaton):
    def step(c):
        out: dict[str, list] = {k: [] for k in ("n_words", "runs", "spans", "items")}
        for t in c["text"]:
            w = words(t)
            runs, own = automaton.scan(w)
            out["n_words"].append(len(w))
            out["runs"].append([{"first": x, "last": y} for x, y in runs])
            out["spans"].append(spans_of(t, runs) if runs else [])
            out["items"].append(sorted(own))
        return None, out
    return step


def _merged(parts: list[DataFrame]) -> DataFrame:
    """One row per document row from the rows of its blocks (equal rows are counted, merged once and repeated)."""
    n = len(parts)
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    own = F.transform(F.arrays_zip("runs", "spans"), lambda z: F.struct(z["runs"]["first"].alias("first"), z["runs"]["last"].alias("last"), z["spans"]["start"].alias("start"), z["spans"]["end"].alias("end")))
    g = every.groupBy("doc_id", "sha", "n_words").agg(
        F.array_sort(F.flatten(F.collect_set(own))).alias("found"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), (F.count("*") / n).cast("int").alias("copies"))
    g = g.withColumn("found", _joined("found")).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    pick = lambda *names: F.transform("found", lambda r: F.struct(*[r[x].alias(x) for x in names]))
    return g.select("doc_id", "n_words", pick("first", "last").alias("runs"), pick("start", "end").alias("spans"), "items")


def _joined(found: str) -> Column:
    """Sorted runs with their spans; runs that meet or touch are one, and so are their spans."""
    empty = F.slice(found, 1, 0)

    def add(done: Column, r: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.struct(last["first"].alias("first"), F.greatest(last["last"], r["last"]).alias("last"), last["start"].alias("start"), F.greatest(last["end"], r["end"]).alias("end"))
        apart = (F.size(done) == 0) | (r["first"] > F.get(done, F.size(done) - 1)["last"] + 1)
        return F.when(apart, F.concat(done, F.array(r))).otherwise(F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(longer)))
    return F.aggregate(found, empty, add)


def digest(scanned: DataFrame) -> DataFrame:
    """The columns of the op7 contract from an operator result."""
    hit = F.aggregate("runs", F.lit(0).cast("long"), lambda s, r: s + r["last"] - r["first"] + 1)
    return scanned.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"), "spans")
