"""Language identification by rank-order profiles.

A profile is the list of the most frequent character n-grams (one to three
letters, word boundaries included), most frequent first. A document's profile
is compared with each language's: an n-gram at place i here and place j there
costs ``|i - j|``, one that the language's profile lacks costs the profile
length. The language with the smallest sum, the out-of-place distance, is the
prediction. ``score`` says how far the next best language is away: (next -
best) / next, where a profile without a common n-gram stands in if only one
language was learned.

Language profiles come from all labelled rows, not a sample: tasks count
n-grams per language and hand on counts (flushed at a fixed number of distinct
n-grams, so a task's memory is bounded); a sum by (language, n-gram) and a
rank limit that Spark also applies before the shuffle leave the most frequent.
Profiles reach the tasks in blocks of at most ``LANGS_A_PASS`` languages
(under 1 MB); more languages mean more passes over the documents, each keeping
the nearest two so far, with the same result. Whole texts are read, in pieces.

Defined cases: texts are lower-cased; letters and marks make words, all else
is a boundary; ties between n-grams go to the smaller code points, ties
between languages to the smaller name. Null texts and texts without a letter
are ``und`` with score 0, as is everything if no language was learned. A null
id is not held out. Rows without a language or without letters teach nothing.
Repeated rows get a row each; an empty table gives an empty result; other
columns are not read.
"""
from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import drop, stored, with_columns

PROFILE = 300
LANGS_A_PASS = 256
UNKNOWN = "und"
_SPACE, _CODE_BITS = 32, 21  # three code points of 21 bits fit one 64-bit n-gram
_PIECE, _HELD = 1 << 20, 1 << 21  # symbols counted at once; distinct n-grams that a task holds
_TABLE: list[np.ndarray] = []


def _kinds() -> np.ndarray:
    """Per code point: 2 letter, 1 mark, 0 boundary (one table for the process)."""
    if not _TABLE:
        kind = {"L": 2, "M": 1}
        _TABLE.append(np.array([kind.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)], dtype=np.uint8))
    return _TABLE[0]


def symbols(text: str | None) -> np.ndarray:
    """Lower-cased letters and marks with single boundaries between, before and after words; empty without a letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    kind = _kinds()[codes]
    if not (kind == 2).any():
        return np.empty(0, dtype=np.uint64)
    seq = np.full(len(codes) + 2, _SPACE, dtype=np.uint64)
    seq[1:-1] = np.where(kind > 0, codes, _SPACE)
    edge = seq == _SPACE
    return seq[~(edge & np.append(False, edge[:-1]))]


def _piece_grams(seq: np.ndarray, first: bool) -> np.ndarray:
    """n-grams that end in ``seq`` (two symbols of the piece before lead it, unless it is the first)."""
    inner = seq != _SPACE
    pairs = seq[:-1] << np.uint64(_CODE_BITS) | seq[1:]
    triples = (pairs[:-1] << np.uint64(_CODE_BITS) | seq[2:])[inner[1:-1]]
    ones = seq[inner] if first else seq[2:][inner[2:]]
    return np.concatenate([ones, pairs if first else pairs[1:], triples])


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams ascending, counts) of a whole text."""
    seq = symbols(text)
    if not len(seq):
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    if len(seq) <= _PIECE:
        return np.unique(_piece_grams(seq, True), return_counts=True)
    parts = [np.unique(_piece_grams(seq[max(0, a - 2):a + _PIECE], a == 0), return_counts=True) for a in range(0, len(seq), _PIECE)]
    return _summed(parts)


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    grams, place = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    n = np.zeros(len(grams), dtype=np.int64)
    np.add.at(n, place, np.concatenate([c for _, c in parts]))
    return grams, n


def profile(grams: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams in order; equal counts by n-gram."""
    return grams[np.argsort(-counts, kind="stable")[:size]]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: dict[str, list] = {}
    n = 0

    def flushed():
        for lang, parts in held.items():
            g, c = _summed(parts)
            for a in range(0, len(g), 1 << 16):
                yield pd.DataFrame({"lang": lang, "gram": g[a:a + (1 << 16)].astype(np.int64), "n": c[a:a + (1 << 16)]})

    for b in batches:
        for lang, text in zip(b["lang"], b["text"]):
            g, c = gram_counts(text)
            if len(g):
                held.setdefault(lang, []).append((g, c))
                n += len(g)
            if n > _HELD:
                held = {k: [_summed(p)] for k, p in held.items()}
                n = sum(len(p[0][0]) for p in held.values())
                if n > _HELD // 2:
                    yield from flushed()
                    held, n = {}, 0
    yield from flushed()


def profiles(labelled: DataFrame, size: int = PROFILE) -> DataFrame:
    """``(lang, place, gram)`` of each language, from ``labelled(lang, text)``."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    counts = rows.mapInPandas(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram"))
    return counts.withColumn("place", place - 1).where(F.col("place") < size).select("lang", "place", "gram")


class Nearest:
    """Out-of-place distances to a block of language profiles."""

    def __init__(self, known: list[tuple[str, list[int]]], size: int):
        self.size = size
        self.langs = [lang for lang, _ in known]
        self.grams = np.unique(np.concatenate([np.array(g, dtype=np.uint64) for _, g in known]))
        self.places = np.full((len(self.grams), len(known)), -1, dtype=np.int32)
        for k, (_, g) in enumerate(known):
            self.places[np.searchsorted(self.grams, np.array(g, dtype=np.uint64)), k] = np.arange(len(g))

    def distances(self, own: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        there = self.grams[at] == own
        places = self.places[at[there]]
        out = np.where(places < 0, self.size, np.abs(places - np.flatnonzero(there)[:, None]))
        return out.sum(0) + self.size * int((~there).sum())


def _pass(rows: DataFrame, known: list[tuple[str, list[int]]], size: int, keep: list[str]) -> DataFrame:
    """Distances to one more block of languages; the nearest two stay."""
    def start():
        block = Nearest(known, size)

        def step(cols):
            out = {"lang_pred": [], "best": [], "next": []}
            for text, lang, best, after in zip(cols["text"], cols["lang_pred"], cols["best"], cols["next"]):
                own = profile(*gram_counts(text), size)
                if len(own):
                    if lang is None:  # a profile without a common n-gram
                        best = after = size * len(own)
                    for d, name in zip(block.distances(own).tolist(), block.langs):
                        if lang is None:
                            best, lang = d, name
                        elif d < best:
                            best, after, lang = d, best, name
                        elif d < after:
                            after = d
                for k, v in zip(out, (lang, best, after)):
                    out[k].append(v)
            return None, out
        step.reads = ("text",)
        return step
    return with_columns(rows, keep, "lang_pred string, best long, next long", start)


def identify(docs: DataFrame, known: DataFrame, *, size: int = PROFILE, a_pass: int = LANGS_A_PASS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row of ``docs``: the ``keep`` columns, ``lang_pred``, ``score`` and the out-of-place ``distance`` (null for ``und``).

    ``known`` are language profiles as ``profiles`` gives them.
    """
    none = F.lit(None)
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], "text", none.cast("string").alias("lang_pred"), none.cast("long").alias("best"), none.cast("long").alias("next"))
    table = stored(known, "lang-profiles")
    left = table.select("lang").distinct().count()
    blocks = _language_blocks(table, a_pass)
    held = None
    while left > 0:
        left -= a_pass
        rows = _pass(rows, next(blocks), size, [*keep, "text"] if left > 0 else list(keep))
        if left > 0:  # the next pass starts from a written table
            before, held = held, stored(rows, "lang-pass")
            rows = held
            if before is not None:
                drop(before)
    drop(table)
    score = F.when(F.col("next") > 0, (F.col("next") - F.col("best")) / F.col("next")).otherwise(0.0)
    return rows.select(*[F.col(f"`{c}`") for c in keep], F.coalesce("lang_pred", F.lit(UNKNOWN)).alias("lang_pred"),
                       F.when(F.col("lang_pred").isNull(), 0.0).otherwise(score).alias("score"), F.col("best").alias("distance"))


def _language_blocks(table: DataFrame, a_pass: int) -> Iterator[list[tuple[str, list[int]]]]:
    """Profiles of ``a_pass`` languages at a time, by name; only one block is held."""
    block: list[tuple[str, list[int]]] = []
    for r in table.orderBy("lang", "place").toLocalIterator():
        if not block or block[-1][0] != r["lang"]:
            if len(block) == a_pass:
                yield block
                block = []
            block.append((r["lang"], []))
        block[-1][1].append(r["gram"])
    yield block


def predictions(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, distance`` for ``docs(doc_id, lang, text)``, learned from the rows not held out."""
    known = profiles(docs.where(~held_out(F.col("doc_id"))).select("lang", "text"))
    out = identify(docs, known)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "distance")
