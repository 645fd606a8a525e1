"""Spelling variants of a vocabulary by Bloom-guided neighbourhoods.

Two words are near if they differ by one inserted, deleted or replaced code
point. Each word generates its deletions, and its replacements by a greater
letter of the vocabulary's alphabet, so every near pair is generated once: by
its longer word, or by the one with the smaller letter. The edits, far too
many to shuffle, are probed against blocked Bloom filters of the vocabulary,
one for each word length, broadcast to the tasks. Only positives are shuffled,
to an exact join with the vocabulary that removes the false ones. A word's
form is its most frequent near word, if that is frequent enough beside it, and
forms are followed to the last one by pointer jumping.

Scale: words are counted where they are read (partial aggregates), so a word
with a third of all occurrences is one row a task. A filter block of 256 bits
serves 16 words; blocks are filled by an aggregate (bitwise or). A positive is
shuffled as its hash, place and letter, however long the word. The blocks of
all lengths stand in one row, and a pass over the vocabulary broadcasts at
most ``BLOCKS_A_PASS`` of them (32 MB): a larger vocabulary takes more passes,
with the same result and the same memory. Hashes of all edits of a word follow
from its own by one multiplication each, in numpy. A word has at most
(alphabet + 1) x length near words, whatever the vocabulary's size.

Defined cases: null texts hold no runs; a null id is written as nothing in the
key that picks deleted letters; repeated rows count like any others; letters
outside A-Z keep their case; words of any length take part (from ``LONG`` code
points on they share a filter); ties of largest n go to the smallest word in
code-point order; an empty table gives an empty result; other columns are not
read.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import again, drop, stored

_AZ = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_APART = r"[^A-Za-zÀ-ÿ]+"
MIN_LENGTH, MIN_COUNT, RATIO, LETTER_LOST = 6, 5, 5, 199
LONG = 64
WORDS_A_BLOCK, BLOCKS_A_PASS = 16, 1 << 20
WORDS_A_TASK = 8192
_CELLS = 1 << 19  # edits made at once
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def lossy_words(docs: DataFrame, one_in: int = LETTER_LOST) -> DataFrame:
    """``(word)`` of the texts of ``docs(doc_id, text)``; of about one in ``one_in`` different words of a document a letter is lost."""
    prefix = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"))
    runs = docs.select(prefix.alias("prefix"), F.explode(F.split(F.translate("text", *_AZ), _APART)).alias("w")).where(F.length("w") >= MIN_LENGTH)
    hashed_runs = runs.select("w", F.crc32(F.concat("prefix", "w").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("w")).cast("int")
    less = F.concat(F.substring("w", F.lit(1), at), F.substring(F.col("w"), at + 2, F.length("w")))
    return hashed_runs.select(F.when(F.col("h") % one_in == 0, less).otherwise(F.col("w")).alias("word"))


def vocabulary(words: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """``(word, n)`` of ``words(word)`` that are long and frequent enough."""
    return words.where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64 bits (two rounds of xor-shift and multiply)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _codes(words: list[str]) -> np.ndarray:
    """Words of one length as rows of code points."""
    return np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").reshape(len(words), -1).astype(np.uint64)


def _groups(words: list[str], cells: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, codes) of words of one length, about ``cells`` letters at a time."""
    size = np.array([len(w) for w in words], dtype=np.int64)
    for n in np.unique(size):
        own = np.flatnonzero(size == n)
        step = max(1, cells // int(n))
        for a in range(0, len(own), step):
            some = own[a:a + step]
            yield some, _codes([words[i] for i in some])


class Blocks:
    """The filters' blocks: those of each length stand together, in order of length."""

    def __init__(self, words_of_length: dict[int, int]):
        self.n = np.zeros(LONG + 1, dtype=np.uint64)
        for length, count in words_of_length.items():
            self.n[length] = -(-count // WORDS_A_BLOCK)
        self.first = np.concatenate([[0], np.cumsum(self.n)[:-1]]).astype(np.uint64)
        self.total = int(self.n.sum())

    def of(self, k: int | np.ndarray, h: np.ndarray) -> np.ndarray:
        """Block of each scrambled hash of a word of length ``k`` (at most ``LONG``)."""
        return self.first[k] + ((h >> np.uint64(32)) * self.n[k] >> np.uint64(32))


def _bits(h: np.ndarray, j: int) -> np.ndarray:
    """Place of a word's bit in the block's j-th 32-bit word."""
    if j == 0:
        return (h & np.uint64(31)).astype(np.uint32)
    return (_mixed(h ^ _BASE) >> np.uint64(5 * j) & np.uint64(31)).astype(np.uint32)


def hashed(vocab: DataFrame) -> DataFrame:
    """``vocab`` with the scrambled hash ``h`` of each word."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            words = b["word"].tolist()
            h = np.zeros(len(words), dtype=np.uint64)
            for own, codes in _groups(words, _CELLS):
                h[own] = _mixed((codes * _powers(codes.shape[1])).sum(1, dtype=np.uint64))
            yield pd.DataFrame({"h": h.view(np.int64), "word": b["word"], "n": b["n"]})

    return vocab.mapInPandas(run, "h long, word string, n long")


def filter_blocks(keyed: DataFrame, blocks: Blocks) -> DataFrame:
    """``(block, b0..b3)``: the bits of each block's words, joined by bitwise or."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            h, length = b["h"].to_numpy().view(np.uint64), b["length"].to_numpy()
            bits = np.zeros((len(h), 8), dtype=np.uint32)
            for j in range(8):
                bits[:, j] = np.uint32(1) << _bits(h, j)
            longs, at = bits.view("<i8"), blocks.of(np.minimum(length, LONG), h)
            yield pd.DataFrame({"block": at.astype(np.int64), **{f"b{j}": longs[:, j] for j in range(4)}})

    rows = keyed.select("h", F.length("word").alias("length")).mapInPandas(run, "block long, b0 long, b1 long, b2 long, b3 long")
    return rows.groupBy("block").agg(*[F.bit_or(f"b{j}").alias(f"b{j}") for j in range(4)])


class Probe:
    """A pass's share of the filters: blocks ``low`` to ``high``."""

    def __init__(self, blocks: Blocks, low: int, high: int, bits: np.ndarray):
        self.blocks, self.low, self.high, self.bits = blocks, low, high, bits

    def hits(self, length: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the hashes that may be of words of this length, and these scrambled."""
        k = min(length, LONG)
        first, n = int(self.blocks.first[k]), int(self.blocks.n[k])
        if not n or first + n <= self.low or first >= self.high:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
        h = _mixed(hashes)
        at = self.blocks.of(k, h).astype(np.int64)
        left = np.flatnonzero((at >= self.low) & (at < self.high))
        for j in range(8):
            left = left[self.bits[at[left] - self.low, j] >> _bits(h[left], j) & np.uint32(1) == 1]
        return left, h[left]


def neighbours(words: list[str], alphabet: np.ndarray, probe: Probe) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``(own, at, letter, edit)`` of all edits that the filters may hold: the word's place, that of the
    code point deleted (letter 0) or replaced (by the alphabet's letter, from 1), and the edit's scrambled hash."""
    for own, codes in _groups(words, _CELLS // max(1, len(alphabet))):
        length = codes.shape[1]
        powers = _powers(length)
        terms = codes * powers
        whole = terms.sum(1, dtype=np.uint64)
        before = np.cumsum(terms, axis=1, dtype=np.uint64)
        deleted = before - terms + (whole[:, None] - before) * _BACK
        # of equal letters side by side only the last is deleted: the others give the same word
        apart = np.ones(codes.shape, dtype=bool)
        apart[:, :-1] = codes[:, :-1] != codes[:, 1:]
        r, c = np.nonzero(apart)
        k, h = probe.hits(length - 1, deleted[r, c])
        yield own[r[k]], c[k], np.zeros(len(k), dtype=np.int64), h
        step = max(1, _CELLS // codes.size)  # a very long word takes some letters at a time
        for a in range(0, len(alphabet), step):
            letters = alphabet[a:a + step]
            r, c, x = np.nonzero(codes[:, :, None] < letters)
            k, h = probe.hits(length, whole[r] + (letters[x] - codes[r, c]) * powers[c])
            yield own[r[k]], c[k], x[k] + a + 1, h


def edited(word: Column, at: Column, letter: Column, alphabet: np.ndarray) -> Column:
    """The word with a code point deleted (letter 0) or replaced."""
    letters = F.array(*[F.lit(chr(x)) for x in [0, *alphabet.tolist()]])
    return F.concat(F.substring(word, F.lit(1), at), F.when(letter > 0, F.get(letters, letter)).otherwise(""), F.substring(word, at + 2, F.length(word)))


def _joined(batches: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """Batches put together to about ``rows`` rows."""
    held: list[pd.DataFrame] = []
    for b in batches:
        held.append(b)
        if sum(map(len, held)) >= rows:
            yield pd.concat(held, ignore_index=True)
            held = []
    if held:
        yield pd.concat(held, ignore_index=True)


def near_pairs(vocab: DataFrame, *, blocks_a_pass: int = BLOCKS_A_PASS) -> DataFrame:
    """``(word, n, other, other_n)``: each pair of near words of ``vocab(word, n)``, a stored table, once."""
    spark = vocab.sparkSession
    counts = {r["k"]: r["c"] for r in vocab.groupBy(F.least(F.length("word"), F.lit(LONG)).alias("k")).agg(F.count("*").alias("c")).collect()}
    letters = vocab.select(F.explode(F.array_distinct(F.split("word", ""))).alias("x")).where("x <> ''").distinct().collect()
    alphabet = np.array(sorted(ord(r["x"]) for r in letters), dtype=np.uint64)
    blocks = Blocks(counts)
    tasks = max(1, -(-sum(counts.values()) // WORDS_A_TASK))
    keyed = stored(hashed(vocab).repartition(tasks, "h"), "spelling-keys")
    filters = stored(filter_blocks(keyed, blocks), "spelling-filters")
    dealt = again(keyed).select("h", "word").repartition(tasks, "h")
    found = []
    for low in range(0, blocks.total, blocks_a_pass):
        high = min(low + blocks_a_pass, blocks.total)
        rows = filters.where(F.col("block").between(low, high - 1)).toArrow()
        bits = np.zeros((high - low, 4), dtype="<i8")
        bits[rows.column("block").to_numpy() - low] = np.stack([rows.column(f"b{j}").to_numpy() for j in range(4)], axis=1)
        share = spark.sparkContext.broadcast(bits.tobytes())

        def run(batches: Iterator[pd.DataFrame], share=share, low=low, high=high) -> Iterator[pd.DataFrame]:
            probe = Probe(blocks, low, high, np.frombuffer(share.value, dtype="<u4").reshape(-1, 8))
            for b in _joined(batches, WORDS_A_TASK):
                h = b["h"].to_numpy()
                for own, at, letter, edit in neighbours(b["word"].tolist(), alphabet, probe):
                    yield pd.DataFrame({"h": h[own], "at": at, "letter": letter.astype(np.int32), "edit": edit.view(np.int64)})

        found.append(stored(dealt.mapInPandas(run, "h long, at int, letter int, edit long"), "spelling-edits"))
        share.destroy()
    drop(filters)
    if not found:
        return stored(keyed.select("word", "n", F.lit("").alias("other"), F.lit(0).cast("long").alias("other_n")), "spelling-pairs")
    edits = found[0]
    for more in found[1:]:
        edits = edits.unionByName(more)
    # positives without a word of their hash go; then the word itself decides, so equal hashes of different words do no harm
    known = again(keyed).select(F.col("h").alias("edit"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    pairs = edits.join(known, "edit").join(again(keyed), "h").where(F.col("other") == edited(F.col("word"), F.col("at"), F.col("letter"), alphabet))
    out = stored(pairs.select("word", "n", "other", "other_n"), "spelling-pairs")
    drop(keyed, *found)
    return out


def roots(forms: DataFrame, longest: int) -> DataFrame:
    """``(word, root)``: the last of the forms that follow from each word of ``forms(word, form)``, over at most ``longest`` of them."""
    now = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    for _ in range(math.ceil(math.log2(max(longest, 1)))):
        step = again(now).select(F.col("word").alias("root"), F.col("root").alias("further"))
        before, now = now, stored(again(now).join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "spelling-roots")
        drop(before)
    return now


def variants(vocab: DataFrame, *, ratio: int = RATIO) -> DataFrame:
    """Per word of ``vocab(word, n)``: ``word, form, root, n, n_near, form_n``."""
    words = stored(vocab, "spelling-words")
    pairs = near_pairs(words)
    both = pairs.unionByName(again(pairs).select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    rows = words.join(near, "word", "left")
    enough = -F.col("best.less") >= ratio * F.col("n")
    rows = stored(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                              F.when(enough, F.col("best.other")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")), "spelling-forms")
    drop(pairs)
    most = rows.agg(F.max("n")).first()[0] or 1
    # n grows by the ratio at each form, from 1 at least
    longest = 1
    while ratio ** (longest + 1) <= most:
        longest += 1
    last = roots(again(rows).where("form IS NOT NULL"), longest)
    return again(rows).join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """``variants`` of the words of ``docs(doc_id, text)``, of which some lose a letter."""
    return variants(vocabulary(lossy_words(docs)))
