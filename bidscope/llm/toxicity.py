"""Toxicity by noisy-channel deobfuscation and a word model.

1. A character trigram model is counted over all texts (bytes of lower-cased
   letters, others are one boundary symbol); counts are summed per task, then
   over the corpus. Its table has a fixed size.
2. Tokens that look obfuscated (signs or digits in a word or at its ends,
   letters set apart, a letter twice or more in a row) become a lattice: each sign
   may stand for letters, separators may go or part two words, repeats may
   shrink. A Viterbi search under the trigram model finds the best reading,
   whose words join those of the text, and the best reading as one word.
3. A word's score is its shrunken toxic share. It shrinks towards the share of
   toxic words among the known words with the same beginning (three to six
   bytes), which stands in for unseen words. By definition a word scores
   ``BASE`` unless its first three bytes begin a known word or beginning that
   scores 0.2 or more. A text scores as its most toxic word.

The word model is fitted on labelled rows outside the held-out third, at
most about ``train_rows`` of them (a hash sample of the labels). It counts the
texts that hold a word, but toxic ones no more often than the word follows
distinct words, so that copies of one text are one piece of evidence. Only words that toxic texts show at least twice are
kept, so the bounded sample bounds the model.

Defined cases: null, empty and word-less texts get the base score; labels
that are null or have no document teach nothing; a doc_id with several labels
teaches its largest; repeated rows are scored each; without any label every
text gets the base score.
"""
from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import with_columns

SYMBOLS = 155  # boundary, 26 letters, 128 high bytes
_CLASS = np.zeros(256, dtype=np.int32)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[128:] = np.arange(27, 155)
_SPACES = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: What a sign may stand for in a word.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i"}
_END = "".join(x for x in LEET if not x.isdigit())  # signs that may also be punctuation
SEPARATORS = set(".-_*~^'​­ ")
COST = {"leet": 1.0, "separator": 0.5, "boundary": 2.0, "repeat": 0.7, "keep": 0.0}
_SHUT = r"""(?=[.,;:?!"')\]}]*(?!\S))"""
_ODD = re.compile(
    r"(?<!\S)(?=\S{3})(?=\S*[^\W\d_])\S*?[^\W_][0-9@$!|+(€£¡*._~^\u200b\u00ad-]+[^\W_]\S*"  # signs inside
    r"|(?<!\S)\S*?([^\W\d_])\1\1\S*"  # repeats
    r"""|(?<![^\s"'(\[{])(?:[^\W_@$][ ._*-]){2,}[^\W_]""" + _SHUT +  # letters set apart
    r"|(?<!\S)[@$!|+(0-9][^\W\d_]\S+"  # a sign first
    r"|(?<!\S)(?=\S*[^\W\d_])\S*[0-9@$!|+(€£¡]" + _SHUT)  # a sign last
_TWICE = re.compile(r"([^\W\d_])\1", re.I)
PREFIXES = (3, 4, 5, 6)
BASE, SHRINK = 0.03, 4.0


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _plain(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass").translate(_SPACES)


def words(text: str) -> list[bytes]:
    return _plain(text).split()


# character model

def count_trigrams(texts: list[str | None], counts: np.ndarray, block: int = 1 << 22) -> None:
    """Texts are joined by two boundaries, in blocks of about ``block`` characters."""
    part, size = [], 0
    for t in [*texts, None]:
        if t:
            part.append(t)
            size += len(t)
        if part and (size >= block or t is None):
            raw = "  ".join(["", *part, ""]).lower().encode("utf-8", "surrogatepass")
            c = _CLASS[np.frombuffer(raw, dtype=np.uint8)]
            counts += np.bincount((c[:-2] * SYMBOLS + c[1:-1]) * SYMBOLS + c[2:], minlength=len(counts))
            part, size = [], 0


def trigram_counts(docs: DataFrame, text: str) -> DataFrame:
    """(key, n) over the whole corpus."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(SYMBOLS**3, dtype=np.int64)
        for b in batches:
            count_trigrams(list(b["text"]), counts)
        at = np.flatnonzero(counts)
        yield pd.DataFrame({"key": at, "n": counts[at]})

    return (docs.select(F.col(text).alias("text")).mapInPandas(run, "key long, n long")
            .groupBy("key").agg(F.sum("n").alias("n")))


class CharModel:
    """Costs -log P(c | a b) with add-one smoothing backed off to the bigram's."""

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        counts = np.zeros(SYMBOLS**3, dtype=np.float32)
        counts[keys] = n
        cube = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
        two = cube.sum(0)
        back = (two + 0.5) / (two.sum(1, keepdims=True) + 0.5 * SYMBOLS)
        self.cost = -np.log((cube + 5.0 * back[None]) / (cube.sum(2, keepdims=True) + 5.0)).astype(np.float32)

    def of(self, a: int, b: int, c: int) -> float:
        return float(self.cost[a, b, c])


def lattice(token: str, ends: bool = True, keep: int = 1) -> Iterator[list[tuple[str, float]]]:
    """Readings of each character: (letters, cost); an empty reading drops it, a space ends a word (if ``ends``).

    Of a letter in a row, those after the first ``keep`` may be dropped.
    """
    last, run = "", 0
    for ch in token:
        options: list[tuple[str, float]] = []
        if ch.isalpha():
            run = run + 1 if ch == last else 1
            options.append((ch, COST["keep"]))
            if run > keep:
                options.append(("", COST["repeat"]))
        else:
            options += [(x, COST["leet"]) for x in LEET.get(ch, "")]
            if ch in SEPARATORS or not options:
                options.append(("", COST["separator"]))
                if ends:
                    options.append((" ", COST["boundary"]))
        yield options
        last = ch


def decode(token: str, model: CharModel, ends: bool = True, keep: int = 1) -> str:
    """Cheapest reading of a token (Viterbi; states are the last two symbols)."""
    states: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
    for options in lattice(token.lower(), ends, keep):
        after: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (cost, trail) in states.items():
            for letters, extra in options:
                x, y, total = a, b, cost + extra
                for byte in letters.encode("utf-8", "surrogatepass"):
                    c = int(_CLASS[byte])
                    total += model.of(x, y, c)
                    x, y = y, c
                kept = after.get((x, y))
                if kept is None or total < kept[0]:
                    after[(x, y)] = (total, (trail, letters) if letters else trail)
        states = after
    best = min(((cost + model.of(a, b, 0), trail) for (a, b), (cost, trail) in states.items()), key=lambda s: s[0])[1]
    out = []
    while best:
        best, letters = best
        out.append(letters)
    return "".join(reversed(out))


_LETTER, _SIGN, _ALNUM = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SIGN[[ord(x) for x in "0123456789@$!|+(.-_*~^"]] = True
_LEET = np.zeros(256, dtype=bool)
_LEET[[ord(x) for x in LEET if x < "\x80"]] = True
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def _lone(b: np.ndarray) -> np.ndarray:
    """Places of spaces that may part two single characters: at most one wide or one ASCII character on either side."""
    at = np.flatnonzero(b == 32)
    pad = np.concatenate([np.zeros(6, dtype=np.uint8), b, np.zeros(6, dtype=np.uint8)])
    left, before, right, after = (pad[at + 6 + k] for k in (-1, -2, 1, 2))
    ok = (left >= 128) | (_ALNUM[left] & ~_ALNUM[before])
    return at[ok & ((right >= 128) | (_ALNUM[right] & ~_ALNUM[after]))]


def suspicious_lines(text: str) -> list[str]:
    """Lines that may hold an obfuscated token: a cheap superset of what ``_ODD`` finds."""
    return [line for _, line in suspicious([text])]


def suspicious(texts: list[str]) -> list[tuple[int, str]]:
    """(number of the text, line) of the ``suspicious_lines`` of texts, which are searched together."""
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    raw = b"\n".join(parts)
    b = np.frombuffer(raw, dtype=np.uint8)
    letter, sign = _LETTER[b], _SIGN[b]
    hit = np.zeros(len(b), dtype=bool)
    if len(b) > 1:
        hit[:-1] |= sign[:-1] & (sign[1:] | letter[1:])  # a sign before a letter, digit or sign
        hit[1:] |= _LEET[b[1:]] & (b[:-1] > 32)  # a sign that ends a word
        same = (b[:-1] | 32) == (b[1:] | 32)
        hit[:-2] |= same[:-1] & same[1:] & letter[:-2]
        lone = _lone(b)  # two in a row with one character between them: letters or digits set apart
        gap = np.diff(lone)
        for k in range(2, 6):
            one = lone[:-1][gap == k]
            hit[one[(b[one + 1] >= 128) | (k == 2)]] = True
        if (b >= 128).any():
            hit |= (b == 0xE2) | (b == 0xC2)  # signs outside of ASCII
            for k in (2, 3, 4):  # a wide letter three times
                if len(b) >= 3 * k:
                    eq = b[:-k] == b[k:]
                    n = len(b) - 3 * k + 1
                    hit[:n] |= (b[:n] >= 0xC0) & eq[:n] & eq[k - 1:][:n] & eq[k:][:n] & eq[2 * k - 1:][:n]
    at = np.flatnonzero(hit)
    if not len(at):
        return []
    ends = np.append(np.flatnonzero(b == 10), len(b))
    lines = np.unique(np.searchsorted(ends, at))
    starts = np.append(0, ends[:-1] + 1)
    last = np.cumsum([len(p) + 1 for p in parts])
    return [(k, raw[i:j].decode("utf-8", "surrogatepass")) for k, i, j in zip(np.searchsorted(last, starts[lines], "right").tolist(), starts[lines], ends[lines])]


def doubled_words(low: bytes) -> set[bytes]:
    """Of ``low`` (letters and spaces, as ``words`` sees them) the words with a letter twice in a row."""
    return doubled([low])[0]


def doubled(lows: list[bytes]) -> list[set[bytes]]:
    """The ``doubled_words`` of each, searched together."""
    low = b" ".join(lows)
    b = np.frombuffer(low, dtype=np.uint8)
    hit = np.zeros(len(b), dtype=bool)
    hit[:-1] = (b[:-1] == b[1:]) & (b[:-1] > 32) & (b[:-1] < 128)
    if (b >= 128).any():
        for k, low_lead, high_lead in ((2, 0xC0, 0xDF), (3, 0xE0, 0xEF), (4, 0xF0, 0xFF)):
            if len(b) >= 2 * k:
                eq = b[:-k] == b[k:]
                n = len(b) - 2 * k + 1
                hit[:n] |= (b[:n] >= low_lead) & (b[:n] <= high_lead) & np.logical_and.reduce([eq[j:j + n] for j in range(k)])
    out: list[set[bytes]] = [set() for _ in lows]
    at = np.flatnonzero(hit)
    last = np.cumsum([len(x) + 1 for x in lows])
    end = -1
    for i, k in zip(at.tolist(), np.searchsorted(last, at, "right").tolist()):
        if i >= end:
            end = low.find(b" ", i)
            end = len(low) if end < 0 else end
            out[k].add(low[low.rfind(b" ", 0, i) + 1:end])
    return out


def _starts(word: str, size: int = 3) -> set[bytes]:
    """First bytes of whatever a word may read when letters in a row go."""
    out = {""}
    for ch, run in groupby(word):
        n = min(size, sum(1 for _ in run))
        out = {o + ch * k for o in out for k in range(1, n + 1)}
        if min(map(len, out)) >= size:
            break
    return {o.encode("utf-8", "surrogatepass")[:size] for o in out}


def may_start(word: bytes, open: set[bytes]) -> bool:
    """Whether some reading of a word with doubled letters may begin with one of ``open``."""
    head = word[:3]
    if len(head) == 3 and head[0] != head[1] != head[2] and max(head) < 128:
        return head in open  # letters that may go come later
    return not open.isdisjoint(_starts(word.decode("utf-8", "surrogatepass")))


class Restorer:
    """Decoded readings of the obfuscated tokens of texts; a bounded cache per worker.

    Words with a doubled letter are decoded if ``twice``; with ``open`` (the beginnings of three bytes
    that matter) only where a reading may begin so.
    """

    def __init__(self, model: CharModel, twice: bool = False, open: set[bytes] | None = None, cache: int = 2_000_000):
        self.model, self.twice, self.open, self.size = model, twice, open, cache
        self.cache: dict[str | bytes, frozenset[bytes]] = {}
        self.held = 0  # characters in the cache

    def _read(self, token: str) -> frozenset[bytes]:
        read = decode(token, self.model)
        out = words(read)
        if " " in read:
            out += words(decode(token, self.model, ends=False))
        if _TWICE.search(token):
            out += words(decode(token, self.model, keep=2))
        return frozenset(out)

    def _cached(self, key: str | bytes, token: str) -> frozenset[bytes]:
        found = self.cache.get(key)
        if found is None:
            found = self._read(token)
            if self.held >= self.size:
                self.cache.clear()
                self.held = 0
            self.cache[key] = found
            self.held += len(token)
        return found

    def all_words(self, texts: list[str | None]) -> Iterator[tuple[list[bytes], set[bytes], set[bytes]]]:
        """Each text's words, the readings of its odd tokens, and its words with doubled letters (to be
        read by ``read_twice``); texts are searched some at a time."""
        for some in _runs(texts):
            lows = [_plain(t) for t in some]
            out: list[set[bytes]] = [set() for _ in some]
            for k, line in suspicious(some):
                for m in _ODD.finditer(line):
                    token = m[0].strip(".,;:?\"')]}")
                    bare = token.strip(_END)  # a sign at either end may also be punctuation
                    if bare != token and _ODD.search(bare):
                        out[k] |= self._cached(bare, bare)
                    out[k] |= self._cached(token, token)
            twice = doubled(lows) if self.twice else [set()] * len(lows)
            for low, found, own in zip(lows, out, twice):
                yield low.split(), found, own

    def read_twice(self, word: bytes) -> frozenset[bytes]:
        return self._cached(word, word.decode("utf-8", "surrogatepass"))

    def readings(self, text: str) -> set[bytes]:
        _, found, twice = next(self.all_words([text]))
        return found.union(*(self.read_twice(w) for w in twice if self.open is None or may_start(w, self.open)))


def shrunk(word: bytes, most: int = 64) -> list[bytes] | None:
    """Whatever a word may read when letters in a row go; None if that is more than ``most``."""
    out = [""]
    for ch, run in groupby(word.decode("utf-8", "surrogatepass")):
        n = sum(1 for _ in run)
        if len(out) * n > most:
            return None
        out = [o + ch * k for o in out for k in range(1, n + 1)]
    return [o.encode("utf-8", "surrogatepass") for o in out]


class Known(dict):
    """Values of words, each computed once; ``bounded`` empties it when it has grown large."""

    def __init__(self, of, most: int = 500_000):
        self.of, self.most = of, most

    def __missing__(self, word: bytes) -> float:
        value = self[word] = self.of(word)
        return value

    def bounded(self) -> None:
        if len(self) > self.most:
            self.clear()


class TextScores:
    """The highest score of a text's words and readings. A doubled word is decoded only if a reading
    open to it scores higher than all before it, as no other can change the result."""

    def __init__(self, share_of: WordModel, restore: Restorer):
        self.restore, self.score, self.bound = restore, Known(share_of), Known(self._highest)

    def _highest(self, word: bytes) -> float:
        """The highest score of what a doubled word may read."""
        share_of = self.score.of
        if not may_start(word, share_of.open):
            return BASE
        may = shrunk(word)
        return 1.0 if may is None else max(map(share_of, may))

    def of(self, own: list[bytes], found: set[bytes], twice: set[bytes]) -> float:
        score = self.score.__getitem__
        best = max(max(map(score, own), default=BASE), max(map(score, found), default=BASE))
        for w in twice:
            if self.bound[w] > best:
                best = max(best, max(map(score, self.restore.read_twice(w)), default=BASE))
        self.score.bounded()
        self.bound.bounded()
        return best


class Plain:
    """Words alone, to compare with: nothing is decoded."""

    def all_words(self, texts: list[str | None]) -> Iterator[tuple[list[bytes], set[bytes], set[bytes]]]:
        return ((words(t or ""), set(), set()) for t in texts)

    def read_twice(self, word: bytes) -> frozenset[bytes]:
        return frozenset()


def _runs(texts: list[str | None], size: int = 1 << 18) -> Iterator[list[str]]:
    """Texts in runs of about ``size`` characters."""
    part, n = [], 0
    for t in texts:
        part.append(t or "")
        n += len(part[-1])
        if n >= size:
            yield part
            part, n = [], 0
    if part:
        yield part


# word model

def share(toxic: float, clean: float, prior: float) -> float:
    return (toxic + SHRINK * prior) / (toxic + clean + SHRINK)


class WordModel:
    """Toxic share of a word, shrunk towards the share among the words with its beginning."""

    def __init__(self, of_word: dict[bytes, tuple[float, float]], of_prefix: dict[bytes, tuple[float, float]]):
        self.of_word, self.of_prefix = of_word, of_prefix
        #: beginnings below which some word may score far over BASE; all others get BASE
        self.open = {k[:3] for k in [*of_word, *of_prefix] if self.of(k) >= 0.2}

    def of(self, word: bytes) -> float:
        p = BASE
        for k in PREFIXES:
            c = self.of_prefix.get(word[:k]) if k <= len(word) else None
            if c is not None:
                p = share(*c, p)
        c = self.of_word.get(word)
        return p if c is None else share(*c, p)

    def __call__(self, word: bytes) -> float:
        return self.of(word) if word[:3] in self.open else BASE


def _beginnings(word: bytes) -> list[bytes]:
    return [word[:k] for k in PREFIXES if k <= len(word)]


def _toxic_evidence(restorer):
    """Of each text, every word once with (a digest of) the word before its first place."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restore = restorer()
        for b in batches:
            out = []
            for w, read, twice in restore.all_words(list(b["text"])):
                first: dict[bytes, bytes] = {x: b"" for x in read.union(*map(restore.read_twice, twice))}
                first.update(zip(reversed(w), [*reversed(w[:-1]), b""]))
                out += [(x, zlib.crc32(before)) for x, before in first.items()]
            yield pd.DataFrame(out, columns=["word", "place"])
    return run


def _clean_evidence(shared):
    """(word, n): texts that hold a known word."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, n = shared.value, Counter()
        for b in batches:
            for t in b["text"]:
                n.update(known.intersection(words(t or "")))
        yield pd.DataFrame({"word": list(n), "n": list(n.values())})
    return run


def _clean_words(shared):
    """Words below the shared beginnings."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        below = shared.value
        starts = {k[:3] for k in below}
        seen: set[bytes] = set()  # words that the task has handed on; bounded
        for b in batches:
            found = {w for t in b["text"] for w in words(t or "") if w[:3] in starts} - seen
            seen = found if len(seen) > 1_000_000 else seen | found
            yield pd.DataFrame([(w, k) for w in found for k in _beginnings(w) if k in below], columns=["word", "prefix"])
    return run


def scored(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
           train_rows: int = 60_000, name: str = "score", restore: bool = True) -> DataFrame:
    """``docs`` with a new column ``name``: the toxicity score from 0 to 1. ``restore=False`` decodes nothing."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    trigrams = trigram_counts(rows, "text").toPandas()  # at most SYMBOLS**3 rows
    table = spark.sparkContext.broadcast((trigrams["key"].to_numpy(dtype=np.int64), trigrams["n"].to_numpy(dtype=np.float64)))
    made: dict = {}

    def char_model() -> CharModel:
        if "m" not in made:
            made["m"] = CharModel(*table.value)
        return made["m"]

    def restorer(open: set[bytes] | None = None) -> Restorer:
        return Restorer(char_model(), True, open) if restore else Plain()

    taught = (labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("toxic")).where(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull())
              .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    part = min(1.0, train_rows / max(1, taught.count()))
    taught = taught.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(int(part * (1 << 20))))
    train = rows.join(F.broadcast(taught), "doc_id")  # about train_rows ids at most
    clean = train.where("toxic = 0").select("text")
    seen = train.where("toxic = 1").select("text").mapInPandas(_toxic_evidence(restorer), "word binary, place long")
    places = seen.groupBy("word", "place").agg(F.count("*").alias("texts"))
    toxic = (places.groupBy("word").agg(F.least(F.sum("texts"), F.count("*")).alias("n")).where("n >= 2")).toPandas()
    toxic = {bytes(w): float(n) for w, n in zip(toxic["word"], toxic["n"])}
    known = spark.sparkContext.broadcast(frozenset(toxic))
    found = clean.mapInPandas(_clean_evidence(known), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).toPandas()
    found = {bytes(w): float(n) for w, n in zip(found["word"], found["n"])}
    of_word = {w: (n, found.get(w, 0.0)) for w, n in toxic.items()}
    types: Counter = Counter()
    for w, c in of_word.items():
        for k in _beginnings(w):
            types[k] += share(*c, BASE)
    below = spark.sparkContext.broadcast(frozenset(k for k, n in types.items() if n >= 1.0))
    others = (clean.mapInPandas(_clean_words(below), "word binary, prefix binary").distinct()
              .groupBy("prefix").agg(F.count("*").alias("n")).toPandas())
    others = {bytes(k): float(n) for k, n in zip(others["prefix"], others["n"])}
    of_prefix = {k: (types[k], others.get(k, 0.0)) for k in below.value}
    model = spark.sparkContext.broadcast((of_word, of_prefix))

    def start():
        share_of = WordModel(*model.value)
        restore = restorer(share_of.open)
        scored_by = TextScores(share_of, restore)

        def step(c):
            return None, {name: [scored_by.of(*x) for x in restore.all_words(c[text])]}
        step.reads = (text,)
        return step

    return with_columns(docs, docs.columns, f"`{name}` double", start)


def scores(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.7, **options) -> DataFrame:
    """Per row: ``doc_id, held_out, score, predicted``."""
    rows = docs.select(F.col(doc_id).alias(doc_id), F.col(text).alias(text))
    found = scored(rows, labels, doc_id=doc_id, text=text, name="toxicity_score", **options)
    score = F.col("toxicity_score")
    return found.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), score.alias("score"), (score >= threshold).cast("int").alias("predicted"))
