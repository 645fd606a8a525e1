"""Best-fit packing by length patterns fitted with non-negative least squares.

Texts become token ids (a public byte-level BPE vocabulary) with the end id
appended; only sequences longer than ``seq_len`` are cut, so that all pieces
but the first are full. The plan needs nothing but the histogram of piece
lengths, which has at most ``seq_len`` entries:

1. lengths are rounded up to classes of ``grain`` tokens, and all patterns of
   one to three classes that fill a sequence are enumerated;
2. non-negative least squares fits the patterns' repeat counts to the class
   histogram (unmet long lengths weigh more than short ones);
3. nine tenths of the counts, rounded down, are placed; a class's slots are
   filled with exact lengths that make up a whole sequence, as far as there
   are such; what is left is fitted again with classes of another grain;
4. the residual lengths are packed best-fit, longest first, into the gaps
   and into new sequences.

If that takes more sequences than best-fit decreasing on all lengths does,
that plan is taken, so no plan is worse than it.

The plan is a list of runs "pieces of this length with ranks r0 to r1 go to
consecutive sequences from s at this offset". A piece's rank among those of
its length comes from per-task counts and a prefix sum, so no length is
gathered in one task, and each task looks its pieces up in the plan.

Defined cases: a null or empty text is one piece holding the end id;
repeated rows are packed each; an empty table gives an empty result.
"""
from __future__ import annotations

import base64
import zlib
from bisect import insort

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import stored, with_columns

_END = "<|endoftext|>"


class Encoder:
    """Ids of the vocabulary in ``json_path``, through the same vocabulary as ranks.

    Without white space runs the look-ahead in the split pattern never
    matters, and the pattern without it splits faster. Texts with the special
    token's string go through the ``tokenizers`` library itself.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import re

        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        make = lambda name, p: tiktoken.Encoding(name, pat_str=p, mergeable_ranks=ranks, special_tokens={})
        self._full = make("full", pattern)
        self._plain = make("plain", pattern.replace(r"\s+(?!\S)|", ""))
        self._runs = re.compile(r"\s\s|\s\Z")
        self._json = Tokenizer.from_file(json_path)

    def ids(self, text: str) -> list[int]:
        if _END in text:
            return self._json.encode(text, add_special_tokens=False).ids
        return (self._full if self._runs.search(text) else self._plain).encode_ordinary(text)


def default_vocabulary() -> dict[str, str]:
    import public_tokenizers as P
    return {"json_path": P.path("byte_bpe_50k.json"), "ranks_path": P.path("byte_bpe_50k.tiktoken"), "pattern": P.PATTERN}


def nnls(a: np.ndarray, b: np.ndarray, tol: float = 1e-9) -> np.ndarray:
    """min |a x - b| with x >= 0, by active sets on the normal equations."""
    n = a.shape[1]
    gram_rhs = a.T @ b
    passive: list[int] = []
    x = np.zeros(n)
    for _ in range(3 * a.shape[0]):
        grad = gram_rhs - a.T @ (a @ x)
        grad[passive] = -np.inf
        j = int(np.argmax(grad))
        if grad[j] <= tol * max(1.0, float(np.abs(gram_rhs).max())):
            break
        passive.append(j)
        while True:
            p = a[:, passive]
            z = np.linalg.lstsq(p, b, rcond=None)[0] if len(passive) > a.shape[0] else _solve(p, b)
            if len(z) == 0 or z.min() > 0:
                break
            old = x[passive]
            low = z <= 0
            step = np.min(old[low] / np.maximum(old[low] - z[low], 1e-300))
            now = old + step * (z - old)
            x[:] = 0
            keep = [k for k, v in zip(passive, now) if v > 1e-12]
            x[keep] = [v for v in now if v > 1e-12]
            if len(keep) == len(passive):
                keep = [k for k, lo in zip(passive, low) if not lo]
            passive = keep
        x[:] = 0
        x[passive] = z
    return x


def _solve(p: np.ndarray, b: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.solve(p.T @ p, p.T @ b)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(p, b, rcond=None)[0]


def patterns(classes: int, small: int = 0) -> list[tuple[int, ...]]:
    """All ways to fill ``classes`` units with one to three lengths over ``small`` (one: any)."""
    out: list[tuple[int, ...]] = [(classes,)]
    out += [(classes - a, a) for a in range(small + 1, classes // 2 + 1)]
    out += [(classes - a - b, b, a) for a in range(small + 1, classes // 3 + 1) for b in range(a, (classes - a) // 2 + 1)]
    return out


#: Lengths up to this part of a sequence fill gaps only; share of the fitted counts that is placed; grains of the rounds, beside the first.
SMALL, SHARE, ROUNDS = 64, 0.9, (0, 3, -1, 5, 1)


class Plan:
    """Runs (length, first rank, count, first sequence, offset) that place every piece."""

    def __init__(self, histogram: dict[int, int], seq_len: int = 2048, grain: int = 8):
        self.seq_len = seq_len
        self._start(histogram)
        for more in ROUNDS:
            for pattern, count in self._fitted(max(1, grain + more)):
                self._repeat(pattern, int(count * SHARE + 1e-9), max(1, grain + more))
        self.by_pattern = self.sequences
        self._residuals()
        least = -(-sum(n * c for n, c in histogram.items()) // seq_len)
        if self.sequences > least and self.by_pattern:
            fitted = dict(self.__dict__)
            self.by_pattern = 0
            self._start(histogram)
            self._residuals()
            if self.sequences >= fitted["sequences"]:
                self.__dict__.update(fitted)

    def _start(self, histogram: dict[int, int]) -> None:
        self.left = dict(histogram)
        self.used = dict.fromkeys(histogram, 0)
        self.runs: list[tuple[int, int, int, int, int]] = []
        self.sequences = 0
        self.gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> (first sequence, count)

    def _place(self, length: int, count: int, first: int, offset: int) -> None:
        self.runs.append((length, self.used[length], count, first, offset))
        self.used[length] += count
        self.left[length] -= count

    def _open(self, lengths: list[int], count: int) -> None:
        at = 0
        for n in lengths:
            self._place(n, count, self.sequences, at)
            at += n
        if at < self.seq_len:
            self.gaps.setdefault(self.seq_len - at, []).append((self.sequences, count))
        self.sequences += count

    def _fitted(self, grain: int) -> list[tuple[tuple[int, ...], float]]:
        """Patterns of classes of what is left, with their repeat counts, most frequent first."""
        top = -(-self.seq_len // grain)
        held = np.zeros(top + 1)
        for n, c in self.left.items():
            held[-(-n // grain)] += c
        ways = [p for p in patterns(top, top // SMALL) if all(held[c] >= p.count(c) for c in p)]
        if not ways:
            return []
        rows = sorted({c for p in ways for c in p})
        row = {c: i for i, c in enumerate(rows)}
        a = np.zeros((len(rows), len(ways)))
        for j, p in enumerate(ways):
            for c in p:
                a[row[c], j] += 1
        weight = 0.1 + 0.9 * np.array(rows) / top
        x = nnls(a * weight[:, None], held[rows] * weight)
        return [(ways[j], float(x[j])) for j in np.argsort(-x, kind="stable") if x[j] > 0]

    def _repeat(self, pattern: tuple[int, ...], count: int, grain: int) -> None:
        """Sequences of this pattern that exact lengths fill to the last token, at most ``count``."""
        while count > 0:
            heads: list[int] = []
            want: dict[int, int] = {}
            for k, c in enumerate(pattern):
                last = k and k == len(pattern) - 1  # takes what the longer ones leave, whatever the class
                choice = [self.seq_len - sum(heads)] if last else range(min(c * grain, self.seq_len), (c - 1) * grain, -1)
                n = next((n for n in choice if self.left.get(n, 0) > want.get(n, 0)), None)
                if n is None:
                    return
                heads.append(n)
                want[n] = want.get(n, 0) + 1
            if sum(heads) < self.seq_len:
                return
            m = min([count, *(self.left[n] // k for n, k in want.items())])
            self._open(heads, m)
            count -= m

    def _residuals(self) -> None:
        order = sorted(self.gaps)
        for n in sorted((n for n, c in self.left.items() if c), reverse=True):
            while self.left[n]:
                k = int(np.searchsorted(order, n))
                if k < len(order):
                    gap = order[k]
                    first, count = self.gaps[gap].pop()
                    m = min(count, self.left[n])
                    if m < count:
                        self.gaps[gap].append((first + m, count - m))
                    if not self.gaps[gap]:
                        del self.gaps[gap], order[k]
                    self._place(n, m, first, self.seq_len - gap)
                    if gap > n:
                        if gap - n not in self.gaps:
                            self.gaps[gap - n] = []
                            insort(order, gap - n)
                        self.gaps[gap - n].append((first, m))
                    continue
                fit, rest = self.seq_len // n, self.left[n]
                for lengths, count in (([n] * fit, rest // fit), ([n] * (rest % fit), 1)):
                    if lengths and count:
                        before = set(self.gaps)
                        self._open(lengths, count)
                        for g in set(self.gaps) - before:
                            insort(order, g)


def _pieces(vocabulary: dict[str, str], seq_len: int, end_id: int, with_ids: bool):
    def start():
        encoder, task, seen = Encoder(**vocabulary), TaskContext.get().partitionId(), {}

        def step(c):
            rows, out = [], {k: [] for k in ("piece", "start", "length", "ids_crc32", "ids", "task", "at")}
            for row, text in enumerate(c["text"]):
                ids = np.array([*encoder.ids(text or ""), end_id], dtype="<u4")
                cuts = [0, *range(len(ids) % seq_len or seq_len, len(ids) + 1, seq_len)]
                for k, (x, y) in enumerate(zip(cuts, cuts[1:])):
                    at = seen.get(y - x, 0)
                    seen[y - x] = at + 1
                    part = ids[x:y]
                    rows.append(row)
                    for name, value in zip(out, (k, x, y - x, zlib.crc32(part.tobytes()), part.tolist() if with_ids else None, task, at)):
                        out[name].append(value)
            return rows, out
        return step
    return start


def _lookup(shared):
    def start():
        runs = shared.value
        key = runs[:, 0] * (1 << 48) + runs[:, 1]

        def step(c):
            rank = np.array(c["rank"], dtype=np.int64)
            found = runs[np.searchsorted(key, np.array(c["length"], dtype=np.int64) * (1 << 48) + rank, "right") - 1]
            return None, {"sequence_id": found[:, 3] + rank - found[:, 1], "offset": found[:, 4]}
        step.reads = ("length",)
        return step
    return start


def pack(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", seq_len: int = 2048, end_id: int = 0,
         grain: int = 8, vocabulary: dict[str, str] | None = None, with_ids: bool = False) -> DataFrame:
    """Per piece: ``doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset``."""
    vocabulary = vocabulary or default_vocabulary()
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    fields = "piece int, start long, length long, ids_crc32 long, ids array<long>, task int, at long"
    pieces = with_columns(source, ["doc_id"], fields, _pieces(vocabulary, seq_len, end_id, with_ids))
    pieces = stored(pieces if with_ids else pieces.drop("ids"), "pack-pieces")
    counts = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most seq_len rows
    plan = Plan(histogram, seq_len, grain)
    runs = np.array(sorted(plan.runs), dtype=np.int64).reshape(-1, 5)
    shared = docs.sparkSession.sparkContext.broadcast(runs)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    names = [c for c in pieces.columns if c not in ("task", "at")]
    ranked = pieces.join(starts, ["length", "task"]).withColumn("rank", F.col("first") + F.col("at"))
    return with_columns(ranked.select(*names, "rank"), names, "sequence_id long, offset long", _lookup(shared))
