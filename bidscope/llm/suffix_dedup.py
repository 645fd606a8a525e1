"""Removal of repeated strings by difference-cover suffix sorting, cut off at the wanted length.

A byte goes if a string of ``length`` bytes covers it that also starts earlier
(in a document with a smaller id, or earlier in the same one). So suffixes
need sorting by their first ``length`` bytes only. Steps:

1. Sample the starts whose offset modulo ``v`` is in a difference cover D.
   Name each by its first ``length - v + 1`` bytes; sort the names. For two
   equal strings at any offsets there is one shift below ``v`` at which both
   are sampled, and there their names agree. So a name that occurs once leads
   to no repeat and is dropped: the next steps only have starts at most
   ``v - 1`` bytes before the others (survivors).
2. Settle by longer names: a survivor's name of ``length + v - 1`` bytes that
   also occurs earlier settles the ``v`` starts from there on at once. Then
   recurse on step 1 with a finer cover, over what is still open: the first of
   equal strings is never settled, so a string that is open twice is also
   named twice. What is left are the ends of the repeats.
3. Merge the remaining suffixes: every start that is still open gets a name
   for its ``length`` bytes; sort those.
4. Compare neighbours: of equal names the earliest start stays, all others
   mark their bytes.

Names are hashes instead of ranks, as only equality is asked: 64 bits and the
bucket of an independent hash. ``wide`` adds 32 bits for inputs beyond some
terabytes (about 2 ** 43 starts).

Documents are dealt to groups, ranges of (id, digest) of about equal bytes,
and sorted there. The corpus is the groups one after another: a place is the
group and the bytes before it in the group, so places order as (id, digest,
offset) do. Texts meet their survivors and marks by group.

Names travel in binary columns, one row for each task's names and bucket, with
a bucket's names in one array and their places as steps from one to the next.
No row names its documents, so a name takes 8 bytes and the step's one or two,
from however many buckets the input needs. A row's names occur once each;
further places of a name in the same block are settled there. So a string that
is in a third of all documents costs one name per block.

Defined cases: null texts are empty; texts shorter than ``length`` lose
nothing; rows that agree in id and text are one document, reported for each
row; rows that agree in id only are ordered by a text digest; a null id comes
before all others; an empty table gives an empty result.
"""
from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import drop, stored

_BLOCK = 1 << 20
_RNG = np.random.Generator(np.random.PCG64(20240229))
_VALUES = _RNG.integers(1, 2**64, size=(2, 256), dtype=np.uint64, endpoint=False)
_FACTORS = (np.uint64(0x9E3779B97F4A7C15 | 3), np.uint64(0xD1342543DE82EF97 | 3))
_NULL_ID = -(1 << 63)
_SHIFT = 40  # places: the group, then 40 bits for the bytes before in the group


def cover(v: int) -> frozenset[int]:
    """A perfect difference cover: every residue but 0 is one difference of two elements."""
    if v == 1:
        return frozenset([0])
    if v == 13:
        return frozenset([0, *(pow(3, k, 13) for k in range(3))])
    return frozenset(pow(2, k, v) for k in range({7: 3, 73: 9}[v]))


def levels(length: int) -> tuple[int, ...]:
    """Periods of the covers, coarse to fine; the first is that of the sample."""
    if length < 12:
        raise ValueError("strings of at least 12 bytes are needed")
    return (73, 13, 1) if length >= 97 else (7, 1)


def _powers(factor: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(factor), -1, 1 << 64))
    up, down = np.full(n, factor, dtype=np.uint64), np.full(n, inverse, dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def names(buffer: np.ndarray, starts: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """64-bit hash of ``length`` bytes at each of the sorted ``starts``."""
    out = np.empty(len(starts), dtype=np.uint64)
    if which not in _POWERS or len(_POWERS[which][0]) <= _BLOCK + length:
        _POWERS[which] = _powers(_FACTORS[which], _BLOCK + length + 256)
    up, down = _POWERS[which]
    at = 0
    while at < len(starts):
        low = int(starts[at])
        end = int(np.searchsorted(starts, low + _BLOCK))
        part = buffer[low:int(starts[end - 1]) + length]
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(_VALUES[which][part] * up[:len(part)], out=sums[1:])
        own = starts[at:end] - low
        h = (sums[own + length] - sums[own]) * down[own]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        out[at:end] = h ^ (h >> np.uint64(32))
        at = end
    return out


class Texts:
    """Documents of a block in one buffer; ``bases`` are the places of their first bytes, ascending."""

    def __init__(self, bases: list[int], raw: list[bytes]):
        self.bases = np.array(bases, dtype=np.int64)
        self.sizes = np.array([len(x) for x in raw], dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])
        self.buffer = np.frombuffer(b"".join(raw), dtype=np.uint8)

    def within(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, offset) of those of the sorted places that are in these documents."""
        x, y = np.searchsorted(places, [self.bases[0], self.bases[-1] + self.sizes[-1]])
        doc = np.searchsorted(self.bases, places[x:y], "right") - 1
        offset = places[x:y] - self.bases[doc]
        ok = offset < self.sizes[doc]
        return doc[ok], offset[ok]

    def sampled(self, length: int, v: int) -> tuple[np.ndarray, np.ndarray]:
        """(document, start in the buffer) of the starts in the cover with ``length`` bytes of room."""
        room = np.maximum(self.sizes - length + 1, 0)
        period = np.array(sorted(cover(v)), dtype=np.int64)
        count = -(-room // v) * len(period)
        doc = np.repeat(np.arange(len(room)), count)
        k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        offset = k // len(period) * v + period[k % len(period)]
        fits = offset < room[doc]
        return doc[fits], (self.first[doc] + offset)[fits]

    def spread(self, places: np.ndarray, before: int, after: int, length: int) -> np.ndarray:
        """Which starts with ``length`` bytes of room are from ``before`` bytes before to ``after`` bytes after a place."""
        doc, offsets = self.within(places)
        low = np.maximum(offsets - before, 0)
        high = np.minimum(offsets + after, self.sizes[doc] - length) + 1
        some = low < high
        first, n = self.first[doc][some], len(self.buffer) + 1
        change = np.bincount(first + low[some], minlength=n) - np.bincount(first + high[some], minlength=n)
        return np.cumsum(change[:-1]) > 0

    def open_at(self, side: dict[int, np.ndarray], length: int) -> np.ndarray:
        """Which starts are near survivors of all covers (levels below 0) and not settled (levels above 0)."""
        out = np.ones(len(self.buffer), dtype=bool)
        for level, places in side.items():
            out &= self.spread(places, -level - 1, 0, length) if level < 0 else ~self.spread(places, 0, level - 1, length)
        return out

    def named_at(self, side: dict[int, np.ndarray], length: int, v: int, finer: bool) -> tuple[np.ndarray, np.ndarray]:
        """(document, start in the buffer) of this level's names; ``finer``: those of a finer cover."""
        open_ = self.open_at(side, length)
        if v == 1:
            at = np.flatnonzero(open_)
            return np.searchsorted(self.first, at, "right") - 1, at
        upto = np.concatenate([[0], np.cumsum(open_)])
        if finer:
            doc, at = self.sampled(length - v + 1, v)
            ok = upto[at + 1] > upto[np.maximum(at - v + 1, 0)]  # a document's last starts are never open
        else:
            doc, offset = self.within(side[-v])
            fits = offset + length + v - 1 <= self.sizes[doc]
            doc = doc[fits]
            at = self.first[doc] + offset[fits]
            ok = upto[at + v] - upto[at] == v
        return doc[ok], at[ok]


def pack_places(refs: np.ndarray, ids: np.ndarray, doc: np.ndarray, offset: np.ndarray) -> bytes:
    """Places (document, offset), documents ascending and offsets ascending within."""
    if not len(doc):
        return b""
    edge = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    step = np.diff(offset, prepend=0)
    step[edge] = offset[edge]
    own = doc[edge]
    counts = np.diff(np.append(edge, len(doc)))
    size = max(1, (int(step.max()).bit_length() + 7) // 8)
    planes = step.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :size].T  # all low bytes first: the high ones are few and small
    body = [refs[own].astype("<i8"), ids[own].astype("<i8"), counts.astype("<i8"), planes]
    return np.array([len(own), len(doc), size], dtype="<i8").tobytes() + zlib.compress(b"".join(x.tobytes() for x in body), 1)


def unpack_places(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(refs, ids, document, offset) as packed."""
    if not blob:
        z = np.zeros(0, dtype=np.int64)
        return z, z, z, z
    n, m, size = np.frombuffer(blob[:24], dtype="<i8")
    body = zlib.decompress(blob[24:])
    refs, ids, counts = (np.frombuffer(body, dtype="<i8", count=n, offset=8 * n * k) for k in range(3))
    step = np.zeros((m, 8), dtype=np.uint8)
    step[:, :size] = np.frombuffer(body, dtype=np.uint8, offset=24 * n).reshape(size, m).T
    step = step.view("<i8").ravel()
    doc = np.repeat(np.arange(n), counts)
    total = np.cumsum(step)
    edge = np.concatenate([[0], np.cumsum(counts)[:-1]])
    return refs, ids, doc, total - np.repeat(total[edge] - step[edge], counts)


def _pack(places: np.ndarray) -> bytes:
    """Ascending places of one group."""
    low = places[:1]
    return pack_places(low >> _SHIFT, low & ((1 << _SHIFT) - 1), np.zeros(len(places), dtype=np.int64), places - low)


def _unpack(blob: bytes) -> np.ndarray:
    group, low, of, offset = unpack_places(blob)
    return ((group << _SHIFT) + low)[of] + offset


def _encode(keys: np.ndarray, extra: np.ndarray | None) -> bytes:
    return keys.astype("<u8").tobytes() + (extra.tobytes() if extra is not None else b"")


def _first_places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, again, twice): index of each key's first place; whether a place repeats an earlier one; whether its key has several."""
    again, twice = np.ones(len(keys), dtype=bool), np.zeros(len(keys), dtype=bool)
    if not len(keys):
        return np.zeros(0, dtype=np.int64), again, twice
    order = np.argsort(keys)
    some = keys[order]
    edge = np.flatnonzero(np.concatenate([[True], some[1:] != some[:-1]]))
    again[np.minimum.reduceat(order, edge)] = False
    times = np.diff(np.append(edge, len(keys)))
    twice[order] = np.repeat(times > 1, times)
    return np.flatnonzero(~again), again, twice


def _emit(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]], buckets: int, keep_all: bool, wide: bool, salt: int) -> pd.DataFrame:
    """Rows (bucket, keys, places, settled) of (names, other names, ascending places) of one group: one per bucket, and one of places that are settled here.

    ``keep_all``: every place of a repeated name is settled (step 1), otherwise all but the first (step 2).
    """
    keys, other, places = (np.concatenate(x) for x in zip(*held))
    first, again, twice = _first_places(keys)
    settled = places[twice if keep_all else again]
    bucket = (other[first] % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
    order = np.argsort(bucket, kind="stable")  # keeps places ascending within a bucket
    bucket, first = bucket[order].astype(np.int64), first[order]
    edge = np.flatnonzero(np.diff(bucket, prepend=-1))
    rows = []
    for b, i in zip(bucket[edge].tolist(), np.split(first, edge[1:]) if len(edge) else []):  # only buckets that occur
        if keep_all:  # names without an open place come last
            known = twice[i]
            i, open_ = np.concatenate([i[~known], i[known]]), i[~known]
        else:
            open_ = i
        extra = (other[i] >> np.uint64(32)).astype("<u4") if wide else None
        rows.append((b, _encode(keys[i], extra), _pack(places[open_]), b""))
    if len(settled):
        rows.append(((salt + (int(settled[0]) >> _SHIFT) * 7919) % buckets, b"", b"", _pack(settled)))
    return pd.DataFrame(rows, columns=["bucket", "keys", "places", "settled"])


def _emitted(named: Iterator[tuple[Texts, np.ndarray, np.ndarray]], length: int, buckets: int, keep_all: bool, wide: bool, most: int) -> Iterator[pd.DataFrame]:
    """Rows of the names at (block, documents, starts in the buffer); blocks of a group go together up to ``most`` names."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    total = n = 0
    for texts, doc, at in named:
        if not len(at):
            continue
        places = texts.bases[doc] + at - texts.first[doc]
        if held and (total + len(at) > most or places[0] >> _SHIFT != held[0][2][0] >> _SHIFT):
            yield _emit(held, buckets, keep_all, wide, n)
            held, total, n = [], 0, n + 1
        held.append((names(texts.buffer, at, length), names(texts.buffer, at, length, 1), places))
        total += len(at)
    if held:
        yield _emit(held, buckets, keep_all, wide, n)


def _load(blob: bytes, wide: bool) -> np.ndarray:
    """Names as unsigned 64-bit numbers, or as pairs of these."""
    if not wide:
        return np.frombuffer(blob, dtype="<u8")
    n = len(blob) // 12
    out = np.empty(n, dtype=[("a", "<u8"), ("b", "<u4")])
    out["a"], out["b"] = np.frombuffer(blob, dtype="<u8", count=n), np.frombuffer(blob, dtype="<u4", offset=8 * n)
    return out


def _to_groups(places: list[np.ndarray]) -> pd.DataFrame:
    """(grp, places): one row per group."""
    every = np.sort(np.concatenate(places)) if places else np.zeros(0, dtype=np.int64)
    group = every >> _SHIFT
    edge = np.flatnonzero(np.diff(group, prepend=-1))
    rows = [(g, _pack(x)) for g, x in zip(group[edge].tolist(), np.split(every, edge[1:]) if len(edge) else [])]
    return pd.DataFrame(rows, columns=["grp", "places"])


def _settle(keep_all: bool, wide: bool, batch: int = 8_000_000):
    """Bucket rows -> (grp, places): survivors (``keep_all``), or starts that are not the first of their name."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks: dict[int, list] = {}
        out: list[np.ndarray] = []
        for b in batches:
            for bucket, keys, places, settled in zip(b["bucket"], b["keys"], b["places"], b["settled"]):
                if settled:
                    out.append(_unpack(settled))
                if keys:
                    blocks.setdefault(bucket, []).append((keys, places))
            if sum(len(x) for x in out) > batch:
                yield _to_groups(out)
                out = []
        for bucket in list(blocks):
            out.append(_settled_bucket(blocks.pop(bucket), keep_all, wide))
        yield _to_groups(out)
    return run


def _settled_bucket(blocks: list[tuple[bytes, bytes]], keep_all: bool, wide: bool) -> np.ndarray:
    keys = [_load(k, wide) for k, _ in blocks]
    at = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
    every = np.concatenate(keys)
    order = np.argsort(every)
    every = every[order]
    new = np.concatenate([[True], every[1:] != every[:-1]])
    del every
    times = np.diff(np.append(np.flatnonzero(new), len(new)))
    many = np.repeat(times > 1, times)
    some = order[many]
    del order
    places = np.full(len(new), -1, dtype=np.int64)  # names without an open place have none
    for (_, p), low in zip(blocks, at):
        x = _unpack(p)
        places[low:low + len(x)] = x
    own = places[some]
    if keep_all or not len(some):
        return own[own >= 0]
    edge = np.flatnonzero(new[many])
    return own[own != np.repeat(np.minimum.reduceat(own, edge), np.diff(np.append(edge, len(own))))]


def _blocks(batches: Iterator[pd.DataFrame], size: int, length: int, near: int = 0) -> Iterator[tuple[dict[int, np.ndarray], Texts]]:
    """(places of the group by level, block): documents of ``length`` bytes or more, each once, in blocks of about ``size`` bytes of a group.

    ``near``: only documents with survivors of this cover.
    """
    bases: list[int] = []
    raw: list[bytes] = []
    total, of = 0, {}
    for side, rows, starts in _dealt(batches):
        if raw and side is not of:
            yield of, Texts(bases, raw)
            bases, raw, total = [], [], 0
        of = side
        sizes = rows["size"].to_numpy()
        wanted = sizes >= length
        if near:
            survivors = side.get(-near, np.zeros(0, dtype=np.int64))
            wanted &= np.searchsorted(survivors, starts + sizes) > np.searchsorted(survivors, starts)
        for ok, start, t in zip(wanted.tolist(), starts.tolist(), rows["text"]):
            if ok and not (bases and bases[-1] == start):
                if total >= size:
                    yield of, Texts(bases, raw)
                    bases, raw, total = [], [], 0
                bases.append(start)
                raw.append(_whole(t))
                total += len(raw[-1])
    if raw:
        yield of, Texts(bases, raw)


def _sample(length: int, buckets: int, size: int, wide: bool):
    v = levels(length)[0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        named = ((block, *block.sampled(length - v + 1, v)) for _, block in _blocks(batches, size, length))
        yield from _emitted(named, length - v + 1, buckets, True, wide, size // 8)
    return run


def _side(places: list[tuple[int, bytes]]) -> dict[int, np.ndarray]:
    """By level: sorted places (-v: survivors of the cover v, v: starts that settle v starts)."""
    found: dict[int, list[np.ndarray]] = {}
    for level, p in places:
        found.setdefault(level, []).append(_unpack(p))
    return {level: np.unique(np.concatenate(x)) for level, x in found.items()}


def _dealt(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[dict[int, np.ndarray], pd.DataFrame, np.ndarray]]:
    """Of batches sorted by group, places before texts and these by (id, ref): (places by level, rows with texts of a group, places of their first bytes)."""
    group, last, at = -1, None, 0
    places: list[tuple[int, bytes]] = []
    side: dict[int, np.ndarray] | None = None
    for b in batches:
        edge = np.flatnonzero(np.diff(b["grp"].to_numpy(), prepend=-1))
        for x, y in zip(edge.tolist(), [*edge[1:].tolist(), len(b)]):
            rows = b.iloc[x:y]
            if (g := int(rows["grp"].iloc[0])) != group:
                group, last, at, places, side = g, None, 0, [], None
            is_text = rows["text"].notna()
            places += list(zip(rows.loc[~is_text, "level"], rows.loc[~is_text, "places"]))
            if not is_text.any():
                continue
            if side is None:
                side, places = _side(places), []
            own, starts = rows[is_text], []
            for key, n in zip(zip(own["id"], own["ref"]), own["size"]):
                if key != last:  # rows that agree in both are one document
                    start, at, last = at, at + n, key
                starts.append(start)
            yield side, own, (group << _SHIFT) + np.array(starts, dtype=np.int64)


def _compressed(bounds: list[tuple[int, int]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        small = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            raw = [t.encode("utf-8", "surrogatepass") for t in b["text"]]
            grp = [bisect_right(bounds, x) for x in zip(b["id"], b["ref"])]
            yield pd.DataFrame({"grp": grp, "id": b["id"], "ref": b["ref"], "size": [len(x) for x in raw], "text": [small(x) for x in raw]})
    return run


def _whole(packed: bytes) -> bytes:
    import zstandard

    return zstandard.decompress(packed)


def _merge(length: int, v: int, near: int, buckets: int, size: int, wide: bool, most: int):
    """Names of the level ``v``; of a finer cover if that of the last survivors, ``near``, is another and v is not the last level."""
    finer = v not in (near, 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        named = ((block, *block.named_at(side, length, v, finer)) for side, block in _blocks(batches, size, length, near))
        yield from _emitted(named, length - v + 1 if finer else length + v - 1, buckets, finer, wide, most)
    return run


def _cut(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for side, rows, starts in _dealt(batches):
            ends = starts + rows["size"].to_numpy()
            own = [(x, v + length - 1, np.searchsorted(x, starts), np.searchsorted(x, ends)) for v, x in side.items()]
            out = []
            for k, (d, t, start) in enumerate(zip(rows["id"], rows["text"], starts)):
                raw = _whole(t)
                spans = spans_of([(x[low[k]:high[k]] - start, n) for x, n, low, high in own if low[k] < high[k]])
                kept, at = [], 0
                for x, y in spans:
                    kept.append(raw[at:x])
                    at = y
                kept.append(raw[at:])
                out.append((d, len(raw), sum(y - x for x, y in spans), len(spans), hashlib.sha256(b"".join(kept)).hexdigest(), [{"start": x, "end": y} for x, y in spans]))
            yield pd.DataFrame(out, columns=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])
    return run


def spans_of(places: list[tuple[np.ndarray, int]]) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by strings of a size at sorted starts, over all (starts, size)."""
    if not places:
        return []
    low = np.concatenate([s for s, _ in places])
    high = np.concatenate([s + n for s, n in places])
    order = np.argsort(low, kind="stable")
    low, reach = low[order], np.maximum.accumulate(high[order])
    edge = np.flatnonzero(low[1:] > reach[:-1])
    return list(zip(low[np.append(0, edge + 1)].tolist(), reach[np.append(edge, len(low) - 1)].tolist()))


def _bounds(rows: DataFrame, count: int, groups: int) -> list[tuple[int, int]]:
    """(id, ref) at which the next group begins, for ranges of about equal bytes."""
    every = max(1, count // min(100 * groups, 1 << 22))
    some = rows.where(F.pmod(F.xxhash64(F.lit(2), "ref"), F.lit(every)) == 0).select("id", "ref", F.octet_length("text").alias("size")).toArrow()
    id_, ref, size = (some.column(c).to_numpy().astype(np.int64) for c in ("id", "ref", "size"))
    order = np.lexsort((ref, id_))
    upto = np.cumsum(size[order] + 256)
    if not len(upto):
        return []
    at = order[np.searchsorted(upto, upto[-1] / groups * np.arange(1, groups))]
    return sorted(set(zip(id_[at].tolist(), ref[at].tolist())))


def repeated_strings(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = 100,
                     block_bytes: int = 12 << 20, merge_bytes: int = 3 << 20, bucket_names: int = 4_000_000, wide: bool = False) -> DataFrame:
    """Per row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans`` (byte offsets)."""
    spark = docs.sparkSession
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_NULL_ID)).alias("id"), F.xxhash64(F.lit(1), F.col(doc_id), t).alias("ref"), t.alias("text"))
    count, total = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(1, least // 2, total // (8 * bucket_names))
    groups = max(least, total // (64 << 20))
    bounds = _bounds(rows, count, groups)
    packed, placed = "bucket long, keys binary, places binary, settled binary", "grp long, places binary"

    def settled(named: DataFrame, level: int) -> DataFrame:
        out = named.repartition(buckets, "bucket").mapInPandas(_settle(level < 0, wide), placed)
        return stored(out.withColumn("level", F.lit(level)), f"suffix-{level}")

    def with_texts(tables: list[DataFrame]) -> DataFrame:
        # no nulls in number columns, which pandas would make floats
        zero, none = F.lit(0).cast("long"), F.lit(None).cast("binary")
        # texts travel compressed
        every = rows.mapInPandas(_compressed(bounds), "grp long, id long, ref long, size long, text binary").select("grp", F.lit(0).alias("level"), none.alias("places"), "id", "ref", "size", "text")
        for t in tables:
            every = every.unionByName(t.select("grp", "level", "places", zero.alias("id"), zero.alias("ref"), zero.alias("size"), none.alias("text")))
        return every.repartitionById(groups, F.col("grp").cast("int")).sortWithinPartitions("grp", F.col("text").isNotNull(), "id", "ref")

    def merged(tables: list[DataFrame], v: int, near: int) -> DataFrame:
        return with_texts(tables).mapInPandas(_merge(length, v, near, buckets, merge_bytes, wide, block_bytes // 8), packed)

    first, *finer, last = levels(length)
    survivors = [settled(with_texts([]).mapInPandas(_sample(length, buckets, block_bytes, wide), packed), -first)]
    marks = [settled(merged(survivors, first, first), first)]
    near = first
    for v in finer:
        survivors.append(settled(merged([*survivors, *marks], v, near), -v))
        near = v
    marks.append(settled(merged([*survivors, *marks], last, near), last))
    drop(*survivors)
    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"
    out = with_texts(marks).mapInPandas(_cut(length), schema)
    back = F.when(F.col("id") != _NULL_ID, F.col("id")).cast(dict(docs.dtypes)[doc_id])
    return out.select(back.alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")
