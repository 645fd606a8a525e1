"""Line deduplication with a segment-partition edit join.

A document's lines are compared without leading and trailing spaces; blank
lines stay. Equal lines are one class. Two lines also link if their edit
distance (code points) is at most ``min(edits, length of the shorter //
chars_per_edit)``, so short lines link only when equal. Of each component of
linked classes the earliest line stays (smallest doc_id, then line number),
all others are removed.

The join splits every line into ``edits + 1`` segments. If two lines are
within ``edits``, one segment of the shorter line occurs in the longer one at
a place that the position-aware selection covers. Segment and selected
substrings are hashed with the length and the segment's number; names that no
segment has, or that one line has alone, are dropped. Only lines with a
shared name are fetched and verified: common prefix and suffix go, and a
banded bit-parallel distance decides the middle.

A pair is counted at the first segment that it shares, so its link counts
once. A task gives a forest and counts, never all its pairs; a name that more
than ``group_rows`` lines share is verified in pairs of blocks. Equal lines
are one row before the join, so a line that a third of all documents hold
costs one row per task.

Defined cases: null and empty texts have no lines that count; rows that agree
in id and text are one document, reported for each row; rows that agree in id
only are ordered by a text digest; a null id comes before all others; an
empty table gives an empty result.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .tables import drop, stored

_LOWEST = -(1 << 63)
_FACTOR = np.uint64(0x9E3779B97F4A7C15 | 3)
_INVERSE = np.uint64(pow(int(_FACTOR), -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def segments(length: np.ndarray, parts: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(start, size) of each of ``parts`` even segments; the last ones are the longer."""
    size, longer = length // parts, length % parts
    out, at = [], np.zeros_like(length)
    for j in range(parts):
        own = size + (j >= parts - longer)
        out.append((at, own))
        at = at + own
    return out


def selections(edits: int) -> list[tuple[int, int, int]]:
    """(shorter by, segment, shift): where a segment of a shorter line is looked for."""
    return [(d, j, o) for d in range(edits + 1) for j in range(edits + 1)
            for o in range(max(-j, d - (edits - j)), min(j, d + (edits - j)) + 1)]


def line_names(lines: list[str], edits: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, line, role): role is the segment's number, plus 4 where the name is the line's own segment."""
    if not lines:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    buffer = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    length = np.array([len(x) for x in lines], dtype=np.int64)
    first = np.cumsum(length) - length
    n = len(buffer)
    up, down = np.full(n, _FACTOR, dtype=np.uint64), np.full(n, _INVERSE, dtype=np.uint64)
    up[0] = down[0] = 1
    up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_mix(buffer.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    out = []
    for d, j, o in selections(edits):
        shorter = length - d
        start, size = segments(shorter, edits + 1)[j]
        start = start + o
        ok = np.flatnonzero((shorter >= least) & (start >= 0) & (start + size <= length))
        at, end = first[ok] + start[ok], first[ok] + start[ok] + size[ok]
        name = _mix((sums[end] - sums[at]) * down[at] + (shorter[ok] * 8 + j).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        out.append((name, ok, np.full(len(ok), j + 4 * (d == 0 and o == 0), dtype=np.uint8)))
    return tuple(np.concatenate(x) for x in zip(*out))


def within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance is at most ``most``: banded bit-parallel columns after trimming."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return False
    low = _common(a, b)
    a, b = a[low:], b[low:]
    high = _common(a[::-1], b[::-1]) if b else 0
    if high:
        a, b = a[:-high], b[:-high]
    if not b or len(a) <= most:
        return len(a) <= most
    return _banded(a, b, most) <= most


def _common(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low + 1 < high:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low + (a[low] == b[low])


def _banded(a: str, b: str, k: int, bits: int = 64) -> int:
    """Edit distance of ``a`` (not shorter, longer than ``k``) to ``b``, exact up to ``k`` (at most ``bits // 2 - 1``).

    Vertical differences are kept for the rows of a band only, which moves
    down a row with each column, so one word holds them (Hyyrö's banded form
    of the bit-parallel columns). The top bit is the lowest diagonal.
    """
    m, top, mask = len(a), bits - 1, (1 << bits) - 1
    where: dict[str, int] = {}
    for i in range(k):
        where[a[i]] = where.get(a[i], 0) | 1 << (top - k + i + 1)
    vp, vn, score = (mask << (top - k)) & mask, 0, k
    for j, x in enumerate(b):
        for c in where:
            where[c] >>= 1
        if j + k < m:
            where[a[j + k]] = where.get(a[j + k], 0) | 1 << top
        eq = where.get(x, 0)
        d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & mask
        hp = (vn | ~(d0 | vp)) & mask
        hn = d0 & vp
        if j + k < m:  # along the lowest diagonal down to the last row of a, then along that row
            score += 1 - (d0 >> top & 1)
        else:
            bit = top - 1 - (j + k - m)
            score += (hp >> bit & 1) - (hn >> bit & 1)
        down = d0 >> 1
        vp = (hn | ~(down | hp)) & mask
        vn = down & hp
    return score


def first_shared(longer: str, shorter: str, edits: int) -> int:
    """The first segment of the shorter line that is found in the longer one."""
    d, n = len(longer) - len(shorter), len(shorter)
    parts = [(int(s[0]), int(z[0])) for s, z in segments(np.array([n]), edits + 1)]
    for by, j, o in selections(edits):
        if by == d:
            start, size = parts[j]
            at = start + o
            if at >= 0 and at + size <= len(longer) and longer[at:at + size] == shorter[start:start + size]:
                return j
    return -1


def _named(edits: int, least: int, buckets: int, size: int):
    import xxhash

    def rows(lines: dict[int, str]) -> pd.DataFrame:
        ids, parts = np.array(list(lines), dtype=np.uint64).view(np.int64), []
        part, total, at = [], 0, 0
        for k, x in enumerate([*lines.values(), None]):
            if part and (x is None or total + len(x) > 1 << 18):
                name, line, role = line_names(part, edits, least)
                parts.append((name, ids[line + at], role))
                part, total, at = [], 0, k
            if x is not None:
                part.append(x)
                total += len(x)
        name, line, role = (np.concatenate(p) for p in zip(*parts))
        bucket = (name % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        out = []
        for b in range(buckets):
            own = order[cuts[b]:cuts[b + 1]]
            if len(own):
                out.append((b, name[own].astype("<u8").tobytes() + line[own].astype("<i8").tobytes() + role[own].tobytes()))
        return pd.DataFrame(out, columns=["bucket", "names"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, total = {}, 0
        for b in batches:
            for t in b["text"]:
                for x in (t or "").split("\n"):
                    x = x.strip(" ")
                    if len(x) >= least:
                        key = xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"), 42)
                        if key not in held:
                            held[key] = x
                            total += len(x)
                if total >= size:
                    yield rows(held)
                    held, total = {}, 0
        if held:
            yield rows(held)
    return run


def _shared_names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(name, lid, role) of names that are a segment of one line and occur in another."""
    blocks: dict[int, list[bytes]] = {}
    for b in batches:
        for bucket, x in zip(b["bucket"], b["names"]):
            blocks.setdefault(bucket, []).append(x)
    for bucket in list(blocks):
        parts = blocks.pop(bucket)
        ns = [len(x) // 17 for x in parts]
        name = np.concatenate([np.frombuffer(x, dtype="<u8", count=n) for x, n in zip(parts, ns)])
        lid = np.concatenate([np.frombuffer(x, dtype="<i8", count=n, offset=8 * n) for x, n in zip(parts, ns)])
        role = np.concatenate([np.frombuffer(x, dtype=np.uint8, offset=16 * n) for x, n in zip(parts, ns)])
        order = np.argsort(name, kind="stable")
        name, lid, role = name[order], lid[order], role[order]
        edge = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
        ok = (np.minimum.reduceat(lid, edge) != np.maximum.reduceat(lid, edge)) & (np.maximum.reduceat(role, edge) >= 4)
        some = np.repeat(ok, np.diff(np.append(edge, len(name))))
        yield pd.DataFrame({"name": name[some].view(np.int64), "lid": lid[some], "role": role[some].astype(np.int32)}).drop_duplicates()


def _group_links(group: list[tuple], cross: bool, edits: int, chars_per_edit: int) -> list[tuple[bytes, bytes, int]]:
    """(key, root, links) of the lines of one name, from rows (key, line, role, block); ``cross``: only between blocks."""
    j = group[0][2] & 3
    rows: dict[bytes, list] = {}
    for key, x, role, block in group:
        row = rows.setdefault(bytes(key), [x, False, block])
        row[1] |= role >= 4
    if len(rows) < 2:
        return []
    by_size: dict[int, list] = {}
    for key, (x, own, block) in rows.items():
        if own:
            by_size.setdefault(len(x), []).append((key, x, block))
    up: dict[bytes, bytes] = {}
    links: dict[bytes, int] = {}

    def root(x: bytes) -> bytes:
        while up.get(x, x) != x:
            up[x] = up.get(up[x], up[x])
            x = up[x]
        return x

    for key, (x, _, block) in rows.items():
        for n in range(len(x) - edits, len(x) + 1):
            for other, y, its in by_size.get(n, ()):
                if other == key or n == len(x) and other > key or cross and its == block:
                    continue
                if within(x, y, min(edits, n // chars_per_edit)) and first_shared(x, y, edits) == j:
                    links[key], links[other] = links.get(key, 0) + 1, links.get(other, 0) + 1
                    r, s = root(key), root(other)
                    if r != s:
                        up[max(r, s)] = min(r, s)
    return [(k, root(k), n) for k, n in links.items()]


def _verified(edits: int, chars_per_edit: int):
    """Rows sorted by (name, left, right); one group is held at a time."""
    columns = ["a", "b", "n_links"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group: list[tuple] = []
        at = None
        for b in batches:
            out = []
            for name, left, right, *row in zip(b["name"], b["left"], b["right"], b["key"], b["line"], b["role"], b["block"]):
                if (name, left, right) != at:
                    if group:
                        out += _group_links(group, at[1] != at[2], edits, chars_per_edit)
                    group, at = [], (name, left, right)
                group.append(tuple(row))
            yield pd.DataFrame(out, columns=columns)
        if group:
            yield pd.DataFrame(_group_links(group, at[1] != at[2], edits, chars_per_edit), columns=columns)
    return run


def _line_rows(rows: DataFrame) -> DataFrame:
    """(id, ref, line_no, line, key) of all lines that are not blank."""
    return (rows.select("id", "ref", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "raw"))
            .select("id", "ref", "line_no", F.trim("raw").alias("line")).where("line <> ''")
            .withColumn("key", F.unhex(F.md5("line"))))


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(_id(doc_id).alias("id"), _ref(doc_id, text).alias("ref"), t.alias("text"))


def _id(doc_id: str) -> Column:
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(_LOWEST))


def _ref(doc_id: str, text: str) -> Column:
    return F.xxhash64(F.lit(1), F.col(doc_id), F.coalesce(F.col(text), F.lit("")))


def linked_lines(rows: DataFrame, *, edits: int, chars_per_edit: int, block_chars: int = 4 << 20, bucket_names: int = 4_000_000, group_rows: int = 2048) -> DataFrame:
    """(key, root, n_links) of distinct lines that have links."""
    spark = rows.sparkSession
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(least, chars // (16 * bucket_names))
    named = rows.select("text").mapInPandas(_named(edits, chars_per_edit, buckets, block_chars), "bucket long, names binary")
    shared = stored(named.repartition(buckets, "bucket").mapInPandas(_shared_names, "name long, lid long, role int"), "line-names")
    lines = _line_rows(rows).select(F.xxhash64("line").alias("lid"), "key", "line")
    texts = stored(lines.join(shared.select("lid").distinct(), "lid", "left_semi").groupBy("lid", "key").agg(F.first("line").alias("line")), "line-texts")
    parts = shared.groupBy("name").agg(F.ceil(F.count("*") / group_rows).cast("int").alias("parts"))
    rows_ = shared.join(parts, "name").join(texts, "lid").withColumn("block", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    # every row meets its block and each other block: block pairs (left, right) with left <= right
    paired = rows_.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "name", "role", "key", "line", "block", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"))
    ordered = paired.repartition("name", "left", "right").sortWithinPartitions("name", "left", "right")
    found = stored(ordered.mapInPandas(_verified(edits, chars_per_edit), "a binary, b binary, n_links long"), "line-links")
    roots = components(found.select("a", "b"))
    counts = found.groupBy("a").agg(F.sum("n_links").alias("n_links"))
    out = stored(counts.join(roots, counts["a"] == roots["node"], "left").select(F.col("a").alias("key"), F.coalesce("root", "a").alias("root"), "n_links"), "line-roots")
    drop(shared, texts, found)
    return out


def _marked(rows: DataFrame, **options) -> DataFrame:
    """(id, ref, line_no, class, n_links, repeated) of all lines that count."""
    linked = linked_lines(rows, **options)
    lines = _line_rows(rows).select("id", "ref", "line_no", "key").join(linked, "key", "left")
    lines = stored(lines.select("id", "ref", "line_no", F.coalesce("root", "key").alias("class"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "lines")
    at = F.struct("id", "ref", "line_no")
    # stored, so that the join deals both sides itself and can split a class that many lines are in
    first = stored(lines.groupBy("class").agg(F.min(at).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "line-first")
    return lines.join(first, "class", "left").withColumn("repeated", F.coalesce(F.col("first") != at, F.lit(False)))


def line_report(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", edits: int = 2, chars_per_edit: int = 20) -> DataFrame:
    """Per row: ``doc_id, n_lines, n_removed, n_links, removed`` (lines that count, removed line numbers from 0, links of its lines to different lines)."""
    rows = _rows(docs, doc_id, text)
    marked = _marked(rows, edits=edits, chars_per_edit=chars_per_edit).groupBy("id", "ref").agg(
        F.array_sort(F.collect_set(F.when(F.col("repeated"), F.col("line_no")))).alias("removed"), F.countDistinct("line_no").alias("n_lines"),
        F.sum("n_links").alias("links"), F.count("*").alias("times"))
    out = docs.select(F.col(doc_id).alias("doc_id"), _id(doc_id).alias("id"), _ref(doc_id, text).alias("ref")).join(marked, ["id", "ref"], "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", F.coalesce("n_lines", zero).alias("n_lines"), F.coalesce(F.size("removed").cast("long"), zero).alias("n_removed"),
                      F.coalesce((F.col("links") * F.col("n_lines") / F.col("times")).cast("long"), zero).alias("n_links"),
                      F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def without_repeated_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", edits: int = 2, chars_per_edit: int = 20) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``; all other columns and all rows stay."""
    gone = _marked(_rows(docs, doc_id, text), edits=edits, chars_per_edit=chars_per_edit).where("repeated").groupBy("id", "ref").agg(F.collect_set("line_no").alias("gone"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _id(doc_id).alias("id"), _ref(doc_id, text).alias("ref"))
    joined = whole.join(gone, ["id", "ref"], "left")
    lines = F.split(F.col(f"row.`{text}`"), "\n", -1)
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("gone", i)), "\n")
    value = {text: F.when(F.col("gone").isNull(), F.col(f"row.`{text}`")).otherwise(kept)}
    return joined.select(*[value.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
