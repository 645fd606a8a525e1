"""SimHash near-duplicates with vantage-point trees over Hamming distance.

Fingerprints of 64 bits link when at most ``radius`` bits differ. If so, one
of the two halves differs in at most ``radius // 2`` bits. So there is one
tree for either half: its upper part, grown on a bounded sample, deals the
distinct fingerprints to shards by their distance to vantage points. Where a
ball around a fingerprint crosses a boundary, a copy visits the shard on the
other side (triangle inequality), so no pair is lost. A shard grows its own
subtree in the same way, and checks whole fingerprints in the leaves. When a
half no longer splits a node (many equal halves), the whole fingerprint and
the whole radius take over.

A shard reports its links as a forest, one link per fingerprint at most, so
a dense group never gives all its pairs. Components come from star steps on
these links. Only the sample and the upper trees pass through the driver.

Defined cases: a null text has no words, as an empty one; no words give
fingerprint zero; with fewer words than a shingle the whole sequence is the
only shingle; repeated rows each get the component; an empty table gives an
empty result.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .tables import drop, stored, with_columns

_HALVES = (np.uint64(0xFFFFFFFF), np.uint64(0xFFFFFFFF00000000))
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, shingle: int = 3, block: int = 1 << 15) -> int:
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    counts = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, block):
        part = words[at:min(at + block, n) + shingle - 1]
        joined = map(b" ".join, zip(*[part[k:] for k in range(shingle)])) if len(part) >= shingle else [b" ".join(part)]
        h = np.array([digest(s, 42) for s in joined], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(sum(1 << int(i) for i in np.flatnonzero(counts * 2 > n)))


def fingerprints(docs: DataFrame, doc_id: str, text: str, shingle: int) -> DataFrame:
    """(doc_id, fp): fp as a signed long."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def start():
        return lambda c: (None, {"fp": np.array([fingerprint(t, shingle) for t in c["text"]], dtype=np.uint64).view(np.int64)})

    return with_columns(source, ["doc_id"], "fp long", start)


def _distance(fps: np.ndarray, vantage: np.uint64, mask: np.uint64) -> np.ndarray:
    return np.bitwise_count((fps ^ vantage) & mask)


def _vantage(fps: np.ndarray, mask: np.uint64) -> tuple[np.uint64, int] | None:
    """The point among a few that splits best, and its median distance; None if none splits."""
    best = None
    for k in np.linspace(0, len(fps) - 1, 5).astype(int):
        d = _distance(fps, fps[k], mask)
        m = int(np.median(d))
        inner = int((d <= m).sum())
        if inner == len(fps):
            m -= 1
            inner = int((d <= m).sum())
        if 0 < inner < len(fps) and (best is None or abs(2 * inner - len(fps)) < best[0]):
            best = abs(2 * inner - len(fps)), fps[k], m
    return None if best is None else (best[1], best[2])


def upper_tree(sample: np.ndarray, half: int, leaf: int) -> list[tuple]:
    """Nodes (vantage, distance, mask, inner, outer); a child below zero is shard ``-1 - child``."""
    nodes: list = []
    shards = 0
    stack = [(sample, _HALVES[half], None)]
    while stack:
        fps, mask, parent = stack.pop()
        split = _vantage(fps, mask) if len(fps) > leaf else None
        if split is None and len(fps) > leaf and mask != _ALL:
            mask = _ALL
            split = _vantage(fps, mask)
        if split is None:
            here = -1 - shards
            shards += 1
        else:
            here = len(nodes)
            nodes.append([split[0], split[1], mask, 0, 0])
            inner = _distance(fps, split[0], mask) <= split[1]
            stack += [(fps[inner], mask, (here, 3)), (fps[~inner], mask, (here, 4))]
        if parent:
            nodes[parent[0]][parent[1]] = here
    return [tuple(n) for n in nodes]


def _reach(mask: np.uint64, radius: int) -> int:
    return radius if mask == _ALL else radius // 2


def deal(fps: np.ndarray, nodes: list[tuple], radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, shard, home): every fingerprint's home shard and the shards that it visits."""
    out = []
    stack = [(0 if nodes else -1, np.arange(len(fps)), np.ones(len(fps), dtype=bool))]
    while stack:
        node, at, home = stack.pop()
        if not len(at):
            continue
        if node < 0:
            out.append((at, np.full(len(at), -1 - node, dtype=np.int64), home))
            continue
        vantage, m, mask, inner, outer = nodes[node]
        d, r = _distance(fps[at], vantage, mask).astype(np.int64), _reach(mask, radius)
        near = d <= m
        # of two home points on either side the inner one visits, so each pair meets once
        to_inner = near | (~home & (d - r <= m))
        to_outer = ~near | (d + r > m)
        stack.append((inner, at[to_inner], home[to_inner]))
        stack.append((outer, at[to_outer], (home & ~near)[to_outer]))
    if not out:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)
    return tuple(np.concatenate(x) for x in zip(*out))


class _Forest:
    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (p := up.get(x, x)) != x:
            up[x] = up.get(p, p)
            x = p
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _labels(h: np.ndarray, both: np.ndarray, radius: int, rows: int = 256) -> np.ndarray:
    """For each of ``both`` (which begins with ``h``) the first place that it reaches through links of ``h``."""
    label = np.arange(len(both))
    for at in range(0, len(h), rows):
        x, y = np.nonzero(np.bitwise_count(h[at:at + rows, None] ^ both[None, :]) <= radius)
        x, y = x[y > x + at] + at, y[y > x + at]
        while True:
            while (label[label] != label).any():
                label = label[label]
            apart = label[x] != label[y]
            if not apart.any():
                break
            x, y = x[apart], y[apart]
            # only roots move, so no node leaves its group behind
            a, b = label[x], label[y]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
    return label


def shard_links(home: np.ndarray, visit: np.ndarray, half: int, radius: int, leaf: int = 384) -> list[tuple[int, int]]:
    """Forest over the pairs (home, home) and (home, visitor) within ``radius``."""
    forest = _Forest()
    stack = [(home, visit, _HALVES[half])]
    while stack:
        h, v, mask = stack.pop()
        if not len(h) or len(h) + len(v) < 2:
            continue
        split = _vantage(h, mask) if len(h) > leaf else None
        if split is None and len(h) > leaf and mask != _ALL:
            mask = _ALL
            split = _vantage(h, mask)
        if split is not None:
            (p, m), r = split, _reach(mask, radius)
            dh, dv = _distance(h, p, mask).astype(np.int64), _distance(v, p, mask).astype(np.int64)
            near = dh <= m
            stack.append((h[near], v[dv - r <= m], mask))
            stack.append((h[~near], np.concatenate([v[dv + r > m], h[near & (dh + r > m)]]), mask))
            continue
        both = np.concatenate([h, v])
        label = _labels(h, both, radius)
        for a in np.flatnonzero(label != np.arange(len(both))):
            forest.join(int(both[a]), int(both[label[a]]))
    return [(x, forest.root(x)) for x in forest.up]


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 3,
                    sample_rows: int = 1 << 16, shard_rows: int = 2048, max_shards: int = 4096) -> DataFrame:
    """Per row: ``doc_id, fingerprint, component_id`` (smallest doc_id reachable)."""
    spark = docs.sparkSession
    rows = stored(fingerprints(docs, doc_id, text, shingle), "simhash-rows")
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-fps")
    n = distinct.count()
    share = min(1.0, sample_rows / max(1, n))
    picked = distinct.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))).select("fp")
    sample = np.sort(np.array([r[0] for r in picked.collect()], dtype=np.int64).view(np.uint64))  # about sample_rows at most
    np.random.default_rng(7).shuffle(sample)
    leaf = max(1, int(max(shard_rows * share, len(sample) / max_shards)))
    trees = spark.sparkContext.broadcast([upper_tree(sample, half, leaf) for half in (0, 1)])

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fps = b["fp"].to_numpy().view(np.uint64)
            for half in (0, 1):
                at, shard, home = deal(fps, trees.value[half], radius)
                yield pd.DataFrame({"half": half, "shard": shard, "fp": fps[at].view(np.int64), "home": home})

    def linked(b: pd.DataFrame) -> pd.DataFrame:
        fps, home = b["fp"].to_numpy().view(np.uint64), b["home"].to_numpy()
        found = shard_links(fps[home], fps[~home], int(b["half"].iloc[0]), radius)
        out = np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"a": out[:, 0], "b": out[:, 1]})

    spread = distinct.select("fp").mapInPandas(dealt, "half int, shard long, fp long, home boolean")
    links = spread.groupBy("half", "shard").applyInPandas(linked, "a long, b long")
    roots = components(links)
    grouped = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    of_fp = stored(grouped.join(smallest, "root").select("fp", "component_id"), "simhash-components")
    drop(distinct)
    return rows.join(of_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
