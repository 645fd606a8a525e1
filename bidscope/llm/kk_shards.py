"""Byte-balanced sharding of indivisible groups by Karmarkar-Karp differencing.

Equal texts form a group that stays in one shard. Groups are pre-aggregated by
a text digest. A group of at least ``1 / units`` of all bytes is an item of
its own (there are fewer than ``units`` of these); smaller groups of one task
are put together to items of about that size. So the differencing works on a
bounded number of items, however many groups there are, and one task can hold
them all. It repeatedly combines the two partial partitions with the largest
spread, oppositely ordered, until one is left.

A slot is a row's gapless number within its shard: tasks number their rows
per shard while they write them, and a small prefix sum over (task, shard)
counts gives each task's start. No shard is gathered in one task.

Defined cases: a null text has no bytes (size 1) and is grouped with empty
texts; repeated rows each get a slot; an empty table gives an empty result.
"""
from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import drop, stored, with_columns


def karmarkar_karp(sizes: list[int], shards: int) -> list[int]:
    """Shard of each item. Differences are kept sorted descending and relative to the smallest part."""
    if not sizes:
        return []
    heap = []
    for i, s in enumerate(sizes):
        heap.append((-s, i, [s] + [0] * (shards - 1), [[i]] + [[] for _ in range(shards - 1)]))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, i, a, own_a = heapq.heappop(heap)
        _, _, b, own_b = heapq.heappop(heap)
        parts = []
        for k in range(shards):
            x, y = own_a[k], own_b[shards - 1 - k]
            if len(x) < len(y):
                x, y = y, x
            x.extend(y)
            parts.append((a[k] + b[shards - 1 - k], x))
        parts.sort(key=lambda p: -p[0])
        low = parts[-1][0]
        heapq.heappush(heap, (low - parts[0][0], i, [p[0] - low for p in parts], [p[1] for p in parts]))
    out = [0] * len(sizes)
    for shard, own in enumerate(heap[0][3]):
        for i in own:
            out[i] = shard
    return out


def _items(unit: int):
    """Groups (sig, bytes) -> (sig, bytes, item): large groups alone, small ones in runs of at least ``unit`` bytes."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, n, open_bytes = TaskContext.get().partitionId(), 0, 0
        small = f"{task}:s0"
        for b in batches:
            names = []
            for size in b["bytes"]:
                n += 1
                if size >= unit:
                    names.append(f"{task}:{n}")
                    continue
                if open_bytes >= unit:
                    small, open_bytes = f"{task}:s{n}", 0
                open_bytes += size
                names.append(small)
            yield b.assign(item=names)
    return run


def _assign(shards: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)  # at most 2 x units items and one per task
        if parts:
            items = pd.concat(parts).sort_values(["bytes", "item"], ascending=[False, True])
            items["shard"] = karmarkar_karp([int(x) for x in items["bytes"]], shards)
            yield items[["item", "shard"]]
    return run


def _number():
    task, seen = TaskContext.get().partitionId(), {}

    def step(c):
        at = []
        for s in c["shard"]:
            at.append(seen.get(s, 0))
            seen[s] = at[-1] + 1
        return None, {"task": [task] * len(at), "at": at}
    step.reads = ("shard",)
    return step


def shard_by_bytes(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shards: int = 8, units: int = 8192) -> DataFrame:
    """Per row: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t).alias("text_crc32"), F.unhex(F.sha2(t, 256)).alias("sig"))
    rows = stored(rows, "kk-rows")
    groups = rows.groupBy("sig").agg(F.sum("size").alias("bytes"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    unit = max(1, -(-total // units))
    items = stored(groups.mapInPandas(_items(unit), "sig binary, bytes long, item string"), "kk-items")
    sums = items.groupBy("item").agg(F.sum("bytes").alias("bytes"))
    of_item = stored(sums.coalesce(1).mapInPandas(_assign(shards), "item string, shard int"), "kk-shards")
    of_group = items.join(of_item, "item").select("sig", "shard")
    placed = rows.join(of_group, "sig").select("doc_id", "size", "text_crc32", "shard")
    placed = stored(with_columns(placed, placed.columns, "task int, at long", _number), "kk-placed")
    drop(rows, items, of_item)
    counts = placed.groupBy("shard", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return (placed.join(starts, ["shard", "task"])
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("at")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")))
