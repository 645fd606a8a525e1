"""Exact top-k by inner product with a KD-tree per shard.

Vectors are dealt to regions by median splits along the widest axis, fitted on
a bounded sample (``SAMPLE`` rows of each length, the first by a hash); every
row is then placed, and each region gets the tight box of all its rows. A
region of more than ``shard_rows`` rows has several shards. A shard's own tree
goes on splitting at medians; every leaf keeps a tight bounding box. The
largest inner product a query can have in a box is the sum of ``max(q * low,
q * high)`` over the axes. Best-first order visits boxes by falling bound and
stops below the kth score so far (an equal bound is still visited: a smaller
id may win the tie).

Pass 1 searches the shard that a query's own row is in. Its kth score is
propagated: pass 2 sends the query only to shards of regions whose box can
hold as good a score, and searches them above that score. Queries come in
chunks of at most ``query_rows``, so a task holds one shard and one chunk.
A window keeps the best k of a query's partial results.

How much is pruned depends on the vectors: on clustered ones most regions are
never visited, on random directions in many dimensions no box excludes the kth
score, and every query visits every shard.

Scores are integer inner products: float64 matrix products where every
partial sum is below 2**53, Python integers elsewhere. Bounds of regions carry
a margin for rounding.

Defined cases: vectors that are null or hold null or non-finite components,
or whose id is null, take no part, nor do those with a component that a long
can't hold; a score beyond a long is the nearest one; vectors of another length than the query's
are no candidates; repeated rows are rows of their own; fewer than k
candidates give all of them; an empty table gives an empty result.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import again, drop, stored

_MOST = (1 << 63) - 1
_NONE = -(1 << 63)  # no kth score yet: a null would make pandas read the column as floats
#: Rows of the sample that regions are fitted on, and the most regions of one vector length (their boxes are broadcast).
SAMPLE, REGIONS = 20_000, 4096
_OUT = "query_row long, query_id {id}, row long, vec_id {id}, score long"


def quantised(x: Column, scale: int) -> Column:
    return F.transform(x, lambda v: F.floor(v.cast("double") * F.lit(float(scale))))


def build_tree(points: np.ndarray, leaf_rows: int = 256) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Leaves (row numbers) with their boxes' low and high corners."""
    leaves, stack = [], [np.arange(len(points))]
    while stack:
        own = stack.pop()
        part = points[own]
        width = part.max(0) - part.min(0) if len(own) else np.zeros(1)
        if len(own) <= leaf_rows or not width.any():
            leaves.append(own)
            continue
        axis = int(np.argmax(width))
        order = np.argpartition(part[:, axis], len(own) // 2)
        stack += [own[order[:len(own) // 2]], own[order[len(own) // 2:]]]
    return leaves, np.stack([points[x].min(0) for x in leaves]), np.stack([points[x].max(0) for x in leaves])


class Splits:
    """Median splits of a sample: every vector of its length has one region."""

    def __init__(self, sample: np.ndarray, regions: int):
        self.axis, self.cut, self.child, self.region = [], [], [], []
        self.regions = 0
        self._node(sample, max(1, regions))

    def _node(self, part: np.ndarray, regions: int) -> int:
        at = len(self.axis)
        for x in (self.axis, self.cut, self.child, self.region):
            x.append(0)
        width = part.max(0) - part.min(0) if len(part) else np.zeros(1)
        axis = int(np.argmax(width)) if width.size else 0
        cut = float(np.median(part[:, axis])) if regions > 1 and width.size and width[axis] > 0 else None
        low = part[:, axis] <= cut if cut is not None else None
        if low is None or low.all():
            self.child[at], self.region[at] = (-1, -1), self.regions
            self.regions += 1
            return at
        self.axis[at], self.cut[at] = axis, cut
        left = self._node(part[low], regions // 2)
        self.child[at] = (left, self._node(part[~low], regions - regions // 2))
        return at

    def of(self, points: np.ndarray) -> np.ndarray:
        """Regions of float64 ``points``."""
        axis, cut, child, region = np.array(self.axis), np.array(self.cut, dtype=np.float64), np.array(self.child), np.array(self.region)
        at = np.zeros(len(points), dtype=np.int64)
        while True:
            inner = np.flatnonzero(child[at, 0] >= 0)
            if not len(inner):
                return region[at]
            own = at[inner]
            at[inner] = np.where(points[inner, axis[own]] <= cut[own], child[own, 0], child[own, 1])


def _floats(column: pd.Series) -> np.ndarray:
    return np.stack(list(column)).astype(np.float64)


def _by_length(b: pd.DataFrame):
    size = b["x"].map(len)
    for dim in size.unique():
        yield int(dim), b[size == dim]


def fitted(base: DataFrame, shard_rows: int) -> dict[int, Splits]:
    """Splits for each vector length, from a bounded sample of ``base(x, row)``."""
    counts = base.groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("n")).where(F.col("n") > shard_rows)
    out = {}
    for r in counts.collect():  # lengths with more than a shard of vectors
        sample = base.where(F.size("x") == r["dim"]).orderBy(F.xxhash64("row"), "row").limit(SAMPLE).select("x").collect()
        out[r["dim"]] = Splits(np.array([x[0] for x in sample], dtype=np.float64), min(REGIONS, -(-r["n"] // shard_rows)))
    return out


def placed(base: DataFrame, splits: dict[int, Splits]) -> DataFrame:
    """``base`` with ``dim`` and ``region``."""
    def run(batches):
        for b in batches:
            for dim, part in _by_length(b):
                tree = splits.get(dim)
                yield part.assign(dim=dim, region=0 if tree is None else tree.of(_floats(part["x"])))

    fields = ", ".join(f"`{n}` {t}" for n, t in base.dtypes)
    return base.mapInPandas(run, f"{fields}, dim int, region long")


def boxes(rows: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: regions with the low and high corners of all their rows."""
    def run(batches):
        held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for (dim, region), part in b.groupby(["dim", "region"]):
                m = np.stack(list(part["x"]))
                low, high = m.min(0), m.max(0)
                if (dim, region) in held:
                    low, high = np.minimum(low, held[dim, region][0]), np.maximum(high, held[dim, region][1])
                held[dim, region] = low, high
        yield pd.DataFrame([(d, r, low, high) for (d, r), (low, high) in held.items()], columns=["dim", "region", "low", "high"])

    def joined(key, part):
        return pd.DataFrame({"dim": [key[0]], "region": [key[1]], "low": [np.stack(list(part["low"])).min(0)], "high": [np.stack(list(part["high"])).max(0)]})

    kind = "dim int, region long, low array<long>, high array<long>"
    each = rows.select("dim", "region", "x").mapInPandas(run, kind).groupBy("dim", "region").applyInPandas(joined, kind)
    out: dict[int, list] = {}
    for r in each.toLocalIterator():  # at most REGIONS rows a length
        out.setdefault(r["dim"], []).append((r["region"], r["low"], r["high"]))
    return {d: tuple(np.array(c, dtype=np.float64 if k else np.int64) for k, c in enumerate(zip(*x))) for d, x in out.items()}


def routed(asking: DataFrame, shared) -> DataFrame:
    """``asking(.., x, dim, kth)`` once for each region whose box may hold a score of at least ``kth`` (``_NONE``: any)."""
    def run(batches):
        for b in batches:
            for dim, part in _by_length(b):
                region, low, high = shared.value[dim]
                q = _floats(part["x"])
                for a in range(0, len(part), 1024):
                    some, own = part.iloc[a:a + 1024], q[a:a + 1024]
                    bound = np.maximum(own, 0) @ high.T + np.minimum(own, 0) @ low.T
                    margin = np.abs(own) @ np.maximum(np.abs(low), np.abs(high)).T * 1e-12 + 1.0
                    kth = some["kth"].to_numpy()
                    n, k = np.nonzero((kth == _NONE)[:, None] | (bound + margin >= kth.astype(np.float64)[:, None]))
                    yield some.iloc[n].assign(region=region[k])

    fields = ", ".join(f"`{n}` {t}" for n, t in asking.dtypes)
    return asking.mapInPandas(run, f"{fields}, region long")


def search(points: np.ndarray, ids: np.ndarray, rows: np.ndarray, queries: np.ndarray, own: np.ndarray, floor: list, k: int,
           leaf_rows: int = 256) -> list[list[tuple[int, int]]]:
    """Per query the best (score, point number), none below its ``floor`` score (None: no floor)."""
    leaves, low, high = build_tree(points, leaf_rows)
    bound = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
    order = np.argsort(-bound, axis=1, kind="stable")
    best: list[list[tuple]] = [[] for _ in queries]  # (score, -id, -row, point), sorted, at most k
    kth = [f for f in floor]
    turn = 0
    active = np.arange(len(queries))
    while turn < len(leaves) and len(active):
        at = order[active, turn]
        active = np.array([q for q, leaf in zip(active, at) if kth[q] is None or bound[q, leaf] >= kth[q]], dtype=np.int64)
        at = order[active, turn] if len(active) else at
        for leaf in np.unique(at) if len(active) else ():
            qs, members = active[at == leaf], leaves[leaf]
            scores = queries[qs] @ points[members].T
            for q, row in zip(qs, scores):
                row = np.where(rows[members] == own[q], -np.inf, row) if row.dtype != object else np.array([float("-inf") if r == own[q] else s for s, r in zip(row, rows[members])], dtype=object)
                edge = kth[q]
                if len(row) > k and row.dtype != object:
                    cut = -np.partition(-row, k - 1)[k - 1]
                    edge = cut if edge is None else max(edge, cut)
                good = np.flatnonzero(row > -np.inf if edge is None else (row >= edge) & (row > -np.inf))
                if len(good):
                    new = [(max(min(int(row[g]), _MOST), -_MOST), -ids[members[g]], -rows[members[g]], members[g]) for g in good]
                    best[q] = sorted(best[q] + new, reverse=True)[:k]
                    if len(best[q]) == k:
                        kth[q] = best[q][-1][0] if kth[q] is None else max(kth[q], best[q][-1][0])
        turn += 1
    return [[(b[0], b[3]) for b in own_best] for own_best in best]


def _matrix(column: pd.Series, limit: int) -> np.ndarray:
    m = np.stack(list(column)) if len(column) else np.zeros((0, 0), dtype=np.int64)
    small = float(np.abs(m.astype(np.float64)).max(initial=0.0)) <= limit
    return m.astype(np.float64) if small else m.astype(object)


def _search_pair(k: int, leaf_rows: int):
    def run(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(vectors) and len(queries):
            limit = int((2.0**53 / max(1, len(vectors["x"].iloc[0]))) ** 0.5)
            points, asked = _matrix(vectors["x"], limit), _matrix(queries["x"], limit)
            if points.dtype != asked.dtype:
                points, asked = (np.stack(list(c)).astype(object) for c in (vectors["x"], queries["x"]))
            ids, rows = vectors["vec_id"].to_numpy(), vectors["row"].to_numpy()
            floors = [None if f == _NONE else int(f) for f in queries["kth"]]
            found = search(points, ids, rows, asked, queries["row"].to_numpy(), floors, k, leaf_rows)
            for qrow, qid, hits in zip(queries["row"], queries["vec_id"], found):
                out += [(qrow, qid, rows[p], ids[p], s) for s, p in hits]
        return pd.DataFrame(out, columns=["query_row", "query_id", "row", "vec_id", "score"])
    return run


def visits(asking: DataFrame, shared, sizes: DataFrame) -> DataFrame:
    """Queries with their ``kth``, once for each further shard that may hold as good a score."""
    home = asking.withColumnsRenamed({"region": "home_region", "part": "home_part"})
    sent = routed(home, shared).join(sizes, ["dim", "region"])
    sent = sent.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    return sent.where((F.col("region") != F.col("home_region")) | (F.col("part") != F.col("home_part"))).drop("parts", "home_region", "home_part")


def top_k(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", is_query: Column | None = None, k: int = 20,
          scale: int = 64, shard_rows: int = 8192, query_rows: int = 65536, leaf_rows: int = 256) -> DataFrame:
    """``query_id, rank, vec_id, score`` (ranks from 1, ties to the smaller vec_id)."""
    id_, x = F.col(vec_id), F.col(embedding)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) * scale < F.lit(2.0**62)))
    asked = is_query if is_query is not None else id_ % 20 == 0
    base = (vectors.where(id_.isNotNull() & x.isNotNull() & (F.size(x) > 0)).where(finite)
            .select(id_.alias("vec_id"), quantised(x, scale).alias("x"), asked.alias("asked"), F.monotonically_increasing_id().alias("row")))
    given = stored(base, "kd-given")
    base = stored(placed(given, fitted(again(given), shard_rows)), "kd-vectors")
    drop(given)
    n_queries = base.where("asked").count()
    chunks = max(1, -(-n_queries // query_rows))
    kind = dict(base.dtypes)["vec_id"]
    schema = _OUT.format(id=kind)
    sizes = stored(again(base).groupBy("dim", "region").agg(F.ceil(F.count("*") / shard_rows).alias("parts")), "kd-sizes")
    dealt = stored(base.join(sizes, ["dim", "region"]).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts"))).drop("parts"), "kd-shards")
    queries = again(dealt).where("asked").withColumn("kth", F.lit(_NONE).cast("long"))
    pair = _search_pair(k, leaf_rows)
    keep = ["vec_id", "x", "row"]

    def searched(v: DataFrame, q: DataFrame, *keys: str) -> DataFrame:
        left, right = v.select(*keys, *keep).groupBy(*keys), q.select(*keys, *keep, "kth").groupBy(*keys)
        return left.cogroup(right).applyInPandas(pair, schema)

    first = stored(searched(dealt, queries, "dim", "region", "part"), "kd-own")
    parts = first
    if again(sizes).agg(F.sum("parts")).first()[0] not in (None, 1):
        kth = first.groupBy("query_row").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth")).withColumnRenamed("query_row", "row")
        asking = visits(queries.drop("kth").join(kth, "row", "left").withColumn("kth", F.coalesce("kth", F.lit(_NONE).cast("long"))), vectors.sparkSession.sparkContext.broadcast(boxes(again(dealt))), again(sizes))
        asking = asking.withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(chunks)))
        replicated = again(dealt).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)).cast("array<long>")))
        parts = first.unionByName(searched(replicated, asking, "dim", "region", "part", "chunk"))
    best = Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("vec_id"), F.col("row"))
    out = stored(parts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "kd-best")
    drop(base, sizes, dealt, first)
    return out
