"""Parquet tables in versions: staged writes, published by one rename.

A table is a folder. Rows go to ``data/commit=<id>/bucket=<n>/...``, where the
bucket is a hash of the key column; ``_versions/<number>.json`` lists, for
each bucket, the commits that are live in that version. A write first stages
its rows in a commit folder of its own; publishing the next version's file
makes them visible. A write that fails, or is empty, publishes nothing, and
readers keep the version they had. Two writers cannot publish the same number:
the later one makes its change anew on what the other left. The rename must be
atomic and refuse an existing name, as HDFS does; on an object store without
that, a table must have one writer at a time.

- ``append`` adds rows;
- ``upsert`` keeps one row of each key, rewriting only the buckets that the
  new rows touch;
- ``replace`` swaps the whole table;
- ``compact`` rewrites buckets that many commits have left in small files.

A stream names itself and its batch number (``stream``): a repeated batch adds
nothing. The version's file also holds the schema, so reading infers nothing,
and totals that a writer maintains (``totals``), in the same commit.

The file grows with buckets x live commits, not with rows; ``compact`` bounds
the commits. Rows are dealt to files with a rebalance hint, so a bucket that
holds a hot key is split over tasks.
"""
from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

BUCKETS = 16


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _names(spark: SparkSession, folder: str) -> list[str]:
    fs, p = _hadoop(spark, folder)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


class Conflict(Exception):
    """Another writer published this version first."""


class Table:
    def __init__(self, spark: SparkSession, path: str, key: str, *, buckets: int = BUCKETS, partition_by: tuple[str, ...] = ()):
        """``buckets`` holds for a new table; an existing one keeps its own."""
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.new_buckets, self.partition_by = buckets, partition_by

    # versions

    def current(self) -> dict:
        """The newest version; an empty one for a table that is not there."""
        numbers = sorted(int(n[:-5]) for n in _names(self.spark, f"{self.path}/_versions") if n.endswith(".json"))
        if not numbers:
            return {"version": 0, "buckets": self.new_buckets, "live": {}, "schema": None, "streams": {}, "totals": None}
        return self.version(numbers[-1])

    def version(self, number: int) -> dict:
        rows = self.spark.read.text(f"{self.path}/_versions/{number:012d}.json", wholetext=True).collect()
        return json.loads(rows[0][0])

    def _publish(self, state: dict) -> None:
        """Write the version aside, then rename it into place, which fails if its number is taken."""
        sc = self.spark.sparkContext
        folder = f"{self.path}/_versions"
        fs, staged = _hadoop(self.spark, f"{folder}/.{uuid.uuid4().hex}")
        out = fs.create(staged, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        target = _hadoop(self.spark, f"{folder}/{state['version']:012d}.json")[1]
        files = sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), sc._jsc.hadoopConfiguration())
        no_overwrite = sc._gateway.new_array(getattr(sc._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            files.rename(files.makeQualified(staged), files.makeQualified(target), no_overwrite)
        except Exception as e:
            fs.delete(staged, False)
            if fs.exists(target):
                raise Conflict(state["version"]) from e
            raise

    def _commit(self, change: Callable[[dict], dict | None]) -> dict:
        """Publish ``change`` of the newest version, again on a newer one if another writer came first."""
        while True:
            now = self.current()
            state = change(now)
            if state is None:
                return now
            state = {**state, "version": now["version"] + 1}
            try:
                self._publish(state)
                return state
            except Conflict:
                continue

    # rows

    def _stage(self, df: DataFrame, buckets: int) -> tuple[str, list[str]]:
        """Write rows to a commit folder: its id and the buckets that got rows."""
        commit = uuid.uuid4().hex
        bucket = F.pmod(F.xxhash64(F.col(self.key)), F.lit(buckets)).cast("int")
        dealt = df.withColumn("bucket", bucket).hint("rebalance", "bucket")
        dealt.write.partitionBy("bucket", *self.partition_by).parquet(f"{self.path}/data/commit={commit}")
        return commit, [n.removeprefix("bucket=") for n in _names(self.spark, f"{self.path}/data/commit={commit}") if n.startswith("bucket=")]

    def _staged(self, commit: str, df: DataFrame) -> DataFrame:
        folder = f"{self.path}/data/commit={commit}"
        return self.spark.read.schema(df.schema).option("basePath", folder).parquet(folder).select(*[F.col(f"`{c}`") for c in df.columns])

    def _merged_schema(self, state: dict, df: DataFrame) -> str:
        """The table's columns, then new ones; a column keeps its type."""
        known = StructType.fromJson(json.loads(state["schema"])) if state["schema"] else StructType()
        types = {f.name: f.dataType for f in known}
        for f in df.schema:
            if types.get(f.name, f.dataType) != f.dataType:
                raise ValueError(f"column {f.name} is {types[f.name].simpleString()}, not {f.dataType.simpleString()}")
            if f.name not in types:
                known = StructType([*known, StructField(f.name, f.dataType, True)])
        return known.json()

    def read(self, state: dict | None = None, buckets: list[str] | None = None) -> DataFrame | None:
        """The rows of a version (default: the newest), or of some of its buckets; None if it holds none."""
        state = state or self.current()
        folders = [f"{self.path}/data/commit={c}/bucket={b}" for b, commits in state["live"].items() if buckets is None or b in buckets for c in commits]
        if not folders:
            return None
        schema = StructType.fromJson(json.loads(state["schema"]))
        placed = StructType([*schema, StructField("commit", StringType()), StructField("bucket", IntegerType())])
        return self.spark.read.schema(placed).option("basePath", f"{self.path}/data").parquet(*folders).select(*[F.col(f"`{f}`") for f in schema.names])

    def append(self, df: DataFrame, *, stream: tuple[str, int] | None = None, totals: Callable[[DataFrame], dict] | None = None) -> dict:
        """Add rows; nothing is published if there are none. ``totals`` gives numbers (or lists of numbers) of the added rows, which are added to the table's."""
        if stream and self.current()["streams"].get(stream[0], -1) >= stream[1]:
            return self.current()
        buckets = self.current()["buckets"]
        commit, touched = self._stage(df, buckets)
        made = totals(self._staged(commit, df)) if touched and totals else None

        def change(now: dict) -> dict | None:
            if not touched or stream and now["streams"].get(stream[0], -1) >= stream[1]:
                return None
            live = {b: [*now["live"].get(b, []), commit] if b in touched else now["live"][b] for b in {**now["live"], **dict.fromkeys(touched)}}
            sums = now["totals"] if made is None else made if now["totals"] is None else {k: _added(now["totals"][k], v) for k, v in made.items()}
            return {**now, "live": live, "schema": self._merged_schema(now, df), "totals": sums, "streams": {**now["streams"], **({stream[0]: stream[1]} if stream else {})}}
        return self._commit(change)

    def upsert(self, df: DataFrame, newest: Callable[[DataFrame], DataFrame], *, stream: tuple[str, int] | None = None) -> dict:
        """Keep what ``newest`` keeps of the table's and the new rows of each key; only touched buckets are rewritten. The table then has no totals."""
        if stream and self.current()["streams"].get(stream[0], -1) >= stream[1]:
            return self.current()
        buckets = self.current()["buckets"]
        staged, touched = self._stage(df, buckets)

        def change(now: dict) -> dict | None:
            if not touched or stream and now["streams"].get(stream[0], -1) >= stream[1]:
                return None
            own, added = self.read(now, touched), self._staged(staged, df)
            rows = added if own is None else own.unionByName(added, allowMissingColumns=True)
            commit, kept = self._stage(newest(rows), buckets)
            live = {b: c for b, c in now["live"].items() if b not in touched} | {b: [commit] for b in kept}
            return {**now, "live": live, "schema": self._merged_schema(now, df), "totals": None, "streams": {**now["streams"], **({stream[0]: stream[1]} if stream else {})}}
        out = self._commit(change)
        self._drop(staged)
        return out

    def replace(self, df: DataFrame, *, totals: Callable[[DataFrame], dict] | None = None) -> dict | None:
        """Swap the whole table; None, and the table as it was, if there are no rows."""
        buckets = self.current()["buckets"]
        commit, touched = self._stage(df, buckets)
        if not touched:
            return None
        made = totals(self._staged(commit, df)) if totals else None
        return self._commit(lambda now: {**now, "live": {b: [commit] for b in touched}, "schema": df.schema.json(), "totals": made})

    def clear(self) -> dict:
        """An empty version."""
        return self._commit(lambda now: {**now, "live": {}, "totals": None})

    def compact(self, most: int = 8) -> dict:
        """Rewrite buckets that more than ``most`` commits share."""
        def change(now: dict) -> dict | None:
            many = [b for b, c in now["live"].items() if len(c) > most]
            if not many:
                return None
            commit, _ = self._stage(self.read(now, many), now["buckets"])
            return {**now, "live": {b: [commit] if b in many else c for b, c in now["live"].items()}}
        return self._commit(change)

    def vacuum(self, keep: int = 2) -> list[str]:
        """Remove what the newest ``keep`` versions do not use; not while a writer stages rows."""
        numbers = sorted(int(n[:-5]) for n in _names(self.spark, f"{self.path}/_versions") if n.endswith(".json"))
        used = {c for n in numbers[-keep:] for commits in self.version(n)["live"].values() for c in commits}
        gone = [c for n in _names(self.spark, f"{self.path}/data") if n.startswith("commit=") and (c := n.removeprefix("commit=")) not in used]
        for c in gone:
            self._drop(c)
        for n in numbers[:-keep]:
            fs, p = _hadoop(self.spark, f"{self.path}/_versions/{n:012d}.json")
            fs.delete(p, False)
        return gone

    def _drop(self, commit: str) -> None:
        fs, p = _hadoop(self.spark, f"{self.path}/data/commit={commit}")
        fs.delete(p, True)


def _added(a, b):
    return [x + y for x, y in zip(a, b)] if isinstance(a, list) else a + b


def newest_by(key: str, *order: Column) -> Callable[[DataFrame], DataFrame]:
    """One row of each key: the greatest by ``order``, ties by a digest of the row. A partial
    aggregate, so a key with very many versions is not gathered in a task."""
    def keep(rows: DataFrame) -> DataFrame:
        every = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
        digest = F.bitwise_not(F.xxhash64(*[F.col(f"`{c}`") for c in sorted(rows.columns)]))
        return rows.groupBy(F.col(key).alias("_key")).agg(F.max_by(every, F.struct(*order, digest)).alias("_row")).select("_row.*")
    return keep
