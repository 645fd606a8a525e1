"""Input tables and stored intermediate tables of the llm operators."""
from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_dir, ship_package

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_WRITTEN: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A given table; workers get the package, since operators run Python there."""
    ship_package(spark)
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def stored(df: DataFrame, tag: str, *partition_by: str) -> DataFrame:
    """Write ``df`` once under the cluster's shared folder and read it back.

    Cuts the lineage: a lost executor re-reads files instead of recomputing.
    The folder lives until ``drop`` or the end of the driver.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{tag}-{uuid.uuid4().hex}"
    w = df.write.option("compression", "zstd")
    # the shuffle files of this write have no later reader; whole texts make large rows, so batches are short
    before = {k: spark.conf.get(k) for k in (_CLEAN, _BATCH)}
    spark.conf.set(_CLEAN, "true")
    spark.conf.set(_BATCH, str(min(int(before[_BATCH]) if int(before[_BATCH]) > 0 else 1000, 1000)))
    try:
        (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    _WRITTEN[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def again(t: DataFrame) -> DataFrame:
    """A stored table read anew, so that it can meet itself in a join or cogroup."""
    out = t.sparkSession.read.schema(t.schema).parquet(t._stored_path)
    out._stored_path = t._stored_path
    return out


def drop(*tables: DataFrame) -> None:
    """Remove stored tables that nothing reads any more."""
    for t in tables:
        path = getattr(t, "_stored_path", None)
        if path in _WRITTEN:
            _delete(path)


def _delete(path: str) -> None:
    spark = _WRITTEN.pop(path)
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _drop_all() -> None:
    for path, spark in list(_WRITTEN.items()):
        if spark.sparkContext._jsc is None:  # the session has ended
            _WRITTEN.pop(path)
        else:
            _delete(path)


def with_columns(df: DataFrame, keep: list[str], fields: str, start) -> DataFrame:
    """``keep`` columns untouched, with new ``fields`` computed in Arrow batches.

    ``start()`` runs once per task and returns a function of a batch's columns
    (name -> list) that gives (rows or None, name -> values). With ``rows``,
    output row k repeats the kept columns of input row ``rows[k]``. Kept
    columns never pass through pandas, where whole numbers beside nulls would
    become floats.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    new = StructType.fromDDL(fields)
    types = {f.name: to_arrow_type(f.dataType) for f in new}
    used = df.columns
    names = [*keep, *types]

    def run(batches):
        step = start()
        for b in batches:
            rows, made = step({c: b.column(c).to_pylist() for c in used if c not in keep or c in _needed(step)})
            kept = [b.column(c) if rows is None else b.column(c).take(pa.array(rows, type=pa.int64())) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(made[c], type=t) for c, t in types.items())], names=names)

    return df.mapInArrow(run, StructType([*(df.schema[c] for c in keep), *new]))


def _needed(step) -> tuple[str, ...]:
    """Kept columns that the step reads as well."""
    return getattr(step, "reads", ())
