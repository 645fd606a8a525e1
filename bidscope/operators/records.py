"""Record store: normalised records in a versioned table, bucketed by id and
partitioned by ``record_type`` (filters on the type prune partitions), with
id / creation time defaults, append, upsert by id and truncate.

A batch job and a stream write through the same commit (see ``versions``): a
failed write leaves the version before it, and a repeated micro-batch adds
nothing."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .versions import BUCKETS, Table, newest_by

# Length of the preview beside the whole text; default type.
PREVIEW_CHARS = 5000
DEFAULT_RECORD_TYPE = "document"
EMPTY_SCHEMA = "id string, created_at timestamp, record_type string"


def prepare_records(df: DataFrame) -> DataFrame:
    """Defaults: ``id`` = new UUID, ``created_at`` = now (UTC),
    ``record_type`` = 'document'. ``raw_text`` is stored whole, with its
    beginning in ``raw_preview`` beside it."""
    out = df
    if "id" not in out.columns:
        out = out.withColumn("id", F.lit(None).cast("string"))
    if "created_at" not in out.columns:
        out = out.withColumn("created_at", F.lit(None).cast("timestamp"))
    if "record_type" not in out.columns:
        out = out.withColumn("record_type", F.lit(None).cast("string"))
    out = out.withColumns({
        "id": F.coalesce(F.col("id"), F.expr("uuid()")),
        "created_at": F.coalesce(F.col("created_at"), F.current_timestamp()),
        "record_type": F.coalesce(F.col("record_type"), F.lit(DEFAULT_RECORD_TYPE)),
    })
    if "raw_text" in out.columns:
        out = out.withColumn("raw_preview", F.substring("raw_text", 1, PREVIEW_CHARS))
    return out


def store(spark: SparkSession, path: str, buckets: int = BUCKETS) -> Table:
    return Table(spark, path, "id", buckets=buckets, partition_by=("record_type",))


def append_records(df: DataFrame, path: str, stream: tuple[str, int] | None = None) -> None:
    """Add records, whatever their ids."""
    store(df.sparkSession, path).append(prepare_records(df), stream=stream)


def upsert_records(df: DataFrame, path: str, stream: tuple[str, int] | None = None) -> None:
    """Keep the newest record of each id, of those stored and those given;
    only the buckets of the given ids are rewritten."""
    store(df.sparkSession, path).upsert(prepare_records(df), latest_by_id, stream=stream)


def list_records(spark: SparkSession, path: str, record_type: str | None = None) -> DataFrame:
    """All records, or those of one type (a partition filter: only that
    type's folders are read). An empty store reads as no rows."""
    df = store(spark, path).read()
    if df is None:
        return spark.createDataFrame([], EMPTY_SCHEMA)
    return df.filter(F.col("record_type") == record_type) if record_type else df


def latest_by_id(df: DataFrame) -> DataFrame:
    """The newest version of each id; versions of the same instant are
    ordered by a digest of their content."""
    return newest_by("id", F.col("created_at"))(df)


def delete_all_records(spark: SparkSession, path: str) -> None:
    """Empty the store: a version without rows; ``vacuum`` removes the files."""
    store(spark, path).clear()
