"""Incremental appends as Structured Streaming queries.

New documents / records dropped into a landing folder are chunked, embedded
and appended to the chunk index, or stamped and put into the record store.
Each micro-batch goes through the commit that batch jobs use, under the name
of its checkpoint and its batch number, so batch and stream writes share one
table, and a batch that is repeated after a failure adds nothing. The
checkpoint folder (under the session's shared folder) lets a restarted query
resume where it stopped. ``trigger(availableNow=True)`` processes what has
landed and stops, which suits scheduled runs; drop it for a continuously
running query.

Uploaded files land as a stream too: the bytes of each micro-batch are
appended once, and a small table keyed by (unit, name) keeps the newest copy.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import index_store, records
from ..operators.versions import Table, newest_by
from ..sources.ingest import base_name, classify, folder

DOC_SCHEMA = "doc_id long, raw_text string, source string, file_type string, supplier_name string"
FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def _started(df: DataFrame, checkpoint: str, write, once: bool) -> StreamingQuery:
    w = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append")
    if once:
        w = w.trigger(availableNow=True)
    return w.start()


def index_stream(spark: SparkSession, landing_dir: str, index_path: str, checkpoint: str,
                 embedder, schema: str = DOC_SCHEMA, once: bool = True) -> StreamingQuery:
    """Stream documents from ``landing_dir`` (parquet) into the chunk index.
    ``embedder`` must be stateless per row (e.g. a fitted pipeline model, or ``TermCounts``)."""
    docs = spark.readStream.schema(schema).parquet(landing_dir)

    def append(batch, number):
        index_store.add_documents(batch, embedder, index_path, stream=(checkpoint, number))
    return _started(docs, checkpoint, append, once)


def records_stream(spark: SparkSession, landing_dir: str, store_path: str, checkpoint: str,
                   schema: str, once: bool = True, upsert: bool = False, files_a_batch: int = 1000) -> StreamingQuery:
    """Stream extracted records into the record store; with ``upsert`` the newest record of an id stays."""
    recs = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(landing_dir)

    def write(batch, number):
        (records.upsert_records if upsert else records.append_records)(batch, store_path, stream=(checkpoint, number))
    return _started(recs, checkpoint, write, once)


def _files(spark: SparkSession, path: str) -> Table:
    return Table(spark, f"{path.rstrip('/')}/files", "path")


def _newest(spark: SparkSession, path: str) -> Table:
    return Table(spark, f"{path.rstrip('/')}/newest", "copy_of")


def land_stream(spark: SparkSession, glob: str, store_path: str, checkpoint: str, unit: Column | None = None,
                files_a_batch: int = 1000, once: bool = True) -> StreamingQuery:
    """Stream uploaded files into ``store_path``. Each upload has a path of its
    own (a file source reads a path once); a name uploaded again in the same
    ``unit`` (default: the folder) replaces the older copy, as in ``ingest.land``.

    Bytes are read in tasks and appended once; what is kept by key is only
    path, time and name.
    """
    key = unit if unit is not None else folder("path")
    files = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("maxFilesPerTrigger", files_a_batch).load(glob)

    def write(batch, number):
        mark = (checkpoint, number)
        _files(spark, store_path).append(batch, stream=mark)
        copies = batch.select(F.concat_ws("\u0000", key, base_name("path")).alias("copy_of"), "modificationTime", "path")
        _newest(spark, store_path).upsert(copies, newest_by("copy_of", F.col("modificationTime"), F.col("path")), stream=mark)
    return _started(files, checkpoint, write, once)


def landed(spark: SparkSession, store_path: str) -> DataFrame | None:
    """The newest copies with their bytes, as ``ingest.land`` gives them; None if nothing has landed."""
    files, newest = _files(spark, store_path).read(), _newest(spark, store_path).read()
    if files is None or newest is None:
        return None
    return files.join(newest.select("path"), "path", "left_semi").withColumn("name", base_name("path")).withColumn("file_type", classify("path"))
