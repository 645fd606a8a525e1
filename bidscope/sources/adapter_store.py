"""Stored adapter tables: the quote lines (and quotation list) of one input
folder, written once as parquet under the shared folder and read by every
analytics query.

In a deployment these are the stored outputs of extraction; for the star
schema they are derived by Spark (scan + joins) and written once, keyed by
the input files' paths, sizes and modification times. The analytics then
scan a columnar table with many splits and prune to the columns they need,
instead of re-running the fact-dimension joins in every branch of a plan.
Build: write to a fresh temporary folder, then rename into place, so a
concurrent or failed build never leaves a half-written table visible; a
build that fails, fails the query. The key is taken from the files at every
call, so changed input is never read from an old table.
"""
from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_dir

_INPUTS = ("lineitem", "part", "supplier")
LAYOUT = "2"  # changes with the derived columns, so that no older table is read


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _key(spark: SparkSession, sf_dir: str) -> str:
    h = hashlib.sha1(LAYOUT.encode())
    for t in _INPUTS:
        path = f"{sf_dir.rstrip('/')}/{t}.parquet"
        fs, p = _fs(spark, path)
        st = fs.getFileStatus(p)
        h.update(f"{st.getPath()}|{st.getLen()}|{st.getModificationTime()}".encode())
        if st.isDirectory():
            for c in fs.listStatus(p):
                h.update(f"{c.getPath()}|{c.getLen()}|{c.getModificationTime()}".encode())
    return h.hexdigest()[:16]


def _base(spark: SparkSession, sf_dir: str, builder) -> str:
    """Folder of the stored tables for the input as it is now (built if new)."""
    base = f"{shared_dir(spark)}/adapter_{_key(spark, sf_dir)}"
    fs, p = _fs(spark, base)
    if not fs.exists(_fs(spark, base + "/_BUILT")[1]):
        tmp = f"{base}.tmp-{uuid.uuid4().hex}"
        try:
            builder(spark, sf_dir).write.mode("overwrite").parquet(f"{tmp}/quote_items")
            qi = spark.read.parquet(f"{tmp}/quote_items")
            (qi.select("rfq_id", "quote_seq", "supplier_name").distinct()
               .write.mode("overwrite").parquet(f"{tmp}/quote_pairs"))
            tfs, tp = _fs(spark, tmp + "/_BUILT")
            tfs.create(tp).close()
            if not fs.exists(p):
                fs.rename(_fs(spark, tmp)[1], p)
        finally:  # a failed build, or one that another build overtook
            fs.delete(_fs(spark, tmp)[1], True)
    return base


def quote_items_table(spark: SparkSession, sf_dir: str, builder) -> DataFrame:
    return spark.read.parquet(f"{_base(spark, sf_dir, builder)}/quote_items")


def quote_pairs_table(spark: SparkSession, sf_dir: str, builder) -> DataFrame:
    return spark.read.parquet(f"{_base(spark, sf_dir, builder)}/quote_pairs")
