"""Session helpers: a local session for tests/bench and shared-folder lookup.

On a cluster the session is built by the platform; nothing here overrides
settings that are already present.
"""
from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings that matter for the plans in this package. AQE re-plans joins from
# runtime sizes (broadcast only what is measured small, split skewed
# partitions of sort-merge joins) and coalesces small shuffle partitions.
ENGINE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # per-group lists (collect_list) stay hash-based for many groups per task
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "65536",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "bidscope") -> SparkSession:
    """A local-mode session for tests and the bench (UI off, no ports).

    Shuffles here are a few MB, so AQE's default 1 MB minimum would merge
    them into one or two partitions and idle the other cores; a smaller
    minimum keeps one partition per core.
    """
    b = (SparkSession.builder.master(f"local[{cpus}]").appName(app)
         .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", os.environ.get("BIDSCOPE_DRIVER_MEM", "16g"))
         .config("spark.driver.extraJavaOptions", os.environ.get("BIDSCOPE_DRIVER_JAVA_OPTS", "")))
    for k, v in ENGINE_CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder for checkpoints and written tables.

    Read from ``spark.checkpoint.dir`` (or the context's checkpoint dir).
    Only a local-mode session (local runs, tests) without either gets a
    folder of its own; on a cluster a machine-local folder would not be
    shared, so an unset setting is an error there.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if not d:
        d = spark.conf.get("spark.checkpoint.dir", None)
        if not d:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster "
                                   "(written tables and checkpoints go there)")
            d = tempfile.mkdtemp(prefix="bidscope-shared-")
        sc.setCheckpointDir(d)
        d = sc.getCheckpointDir() or d
    return d.rstrip("/")


_SCRATCH: dict[str, SparkSession] = {}


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder name under the shared folder, for tables that a query
    writes and reads back; removed when the driver ends."""
    path = f"{shared_dir(spark)}/{tag}_{uuid.uuid4().hex}"
    _SCRATCH[path] = spark
    return path


@atexit.register
def _remove_scratch() -> None:
    for path, spark in _SCRATCH.items():
        sc = spark.sparkContext
        if sc._jsc is not None:  # the session is still there
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``bidscope`` importable on the Python workers (``addPyFile`` of a
    zip of the package, once per application), so operators that run
    Python in tasks work wherever the driver was started. A deployment that
    already ships the package (``--py-files``) just gets a second copy."""
    import io
    import zipfile

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    target = f"{shared_dir(spark)}/bidscope_{app}.zip"
    jvm = sc._jvm
    path = jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    out = fs.create(path, True)
    out.write(bytearray(buf.getvalue()))
    out.close()
    sc.addPyFile(target)
    _SHIPPED.add(app)
