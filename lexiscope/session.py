"""Session helpers: building a local session for tests and resolving the
cluster's shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "lexiscope") -> SparkSession:
    """A local session for tests and the benchmark. On a cluster the caller
    brings its own session; nothing in the library depends on this one."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# Of an Arrow batch, at most: rows and, as Spark counts them for functions of columns
# alone, bytes. By default these are 10,000 and 64 MB; token lists take four to eight
# times their text, in every worker of a task and again in the JVM.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
_BATCHES = (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", BATCH_ROWS),
            ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", BATCH_BYTES))


def bounded_batches(spark: SparkSession) -> None:
    """Hand the Python workers of this session small Arrow batches, as long as Spark's
    defaults hold: a limit that the caller has set stays."""
    for key, default, own in _BATCHES:
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, own)


def checkpoint_dir(spark: SparkSession) -> str:
    """Return this application's folder in the one that ``spark.checkpoint.dir``
    names.

    On a cluster this setting points at shared storage and is used as is; there
    it must be set. Only a local session (tests) gets a scratch folder.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="lexiscope-ckpt-")
    sc.setCheckpointDir(configured)
    return sc._jsc.sc().getCheckpointDir().get()


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``lexiscope`` importable in the Python workers of this session
    (what ``--py-files`` does): zip it into the driver's temporary folder and
    ``addPyFile`` the archive once per application; the driver serves it to the
    executors and removes the folder when it ends. Python functions of the
    library are pickled by reference, so executors need the package."""
    import atexit
    import shutil
    import zipfile

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    out_dir = tempfile.mkdtemp(prefix="lexiscope-ship-")
    atexit.register(shutil.rmtree, out_dir, ignore_errors=True)
    path = os.path.join(out_dir, f"lexiscope-{sc.applicationId}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)
