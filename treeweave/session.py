"""Session settings and the shared folder that jobs may write intermediate tables to."""

from __future__ import annotations

import atexit
import pathlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_local_folder: str | None = None


def build_session(app: str = "treeweave", master: str | None = None, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # File contents go to Python in batches of bounded size, however large the files are.
        .config("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    session = builder.getOrCreate()
    ship_package(session)
    return session


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, for clusters where it is not installed."""
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    package = pathlib.Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="treeweave-package-")
    archive = shutil.make_archive(f"{folder}/{package.name}", "zip", package.parent, package.name)
    # Executors fetch the archive from the driver for as long as it runs.
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.addPyFile(archive)
    _shipped.add(application)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: `spark.checkpoint.dir`, or a temporary one in local mode only."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    global _local_folder
    _local_folder = _local_folder or tempfile.mkdtemp(prefix="treeweave-")
    return _local_folder


def new_folder(spark: SparkSession, label: str) -> str:
    """A folder of its own below the shared one; all folders of an application lie side by side."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def pin(df: DataFrame) -> DataFrame:
    """Checkpoint `df` in the shared folder: later steps see the same rows even if executors are lost."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def kept(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """`df` written to the shared folder and read again: as `pin`, but worked out once, and later plans know how large it is."""
    folder = new_folder(df.sparkSession, label)
    df.write.option("compression", compression).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
