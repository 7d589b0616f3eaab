"""Session defaults."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession


def session(name: str = "verbarium", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC timestamps; ``conf`` overrides."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_base(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share; a local
    one where all runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="verbarium-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def shared_folder(spark: SparkSession) -> str:
    """A new folder path under ``shared_base``."""
    return f"{shared_base(spark)}/files/{uuid.uuid4().hex}"


def deleted(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of an Arrow batch that a task hands to Python, about.
BATCH_BYTES = 8 << 20


@contextmanager
def _held(spark: SparkSession, key: str, value: str):
    old = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, old)


def shuffles_released(spark: SparkSession):
    """Tables written here leave no shuffle files once they are written; else these stay
    until the driver happens to collect its garbage. For tables that are read from their
    files from then on."""
    return _held(spark, RELEASE, "true")


def small_batches(spark: SparkSession):
    """Tables written here pass through Python in batches bounded by bytes; else a batch is
    10,000 rows, however long they are, and both the executor and the worker hold it."""
    asked = int(spark.conf.get(BATCH, None) or 0)
    return _held(spark, BATCH, str(min(asked, BATCH_BYTES) if asked > 0 else BATCH_BYTES))
