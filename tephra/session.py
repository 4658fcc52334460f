"""Sessions and the folder that all executors share."""

from __future__ import annotations

import atexit
import functools
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", app: str = "tephra", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The URI in ``spark.checkpoint.dir``. Only where it is unset (tests, one machine) a local folder is made and set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="tephra-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; it goes when this process ends."""
    path = f"{shared_folder(spark)}/tephra-{os.getpid()}/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder, if the session still lives."""
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the JVM is gone at exit: the shared folder's owner cleans up
        pass


def bounded_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Let Arrow batches to Python workers hold at most so many bytes (or one row), besides Spark's limit of rows; a lower setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(str(spark.conf.get(key, "67108864b")).rstrip("bB")) > most:
        spark.conf.set(key, str(most))


def give_back() -> None:
    """Return freed memory of this process to the system: workers are used again by the next stages, which count on it."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not a GNU system
        pass


def tidy(task):
    """A function over a task's batches that gives memory back when the task ends."""

    @functools.wraps(task)
    def run(batches):
        try:
            yield from task(batches)
        finally:
            give_back()

    return run


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a DataFrame once as Parquet in the shared folder and read it back: lineage ends here, and lost executors cost no recomputation."""
    spark = df.sparkSession
    bounded_batches(spark)
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
