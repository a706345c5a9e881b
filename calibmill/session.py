"""Session set-up, table access and staging of intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from typing import Any

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "calibmill", cores: str | int | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine expects (UTC, AQE, Arrow).

    Its master is the one the job was submitted with; where there is none, or ``cores`` is given, the session is a local one.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    builder = SparkSession.builder.appName(app)
    if cores is not None or not SparkConf().contains("spark.master"):
        builder = builder.master(f"local[{cores or '*'}]")
        settings |= {"spark.driver.memory": "8g", "spark.ui.enabled": "false"}  # memory counts where this starts the JVM
    spark = builder.config(map=settings | conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only a local session that names none (tests, a laptop) gets a temporary folder; a cluster whose session names none is refused, as
    its executors would write to their own disks.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="calibmill-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(found)
    return found


def file_system(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """(file system, path) of a path, as the JVM's objects: works for local folders, HDFS and object stores alike."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    system, where = file_system(spark, path)
    return system.exists(where)


_SCRATCH: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted by ``release`` or when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    system, where = file_system(spark, path)
    system.deleteOnExit(where)
    _SCRATCH.append(path)
    return path


def release(spark: SparkSession) -> int:
    """Delete every staged table so far: for long sessions, once the results of their queries are written. Counts them."""
    done = [_SCRATCH.pop() for _ in range(len(_SCRATCH))]
    for path in done:
        system, where = file_system(spark, path)
        system.delete(where, True)
    return len(done)


def stage(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage in front of several consumers (the Python parser runs once, not once per
    consumer) and survives the loss of executors, since the folder outlives them. The job runs at once, so building a query
    with stages runs all but its last step.
    """
    spark = df.sparkSession
    path = scratch(spark, "stage")
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
