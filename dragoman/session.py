"""Session settings, the shared scratch folder, and shipping of the package to the workers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent


def get_session(app: str = "dragoman", cpus: int | None = None, tasks: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and benches; on a cluster pass the platform's own session around.

    ``tasks`` deals every table read by a registered query to so many tasks, whatever its row groups.
    """
    cpus = cpus or os.cpu_count() or 4
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # several files, or row groups, are read by as many cores
        .config("spark.sql.files.minPartitionNum", str(cpus))
        .config("spark.sql.files.openCostInBytes", "65536")
    )
    if tasks is not None:
        builder = builder.config("spark.dragoman.tasks", str(tasks))
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Hand the package to every Python worker of the session, once, as a zip that Spark serves."""
    sc = spark.sparkContext
    if getattr(sc, "_dragoman_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="dragoman-")) / "dragoman.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(PACKAGE.rglob("*.py")):
            z.write(f, f"{PACKAGE.name}/{f.relative_to(PACKAGE)}")
    sc.addPyFile(str(path))
    sc._dragoman_shipped = True


def scratch_root(spark: SparkSession) -> str:
    """This application's folder for intermediate tables, on a file system that all executors share.

    It lies in ``spark.checkpoint.dir``, and where that is not set (tests, a notebook) in the warehouse, unless that is
    a machine's own disk on a cluster. ``clear_scratch`` removes it; nothing else does.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        if warehouse.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"{warehouse}/_scratch"
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}"


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh path for one intermediate table."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove this application's intermediate tables. Call it when no result reads them any more."""
    jvm, path = spark._jvm, scratch_root(spark)
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
