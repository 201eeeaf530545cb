"""Session helpers: shipping the package, cutting lineage."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_WRITTEN: dict[str, SparkSession] = {}


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers (as --py-files would)."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="corpusloom-"), "corpusloom.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    Only a session that runs in one local process (a test) gets a folder of its
    own where none is set: on a cluster each executor would write to its own
    disk, and a later read would miss the others' files.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        configured = tempfile.mkdtemp(prefix="corpusloom-checkpoint-")
    spark.sparkContext.setCheckpointDir(configured)
    return spark.sparkContext.getCheckpointDir()


def new_folder(spark: SparkSession, kind: str) -> str:
    """A fresh folder name below the checkpoint folder, deleted at the latest
    when the driver ends."""
    path = f"{checkpoint_dir(spark)}/{kind}-{uuid.uuid4()}"
    if not _WRITTEN:
        atexit.register(_delete_all)
    _WRITTEN[path] = spark
    return path


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete what was stored under ``path`` once its readers are done."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    _WRITTEN.pop(path, None)


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs: it does so once the driver has
    collected its garbage, which a loop of many steps would otherwise wait long for."""
    spark._jvm.System.gc()


def _delete_all() -> None:
    for path, spark in list(_WRITTEN.items()):
        with contextlib.suppress(Exception):  # the driver's JVM may be gone already
            if not spark._jsc.sc().isStopped():
                delete_folder(spark, path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table below the checkpoint folder and go on from there.

    A lost executor then costs a re-read, not the whole text pipeline again, and
    later steps read only the columns they need.
    """
    return store(df)[0]


def store(df: DataFrame) -> tuple[DataFrame, str]:
    """``cut_lineage`` with the folder, for ``delete_folder``."""
    spark = df.sparkSession
    path = new_folder(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path
