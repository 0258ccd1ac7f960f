"""Spark session settings and the shared checkpoint folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "worklens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every operator assumes (UTC, AQE, Arrow).

    On a cluster the submit command supplies the master, memory and
    ``spark.checkpoint.dir``; only settings that affect results are pinned here.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, taken from ``spark.checkpoint.dir``.

    A local session without the setting gets a fresh temporary folder; a
    cluster without it is refused, because a machine-local folder is lost with
    its executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        master = spark.conf.get("spark.master", spark.sparkContext.master)
        if not master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="worklens-checkpoints-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured.rstrip("/")


def run_folder(spark: SparkSession) -> str:
    """The part of the shared folder that belongs to this application."""
    return os.path.join(shared_folder(spark), f"worklens-{spark.sparkContext.applicationId}")


def new_shared_path(spark: SparkSession, name: str) -> str:
    """An unused path in the folder of this application; see ``remove_run_folder``."""
    return os.path.join(run_folder(spark), f"{name}-{uuid.uuid4().hex}")


def remove_run_folder(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application, once no result is read any more."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, where it is not installed on them."""
    root = os.path.dirname(os.path.abspath(__file__))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="worklens-"), "worklens"), "zip", os.path.dirname(root), "worklens")
    spark.sparkContext.addPyFile(archive)


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder.

    Lineage ends here, so a lost executor does not recompute what came before,
    and the table's size is known: joins broadcast it only when it is small.
    """
    spark = df.sparkSession
    path = new_shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table of a path, or None where nothing complete has been written."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
