"""Cutting lineage: tables written to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Local:
    """The folder of a local master without spark.checkpoint.dir, which goes when the process ends."""

    folder: str | None = None


def _base(spark: SparkSession) -> str:
    """spark.checkpoint.dir as a whole URI: one without a scheme is on the default file system, as Spark itself takes it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: a cluster needs a folder that all executors share")
        if Local.folder is None:
            Local.folder = tempfile.mkdtemp(prefix="quireflow-")
            atexit.register(shutil.rmtree, Local.folder, ignore_errors=True)
        return f"file://{Local.folder}"
    if "://" not in base and not base.startswith("file:"):
        path = spark._jvm.org.apache.hadoop.fs.Path(base)
        base = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(path).toString()
    return base.rstrip("/")


def session_dir(spark: SparkSession) -> str:
    """The folder below spark.checkpoint.dir with all that this application stores."""
    return f"{_base(spark)}/quireflow-{spark.sparkContext.applicationId}"


def shared_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors share, below spark.checkpoint.dir, as a URI.

    Only a local master may do without that setting; it then gets a folder of its own, which goes with the process.
    """
    return f"{session_dir(spark)}/{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "part") -> DataFrame:
    """df written as Parquet to the shared folder and read back: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> None:
    """Deletes all that this application has stored. Results that are not written yet may still read it: call this once they are."""
    path = spark._jvm.org.apache.hadoop.fs.Path(session_dir(spark))
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
