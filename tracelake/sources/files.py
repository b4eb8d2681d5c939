"""Files by Spark and Hadoop, and this application's scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_temporary: dict[str, str] = {}


def files_of(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def remove(spark: SparkSession, path: str) -> None:
    fs, where = files_of(spark, path)
    fs.delete(where, True)


def move(spark: SparkSession, path: str, to: str) -> bool:
    """Renames a folder; False if that is not possible, as where ``to`` is there."""
    fs, where = files_of(spark, path)
    _, new = files_of(spark, to)
    return not fs.exists(new) and fs.rename(where, new)


def scratch(spark: SparkSession) -> str:
    """This application's folder where driver and executors both write: in ``spark.checkpoint.dir``, or, on a local
    master without that setting, a temporary one."""
    if shared := spark.conf.get("spark.checkpoint.dir", None):
        return f"{shared.rstrip('/')}/trace-{spark.sparkContext.applicationId}"
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _temporary:
        _temporary[app] = tempfile.mkdtemp(prefix="trace-")
        atexit.register(shutil.rmtree, _temporary[app], ignore_errors=True)
    return _temporary[app]


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder's name in ``scratch``."""
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


def clean_up(spark: SparkSession) -> None:
    """Deletes what this application has in ``scratch``, once no result that rests on it is needed."""
    remove(spark, scratch(spark))


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df``, written to a scratch folder and read from there."""
    folder = scratch_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
