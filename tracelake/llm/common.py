"""What the training-data operators share: tables, the shared folder, words and hash-range prefixes."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows in one Arrow batch; long texts make larger batches of the default size heavy.
ARROW_ROWS = 1000

_local_dirs: dict[str, str] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df``, after Arrow batches of the session were made small, because rows hold whole texts or vectors."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Each name, with as many underscores before it as make it differ from the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def named(column: str) -> Column:
    """A column by its name, whatever characters that holds."""
    return F.col("`" + column.replace("`", "``") + "`")


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in the one that driver and executors share, ``spark.checkpoint.dir``.

    Only a local master may run without that setting; it then gets a temporary folder of its own."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return f"{found.rstrip('/')}/tracelake-{spark.sparkContext.applicationId}"
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="tracelake-")
        atexit.register(shutil.rmtree, _local_dirs[app], ignore_errors=True)
    return _local_dirs[app]


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's name in ``shared_dir``."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def clean_up(spark: SparkSession) -> None:
    """Deletes what ``materialise`` has written in this application, once no result that rests on it is needed."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def materialise(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: the lineage ends there, and an
    executor that is lost takes nothing with it. ``by``: a column whose values get a folder each."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def word_count(text: Column) -> Column:
    """The number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_key(*parts: Column) -> Column:
    """A uniform key of 60 bits from MD5, which other engines can compute as well."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def key_block(key: Column, blocks: Column) -> Column:
    """Which of so many equal ranges of the 60-bit key space holds the key (blocks < 2^31)."""
    return F.shiftright(F.shiftright(key, 29) * blocks, 31)
