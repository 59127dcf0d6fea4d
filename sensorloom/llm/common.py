"""Shared helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space. bytes.split() cuts at the same bytes.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; where it is unset (tests), a folder of our own. A cluster must name it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="sensorloom-")
        spark.conf.set("spark.checkpoint.dir", named)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def delete(spark: SparkSession, name: str) -> None:
    """Delete a folder, wherever it is stored."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends here and any executor can be lost.

    The shuffle files of the write are removed when it is done, so steps don't add up on disk.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/staged-{uuid.uuid4().hex}"
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete a table of staged() that nothing reads any more."""
    for name in {f.rsplit("/", 1)[0] for f in table.inputFiles() if "/staged-" in f}:
        delete(table.sparkSession, name)


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder; Spark deletes it when nothing refers to it."""
    scratch_dir(df.sparkSession)
    return df.checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(col: Column) -> Column:
    """Null reads as the empty text."""
    return F.coalesce(col.cast("string"), F.lit(""))
