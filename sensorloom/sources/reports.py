"""Feature tables and evaluation reports on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_features(features: DataFrame, path: str) -> None:
    """The feature table as Parquet by source, each file in time order."""
    order = [c for c in ("subject_id", "window_start_ts", "window_start_sec") if c in features.columns]
    features.sortWithinPartitions(*order).write.mode("overwrite").partitionBy("source").parquet(path)


def read_features(spark: SparkSession, path: str, build=None, rebuild: bool = False) -> DataFrame:
    """The stored table, or build() stored and read back where there is none or a rebuild is asked for."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    if build is not None and (rebuild or not there):
        write_features(build(), path)
    return spark.read.parquet(path)


def write_report(metrics: DataFrame, predictions: DataFrame, summary: DataFrame, path: str) -> None:
    """Fold metrics as CSV, predictions as Parquet by model and fold, the summary as JSON."""
    metrics.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/metrics")
    predictions.write.mode("overwrite").partitionBy("model", "fold").parquet(f"{path}/predictions")
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")


def time_sorted(features: DataFrame) -> DataFrame:
    """By source, subject, start time and start second, nulls last."""
    return features.orderBy(*[F.col(c).asc_nulls_last() for c in ("source", "subject_id", "window_start_ts", "window_start_sec") if c in features.columns])
