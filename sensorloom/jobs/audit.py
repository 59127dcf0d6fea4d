"""Checks of readings, windows and decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.prep import PARTS


def signal_audit(readings: DataFrame) -> DataFrame:
    """Count, range, time span and mean start lag behind the session's first reading, of each source and signal."""
    session = ["source", "subject_id", "session_id"]
    starts = readings.groupBy(*session, "signal").agg(F.min("ts_sec").alias("a"), F.max("ts_sec").alias("b"), F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    firsts = starts.groupBy(*session).agg(F.min("a").alias("first"))
    rows = starts.join(firsts, session)
    return rows.groupBy("source", "signal").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), (F.max("b") - F.min("a")).alias("span"), F.avg(F.col("a") - F.col("first")).alias("mean_start_lag"))


def decision_audit(preds: DataFrame, threshold: float) -> DataFrame:
    """Decisions that differ from the stored threshold's, training accuracy and mean confidence of each model."""
    sure = F.when(F.col("pred_label") == 1, F.col("proba_1")).otherwise(1 - F.col("proba_1"))
    return preds.groupBy("model").agg(
        F.count("*").alias("n"),
        F.sum((F.col("pred_label") != (F.col("proba_1") >= threshold).cast("int")).cast("long")).alias("broken_decisions"),
        F.avg((F.col("y_true") == F.col("pred_label")).cast("double")).alias("training_accuracy"),
        F.avg(sure).alias("mean_confidence"),
    )


def label_audit(windows: DataFrame, min_overlap: float = 0.5) -> DataFrame:
    """Labelled windows, their mean overlap, and those of them that overlap less than they should."""
    held = F.col("nurse_label").isNotNull()
    below = held & (F.col("label_overlap_ratio") < min_overlap)
    return windows.agg(F.sum(held.cast("long")).alias("labelled"), F.avg(F.when(held, F.col("label_overlap_ratio"))).alias("mean_overlap"), F.sum(below.cast("long")).alias("below_least"))


def forbidden_columns(names: list[str]) -> list[str]:
    """Model inputs that give the label or the person away."""
    return [n for n in names if any(p in n.lower() for p in PARTS)]
