"""Rows in one order over many partitions, numbered without bringing a key into one task."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

_INSIDE = (1 << 33) - 1


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows, written in the order of these columns (nulls first), with pos: 0, 1, 2 and on over the whole table.

    Range partitions cut any key, however many rows it has, also rows that are equal in all columns of
    the order. One count for each partition reaches the driver.
    """
    laid = staged(
        rows.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(*order, "_tie")
        .sortWithinPartitions(*order, "_tie")
        .drop("_tie")
        .withColumn("_at", F.monotonically_increasing_id())
    )
    part = F.shiftright("_at", 33)
    sizes = [(r["part"], r["n"]) for r in laid.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()]  # one row for each partition
    starts = list(zip((p for p, _ in sizes), accumulate((n for _, n in sizes), initial=0), strict=False))
    known = rows.sparkSession.createDataFrame(starts, "_part long, _start long")
    return laid.withColumn("_part", part).join(F.broadcast(known), "_part").withColumn("pos", F.col("_start") + F.col("_at").bitwiseAND(F.lit(_INSIDE))).drop("_part", "_start", "_at")
