"""Folds, caps and balanced samples. Every choice goes by md5 of a seed and the row's key, so it doesn't depend on partitions."""

from __future__ import annotations

from itertools import accumulate

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import staged


def draw(seed: int, *key: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))


def draw_rank(df: DataFrame, cells: list[str], key: str, seed: int) -> DataFrame:
    """Adds _r, the place from 1 of each row of a cell in drawn order; cells should not be null.

    Rows of a cell are ranked in 256 parts by the first digits of the draw, and parts are put after each
    other by their counts, so that a class with most of the rows isn't sorted in one task.
    """
    rows = df.withColumns({"_draw": draw(seed, key)}).withColumn("_part", F.substring("_draw", 1, 2))
    before = F.sum("_n").over(Window.partitionBy(*cells).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    counts = rows.groupBy(*cells, "_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*cells, "_part").orderBy("_draw", key))
    return rows.withColumn("_r", inside).join(counts, [*cells, "_part"]).withColumn("_r", F.col("_r") + F.col("_before")).select(*df.columns, "_r")


def cap_per_group_class(df: DataFrame, cap: int | None, group: str, label: str, key: str, seed: int = 42) -> DataFrame:
    """At most `cap` drawn rows of each group and class; None or 0: all."""
    if not cap or cap <= 0:
        return df
    return draw_rank(df, [group, label], key, seed).filter(F.col("_r") <= cap).drop("_r")


def balance_sources(df: DataFrame, mode: str, source: str, label: str, key: str, seed: int = 42) -> DataFrame:
    """'source': cut all sources to the smallest. 'source_class': the same within each class; a class of one source stays whole."""
    if mode == "none":
        return df
    cells = [source] if mode == "source" else [source, label]
    counts = df.groupBy(*cells).agg(F.count("*").alias("_n"))
    if mode == "source":
        limit = counts.agg(F.min("_n").alias("_cap"))
        ranked = df.withColumn("_cap", limit.scalar())
    else:
        limit = counts.groupBy(label).agg(F.when(F.count("*") > 1, F.min("_n")).alias("_cap"))
        ranked = df.join(F.broadcast(limit), label)  # one row for each class
    kept = draw_rank(ranked, cells, key, seed).filter(F.col("_cap").isNull() | (F.col("_r") <= F.col("_cap")))
    return kept.select(*df.columns)


def limit_entities(df: DataFrame, key: str, n: int, numeric: bool = True) -> DataFrame:
    """Rows of the first n entities, in numeric or name order."""
    order = [F.col(key).try_cast("double").asc_nulls_last(), F.col(key)] if numeric else [F.col(key)]
    first = df.select(key).distinct().orderBy(*order).limit(n)
    return df.join(first, key, "left_semi")


def sorted_place(df: DataFrame, key: str) -> DataFrame:
    """key and place: 0, 1, 2, ... in sorted order (nulls first) of a table with one row for each key.

    Range partitions are numbered one after another by their counts, one row each on the driver.
    """
    laid = staged(df.select(key).repartitionByRange(key).sortWithinPartitions(key).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = laid.groupBy(part.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()  # one row for each partition
    starts = list(zip((r["p"] for r in sizes), accumulate((r["n"] for r in sizes), initial=0), strict=False))
    known = df.sparkSession.createDataFrame(starts, "_p long, _start long")
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return laid.withColumn("_p", part).join(F.broadcast(known), "_p").select(key, (F.col("_start") + inside).alias("place"))


def folds_loso(df: DataFrame, group: str) -> DataFrame:
    """One fold for each group: its place in sorted order. Only the groups are sorted, by range."""
    groups = sorted_place(df.select(group).distinct().filter(F.col(group).isNotNull()), group)
    return df.join(groups.select(group, F.col("place").cast("int").alias("fold")), group)


def spread_folds(shapes: list[tuple[int, ...]], sizes: list[int], k: int) -> list[list[int]]:
    """How many of the equal groups of each shape (rows by class) go to each of k folds.

    Shapes with the most uneven counts come first. Each group goes to the fold with which the classes'
    shares spread least over folds; of equal ones to that with the fewest rows, then the first.
    """
    if not shapes:
        return []
    counts = np.array(shapes, dtype=float)
    total = np.maximum((counts * np.array(sizes)[:, None]).sum(axis=0), 1)
    held, out = np.zeros((k, counts.shape[1])), [[0] * k for _ in shapes]
    order = sorted(range(len(shapes)), key=lambda i: (-round(float(counts[i].std()), 9), shapes[i]))
    for i in order:
        for _ in range(sizes[i]):
            tried = np.repeat(held[None], k, axis=0)
            tried[np.arange(k), np.arange(k)] += counts[i]
            score = np.round((tried / total).std(axis=1).mean(axis=1), 9)
            f = min(range(k), key=lambda f: (score[f], held[f].sum(), f))
            held[f] += counts[i]
            out[i][f] += 1
    return out


def folds_balanced(df: DataFrame, k: int, group: str, label: str, seed: int = 42) -> DataFrame:
    """Folds of whole groups whose classes' shares spread as little as a greedy assignment finds; k is at most the number of groups.

    Groups with the same rows by class are alike, so the choice needs one row for each different
    shape, and the groups of a shape are dealt by draw, in parts. Rows with a null group or label get none.
    """
    counts = df.filter(F.col(group).isNotNull() & F.col(label).isNotNull()).groupBy(group, label).agg(F.count("*").alias("n"))
    classes = [r[label] for r in counts.select(label).distinct().orderBy(label).collect()]  # one row for each class
    shape = F.concat_ws(",", *[F.coalesce(F.sum(F.when(F.col(label) == c, F.col("n"))), F.lit(0)).cast("string") for c in classes])
    groups = staged(counts.groupBy(group).agg(shape.alias("_shape")))
    shapes = groups.groupBy("_shape").agg(F.count("*").alias("m")).orderBy("_shape").collect()  # one row for each shape
    k = max(1, min(k, sum(r["m"] for r in shapes)))
    dealt = spread_folds([tuple(int(n) for n in r["_shape"].split(",")) for r in shapes], [r["m"] for r in shapes], k)
    ends = [(r["_shape"], list(accumulate(d))) for r, d in zip(shapes, dealt, strict=True)]
    known = df.sparkSession.createDataFrame(ends, "_shape string, _ends array<int>")
    placed = draw_rank(groups, ["_shape"], group, seed).join(known, "_shape")
    fold = F.size(F.filter("_ends", lambda e: e < F.col("_r")))
    return df.join(placed.select(group, fold.cast("int").alias("fold")), group)


def folds_group(df: DataFrame, k: int, group: str, label: str, seed: int = 42) -> DataFrame:
    """Stratified folds of whole groups: groups go round the folds by main class, the largest first, then by draw.

    k is at most the number of groups. Works on one row for each group and class.
    """
    counts = df.groupBy(group, label).agg(F.count("*").alias("n"))
    groups = counts.groupBy(group).agg(F.sum("n").alias("n"), F.max_by(label, F.struct(F.col("n"), -F.col(label))).alias("main")).withColumn("_d", draw(seed, group))
    spot = F.row_number().over(Window.orderBy("main", F.desc("n"), "_d", group)) - 1
    most = F.least(F.lit(k), F.count("*").over(Window.partitionBy(F.lit(1))))
    dealt = groups.select(group, F.pmod(spot, most).cast("int").alias("fold"))
    return df.join(dealt, group)


def folds_stratified(df: DataFrame, k: int, label: str, key: str, seed: int = 42) -> DataFrame:
    """Stratified folds of rows; k is at most the size of the smallest class, but two at least."""
    sizes = df.groupBy(label).agg(F.count("*").alias("n"))
    most = sizes.agg(F.least(F.lit(k), F.greatest(F.lit(2), F.min("n"))).alias("k")).scalar()
    return draw_rank(df, [label], key, seed).withColumn("fold", F.pmod(F.col("_r") - 1, most).cast("int")).drop("_r")


def calibration_split(df: DataFrame, label: str, key: str, group: str | None = None, seed: int = 42) -> DataFrame:
    """Adds calibration (true for the held-out part of a training set), or false for all where none is possible.

    With four groups or more: the first fold, of five, four, three or two, whose two sides hold all
    classes. Else (or without groups) a fifth of the rows by class, more if the smallest class has
    under five. Under 20 rows or with one class: none.
    """
    stats = df.agg(F.count("*").alias("n"), F.count_distinct(label).alias("k"), *([F.count_distinct(group).alias("g")] if group else [])).first()
    if stats["n"] < 20 or stats["k"] < 2:
        return df.withColumn("calibration", F.lit(False))
    if group and stats["g"] >= 4:
        for parts in (5, 4, 3, 2):
            if stats["g"] < parts:
                continue
            folded = folds_group(df, parts, group, label, seed)
            cells = folded.groupBy("fold", label).agg(F.count("*").alias("n")).collect()  # at most five folds by class
            for f in range(parts):
                inside = {r[label] for r in cells if r["fold"] == f}
                outside = {r[label] for r in cells if r["fold"] != f}
                if len(inside) == stats["k"] == len(outside):
                    return folded.withColumn("calibration", F.col("fold") == f).drop("fold")
    return folds_stratified(df, 5, label, key, seed).withColumn("calibration", F.col("fold") == 0).drop("fold")
