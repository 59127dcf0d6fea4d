"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact length, a bounded knapsack over those counts fits each source's
budget, and seeded documents of each length are then taken until its count is met.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, staged, whole_text

#: Words of budget that the exact fit covers; what is left above it is first filled in proportion.
FIT_WORDS = 65_536
#: Parts into which the documents of one source and length are cut, so that no task sorts them all.
PARTS = 512


def word_count(text: Column) -> Column:
    return F.regexp_count(whole_text(text), F.lit(WORD)).cast("long")


def source_targets(sizes: dict, weights: tuple[float, ...], share: float, most: float) -> dict:
    """Budget of each source: share of all sizes by weight, none above `most` times its size.

    Sources come by code point, null last, and take the weights in turn. What a full source can't
    hold goes to the others by weight, until none is above its limit.
    """
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_ = {}, list(names)
    budget = share * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if budget * weight[s] / total > most * sizes[s]]
        if not over:
            target |= {s: budget * weight[s] / total for s in open_}
            break
        target |= {s: float(most * sizes[s]) for s in over}
        budget -= sum(target[s] for s in over)
        open_ = [s for s in open_ if s not in target]
    return target


def fit_counts(size: np.ndarray, count: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each size to take, so that their words come as near the budget as can be found."""
    total = int((size * count).sum())
    if budget >= total:
        return count.copy()
    share = count * (budget / total)
    take = np.minimum(np.floor(share).astype(np.int64), count)
    left = budget - int((size * take).sum())
    for i in np.argsort(take - share, kind="stable"):  # largest remainder first
        if left <= FIT_WORDS:
            break
        if take[i] < count[i] and size[i] <= left:
            take[i] += 1
            left -= int(size[i])
    for i in np.argsort(-size, kind="stable"):
        if left <= FIT_WORDS:
            break
        more = min(int(count[i] - take[i]), (left - FIT_WORDS + int(size[i]) - 1) // int(size[i]), left // int(size[i]))
        take[i] += more
        left -= more * int(size[i])
    # Bounded knapsack over what is left: bit w of `reach` is set if w words can be made exactly.
    goal = min(left, FIT_WORDS)
    bound = goal + min(int(size.max()), FIT_WORDS)
    mask, reach, steps = (1 << (bound + 1)) - 1, 1, []
    for i in np.argsort(-size, kind="stable"):
        free, piece = min(int(count[i] - take[i]), bound // int(size[i])), 1
        while free > 0 and not reach >> goal & 1:
            n = min(piece, free)
            steps.append((int(i), n, reach))
            reach |= reach << (n * int(size[i])) & mask
            free -= n
            piece *= 2
    at = (reach & (1 << (goal + 1)) - 1).bit_length() - 1  # the most words up to the goal
    if over := reach >> (goal + 1):
        more = goal + (over & -over).bit_length()  # the fewest beyond it
        at = more if more - goal < goal - at else at
    for i, n, before in reversed(steps):
        if not before >> at & 1:
            take[i] += n
            at -= n * int(size[i])
    return take


def _fit_source(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("size", ignore_index=True)
    size, count = pdf["size"].to_numpy(), pdf["n"].to_numpy()
    words, target = int((size * count).sum()), int(round(float(pdf["target"].iloc[0])))
    base = target // words if words else 0
    extra = fit_counts(size, count, target - base * words)
    return pd.DataFrame({"source_no": pdf["source_no"], "size": size, "base": base, "extra": extra})


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 42) -> DataFrame:
    """doc_id, size, source_size, target, copies and taken (copies times size) of every document.

    Null texts and texts without words have size 0 and are never taken. Null is a source of its own,
    the last. The draw goes by a hash of id and text, so rows without an id are dealt like others. Rows
    that repeat a doc_id are each counted and drawn by themselves (ties are equal rows). An empty table
    gives no rows. Sources are few enough to list on the driver: one row each. The lengths of one source are
    fitted in one task: n different lengths need n * n / 2 words, so 10^13 words have under
    5 million. Other columns are not read.
    """
    return _drawn(docs, weights, share, most, seed).select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _drawn(docs: DataFrame, weights: tuple[float, ...], share: float, most: int, seed: int, **keys: Column) -> DataFrame:
    """The draw of mix(), with further columns that tell rows apart (and settle ties)."""
    spark = docs.sparkSession
    rows = staged(docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), F.xxhash64(F.col("doc_id"), whole_text(F.col("text")), F.lit(seed)).alias("draw"), *[c.alias(k) for k, c in keys.items()]))
    totals = {r["source"]: r["words"] for r in rows.groupBy("source").agg(F.sum("size").alias("words")).collect()}
    targets = source_targets(totals, weights, share, most)
    plan = spark.createDataFrame(
        [(i, s, int(totals[s]), float(targets[s])) for i, s in enumerate(sorted(totals, key=lambda s: (s is None, s or "")))],
        "source_no int, source string, source_size long, target double",
    )
    rows = rows.alias("r").join(F.broadcast(plan.alias("p")), F.col("r.source").eqNullSafe(F.col("p.source"))).select(
        "doc_id", "size", "source_no", "source_size", "target", "draw", F.pmod("draw", F.lit(PARTS)).cast("int").alias("part"), *keys
    )
    cells = rows.filter("size > 0").groupBy("source_no", "size", "part").agg(F.count("*").alias("n"), F.first("target").alias("target"))
    quotas = cells.groupBy("source_no", "size").agg(F.sum("n").alias("n"), F.first("target").alias("target")).groupBy("source_no").applyInPandas(_fit_source, "source_no int, size long, base long, extra long")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source_no", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.select("source_no", "size", "part", before.alias("before")).join(quotas, ["source_no", "size"])
    place = F.col("before") + F.row_number().over(Window.partitionBy("source_no", "size", "part").orderBy("draw", "doc_id", *keys))
    return rows.join(cells, ["source_no", "size", "part"], "left").withColumn("copies", F.when(F.col("base").isNull(), 0).otherwise(F.col("base") + (place <= F.col("extra")).cast("long")))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 42) -> DataFrame:
    """The documents of the mix with all their columns, each row as many times as it is taken by itself."""
    source, text = F.col("source").cast("string"), F.md5(whole_text(F.col("text")))
    drawn = _drawn(docs, weights, share, most, seed, _mix_source=source, _mix_text=F.unhex(text))
    # Rows equal in id, source and text have the same base, so that their copies differ by one at most.
    cells = drawn.groupBy(F.col("doc_id").alias("_mix_id"), "_mix_source", "_mix_text").agg(F.sum("copies").alias("_mix_copies"), F.count("*").alias("_mix_n")).filter("_mix_copies > 0")
    cells = staged(cells)
    same = F.col("doc_id").eqNullSafe(F.col("_mix_id")) & source.eqNullSafe(F.col("_mix_source")) & (F.unhex(text) == F.col("_mix_text"))
    out = docs.join(cells.filter("_mix_n = 1"), same)
    repeated = cells.filter("_mix_n > 1")
    if not repeated.isEmpty():
        nth = F.row_number().over(Window.partitionBy("_mix_id", "_mix_source", "_mix_text").orderBy(F.to_json(F.struct(*[docs[c] for c in docs.columns]))))
        own = F.expr("_mix_copies div _mix_n") + (nth <= F.expr("_mix_copies % _mix_n")).cast("long")
        out = out.unionByName(docs.join(repeated, same).withColumn("_mix_copies", own).filter("_mix_copies > 0"))
    return out.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_copies").cast("int")))).select(*docs.columns)
