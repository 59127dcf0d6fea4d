"""Decision thresholds from one histogram pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 91 thresholds from 0.05 to 0.95, as evenly spaced doubles are computed.
THRESHOLDS = tuple(0.05 + i * ((0.95 - 0.05) / 90) for i in range(91))


def sweep(scored: DataFrame, keys: list[str], truth: str = "y_true", score: str = "proba_1") -> DataFrame:
    """recall, precision, balanced_accuracy and macro_f1 of `score >= threshold` at each threshold.

    Rows fall into the 92 bins between thresholds (one count with map-side sums); the counts at or
    above each threshold are then sums over at most 92 rows for each group.
    """
    grid = F.array(*[F.lit(t) for t in THRESHOLDS])
    good = scored.filter(F.col(truth).isNotNull() & F.col(score).isNotNull())
    # The guess is off by one bin at most; the comparisons with the exact thresholds settle it.
    guess = F.least(F.lit(90), F.greatest(F.lit(0), F.floor((F.col(score) - 0.05) * 100).cast("int")))
    at = lambda i: F.try_element_at(grid, i + 1)
    fits = F.when(F.col(score) < F.lit(THRESHOLDS[0]), -1).when((guess < 90) & (F.col(score) >= at(F.least(guess + 1, F.lit(90)))), guess + 1).when(F.col(score) < at(guess), guess - 1).otherwise(guess)
    bins = good.groupBy(*keys, fits.alias("bin")).agg(F.sum((F.col(truth) == 1).cast("long")).alias("pos"), F.sum((F.col(truth) != 1).cast("long")).alias("neg"))
    groups = bins.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bin", F.struct("pos", "neg")))).alias("m"), F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    rows = groups.select(*keys, "m", "all_pos", "all_neg", F.posexplode(grid).alias("i", "threshold"))
    above = lambda name: F.aggregate(F.sequence(F.col("i"), F.lit(90)), F.lit(0).cast("long"), lambda a, b: a + F.coalesce(F.try_element_at("m", b)[name], F.lit(0)))
    rows = rows.select(*keys, "i", "threshold", "all_pos", "all_neg", above("pos").alias("tp"), above("neg").alias("fp"))
    div = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, fp, fn, tn = F.col("tp"), F.col("fp"), F.col("all_pos") - F.col("tp"), F.col("all_neg") - F.col("fp")
    recall, other = div(tp, F.col("all_pos")), div(tn, F.col("all_neg"))
    classes = (F.col("all_pos") > 0).cast("int") + (F.col("all_neg") > 0).cast("int")
    seen = ((tp + fp + fn) > 0).cast("int") + ((tn + fn + fp) > 0).cast("int")
    f_pos, f_neg = div(2 * tp, 2 * tp + fp + fn), div(2 * tn, 2 * tn + fn + fp)
    return rows.select(*keys, "threshold", recall.alias("recall"), div(tp, tp + fp).alias("precision"), div(recall + other, classes).alias("balanced_accuracy"), div(f_pos + f_neg, seen).alias("macro_f1"))


def tune(swept: DataFrame, keys: list[str], goal: str = "balanced_accuracy", floor: float = 0.70) -> DataFrame:
    """The best threshold for a goal: balanced_accuracy, macro_f1, balanced_accuracy_recall_floor (best balanced
    accuracy where recall is at least the floor) or recall_floor (best precision there); where recall never reaches
    the floor, the largest recall. The lowest of equal ones wins."""
    if goal == "balanced_accuracy_recall_floor":
        ok = F.col("recall") >= floor
        score = F.struct(ok.alias("a"), F.when(ok, F.col("balanced_accuracy")).otherwise(F.col("recall")).alias("b"), (-F.col("threshold")).alias("c"))
    elif goal == "recall_floor":
        ok = F.col("recall") >= floor
        score = F.struct(ok.alias("a"), F.when(ok, F.col("precision")).otherwise(F.col("recall")).alias("b"), (-F.col("threshold")).alias("c"))
    else:
        score = F.struct(F.col(goal).alias("a"), (-F.col("threshold")).alias("b"))
    best = F.max_by(F.struct("threshold", "recall", "precision", "balanced_accuracy", "macro_f1"), score).alias("_b")
    return swept.groupBy(*keys).agg(best).select(*keys, "_b.*")


def select_candidate(results: DataFrame, score: str, order: str) -> DataFrame:
    """The row with the best score, the first of equals."""
    return results.agg(F.max_by(F.struct(*results.columns), F.struct(F.col(score), -F.col(order))).alias("_b")).select("_b.*")
