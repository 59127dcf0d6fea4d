"""Scores of predictions. All start from one count of (truth, prediction) pairs, so rows are shuffled once and map-side first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pair_counts(preds: DataFrame, keys: list[str], truth: str = "y_true", pred: str = "pred_label") -> DataFrame:
    return preds.groupBy(*keys, F.col(truth).cast("int").alias("t"), F.col(pred).cast("int").alias("p")).agg(F.count("*").alias("n"))


def confusion_matrix(preds: DataFrame, keys: list[str], labels: list[int]) -> DataFrame:
    """One row for each group and cell: truth, predicted, n; cells without rows are 0."""
    cells = F.explode(F.array(*[F.struct(F.lit(a).alias("truth"), F.lit(b).alias("predicted")) for a in labels for b in labels]))
    held = F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", F.col("t"), F.col("p")), F.col("n"))))
    groups = pair_counts(preds, keys).filter(F.col("t").isNotNull() & F.col("p").isNotNull()).groupBy(*keys).agg(held.alias("_m"))
    rows = groups.withColumn("_c", cells)
    count = F.coalesce(F.try_element_at("_m", F.concat_ws(":", F.col("_c.truth"), F.col("_c.predicted"))), F.lit(0))
    return rows.select(*keys, F.col("_c.truth").alias("truth"), F.col("_c.predicted").alias("predicted"), count.cast("long").alias("n"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _by_class(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Each pair counts once for the class of its truth and once for that of its prediction."""
    side = lambda c, s, f, h: F.struct(F.col(c).alias("c"), s.cast("long").alias("s"), f.cast("long").alias("f"), h.cast("long").alias("h"))
    n, none = F.col("n"), F.lit(0)
    sides = F.explode(F.array(side("t", n, none, F.when(F.col("t") == F.col("p"), n).otherwise(none)), side("p", none, n, none)))
    return pairs.withColumn("_s", sides).groupBy(*keys, F.col("_s.c").alias("class")).agg(F.sum("_s.s").alias("support"), F.sum("_s.f").alias("found"), F.sum("_s.h").alias("hit"))


def class_counts(preds: DataFrame, keys: list[str], labels: list[int] | None = None) -> DataFrame:
    """support, found (predicted) and hit of each class in a group: of the given labels, or of those in truth or prediction."""
    pairs = pair_counts(preds, keys).filter(F.col("t").isNotNull() & F.col("p").isNotNull())
    counts = _by_class(pairs, keys)
    if labels is None:
        return counts
    groups = counts.select(*keys).distinct().withColumn("class", F.explode(F.array(*[F.lit(x) for x in labels])))
    full = groups.join(counts, [*keys, "class"], "left")
    return full.fillna(0, ["support", "found", "hit"])


def _scored(counts: DataFrame) -> DataFrame:
    p, r = _ratio(F.col("hit"), F.col("found")), _ratio(F.col("hit"), F.col("support"))
    return counts.withColumns({"precision": p, "recall": r, "f1": _ratio(2 * F.col("hit"), F.col("found") + F.col("support"))})


def classification_report(preds: DataFrame, keys: list[str], labels: list[int]) -> DataFrame:
    """precision, recall, f1 and support of each class, and their plain and weighted means; 0 where nothing can be divided."""
    rows = _scored(class_counts(preds, keys, labels))
    cols = ("precision", "recall", "f1")
    each = rows.select(*keys, F.col("class").cast("string").alias("class"), *cols, F.col("support").cast("long").alias("support"))
    total = F.sum("support").cast("long").alias("support")
    macro = rows.groupBy(*keys).agg(F.lit("macro avg").alias("class"), *[F.avg(c).alias(c) for c in cols], total)
    weighted = rows.groupBy(*keys).agg(F.lit("weighted avg").alias("class"), *[_ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c) for c in cols], total)
    return each.unionByName(macro).unionByName(weighted)


def _scores(counts: DataFrame, keys: list[str]) -> DataFrame:
    return (
        _scored(counts)
        .groupBy(*keys)
        .agg(
            F.sum("support").cast("long").alias("n"),
            _ratio(F.sum("hit"), F.sum("support")).alias("accuracy"),
            F.coalesce(F.avg(F.when(F.col("support") > 0, F.col("recall"))), F.lit(0.0)).alias("balanced_accuracy"),
            F.avg("f1").alias("macro_f1"),
            _ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"),
        )
    )


def score_metrics(preds: DataFrame, keys: list[str]) -> DataFrame:
    """accuracy, balanced accuracy (classes that truth has), macro F1 (classes of truth or prediction), weighted F1."""
    return _scores(class_counts(preds, keys), keys)


def metrics_by_source(preds: DataFrame, model: str = "model", source: str = "source") -> DataFrame:
    """The metrics of each model over all rows (scope 'all') and for each source, from one count of the rows."""
    pairs = pair_counts(preds, [model, source]).filter(F.col("t").isNotNull() & F.col("p").isNotNull())
    both = pairs.withColumn("scope", F.explode(F.array(F.lit("all"), F.coalesce(F.col(source), F.lit("")))))
    return _scores(_by_class(both, [model, "scope"]), [model, "scope"])


METRICS = ("accuracy", "balanced_accuracy", "macro_f1", "weighted_f1")


def summarise_folds(metrics: DataFrame, model: str = "model") -> DataFrame:
    """Mean and sample deviation of the four metrics over folds, to six places."""
    return metrics.groupBy(model).agg(*[F.round(f(m), 6).alias(f"{m}_{n}") for m in METRICS for n, f in (("mean", F.avg), ("std", F.stddev_samp))])


def rank_models(metrics: DataFrame, model: str = "model") -> DataFrame:
    """Models by mean weighted F1, best first; ties by name."""
    return metrics.groupBy(model).agg(F.avg("weighted_f1").alias("weighted_f1")).orderBy(F.desc("weighted_f1"), model)


def pick_best(metrics: DataFrame, saved: DataFrame) -> DataFrame:
    """The saved model with the best mean weighted F1; where no metrics are known, training accuracy counts. saved: model, training_accuracy."""
    joined = saved.join(metrics.groupBy("model").agg(F.avg("weighted_f1").alias("_f1")), "model", "left")
    known = joined.agg(F.count("_f1")).scalar() > 0
    score = F.when(known, F.coalesce("_f1", F.lit(-1.0))).otherwise(F.col("training_accuracy"))
    return joined.select("model", score.alias("score")).orderBy(F.desc("score"), "model").limit(1)


def report_json(preds: DataFrame, keys: list[str], labels: list[int]) -> DataFrame:
    """classification_report (a map of class to scores) and confusion_matrix (nested arrays) as JSON text."""
    rows = classification_report(preds, keys, labels)
    entry = F.struct(F.col("class"), F.struct(*[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support"))
    reports = rows.groupBy(*keys).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("classification_report"))
    cells = confusion_matrix(preds, keys, labels).groupBy(*keys, "truth").agg(F.array_sort(F.collect_list(F.struct("predicted", "n")))["n"].alias("_row"))
    matrix = cells.groupBy(*keys).agg(F.to_json(F.array_sort(F.collect_list(F.struct("truth", "_row")))["_row"]).alias("confusion_matrix"))
    return reports.join(matrix, keys)


def distribution(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows for each combination of values, null included."""
    return df.groupBy(*columns).agg(F.count("*").alias("n"))
