"""Training, tuning, evaluating and scoring classifiers on subject-grouped folds.

Rows are: id (string), y (the place of the class among the sorted classes), vec (features, null where
missing), group_id and source. The driver goes through models, folds and candidates; every step of
one runs on Spark.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import IsotonicRegression
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import TrainConfig
from ..operators import decision, metrics, prep, splits, thresholds
from ..sources.scratch import shared_dir, staged
from . import trees
from .stages import Alerts, Bayes, Boosted, Calibrated, Decided, Forest, Grown, Imputed, Neighbours, OneClass, Scaled, Selected, Sigmoid, Stage, Told, Vectors, with_vector

MODELS = ("rf", "balanced_rf", "extra_trees", "gbt", "gnb", "knn")
#: Models that balance classes by themselves, and those that need scaled features.
INTERNAL, SCALED = ("balanced_rf",), ("knn",)
ROW = ["id", "y", "vec", "group_id", "source"]


# Models ------------------------------------------------------------------------------------------


def forest(count: int, depth: int, seed: int) -> RandomForestClassifier:
    """Entropy, two rows a leaf, balanced weights."""
    return RandomForestClassifier(labelCol="y", featuresCol="features", weightCol="weight", numTrees=count, maxDepth=depth, impurity="entropy", minInstancesPerNode=2, featureSubsetStrategy="sqrt", seed=seed)


def fit_model(train: DataFrame, name: str, classes: int, config: TrainConfig):
    """A fitted model of the given name. train: id, y, vec without nulls."""
    if name == "rf":
        return Forest(forest(config.forest_trees, config.max_depth, config.seed).fit(prep.balanced_weights(with_vector(train), "y")))
    if name == "extra_trees":
        return Grown(trees.extra_trees(train, config.extra_trees, classes, config.max_depth, seed=config.seed)[0])
    if name == "balanced_rf":
        return Grown(trees.balanced_forest(train, config.balanced_trees, classes, config.max_depth, seed=config.seed))
    if name == "gbt":
        return Boosted(trees.boosting(train, config.boosting_rounds, config.boosting_step, classes))
    if name == "gnb":
        width = train.select(F.max(F.size("vec"))).first()[0]
        cols = [f"x{i}" for i in range(width)]
        wide = train.select("y", *[F.col("vec")[i].alias(c) for i, c in enumerate(cols)])
        return Bayes(classes=[r.asDict() for r in prep.gnb_fit(wide, cols, "y").orderBy("label").collect()])  # one row for each class
    if name == "knn":
        return Neighbours(staged(train.select("id", "vec", F.col("y").cast("int").alias("label"))), k=config.neighbours, classes=classes)
    raise ValueError(f"unknown model: {name} (known: {', '.join(MODELS)})")


# Calibration ---------------------------------------------------------------------------------------


_SUMS = ["loss", "g0", "g1", "h0", "h1", "h2"]


def fit_sigmoids(raw: DataFrame, places: list[int], most: int = 60) -> list[Sigmoid]:
    """The least cross entropy against smoothed targets, (n+ + 1) / (n+ + 2) and 1 / (n- + 2), for each class against the rest.

    Newton steps for all classes together: a pass sums loss, gradient and curvature at eight points
    along each class's step, of which the best is the next.
    """
    counts = raw.agg(F.count("*").alias("n"), *[F.count_if(F.col("y") == c).alias(f"p{c}") for c in places]).first()
    up = {c: counts[f"p{c}"] for c in places}
    down = {c: counts["n"] - up[c] for c in places}
    at = {c: np.array([0.0, math.log((down[c] + 1) / (up[c] + 1))]) for c in places}
    flat = raw.select("y", *[F.get("prob", F.lit(c)).alias(f"p{c}") for c in places])  # numbers, which pass to Python as they are
    move, least, open_ = {c: np.zeros(2) for c in places}, dict.fromkeys(places, math.inf), list(places)
    for _ in range(most):
        points = [(c, k, *(at[c] + move[c] * 0.5**k)) for c in open_ for k in range(8 if move[c].any() else 1)]

        def run(batches: Iterator[pd.DataFrame], points=points) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                y, out = pdf["y"].to_numpy(), []
                for c, k, a, b in points:
                    f = pdf[f"p{c}"].to_numpy()
                    z, target = a * f + b, np.where(y == c, (up[c] + 1) / (up[c] + 2), 1 / (down[c] + 2))
                    loss, p = np.logaddexp(0, z) - (1 - target) * z, 1 / (1 + np.exp(np.clip(z, -700, 700)))
                    out.append((c, k, loss.sum(), (f * (target - p)).sum(), (target - p).sum(), (f * f * p * (1 - p)).sum(), (f * p * (1 - p)).sum(), (p * (1 - p)).sum()))
                yield pd.DataFrame(out, columns=["c", "k", *_SUMS])

        if not points:
            break
        sums = flat.mapInPandas(run, "c int, k int, " + ", ".join(f"{n} double" for n in _SUMS)).groupBy("c", "k").agg(*[F.sum(n).alias(n) for n in _SUMS]).collect()  # eight rows for each class at most
        for c in list(open_):
            best = min((r for r in sums if r["c"] == c), key=lambda r: (r["loss"], r["k"]))
            if best["loss"] > least[c]:
                open_.remove(c)
                continue
            at[c] = next(np.array([a, b]) for d, k, a, b in points if (d, k) == (c, best["k"]))
            least[c] = best["loss"]
            move[c] = -np.linalg.solve(np.array([[best["h0"], best["h1"]], [best["h1"], best["h2"]]]) + 1e-12 * np.eye(2), np.array([best["g0"], best["g1"]]))
            if np.abs(move[c]).max() < 1e-10 * max(1.0, np.abs(at[c]).max()):
                open_.remove(c)
    return [Sigmoid(float(at[c][0]), float(at[c][1])) for c in places]


def fit_calibrators(raw: DataFrame, classes: int, method: str) -> list:
    """One calibrator for each class against the rest (two classes: for the second), on held-out rows with y and prob."""
    places = list(range(classes)) if classes > 2 else [1]
    if method == "sigmoid":
        return fit_sigmoids(raw, places)
    rows = [raw.select((F.col("y") == c).cast("double").alias("y"), array_to_vector(F.array(F.col("prob")[c])).alias("features")) for c in places]
    return [IsotonicRegression(labelCol="y", featuresCol="features").fit(r) for r in rows]


# Preparing a training set --------------------------------------------------------------------------


def vector_medians(rows: DataFrame) -> list[float]:
    """Exact median of each feature; one without values gets 0, so that names and places stay together."""
    width = rows.select(F.max(F.size("vec"))).first()[0] or 0
    cells = rows.select(F.posexplode("vec").alias("idx", "v"))
    found = {r["idx"]: r["q"] for r in prep.percentiles(cells, ["idx"], "v", 0.5).collect()}  # one row for each feature
    return [0.0 if found.get(i) is None else float(found[i]) for i in range(width)]


def vector_scaler(rows: DataFrame) -> list[tuple[float, float]]:
    found = rows.select(F.posexplode("vec").alias("idx", "v")).groupBy("idx").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).orderBy("idx").collect()  # one row for each feature
    return [(float(r["m"]), float(r["s"] or 0.0) or 1.0) for r in found]


def fit_feature_selector(rows: DataFrame, label: str, k: int, count: int = 300, depth: int = 10, seed: int = 42) -> DataFrame:
    """idx and importance of the k features that count most in extra trees. rows: id, vec and a label 0, 1, ..."""
    train = rows.select("id", F.col(label).alias("y"), "vec")
    classes = (train.agg(F.max("y")).first()[0] or 0) + 1
    found = trees.extra_trees(train, count, int(classes), depth, seed=seed)[1]
    table = rows.sparkSession.createDataFrame([(i, float(x)) for i, x in enumerate(found)], "idx int, importance double")
    return prep.select_top_k(table, k)


def smote_note(counts: list[int]) -> str:
    """What oversampling does for classes of these sizes."""
    return "skipped_minority_too_small" if min(counts) < 3 else f"smote_k{max(1, min(5, min(counts) - 1))}"


def oversampled(train: DataFrame, seed: int) -> DataFrame:
    made = prep.smote(train.select("id", F.col("y").cast("int").alias("label"), "vec"), seed=seed)
    new = made.select(F.concat_ws("|", F.lit("made"), F.col("base_id").cast("string"), F.col("copy").cast("string")).alias("id"), F.col("label").cast("double").alias("y"), "vec")
    return train.select("id", "y", "vec").unionByName(new)


# A fitted candidate --------------------------------------------------------------------------------


@dataclass
class Bundle:
    """All that scoring needs: classes, imputing, selection, scaling, the model, its calibration and threshold."""

    name: str
    classes: list[int]
    medians: list[float] = field(default_factory=list)
    selected: list[int] | None = None
    scaler: list | None = None
    model: object = None
    calibrators: list = field(default_factory=list)
    threshold: float | None = None
    score: float | None = None
    notes: dict = field(default_factory=dict)

    def preparation(self) -> list[Stage]:
        out = [Imputed(medians=self.medians)]
        if self.selected is not None:
            out.append(Selected(places=self.selected))
        if self.scaler is not None:
            out.append(Scaled(means=[m for m, _ in self.scaler], deviations=[s for _, s in self.scaler]))
        return out

    def decision(self) -> Decided:
        return Decided(self.classes, self.threshold)

    def stages(self) -> list[Stage]:
        """From vec to prob, pred (the class), and confidence, the probability of the class decided on."""
        if len(self.classes) == 1:  # one class in training: that is the prediction
            return [OneClass(), self.decision()]
        return [*self.preparation(), self.model, *([Calibrated(self.calibrators)] if self.calibrators else []), self.decision()]

    def features(self, rows: DataFrame) -> DataFrame:
        return PipelineModel(self.preparation()).transform(rows)

    def scored(self, rows: DataFrame) -> DataFrame:
        """rows (id, vec, ...) with prob, pred and confidence. vec is what the model read."""
        return PipelineModel(self.stages()).transform(rows)

    def pipeline(self, columns: list[str], target: str) -> PipelineModel:
        """All of it, from a feature table with id to alert states."""
        ends = [Told(self.classes, self.classes, self.threshold), Alerts(notes=self.notes)]
        return PipelineModel([Vectors(columns=columns, target=target), *self.stages(), *ends])


def goal_note(goal: str, row, floor: float) -> str:
    """Fixed form: the goal, its score, and what the threshold gives."""
    short = goal.endswith("recall_floor") and row["recall"] < floor
    value = row["recall"] if short else row["precision"] if goal == "recall_floor" else row["macro_f1"] if goal == "macro_f1" else row["balanced_accuracy"]
    return f"{goal}{'_fallback_recall' if short else ''}:{value:.6f};precision:{row['precision']:.6f};recall:{row['recall']:.6f};balanced_accuracy:{row['balanced_accuracy']:.6f}"


def _score(held: DataFrame, metric: str) -> float:
    """held: y_true, pred_label."""
    row = metrics.score_metrics(held.withColumn("g", F.lit(0)), ["g"]).first()
    return float(row[metric]) if row else float("nan")


def fit_candidate(fit: DataFrame, held: DataFrame | None, name: str, classes: list[int], config: TrainConfig, cap: int | None, k: int | None) -> Bundle:
    """One model on one setting: cap, balance, impute, select, scale, oversample, fit; then calibrate and tune on held."""
    two = len(classes) == 2
    train = splits.cap_per_group_class(fit, cap, "group_id", "y", "id", config.seed) if two else fit
    train = splits.balance_sources(train, config.source_balance, "source", "y", "id", config.seed) if two else train
    train = staged(train.select(*ROW))
    out = Bundle(name, classes, vector_medians(train))
    width, selection = len(out.medians), f"all_{len(out.medians)}"
    if k and 0 < k < width:
        chosen = fit_feature_selector(out.features(train), "y", k, config.selector_trees, config.max_depth, config.seed)
        kept = [r["idx"] for r in chosen.orderBy("idx").collect()]  # one row for each feature kept
        out.selected = kept if len(kept) < width else None
        selection = f"extratrees_top_{len(kept)}" if len(kept) < width else f"skipped_zero_importance_all_{width}"
    if name in SCALED:
        out.scaler = vector_scaler(out.features(train))
    ready = out.features(train)
    sizes = [r["n"] for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()]  # one row for each class
    # The notes of a run.
    resampling = "model_internal_balancing" if name in INTERNAL else smote_note(sizes) if config.smote else "none"
    ready = staged(oversampled(ready, config.seed) if resampling.startswith("smote") else ready)
    out.model = fit_model(ready, name, len(classes), config)
    calibration, tuning = ("skipped_no_calibration_split" if held is None and config.calibration != "none" else "none"), "skipped_no_calibration_split"
    cells = [r["n"] for r in train.groupBy("source").agg(F.count("*").alias("n")).collect()] if two and config.source_balance != "none" else []  # one row for each source
    balance = "none" if not cells else "none_single_source" if len(cells) < 2 else f"source_balanced_total_{min(cells)}" if config.source_balance == "source" else "source_balanced_per_class"
    if held is not None:
        tuning = "none"
        raw = staged(out.model.transform(out.features(held)).select("id", "y", "prob"))
        if config.calibration != "none":
            out.calibrators = fit_calibrators(raw, len(classes), config.calibration)
            raw, calibration = staged(Calibrated(out.calibrators).transform(raw)), f"{config.calibration}_holdout"
        truth = F.get(F.array(*[F.lit(c) for c in classes]), F.col("y").cast("int")).alias("y_true")
        judge = lambda: _score(out.decision().transform(raw).select(truth, F.col("pred").alias("pred_label")), config.selection_metric)
        if two and config.tune_threshold:
            swept = thresholds.sweep(raw.select(F.lit(0).alias("g"), F.col("y").cast("int").alias("y_true"), F.col("prob")[1].alias("proba_1")), ["g"]).persist()
            best = (float("-inf"), None, "none")
            for goal in config.threshold_metric_grid or (config.threshold_metric,):
                row = thresholds.tune(swept, ["g"], goal, config.recall_floor).first()
                out.threshold = row["threshold"]
                score = judge()
                note = f"{goal_note(goal, row, config.recall_floor)};selection_{config.selection_metric}:{score:.6f}"
                best = max(best, (score, out.threshold, note), key=lambda x: x[0])
            swept.unpersist()
            out.score, out.threshold, tuning = best
        else:
            out.score = judge()
    out.notes = {
        "resampling": resampling,
        "calibration": calibration,
        "class_cap": f"cap_{cap}_per_group_class" if two and cap else "none",
        "source_balance": balance,
        "feature_selection": selection,
        "n_selected_features": len(out.selected) if out.selected is not None else len(out.medians),
        "threshold_tuning": tuning,
        "tuning_selection": "none" if out.score is None else f"{config.selection_metric}:{out.score:.6f}",
    }
    return out


def fit_best(train: DataFrame, name: str, config: TrainConfig, grouped: bool = True) -> Bundle:
    """The best of the candidates (caps by numbers of features; the first of equals). train: as ROW, with the class itself as y."""
    classes = [int(r["y"]) for r in train.select("y").distinct().orderBy("y").collect()]  # one row for each class
    if name not in MODELS:
        raise ValueError(f"unknown model: {name} (known: {', '.join(MODELS)})")
    if len(classes) < 2:
        return Bundle(name, classes, notes={"resampling": "skipped_single_class_train", "calibration": "none", "class_cap": "none", "source_balance": "none", "feature_selection": "none", "n_selected_features": None, "threshold_tuning": "skipped_single_class_train", "tuning_selection": "none"})
    place = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("y").cast("int")) - 1
    rows = train.withColumn("y", place.cast("double"))
    if config.calibration == "none":
        fit, held = rows, None
    else:
        split = staged(splits.calibration_split(rows, "y", "id", "group_id" if grouped else None, config.seed))
        fit, held = split.filter(~F.col("calibration")), split.filter("calibration")
        held = None if held.isEmpty() else held
    best = None
    for cap in config.class_cap_grid or (config.class_cap,):
        for k in config.top_k_grid or (config.top_k,):
            one = fit_candidate(fit, held, name, classes, config, cap, k)
            if best is None or (one.score is not None and one.score > (best.score if best.score is not None else float("-inf"))):
                best = one
    return best


# Jobs ----------------------------------------------------------------------------------------------


def model_rows(table: DataFrame, columns: list[str], target: str) -> DataFrame:
    """Rows for models from a feature table with id; rows without the target are left out."""
    vec = F.array(*[F.col(c).cast("double") for c in columns])
    return prep.task_rows(table, target).withColumns({"y": F.col("target"), "vec": vec, "id": F.col("id").cast("string")}).drop("target")


def with_folds(rows: DataFrame, config: TrainConfig) -> DataFrame:
    if config.cv == "loso":
        return splits.folds_loso(rows, "group_id")
    if config.cv == "rows":
        return splits.folds_stratified(rows, config.folds, "y", "id", config.seed)
    return splits.folds_balanced(rows, config.folds, "group_id", "y", config.seed)


def predictions(scored: DataFrame, bundle: Bundle, labels: list[int]) -> DataFrame:
    """pred_label, confidence and a probability for each label (null: unknown to the model)."""
    return Told(bundle.classes, labels, bundle.threshold).transform(scored)


def _exists(spark: SparkSession, name: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def evaluate(table: DataFrame, columns: list[str], target: str, config: TrainConfig, folder: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fold metrics, predictions with alert states, and the summary of each model.

    table has id, group_id, source, subject_id, the time of the window and the features. Models and folds
    run side by side, config.parallel at a time, each in a pool of its own where the scheduler is fair. Each
    writes its predictions and then its notes below `folder` (else below one of this run); what a folder
    holds already isn't made again, so a run that was lost goes on from there.
    """
    spark = table.sparkSession
    folder = folder or f"{shared_dir(spark)}/evaluation-{uuid.uuid4().hex}"
    rows = staged(with_folds(model_rows(table, columns, target), config))
    folds = {r["fold"]: r["n"] for r in rows.groupBy("fold").agg(F.count("*").alias("n")).collect()}  # one row for each fold
    labels = [int(r["y"]) for r in rows.select("y").distinct().orderBy("y").collect()]  # one row for each class
    told_kinds = "model string, fold int, n_train long, n_test long, notes string, decision_threshold double"

    def one(name: str, f: int) -> tuple[DataFrame, DataFrame]:
        place = f"{folder}/{name}-{f}"
        if not _exists(spark, f"{place}/notes/_SUCCESS"):
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"{name}-{f}")
            bundle = fit_best(rows.filter(F.col("fold") != f).select(*ROW), name, config)
            scored = predictions(bundle.scored(rows.filter(F.col("fold") == f)), bundle, labels)
            scored.withColumns({"model": F.lit(name), "y_true": F.col("y").cast("int")}).drop("vec", "y").write.mode("overwrite").parquet(f"{place}/rows")
            note = (name, f, sum(folds.values()) - folds[f], folds[f], json.dumps(bundle.notes), bundle.threshold)
            spark.createDataFrame([note], told_kinds).coalesce(1).write.mode("overwrite").parquet(f"{place}/notes")
        return spark.read.parquet(f"{place}/rows"), spark.read.schema(told_kinds).parquet(f"{place}/notes")

    work = [(name, f) for name in config.models for f in sorted(folds)]
    with ThreadPoolExecutor(max(1, config.parallel)) as pool:
        made = list(pool.map(inheritable_thread_target(spark)(lambda w: one(*w)), work))
    out, told = (reduce(DataFrame.unionByName, part) for part in zip(*made, strict=True))
    preds = decision.alert_state(out, ["model", "fold"])
    keys = ["model", "fold"]
    kinds = "resampling string, calibration string, class_cap string, source_balance string, feature_selection string, n_selected_features int, threshold_tuning string, tuning_selection string"
    told = told.select(*keys, "n_train", "n_test", F.from_json("notes", kinds).alias("n"), "decision_threshold").select(*keys, "n_train", "n_test", "n.*", "decision_threshold")
    scores = told.join(metrics.score_metrics(out, keys).drop("n"), keys, "left").join(metrics.report_json(out, keys, labels), keys, "left")
    return scores, preds, metrics.summarise_folds(scores)


def train_final(table: DataFrame, columns: list[str], target: str, path: str, config: TrainConfig) -> DataFrame:
    """Fit each model on all rows, tuned on a split without groups, and save it as a pipeline: model, training_accuracy, mean_confidence, path."""
    rows = staged(model_rows(table, columns, target).select(*ROW))
    saved = []
    for name in config.models:
        bundle = fit_best(rows, name, config, grouped=False)
        if len(bundle.classes) < 2:
            raise ValueError("final training needs two classes or more")
        bundle.pipeline(columns, target).write().overwrite().save(f"{path}/{name}")
        row = bundle.scored(rows).agg(F.avg((F.col("pred") == F.col("y")).cast("double")).alias("a"), F.avg("confidence").alias("c")).first()
        saved.append((name, row["a"], row["c"], f"{path}/{name}"))
    return table.sparkSession.createDataFrame(saved, "model string, training_accuracy double, mean_confidence double, path string")


def score(path: str, table: DataFrame) -> DataFrame:
    """The feature table with decisions of a saved pipeline: labels, probabilities, confidence and alert states."""
    return PipelineModel.load(path).transform(table)


def holdout(table: DataFrame, columns: list[str], target: str, name: str, config: TrainConfig) -> DataFrame:
    """Predictions for the fifth of rows whose fold is 0, by a model of the rest: id, y_true, pred_label, confidence, proba_<class>."""
    rows = staged(with_folds(model_rows(table, columns, target), config))
    labels = [int(r["y"]) for r in rows.select("y").distinct().orderBy("y").collect()]  # one row for each class
    bundle = fit_best(rows.filter("fold <> 0").select(*ROW), name, config)
    out = predictions(bundle.scored(rows.filter("fold = 0")), bundle, labels)
    return out.select("id", F.col("y").cast("int").alias("y_true"), "pred_label", *[F.round(c, 9).alias(c) for c in ["confidence", *[f"proba_{c}" for c in labels]]])
