"""Fitting, tuning, saving and scoring of every kind of model, on small tables."""

import json

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from sensorloom.config import TrainConfig
from sensorloom.jobs import audit, models, stages, trees
from sensorloom.operators import decision, metrics, prep
from sensorloom.sources import reports
from sensorloom.sources.scratch import shared_dir

COLS = ["a", "b", "c"]
SMALL = TrainConfig(folds=3, forest_trees=8, extra_trees=8, balanced_trees=8, selector_trees=4, boosting_rounds=3, max_depth=3, class_cap=40)


@pytest.fixture(scope="module")
def table(spark):
    """Three separable classes in 12 groups of two sources, with holes; class 0 is the largest."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(180):
        y = 0 if i % 6 < 3 else 1 if i % 6 < 5 else 2
        x = rng.normal(size=3) + np.array([3.0 * y, -2.0 * y, 0.0])
        cells = [None if rng.random() < 0.05 else float(v) for v in x]
        rows.append((i, "lab" if i % 4 else "field", f"s{i % 12}", f"g{i % 12}", float(i), y, int(y > 0), *cells, None))
    return spark.createDataFrame(rows, "id long, source string, subject_id string, group_id string, window_start_ts double, target3 int, target_binary int, a double, b double, c double, empty double").cache()


@pytest.mark.parametrize("name", models.MODELS)
def test_every_model_learns_three_classes(table, name):
    got = models.holdout(table, [*COLS, "empty"], "target3", name, SMALL).toPandas()
    assert len(got) == table.count() / 3
    assert np.allclose(got[["proba_0", "proba_1", "proba_2"]].sum(axis=1), 1, atol=1e-6)
    assert (got["y_true"] == got["pred_label"]).mean() > 0.75
    assert (got[["proba_0", "proba_1", "proba_2"]].to_numpy().argmax(1) == got["pred_label"]).all()


@pytest.mark.parametrize("method", ["sigmoid", "isotonic", "none"])
def test_calibration_and_thresholds(table, method):
    config = TrainConfig(**{**SMALL.__dict__, "calibration": method, "smote": False, "threshold_metric_grid": ("recall_floor", "macro_f1")})
    rows = models.model_rows(table, COLS, "target_binary")
    bundle = models.fit_best(rows.select(*models.ROW), "rf", config)
    assert len(bundle.calibrators) == (method != "none") and (bundle.threshold is None) == (method == "none")
    out = bundle.scored(rows).toPandas()
    p = np.stack(out["prob"].to_numpy())
    assert np.allclose(p.sum(1), 1)
    if bundle.threshold is not None:
        assert (out["pred"] == (p[:, 1] >= bundle.threshold)).all()
    assert np.allclose(out["confidence"], p[np.arange(len(p)), out["pred"]])


def test_grid_keeps_the_best_candidate(table):
    config = TrainConfig(**{**SMALL.__dict__, "class_cap_grid": (None, 5), "top_k_grid": (1, 2)})
    bundle = models.fit_best(models.model_rows(table, COLS, "target_binary").select(*models.ROW), "gnb", config)
    assert len(bundle.selected) in (1, 2) and set(bundle.selected) <= {0, 1, 2} and bundle.score > 0.7
    assert bundle.notes["feature_selection"] in ("extratrees_top_1", "extratrees_top_2")
    assert bundle.notes["class_cap"] in ("none", "cap_5_per_group_class") and bundle.notes["resampling"] == "smote_k5"
    assert bundle.notes["threshold_tuning"].startswith("balanced_accuracy:") and ";selection_balanced_accuracy:" in bundle.notes["threshold_tuning"]


def test_unknown_names_and_one_class(table, spark):
    with pytest.raises(ValueError, match="unknown model"):
        models.fit_best(models.model_rows(table, COLS, "target3").select(*models.ROW), "svm", SMALL)
    one = models.model_rows(table.filter("target3 = 1"), COLS, "target3")
    bundle = models.fit_best(one.select(*models.ROW), "rf", SMALL)
    assert {(r["pred"], r["confidence"]) for r in bundle.scored(one).collect()} == {(1, 1.0)}
    got = models.predictions(bundle.scored(one), bundle, [0, 1]).first()
    assert got["proba_0"] is None and got["proba_1"] == 1.0


def test_naive_bayes_and_neighbours_give_probabilities(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(60, 2)), np.arange(60) % 3
    x[:, 0] += y
    df = spark.createDataFrame([(str(i), float(c), [float(v) for v in r]) for i, (c, r) in enumerate(zip(y, x, strict=True))], "id string, y double, vec array<double>")
    got = models.fit_model(df, "gnb", 3, SMALL).transform(df).toPandas().set_index("id")["prob"]
    eps = 1e-8 * x.var(0).max()
    like = np.stack([np.exp(-0.5 * ((x - x[y == c].mean(0)) ** 2 / (x[y == c].var(0) + eps) + np.log(2 * np.pi * (x[y == c].var(0) + eps))).sum(1)) / 3 for c in range(3)], axis=1)
    assert np.allclose(np.stack([got[str(i)] for i in range(60)]), like / like.sum(1, keepdims=True))
    asked = df.withColumn("vec", F.transform("vec", lambda v: v + 0.01))
    got = models.fit_model(df, "knn", 3, SMALL).transform(asked).toPandas().set_index("id")["prob"]
    for i in range(60):
        d = np.sqrt(((x - x[i] - 0.01) ** 2).sum(1))
        near = np.argsort(d, kind="stable")[:9]
        share = np.array([(1 / d[near])[y[near] == c].sum() for c in range(3)])
        assert np.allclose(got[str(i)], share / share.sum())


@pytest.mark.parametrize("cv, folds", [("group", 3), ("rows", 2), ("loso", 12)])
def test_evaluation_writes_its_report(table, tmp_path, cv, folds):
    config = TrainConfig(**{**SMALL.__dict__, "models": ("gnb",), "cv": cv, "folds": folds, "calibration": "sigmoid" if cv == "group" else "none", "smote": cv != "loso"})
    scores, preds, summary = models.evaluate(table, COLS, "target3", config)
    got, rows = scores.toPandas(), preds.toPandas()
    assert len(got) == folds and got["n_test"].sum() == len(rows) == 180 and (got["n_train"] + got["n_test"] == 180).all()
    assert len(got.columns) == 19
    one = rows[rows["fold"] == 0]
    first = got[got["fold"] == 0].iloc[0]
    assert abs(first["accuracy"] - (one["y_true"] == one["pred_label"]).mean()) < 1e-12
    assert np.sum(json.loads(first["confusion_matrix"])) == len(one)
    assert set(rows["alert_state"]) <= set(decision.ACTIONS)
    if cv == "group":
        assert rows.groupby("group_id")["fold"].nunique().max() == 1
        reports.write_report(scores, preds, summary, f"{tmp_path}/report")
        assert preds.sparkSession.read.parquet(f"{tmp_path}/report/predictions").count() == 180
        assert preds.sparkSession.read.json(f"{tmp_path}/report/summary").count() == 1


def test_evaluation_goes_on_where_it_was_lost(table, tmp_path, monkeypatch):
    """Side by side or one by one, the metrics are the same; what is written isn't made again."""
    config = TrainConfig(**{**SMALL.__dict__, "models": ("gnb", "knn"), "calibration": "none"})
    whole = {(r["model"], r["fold"]): (r["accuracy"], r["resampling"]) for r in models.evaluate(table, COLS, "target3", config)[0].collect()}
    kept, calls = models.fit_best, []

    def lost(train, name, *args, **kinds):
        calls.append(name)
        if name == "knn":
            raise RuntimeError("lost")
        return kept(train, name, *args, **kinds)

    monkeypatch.setattr(models, "fit_best", lost)
    one_by_one = TrainConfig(**{**config.__dict__, "parallel": 1})
    with pytest.raises(RuntimeError, match="lost"):
        models.evaluate(table, COLS, "target3", one_by_one, f"{tmp_path}/run")
    assert calls.count("gnb") == 3
    monkeypatch.setattr(models, "fit_best", lambda train, name, *a, **k: calls.append(f"again {name}") or kept(train, name, *a, **k))
    got = {(r["model"], r["fold"]): (r["accuracy"], r["resampling"]) for r in models.evaluate(table, COLS, "target3", one_by_one, f"{tmp_path}/run")[0].collect()}
    assert got == whole and len(got) == 6 and calls.count("again knn") == 3 and "again gnb" not in calls


@pytest.mark.parametrize("name", models.MODELS)
def test_saved_pipelines_score_alike(table, tmp_path, name):
    config = TrainConfig(**{**SMALL.__dict__, "models": (name,), "top_k": 2})
    saved = models.train_final(table, COLS, "target3", f"{tmp_path}/b", config)
    row = saved.first()
    assert row["training_accuracy"] > 0.75 and 0 < row["mean_confidence"] <= 1
    loaded = PipelineModel.load(row["path"])
    first, told = loaded.stages[0], next(s for s in loaded.stages if isinstance(s, stages.Told))
    assert (first.getOrDefault("columns"), first.getOrDefault("target"), told.getOrDefault("classes")) == (COLS, "target3", [0, 1, 2])
    assert loaded.stages[-1].getOrDefault("notes")["feature_selection"] == "extratrees_top_2"
    got = models.score(row["path"], table).toPandas()
    assert len(got) == 180 and abs((got["pred_label"] == got["target3"]).mean() - row["training_accuracy"]) < 1e-12
    assert got["alert_state"].notna().all()
    with pytest.raises(ValueError, match="missing"):
        models.score(row["path"], table.drop("b"))
    assert metrics.pick_best(table.sparkSession.createDataFrame([], "model string, weighted_f1 double"), saved).first()["model"] == name


@pytest.mark.parametrize(("name", "target", "method"), [("rf", "target_binary", "isotonic"), ("knn", "target3", "isotonic"), ("gbt", "target_binary", "sigmoid"), ("gnb", "target_binary", "none")])
def test_a_pipeline_is_the_same_before_and_after_saving(table, tmp_path, name, target, method):
    """Every stage, its parts and its params, and a pipeline that was saved twice."""
    config = TrainConfig(**{**SMALL.__dict__, "calibration": method})
    bundle = models.fit_best(models.model_rows(table, COLS, target).select(*models.ROW), name, config, grouped=False)
    made = bundle.pipeline(COLS, target)
    made.write().overwrite().save(f"{tmp_path}/one")
    once = PipelineModel.load(f"{tmp_path}/one")
    once.write().overwrite().save(f"{tmp_path}/two")
    twice = PipelineModel.load(f"{tmp_path}/two")
    assert [s.uid for s in made.stages] == [s.uid for s in once.stages] == [s.uid for s in twice.stages]
    assert [type(s) for s in made.stages] == [type(s) for s in twice.stages]
    told = [{p.name: v for p, v in s.extractParamMap().items()} for s in made.stages]
    assert told == [{p.name: v for p, v in s.extractParamMap().items()} for s in twice.stages]
    want, *others = [m.transform(table).orderBy("id").select("id", "pred_label", "confidence", "proba_0", "proba_1", "decision_threshold", "alert_state").collect() for m in (made, once, twice)]
    assert others == [want, want] and len(want) == 180
    assert (want[0]["decision_threshold"] is None) == (bundle.threshold is None)


def test_stages_by_hand(spark):
    df = spark.createDataFrame([(1, [1.0, None, 5.0], [0.3, 0.7]), (2, [None, 2.0, 3.0], [0.5, 0.5])], "id int, vec array<double>, prob array<double>").orderBy("id")
    vec = PipelineModel([stages.Imputed(medians=[9.0, 8.0, 7.0]), stages.Selected(places=[2, 1]), stages.Scaled(means=[3.0, 2.0], deviations=[2.0, 3.0])])
    assert [r["vec"] for r in vec.transform(df).collect()] == [[1.0, 2.0], [0.0, 0.0]]
    assert [(r["pred"], r["confidence"]) for r in stages.Decided([4, 6]).transform(df).collect()] == [(6, 0.7), (4, 0.5)]
    assert [(r["pred"], r["confidence"]) for r in stages.Decided([4, 6], 0.8).transform(df).collect()] == [(4, 0.3), (4, 0.5)]
    out = PipelineModel([stages.Decided([4, 6]), stages.Told([4, 6], [4, 5, 6])]).transform(df).collect()
    assert [(r["proba_4"], r["proba_5"], r["proba_6"], r["decision_threshold"]) for r in out] == [(0.3, None, 0.7, None), (0.5, None, 0.5, None)]
    only = PipelineModel([stages.OneClass(), stages.Decided([7])]).transform(df).collect()
    assert [(r["pred"], r["confidence"]) for r in only] == [(7, 1.0), (7, 1.0)]


@pytest.mark.parametrize("q", [0.0, 0.5, 0.75])
def test_percentiles_are_exact(spark, q):
    """Groups of many sizes, with ties in the large one, and one without values."""
    rng = np.random.default_rng(2)
    groups = {str(n): np.round(rng.normal(size=n), 2 if n > 1000 else 6) for n in (1, 2, 3, 4, 5, 6, 7, 100, 30_001)}
    df = spark.createDataFrame([(k, float(v)) for k, x in groups.items() for v in x] + [("none", None)], "g string, v double")
    got = {r["g"]: r["q"] for r in prep.percentiles(df, ["g"], "v", q).collect()}
    assert got.pop("none") is None
    assert all(abs(got[k] - np.percentile(x, 100 * q)) < 1e-12 for k, x in groups.items()) and len(got) == len(groups)
    assert abs(prep.percentiles(df.filter("g = '30001'"), [], "v", q).first()["q"] - got["30001"]) < 1e-12


def test_column_rules(spark):
    names = ["x", "hour", "Month", "window_hours", "hour_of_peak", "subject_age", "my_label", "window_duration_sec", "survey_offset_hours", "baseline_quality_n", "alert_n"]
    df = spark.createDataFrame([tuple(1.0 for _ in names)], ", ".join(f"{n} double" for n in names))
    assert prep.feature_columns(df) == ["x", "hour_of_peak", "baseline_quality_n"]
    assert prep.feature_columns(df, include_time=True) == ["x", "hour", "Month", "hour_of_peak", "baseline_quality_n"]
    assert prep.baseline_columns(df) == ["x", "hour", "Month", "window_hours", "hour_of_peak", "window_duration_sec", "survey_offset_hours", "baseline_quality_n", "alert_n"]


def test_audits(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.5), (2, 0.2), (None, 0.1)], "nurse_label int, label_overlap_ratio double")
    assert audit.label_audit(df).first().asDict() == {"labelled": 3, "mean_overlap": pytest.approx(1.6 / 3), "below_least": 1}
    assert audit.forbidden_columns(["acc_mean", "nurse_label", "window_start_ts"]) == ["nurse_label", "window_start_ts"]


@pytest.mark.parametrize("classes", [2, 3])
def test_a_forest_gives_the_shares_of_the_built_in_one(spark, classes):
    """Trees of many nodes and trees of one; rows at a threshold go the same way."""
    rng = np.random.default_rng(6)
    x, y = np.round(rng.normal(size=(400, 5)), 1), rng.integers(0, classes, 400)
    df = stages.with_vector(spark.createDataFrame([(str(i), float(c), [float(v) for v in r], 1.0 + i % 3) for i, (c, r) in enumerate(zip(y, x, strict=True))], "id string, y double, vec array<double>, weight double"))
    for depth in (0, 6):
        model = models.forest(7, depth, 1).fit(df)
        grown = trees.saved_forest(spark, *_saved(model, spark), classes)
        assert len(grown.roots) == 7 and (depth > 0 or (grown.feature == -1).all())
        got = np.stack(stages.Forest(model).transform(df.select("id", "vec")).toPandas().set_index("id").loc[[str(i) for i in range(400)], "prob"])
        want = np.stack([p.toArray() for p in model.transform(df).toPandas().set_index("id").loc[[str(i) for i in range(400)], "probability"]])
        assert np.allclose(got, want, rtol=0, atol=1e-12)


def _saved(model, spark):
    path = f"{shared_dir(spark)}/forest-of-test-{id(model)}"
    model.write().overwrite().save(path)
    return (path,)
