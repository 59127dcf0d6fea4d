"""Hand-made frames for the edges of each operator."""

import io
import json
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sensorloom.functions import columns as C
from sensorloom.operators import baseline, decision, eda, hrv, metrics, prep, splits, stats, survey, thresholds, windows
from sensorloom.schema import base_features
from sensorloom.sources import reports, sessions


def one(df):
    return df.first().asDict()


def test_feature_names():
    assert len(base_features()) == 173 == len(set(base_features()))


def test_subject_ids_and_clocks(spark):
    rows = spark.createDataFrame([(" 15.0 ", "7:05:30.9"), ("15.5", "24:00"), (None, "x"), ("AB", "12")], "a string, b string")
    got = rows.select(C.normalize_subject_id(F.col("a")).alias("a"), C.parse_clock(F.col("b")).alias("b")).collect()
    assert [tuple(r) for r in got] == [("15", 7 * 3600 + 330), ("15.5", None), ("", None), ("AB", 43200)]


def test_dates_and_iso(spark):
    rows = spark.createDataFrame([("2020-4-09", 0.5), ("4/9/2020", -1.0), ("9.4.2020", 86399.25), ("no", 1e9)], "d string, t double")
    got = rows.select(C.parse_date(F.col("d")).cast("string"), C.iso_utc(F.col("t"))).collect()
    assert [r[0] for r in got] == ["2020-04-09"] * 3 + [None]
    assert [r[1] for r in got] == ["1970-01-01T00:00:00.500000+00:00", "1969-12-31T23:59:59.000000+00:00", "1970-01-01T23:59:59.250000+00:00", "2001-09-09T01:46:40.000000+00:00"]


def readings(spark, rates, seconds, late=()):
    rows = [("field", "s1", "a", name, float(fs), 10.0 if name in late else 0.0, i, float(i % 7)) for name, fs in rates.items() for i in range(int(fs * (seconds - (10 if name in late else 0))))]
    return spark.createDataFrame(rows, "source string, subject_id string, session_id string, signal string, fs double, start_ts double, sample_idx long, value double")


def test_sampled_windows(spark):
    """130 s of four rates give two whole windows of 60 s; a signal that starts late is shifted."""
    rows = windows.align_signals(readings(spark, {"acc": 32, "bvp": 64, "eda": 4, "hr": 1}, 130, late=("hr",)))
    got = windows.assign_sampled_windows(rows, 60, 60).groupBy("signal", "window_id").count().collect()
    count = {(r["signal"], r["window_id"]): r["count"] for r in got}
    assert count == {("acc", 0): 1920, ("acc", 1): 1920, ("bvp", 0): 3840, ("bvp", 1): 3840, ("eda", 0): 240, ("eda", 1): 240, ("hr", 0): 50, ("hr", 1): 60}


def test_stats_of_missing_and_short_signals(spark):
    rows = spark.createDataFrame([("a", 1, float("nan")), ("a", 2, None), ("b", 1, 5.0), ("c", 1, 2.0), ("c", 2, 2.0), ("c", 3, 2.0)], "k string, i int, v double")
    got = {r["k"]: r for r in stats.basic_stats(rows, ["k"], "v").collect()}
    assert got["a"]["n"] == 0 and got["a"]["value_mean"] is None and got["a"]["value_iqr"] is None
    assert got["b"]["value_std"] == 0 and got["b"]["value_energy"] == 25
    slopes = {r["k"]: r["slope"] for r in stats.slope(rows, ["k"], "v", ["i"]).collect()}
    assert slopes["a"] is None and slopes["b"] is None and slopes["c"] == 0
    assert {r["k"]: r["peak_count"] for r in stats.peak_count(rows, ["k"], "v", ["i"]).collect()} == {"b": 0, "c": 0}


@pytest.mark.parametrize("width", [3, 6, 7, 80])
def test_tonic_is_the_centred_median(spark, width):
    x = np.random.default_rng(width).normal(size=240)
    rows = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "k int, i int, v double")
    got = eda.tonic_phasic(rows, ["k"], "v", ["i"], width).orderBy("i").toPandas()["tonic"]
    want = pd.Series(x).rolling(width, min_periods=1, center=True).median()
    assert np.allclose(got, want)
    assert eda.tonic_width(240, 4.0) == 80


def test_beats_keep_the_strongest():
    place, height = np.array([0, 10, 15, 40, 45]), np.array([1.0, 5.0, 9.0, 7.0, 2.0])
    assert hrv.strongest_beats(place, height, 19).tolist() == [2, 3]


def test_band_powers_of_a_known_wave():
    t = np.cumsum(np.full(200, 0.8))
    lf, hf = hrv.band_powers(0.8 + 0.05 * np.sin(2 * np.pi * 0.1 * t))
    assert lf > 50 * hf
    assert hrv.band_powers(np.full(7, 0.8)) is None


def test_ibi_grid(spark):
    rows = spark.createDataFrame([("s", "a", 2.1, 0.8), ("s", "a", 2.9, 0.9), ("s", "a", 5.0, 1.0)], "subject_id string, session_id string, rel_t double, ibi double")
    assert [r["ibi"] for r in windows.ibi_grid(rows).orderBy("sec").collect()] == [0.9, 0.9, 0.9, 0.9, 0.9, 1.0]


def test_survey_rows(spark):
    rows = [("15.0", "2020-04-09", "23:30:00", "00:15:00", "2"), ("15", "2020-04-09", "08:00", "08:00", "0"), ("15", "2020-04-09", "08:00", None, "1"), ("15", "2020-04-09", "08:00", "09:00", "na"), (None, "2020-04-09", "08:00", "09:00", "1"), ("15", "2020-04-09", "08:00", "09:00", "3")]
    raw = spark.createDataFrame(rows, "ID string, date string, `Start time` string, `End time` string, `Stress level` string")
    got = survey.survey_intervals(raw, -4.0).orderBy("survey_start_ts").collect()
    assert [(r["survey_end_ts"] - r["survey_start_ts"], r["nurse_label"]) for r in got] == [(0.0, 0), (2700.0, 2)]
    assert got[0]["survey_start_ts"] == pd.Timestamp("2020-04-09 12:00", tz="UTC").timestamp()


@pytest.mark.parametrize("bucket", [None, 100.0])
def test_overlap_labels(spark, bucket):
    w = spark.createDataFrame([("f", "s", "a", i, 100.0 * i, 100.0 * i + 100) for i in range(5)] + [("f", "t", "a", 0, 0.0, 100.0)], "source string, subject_id string, session_id string, window_id int, window_start_ts double, window_end_ts double")
    # Window 0: equal halves, the earlier wins. 1: .49. 2: .50. 3: only touched. 4: an empty interval.
    iv = spark.createDataFrame([("s", 0.0, 50.0, 2), ("s", 50.0, 100.0, 1), ("s", 100.0, 149.0, 1), ("s", 250.0, 300.0, 0), ("s", 450.0, 450.0, 2)], "subject_id string, survey_start_ts double, survey_end_ts double, nurse_label int")
    got = {(r["subject_id"], r["window_id"]): (r["nurse_label"], round(r["label_overlap_ratio"], 6)) for r in survey.label_by_overlap(w, iv, 0.5, bucket).collect()}
    assert got == {("s", 0): (2, 0.5), ("s", 1): (None, 0.49), ("s", 2): (0, 0.5), ("s", 3): (None, 0.0), ("s", 4): (None, 0.0), ("t", 0): (None, 0.0)}


def test_baseline_scale_and_order(spark):
    rows = [("lab", "p", i, None, 60.0 * i, 60.0, 1 if i >= 2 else 2, 5.0, float(i)) for i in range(5)] + [("field", "q", 0, 0.0, 0.0, 60.0, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "source string, subject_id string, window_id int, window_start_ts double, window_start_sec double, window_duration_sec double, protocol_label int, c double, x double")
    got = {(r["source"], r["window_id"]): r for r in baseline.add_personal_baseline(df, ["c", "x"], 2).collect()}
    assert len(got) == 6
    assert got["lab", 0]["baseline_quality_n"] == 2 and got["lab", 0]["x_delta_base"] == -2.5  # windows 2 and 3
    assert got["lab", 0]["c_z_personal"] == 0  # no spread: scale 1
    assert got["field", 0]["x_z_personal"] == 0


GOLD = [(0, 2)] * 24 + [(2, 2)] * 10


def test_golden_metrics(spark):
    preds = spark.createDataFrame([("m", 0, t, p) for t, p in GOLD], "model string, fold int, y_true int, pred_label int")
    got = one(metrics.score_metrics(preds, ["model", "fold"]))
    assert [round(got[m], 6) for m in metrics.METRICS] == [0.294118, 0.5, 0.227273, 0.13369]
    report = {r["class"]: r for r in metrics.classification_report(preds, ["model"], [0, 1, 2]).collect()}
    assert round(report["macro avg"]["f1"], 6) == 0.151515
    js = one(metrics.report_json(preds, ["model"], [0, 1, 2]))
    assert json.loads(js["confusion_matrix"]) == [[0, 0, 24], [0, 0, 0], [0, 0, 10]]
    assert json.loads(js["classification_report"])["2"]["recall"] == 1.0


def test_golden_fold_summary(spark):
    rows = [("m", i, a, b, c, d) for i, (a, b, c, d) in enumerate([(0.0, 0.0, 0.0, 0.0), (0.0, 0.0, 0.0, 0.0), (0.294118, 0.5, 0.227273, 0.13369)])]
    got = one(metrics.summarise_folds(spark.createDataFrame(rows, "model string, fold int, accuracy double, balanced_accuracy double, macro_f1 double, weighted_f1 double")))
    assert abs(got["accuracy_mean"] - 0.098039) < 1e-6 and abs(got["accuracy_std"] - 0.169809) < 1e-6 and abs(got["weighted_f1_std"] - 0.077186) < 1e-6


def test_sweep_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    score = np.concatenate([rng.random(300), np.array(thresholds.THRESHOLDS)])
    truth = (rng.random(len(score)) < score).astype(int)
    df = spark.createDataFrame([("g", int(t), float(s)) for t, s in zip(truth, score, strict=True)], "g string, y_true int, proba_1 double")
    got = {r["threshold"]: r for r in thresholds.sweep(df, ["g"]).collect()}
    assert sorted(got) == sorted(thresholds.THRESHOLDS)
    for t in thresholds.THRESHOLDS:
        p = score >= t
        tp, fp = (p & (truth == 1)).sum(), (p & (truth == 0)).sum()
        assert abs(got[t]["recall"] - tp / (truth == 1).sum()) < 1e-12
        assert abs(got[t]["precision"] - (tp / (tp + fp) if tp + fp else 0)) < 1e-12


def test_alert_states(spark):
    cols = "source string, subject_id string, window_start_ts double, pred_label int, confidence double, hr_mean_delta_base double, eda_mean_delta_base double, acc_activity_z_personal double, proba_1 double"
    rows = [(2, 0.9, 0, 0, 0), (2, 0.9, 0, 0, 0), (2, 0.9, 0, 0, 0), (2, 0.9, 11, 0, 2), (1, 0.5, 0, 0, 0), (0, 0.2, 0, 0, 0), (0, 0.9, 0, 0, 0), (None, None, None, None, None)]
    df = spark.createDataFrame([("f", "s", float(i), p, c, *[None if x is None else float(x) for x in r], 0.5) for i, (p, c, *r) in enumerate(rows)], cols)
    got = [r.asDict() for r in decision.alert_state(df.withColumn("proba_2", F.lit(0.1))).orderBy("window_start_ts").collect()]
    assert [r["alert_state"] for r in got] == ["rising_stress", "persistent_stress", "critical_alert", "physical_activity_delay", "monitor_more", "low_confidence_normal", "normal", "low_confidence_normal"]
    assert [r["streak"] for r in got] == [1, 2, 3, 4, 0, 0, 0, 0]
    assert [r["decision_adjusted_label"] for r in got] == [2, 2, 2, 1, 1, 0, 0, 0]
    assert decision.alert_state(df).filter("alert_state = 'monitor_more'").count() == 1  # two classes: 1 is stress, .5 is too unsure


def test_splits_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(i, f"g{i % 12}", i % 2) for i in range(120)], "id long, group_id string, label int")
    for f in (lambda d: splits.folds_group(d, 4, "group_id", "label"), lambda d: splits.folds_stratified(d, 5, "label", "id"), lambda d: splits.cap_per_group_class(d, 3, "group_id", "label", "id"), lambda d: splits.calibration_split(d, "label", "id", "group_id")):
        a, b = (sorted(map(tuple, f(df.repartition(n)).collect())) for n in (1, 8))
        assert a == b
    folds = splits.folds_group(df, 4, "group_id", "label").groupBy("group_id").agg(F.count_distinct("fold").alias("n"))
    assert folds.filter("n > 1").count() == 0


def test_smote_and_neighbours(spark):
    rng = np.random.default_rng(0)
    rows = [(i, int(i >= 30), [float(v) for v in rng.normal(size=3)]) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, label int, vec array<double>")
    made = prep.smote(df).collect()
    assert len(made) == 20 and {r["label"] for r in made} == {1}
    assert prep.smote(df.filter("id < 32")).count() == 0  # a class of two rows
    near = prep.nearest(df.filter("id < 5"), df, 3).toPandas()
    x = np.array([r[2] for r in rows])
    for q, g in near.groupby("q_id"):
        assert g.sort_values("rank")["id"].tolist() == np.argsort(((x - x[q]) ** 2).sum(1), kind="stable")[:3].tolist()


def test_imputing_keeps_empty_columns(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, None)], "a double, b double")
    assert prep.fit_medians(df, ["a", "b"]) == {"a": 2.0, "b": 0.0}
    assert prep.fit_scaler(spark.createDataFrame([(2.0,), (2.0,)], "a double"), ["a"]) == {"a": (2.0, 1.0)}
    with pytest.raises(ValueError, match="c"):
        prep.require_columns(df, ["a", "c"])


def test_session_archives(spark, tmp_path):
    folder = tmp_path / "S1"
    folder.mkdir()
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("ACC.csv", "100.0, 100.0, 100.0\n32.0, 32.0, 32.0\n1,2,3\n4,x,6\n")
        z.writestr("HR.csv", "110.0\n1.0\n70\n71\n")
        z.writestr("IBI.csv", "100.0, IBI\n1.5,0.8\nbad\n2.5,0.9\n")
        z.writestr("EDA.csv", "")
    (folder / "dev_100.zip").write_bytes(held.getvalue())
    (folder / "dev_200.zip").write_bytes(b"broken")
    rows = sessions.read_sessions(spark, f"{tmp_path}/*/*.zip").collect()
    got = {(r["signal"], r["sample_idx"]): r["value"] for r in rows}
    assert got == {("acc_x", 0): 1.0, ("acc_x", 1): 4.0, ("acc_y", 0): 2.0, ("acc_y", 1): None, ("acc_z", 0): 3.0, ("acc_z", 1): 6.0, ("hr", 0): 70.0, ("hr", 1): 71.0}
    assert rows[0]["subject_id"] == "S1" and rows[0]["session_id"] == "dev_100"
    assert sessions.read_beats(spark, f"{tmp_path}/*/*.zip").count() == 2


def test_feature_table_is_reused(spark, tmp_path):
    path, calls = f"{tmp_path}/features", []

    def build():
        calls.append(1)
        return spark.createDataFrame([("lab", "s", 1.0)], "source string, subject_id string, window_start_ts double")

    for rebuild in (False, False, True):
        assert reports.read_features(spark, path, build, rebuild).count() == 1
    assert len(calls) == 2
