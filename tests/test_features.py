"""The feature table from session archives, against the definitions written out in numpy."""

import io
import os
import sys
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sensorloom import catalogue
from sensorloom.config import WindowConfig
from sensorloom.jobs import features
from sensorloom.operators import prep, windows
from sensorloom.schema import base_features
from sensorloom.sources import sessions

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle import check

START, SECONDS = 1_586_400_000.0, 130
RATES = {"ACC": 32.0, "BVP": 64.0, "EDA": 4.0, "TEMP": 4.0, "HR": 1.0}


def made_signals(seed):
    """Samples of one session by file; motion in counts, some missing cells, heart rate 10 s late."""
    rng = np.random.default_rng(seed)
    t = lambda fs, s=SECONDS: np.arange(int(fs * s)) / fs
    acc = np.stack([20 + 8 * np.sin(t(32)), 40 + rng.normal(size=len(t(32))), 5 * rng.normal(size=len(t(32)))], axis=1).round(3)
    acc[7, 1] = np.nan
    bvp = (60 * np.sin(2 * np.pi * 1.2 * t(64)) + 10 * rng.normal(size=len(t(64)))).round(3)
    eda = (2 + 0.3 * np.sin(t(4) / 5) + 0.05 * rng.normal(size=len(t(4)))).round(4)
    eda[[3, 50, 51]] = np.nan
    return {"ACC": acc, "BVP": bvp, "EDA": eda, "TEMP": (33 + rng.normal(size=len(t(4))) / 10).round(3), "HR": (70 + rng.normal(size=SECONDS - 10)).round(2)}


def archive(signals, beats):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for name, x in signals.items():
            rows = np.atleast_2d(x.T).T
            start = START + (10 if name == "HR" else 0)
            lines = [",".join([str(start)] * rows.shape[1]), ",".join([str(RATES[name])] * rows.shape[1]), *(",".join("" if np.isnan(v) else repr(float(v)) for v in r) for r in rows)]
            z.writestr(f"{name}.csv", "\n".join("x" if not line else line for line in lines))
        z.writestr("IBI.csv", "\n".join([f"{START}, IBI", *(f"{a},{b}" for a, b in beats)]))
    return held.getvalue()


def eight(prefix, x):
    if not len(x):
        return {}
    low, mid, high = np.percentile(x, [25, 50, 75])
    return {f"{prefix}_{k}": v for k, v in zip(("mean", "std", "median", "min", "max", "iqr", "range", "energy"), (x.mean(), x.std(), mid, x.min(), x.max(), high - low, np.ptp(x), (x**2).mean()), strict=True)}


def tops(x, k):
    return [i for i in range(1, len(x) - 1) if x[i - 1] < x[i] >= x[i + 1] and x[i] > x.mean() + k * x.std()]


def variability(prefix, rr):
    rr = rr[(rr >= 0.3) & (rr <= 2)]
    if len(rr) < 2:
        return {}
    ms, step = rr * 1000, np.diff(rr * 1000)
    out = eight(f"{prefix}_rr_ms", ms) | {f"{prefix}_{k}": v for k, v in {"sdnn_ms": ms.std(ddof=1), "rmssd_ms": np.sqrt((step**2).mean()), "pnn50": (abs(step) > 50).mean(), "cvnn": ms.std() / (ms.mean() + 1e-8), "hr_mean": (60000 / ms).mean(), "hr_std": (60000 / ms).std()}.items()}
    at = np.concatenate([[0], np.cumsum(rr)[:-1]])
    if len(rr) >= 8 and at[-1] >= 20:
        level = np.interp(np.arange(0, at[-1], 0.25), at, ms)
        power, freq = abs(np.fft.rfft(level - level.mean())) ** 2 / len(level), np.fft.rfftfreq(len(level), 0.25)
        lf, hf = (np.trapezoid(power[(freq >= a) & (freq < b)], freq[(freq >= a) & (freq < b)]) for a, b in ((0.04, 0.15), (0.15, 0.4)))
        out |= {f"{prefix}_lf_power": lf, f"{prefix}_hf_power": hf, f"{prefix}_lf_hf_ratio": lf / (hf + 1e-8), f"{prefix}_hf_norm": hf / (lf + hf + 1e-8)}
    return out


def expected(parts):
    """All features of one window. parts: (samples, rate) by signal."""
    out = {}
    xyz = parts["ACC"][0]
    xyz = xyz[~np.isnan(xyz).any(axis=1)]
    xyz = xyz / 64 if abs(xyz).max() > 8 else xyz
    mag, moved = np.linalg.norm(xyz, axis=1), np.linalg.norm(xyz - np.median(xyz, axis=0), axis=1)
    jerk = np.diff(mag) * 32
    for name, x in zip(("x", "y", "z", "mag", "dyn_mag", "jerk"), (*xyz.T, mag, moved, jerk), strict=True):
        out |= eight(f"acc_{name}", x)
    still = max(0.03, np.percentile(moved, 25) + 0.5 * moved.std())
    out |= {"acc_activity": moved.std() + abs(jerk).mean(), "acc_posture_tilt": xyz[:, 2].mean() / (mag.mean() + 1e-8), "acc_stationary_ratio": (moved < still).mean(), "acc_active_ratio": (moved > 0.15).mean()}
    out |= {"acc_signal_magnitude_area": abs(xyz).sum(axis=1).mean(), "acc_vector_magnitude_area": abs(mag - np.median(mag)).mean(), "acc_jerk_zero_cross_rate": ((jerk[1:] < 0) != (jerk[:-1] < 0)).mean()}
    for name in ("EDA", "TEMP", "BVP", "HR", "IBI"):
        x, fs = parts[name][0][~np.isnan(parts[name][0])], parts[name][1]
        low = name.lower()
        out |= eight(low, x) | ({f"{low}_slope": (x[-1] - x[0]) / ((len(x) - 1) / fs)} if len(x) > 1 else {})
        if name == "EDA":
            d, n = np.diff(x), len(tops(x, 0.25))
            out |= {"eda_rise_rate": (d > 0).mean(), "eda_abs_diff_mean": abs(d).mean(), "eda_peak_count": n, "eda_peak_rate": n / (len(x) / fs)}
            width = max(3, round(min(20, max(4, len(x) / fs / 3)) * fs))
            tonic = pd.Series(x).rolling(width, min_periods=1, center=True).median().to_numpy()
            up = np.maximum(x - tonic, 0)
            high = up[tops(up, 0.25)]
            out |= eight("eda_tonic", tonic) | eight("eda_phasic", x - tonic)
            out |= {"eda_tonic_slope": (tonic[-1] - tonic[0]) / ((len(x) - 1) / fs), "eda_phasic_auc": np.trapezoid(up, dx=1 / fs), "eda_phasic_positive_ratio": (x > tonic).mean()}
            out |= {"eda_scr_peak_count": len(high), "eda_scr_peak_rate": len(high) / (len(x) / fs), "eda_scr_amp_mean": high.mean() if len(high) else 0, "eda_scr_amp_max": high.max() if len(high) else 0}
        if name == "BVP" and len(x) >= int(fs * 10):
            kept = []
            for i in tops(x, 0.35):
                if not kept or i - kept[-1] >= round(0.3 * fs):
                    kept.append(i)
                elif x[i] > x[kept[-1]]:
                    kept[-1] = i
            rr = np.diff(kept) / fs
            rr = rr[(rr >= 0.3) & (rr <= 2)]
            if len(rr) >= 2:
                out |= eight("bvp_derived_hr", 60 / rr) | {"bvp_peak_count": len(kept), "bvp_peak_rate": len(kept) / (len(x) / fs)} | variability("bvp_hrv", rr)
        if name == "IBI":
            out |= variability("ibi_hrv", x)
    return out


BEATS = [(round(0.9 * i + 2.3, 3), round(0.85 + 0.1 * np.sin(i / 3), 3)) for i in range(120)]


def grid():
    out = np.full(int(max(a for a, _ in BEATS)) + 1, np.nan)
    for a, b in BEATS:
        out[int(a)] = b
    return pd.Series(out).ffill().bfill().to_numpy()


@pytest.fixture(scope="module")
def field(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("archives")
    (path / "7").mkdir()
    (path / "7" / f"dev_{int(START)}.zip").write_bytes(archive(made_signals(3), BEATS))
    (path / "7" / f"dev_{int(START) + 90_000}.zip").write_bytes(b"broken")
    glob = f"{path}/*/*.zip"
    return sessions.read_sessions(spark, glob).unionByName(windows.beat_readings(sessions.read_beats(spark, glob)))


def test_all_features_equal_their_definitions(spark, field, tmp_path):
    """Survey in local time, four hours behind; the scan finds that out. The second window is half covered."""
    day, clock = pd.Timestamp(START - 4 * 3600, unit="s").strftime("%Y-%m-%d"), lambda s: pd.Timestamp(START - 4 * 3600 + s, unit="s").strftime("%H:%M:%S")
    (tmp_path / "sheet.csv").write_text(f"ID,date,Start time,End time,Stress level\n7.0,{day},{clock(0)},{clock(60)},2\n7,{day},{clock(60)},{clock(92)},1\n8,{day},{clock(0)},{clock(60)},na\n")
    table = features.field_table(field, sessions.read_survey(spark, f"{tmp_path}/sheet.csv"))
    got = {r["window_id"]: r.asDict() for r in table.collect()}
    assert sorted(got) == [0, 1]
    assert [(got[w]["target3"], got[w]["target_binary"], round(got[w]["label_overlap_ratio"], 6), got[w]["survey_offset_hours"]) for w in (0, 1)] == [(2, 1, 1.0, -4.0), (1, 1, round(32 / 60, 6), -4.0)]
    assert got[1]["window_start_utc"] == pd.Timestamp(START + 60, unit="s").strftime("%Y-%m-%dT%H:%M:%S.000000+00:00") and got[1]["group_id"] == "field:7"
    signals = made_signals(3)
    held = {k: (np.concatenate([np.full(10, np.nan), v]) if k == "HR" else v, RATES[k]) for k, v in signals.items()} | {"IBI": (grid(), 1.0)}
    seen = set()
    for w in (0, 1):
        want = expected({k: (v[round(60 * w * fs) : round(60 * (w + 1) * fs)], fs) for k, (v, fs) in held.items()})
        seen |= set(want)
        for name in base_features():
            if name in want:
                assert got[w][name] == pytest.approx(want[name], rel=1e-9, abs=1e-9), (w, name)
            else:
                assert got[w][name] is None, (w, name)
    assert seen == set(base_features())


def test_lab_recordings_and_the_whole_table(spark, field, tmp_path):
    """Lab arrays of 130 s at their own rates; a window of mixed labels is left out. Then both sources with personal columns."""
    label = [1] * 60 * 70 + [2] * 40 * 70 + [1] * 30 * 70
    rows = [("S2", [0.1] * 32 * 130, [0.2] * 32 * 130, [0.9] * 32 * 130, [float(np.sin(i / 9)) for i in range(64 * 130)], [float(i % 5) for i in range(4 * 130)], label)]
    spark.createDataFrame(rows, "subject_id string, acc_x array<double>, acc_y array<double>, acc_z array<double>, bvp array<double>, eda array<double>, label array<int>").write.parquet(f"{tmp_path}/lab.parquet")
    readings, labels = sessions.read_lab(spark, f"{tmp_path}/lab.parquet", {"acc_x": 32, "acc_y": 32, "acc_z": 32, "bvp": 64, "eda": 4}, 70.0)
    lab = features.lab_table(readings, labels)
    got = lab.collect()
    assert [(r["window_id"], r["protocol_label"], r["label_purity"], r["target3"], r["window_start_ts"]) for r in got] == [(0, 1, 1.0, 0, None)]
    assert got[0]["acc_mag_std"] == pytest.approx(0, abs=1e-12) and got[0]["temp_mean"] is None and got[0]["eda_mean"] == 2.0
    two = features.lab_table(readings, labels, WindowConfig(min_label_purity=0.6)).count()
    assert two == 2
    survey = spark.createDataFrame([], "ID string, date string, `Start time` string, `End time` string, `Stress level` string")
    both = features.extract(features.field_table(field, survey, WindowConfig(survey_offset_hours=0.0), keep_unlabelled=True), lab)
    assert both.count() == 3 and len(both.columns) == 718 and len(prep.feature_columns(both)) == 693
    first = both.filter("source = 'field' and window_id = 0").first()
    assert first["baseline_quality_n"] == 2 and first["target3"] is None
    half = (both.filter("source = 'field'").agg(F.max("temp_mean") - F.min("temp_mean")).first()[0]) / 2
    assert abs(first["temp_mean_delta_base"]) == pytest.approx(half)


def test_spans_without_aligned_samples(spark):
    """Signals that start late, also by a part of a sample, at several rates."""
    rows = [("lab", "a", f"s{k % 3}", name, fs, 100.0 + k + late, i, 0.0) for k in range(6) for name, fs, late in (("x", 4.0, 0.0), ("y", 1.0, 10.0), ("z", 32.0, 0.51)) for i in range(7 + k)]
    readings = spark.createDataFrame(rows, "source string, subject_id string, session_id string, signal string, fs double, start_ts double, sample_idx long, value double")
    want = windows.session_spans(windows.align_signals(readings)).collect()
    for got in (windows.late_spans(readings), windows.session_spans(windows.align_signals(readings, windows.late_spans(readings)))):
        assert sorted(got.collect(), key=str) == sorted(want, key=str)


def test_queries_compute_what_they_return(spark, sf_dir, monkeypatch):
    """The audit of labels needs no features, and the plain series no other family."""

    def none(*args):
        raise AssertionError("not needed")

    monkeypatch.setattr(features, "motion_features", none)
    check(spark, sf_dir, catalogue.QUERIES["extract_series"], catalogue.SQL["extract_series"])
    monkeypatch.setattr(features, "add_features", none)
    check(spark, sf_dir, catalogue.QUERIES["label_checks"], catalogue.SQL["label_checks"])


def _samples(pieces):
    """(window, signal, rate, place in the window, value) of the samples that are there."""
    return sorted((r["session_id"], r["window_id"], r["signal"], r["fs"], r["i"] + j, v) for r in pieces.collect() for j, v in enumerate(r["v"]) if v is not None)


def test_blocks_are_cut_as_their_samples_are(spark):
    """Gaps at both ends of blocks, missing and repeated samples, late signals, windows that overlap, and a rate that doesn't divide the window."""
    rng = np.random.default_rng(5)
    rows = []
    for session, signal, fs, late in (("a", "x", 4.0, 0.0), ("a", "y", 1.0, 10.0), ("a", "z", 0.3, 0.0), ("b", "x", 7.0, 0.51), ("b", "y", 7.0, 0.0)):
        for i in range(int(95 * fs)):
            if rng.random() > 0.3 and not 40 < i / fs < 55:
                rows.append(("field", session, session, signal, fs, 100.0 + late, i, None if rng.random() < 0.1 else float(rng.integers(9))))
    rows += [("field", "a", "a", "x", 4.0, 100.0, i, 99.0) for i in (4, 8) if any(r[1] == "a" and r[3] == "x" and r[6] == i for r in rows)]
    readings = spark.createDataFrame(rows, "source string, subject_id string, session_id string, signal string, fs double, start_ts double, sample_idx long, value double")
    spans = windows.late_spans(readings).localCheckpoint()
    aligned = windows.assign_sampled_windows(windows.align_signals(readings, spans), 20.0, 15.0, spans).filter("value is not null")
    low = F.bround(F.col("window_id") * 15.0 * F.col("fs")).cast("long")
    want = aligned.groupBy("session_id", "window_id", "signal", "fs", (F.col("sample_idx") - low).alias("i")).agg(F.max("value").alias("v"))
    want = sorted((r["session_id"], r["window_id"], r["signal"], r["fs"], r["i"], r["v"]) for r in want.collect())
    for sec in (60.0, 7.0):
        held = windows.blocks(readings, sec)
        assert _samples(windows.cut_windows(held, 20.0, 15.0, spans, align=True)) == want
        assert sorted(windows.block_spans(held).collect(), key=str) == sorted(spans.collect(), key=str)
        lists = windows.window_lists(windows.cut_windows(held, 20.0, 15.0, spans, align=True), features.KEYS, ("x", "y", "z"))
        got = [(r["session_id"], r["window_id"], s, r[f"{s}_fs"], p["i"] + j, v) for r in lists.collect() for s in ("x", "y", "z") for p in r[s] for j, v in enumerate(p["v"]) if v is not None]
        assert sorted(got) == want


def test_recordings_in_blocks(spark, sf_dir):
    """The same samples as in long form."""
    from sensorloom.sources import driver_tables as D

    names = ["source", "subject_id", "session_id", "signal", "fs", "start_ts"]
    long = D.recordings(spark, sf_dir).select(*names, "sample_idx", "value")
    held = D.recording_blocks(spark, sf_dir)
    laid = held.select(*names, "sample_idx", F.posexplode("values").alias("_j", "value")).select(*names, (F.col("sample_idx") + F.col("_j")).alias("sample_idx"), "value")
    assert long.exceptAll(laid).count() == 0 and laid.exceptAll(long).count() == 0
    labels = D.block_labels(held).select("subject_id", "sample_idx", F.posexplode("values").alias("_j", "label"))
    labels = labels.select("subject_id", (F.col("sample_idx") + F.col("_j")).alias("sample_idx"), F.col("label").cast("int").alias("label"))
    want = D.recording_labels(spark, sf_dir).select("subject_id", "sample_idx", "label")
    assert want.exceptAll(labels).count() == 0 and labels.exceptAll(want).count() == 0


def test_windows_are_dealt_once_and_not_one_call_each(spark, field):
    """All families share one exchange of pieces of windows; no family calls Python for each window."""
    held = windows.blocks(field).localCheckpoint()
    rows = features.families(windows.cut_windows(held, 60.0, 60.0, windows.block_spans(held).localCheckpoint(), True))
    plan = rows._jdf.queryExecution().sparkPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and plan.count("ArrowEvalPython") == 1 and "Window [" not in plan
    assert rows.count() == 2 and set(rows.columns) == {*features.KEYS, *base_features()}


def test_features_of_a_window_do_not_depend_on_its_batch(spark):
    """Windows of different sizes and without some signals, alone and together."""
    from sensorloom.operators import acc, eda, hrv, stats

    rng = np.random.default_rng(8)
    made = lambda n: [(3 * k, [None if x < 0.1 else float(x) for x in rng.random(min(3, n - 3 * k))]) for k in range(-(-n // 3))]
    rows = [(i, *(made(n) if (i + k) % 5 else None for k in range(3)), made(n), 2.0) for i, n in enumerate((0, 1, 2, 3, 40, 40, 90, 7, 90, 41))]
    piece = "array<struct<i: bigint, v: array<double>>>"
    df = spark.createDataFrame(rows, f"id int, x {piece}, y {piece}, z {piece}, v {piece}, fs double")
    found = [acc.motion("x", "y", "z", "fs"), eda.conductance("v", "fs"), hrv.pulse("v", "fs"), hrv.intervals("v"), stats.plain("v", "fs")]
    together = sorted(df.coalesce(1).select("id", *found).collect())
    assert [tuple(r) for r in together] == sorted(tuple(r) for i in range(len(rows)) for r in df.filter(F.col("id") == i).coalesce(1).select("id", *found).collect())
    assert all(x is None for x in together[0][1]) and together[0][5][0] is None and together[4][5][0] is not None
