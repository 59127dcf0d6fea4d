"""Fixed table schemas (as DDL text) and feature names."""

from __future__ import annotations

READINGS = "source string, subject_id string, session_id string, signal string, fs double, start_ts double, sample_idx long, value double"
SURVEY_RAW = "ID string, date string, `Start time` string, `End time` string, `Stress level` string"
INTERVALS = "subject_id string, survey_start_ts double, survey_end_ts double, nurse_label int"

STATS = ("mean", "std", "median", "min", "max", "iqr", "range", "energy")
#: A window of a session.
WINDOW_KEYS = ("source", "subject_id", "session_id", "window_id")


def stat_names(prefix: str) -> list[str]:
    return [f"{prefix}_{s}" for s in STATS]


#: Base features of a full window, absent ones null: 173 names.
_HRV = ("sdnn_ms", "rmssd_ms", "pnn50", "cvnn", "hr_mean", "hr_std", "lf_power", "hf_power", "lf_hf_ratio", "hf_norm")


def base_features() -> list[str]:
    acc = [n for p in ("acc_x", "acc_y", "acc_z", "acc_mag", "acc_dyn_mag", "acc_jerk") for n in stat_names(p)]
    acc += [f"acc_{n}" for n in ("activity", "posture_tilt", "stationary_ratio", "active_ratio", "signal_magnitude_area", "vector_magnitude_area", "jerk_zero_cross_rate")]
    eda = [*stat_names("eda"), *(f"eda_{n}" for n in ("slope", "rise_rate", "abs_diff_mean", "peak_count", "peak_rate"))]
    parts = [*stat_names("eda_tonic"), *stat_names("eda_phasic"), *(f"eda_{n}" for n in ("tonic_slope", "phasic_auc", "phasic_positive_ratio", "scr_peak_count", "scr_peak_rate", "scr_amp_mean", "scr_amp_max"))]
    plain = [n for p in ("temp", "bvp", "hr", "ibi") for n in [*stat_names(p), f"{p}_slope"]]
    derived = [*stat_names("bvp_derived_hr"), "bvp_peak_count", "bvp_peak_rate"]
    hrv = [n for p in ("bvp_hrv", "ibi_hrv") for n in [*stat_names(f"{p}_rr_ms"), *(f"{p}_{h}" for h in _HRV)]]
    return acc + eda + parts + plain + derived + hrv
