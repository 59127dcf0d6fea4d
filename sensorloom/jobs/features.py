"""The feature table of session windows: samples to labelled, personal features of all families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import WindowConfig
from ..functions.columns import group_id, iso_utc
from ..operators import acc, eda, hrv, prep, stats, windows
from ..operators.baseline import add_personal_baseline
from ..operators.survey import best_offset, label_by_overlap, labelled_only, map_field_labels, map_lab_labels, scan_offsets, survey_intervals
from ..schema import base_features, stat_names
from ..sources.scratch import staged

KEYS = ["source", "subject_id", "session_id", "window_id"]
#: Signals that get the eight statistics and a slope.
SERIES = ("eda", "temp", "bvp", "hr", "ibi")


#: All signals that features are made of.
SIGNALS = (*SERIES, "acc_x", "acc_y", "acc_z")


def series_features(signals: tuple[str, ...] = SERIES) -> dict[str, tuple[Column, list[str]]]:
    """Statistics and slope of each plain signal: the column that holds them as an array, and their names."""
    return {f"_{s}": (stats.plain(s, f"{s}_fs"), [*stat_names(s), f"{s}_slope"]) for s in signals}


def motion_features() -> dict[str, tuple[Column, list[str]]]:
    axes = [f"acc_{a}" for a in acc.AXES]
    names = [n for p in acc.SERIES for n in stat_names(p)] + [f"acc_{n}" for n in acc.CONTEXT]
    return {"_motion": (acc.motion(*axes, F.greatest(*[F.col(f"{a}_fs") for a in axes])), names)}


def _beats(prefix: str) -> list[str]:
    return [*stat_names(f"{prefix}_rr_ms"), *(f"{prefix}_{n}" for n in hrv.VARIABILITY)]


def families(pieces: DataFrame, series_only: bool = False) -> DataFrame:
    """All families of features side by side, one row for each window that has samples.

    pieces: as of windows.cut_windows. They are dealt by KEYS once, and those of a window, whose samples are
    bounded, become an array for each signal; each family computes its own from these, in Arrow batches.
    series_only: just the statistics of the plain signals.
    """
    rows, found = windows.window_lists(pieces, KEYS, SERIES if series_only else SIGNALS), series_features()
    if not series_only:
        found |= motion_features()
        found["_conductance"] = eda.conductance("eda", "eda_fs"), [*eda.LEVEL, *stat_names("eda_tonic"), *stat_names("eda_phasic"), *eda.PARTS]
        found["_pulse"] = hrv.pulse("bvp", "bvp_fs"), [*stat_names("bvp_derived_hr"), "bvp_peak_count", "bvp_peak_rate", *_beats("bvp_hrv")]
        found["_intervals"] = hrv.intervals("ibi"), _beats("ibi_hrv")
    rows = rows.select(*KEYS, *[c.alias(k) for k, (c, _) in found.items()])
    cells = {name: F.get(k, F.lit(j)).alias(name) for k, (_, names) in found.items() for j, name in enumerate(names)}
    return rows.select(*KEYS, *[cells[n] for n in base_features() if n in cells])


def add_features(table: DataFrame, held: DataFrame, spans: DataFrame, config: WindowConfig, align: bool = False, series_only: bool = False) -> DataFrame:
    """The table of windows with all base features (or those of the plain signals), null where a window has too little of a signal.

    held: blocks of samples. The table of windows is written once; blocks are cut into windows, and pieces
    of windows that aren't in it are dropped before their samples are dealt.
    """
    table = staged(table)
    pieces = windows.cut_windows(held.filter(F.col("signal").isin(*(SERIES if series_only else SIGNALS))), config.window_sec, config.step_sec, spans, align)
    table = table.join(families(pieces.join(table.select(*KEYS), KEYS, "left_semi"), series_only), KEYS, "left")
    keys = [c for c in table.columns if c not in base_features()]
    return table.select(*keys, *[c for c in base_features() if c in table.columns])


def field_windows(spans: DataFrame, survey: DataFrame, config: WindowConfig = WindowConfig(), keep_unlabelled: bool = False) -> DataFrame:
    """Windows of device sessions, labelled by the survey interval that covers most of them, without features. spans: as of windows.late_spans."""
    offset = config.survey_offset_hours
    if offset is None:
        sessions = spans.select("subject_id", "session_id", F.col("session_start").alias("start_ts"))
        best = best_offset(scan_offsets(sessions, survey_intervals(survey))).first()  # one row
        offset = float(best["survey_offset_hours"])
    held = windows.session_windows(spans, config.window_sec, config.step_sec)
    held = map_field_labels(label_by_overlap(held, survey_intervals(survey, offset), config.min_overlap, bucket_sec=config.window_sec))
    held = labelled_only(held, keep_unlabelled)
    return held.withColumns({"group_id": group_id(F.col("source"), F.col("subject_id")), "window_start_utc": iso_utc(F.col("window_start_ts")), "window_end_utc": iso_utc(F.col("window_end_ts")), "survey_offset_hours": F.lit(offset)})


def field_table(readings: DataFrame, survey: DataFrame, config: WindowConfig = WindowConfig(), keep_unlabelled: bool = False, series_only: bool = False) -> DataFrame:
    """field_windows with all features, or only those of the plain signals.

    readings: all signals of the sessions, beats as the signal ibi (see beat_readings), or windows.blocks of
    them, which should be staged, as they are read twice; survey: the sheet as text. Without a set offset the
    one that a scan finds best is used. Labels come before features, so samples of windows without a label
    are dropped before they are dealt.
    """
    held = _blocks(readings)
    spans = staged(windows.block_spans(held))
    return add_features(field_windows(spans, survey, config, keep_unlabelled), held, spans, config, True, series_only)


def _blocks(readings: DataFrame) -> DataFrame:
    return readings if "values" in readings.columns else staged(windows.blocks(readings))


def lab_table(readings: DataFrame, labels: DataFrame, config: WindowConfig = WindowConfig(), series_only: bool = False) -> DataFrame:
    """Windows of lab recordings whose samples are mostly of one protocol label. readings: as field_table has them; labels: subject_id, sample_idx, label, fs, or blocks with values and n."""
    source, subject = F.lit("lab").alias("source"), F.col("subject_id").alias("session_id")
    values = [F.col(c) for c in ("values", "n")] if "values" in labels.columns else [F.col("label").cast("int").alias("value")]
    samples = labels.select(source, "subject_id", subject, F.lit("label").alias("signal"), "fs", F.lit(0.0).alias("start_ts"), F.col("sample_idx").cast("long").alias("sample_idx"), *values)
    marks = _blocks(samples)
    spans = staged(windows.block_spans(marks))
    seen = windows.cut_windows(marks, config.window_sec, config.step_sec, spans).select(*KEYS, "i", F.posexplode("v").alias("_j", "label"))
    seen = seen.select(*KEYS, (F.col("i") + F.col("_j")).alias("sample_idx"), F.col("label").cast("int").alias("label"))
    pure = windows.mode_and_purity(seen, KEYS, "label", "sample_idx")
    named = map_lab_labels(pure, config.min_label_purity).withColumnsRenamed({"label": "protocol_label", "purity": "label_purity"})
    none = F.lit(None).cast("double")
    found = windows.session_windows(spans, config.window_sec, config.step_sec).withColumns({"window_start_ts": none, "window_end_ts": none}).join(named, KEYS)
    found = found.withColumn("group_id", group_id(F.col("source"), F.col("subject_id")))
    return add_features(found, _blocks(readings), spans, config, False, series_only)


def extract(*tables: DataFrame, config: WindowConfig = WindowConfig()) -> DataFrame:
    """The tables of both kinds of sources together, with the personal columns of every feature.

    Baselines take a person's first windows of those given: with field tables of labelled windows only,
    the first labelled ones (the published order); with unlabelled ones kept, the first of all.
    """
    combined = staged(prep.combine_sources(*tables))
    return add_personal_baseline(combined, prep.baseline_columns(combined), config.baseline_minutes)
