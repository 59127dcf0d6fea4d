"""Settings of the jobs, with the defaults of the published method."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class WindowConfig:
    window_sec: float = 60.0
    step_sec: float = 60.0
    min_label_purity: float = 0.8
    min_overlap: float = 0.5
    baseline_minutes: float = 10.0
    survey_offset_hours: float | None = None  # None: found by a scan


@dataclass(frozen=True)
class TrainConfig:
    """Grids, where given, take the place of the single setting; the candidate that does best on the held-out part of the training set is kept."""

    models: tuple[str, ...] = ("balanced_rf", "rf", "extra_trees", "knn", "gnb", "gbt")
    cv: str = "group"  # group: stratified folds of whole groups; loso: one fold for each group; rows: stratified rows
    folds: int = 5
    class_cap: int | None = 150
    class_cap_grid: tuple[int | None, ...] = ()
    source_balance: str = "none"
    top_k: int | None = None
    top_k_grid: tuple[int | None, ...] = ()
    smote: bool = True
    calibration: str = "sigmoid"  # sigmoid, isotonic or none
    tune_threshold: bool = True
    threshold_metric: str = "balanced_accuracy"
    threshold_metric_grid: tuple[str, ...] = ()
    recall_floor: float = 0.70
    selection_metric: str = "balanced_accuracy"
    seed: int = 42
    forest_trees: int = 500
    extra_trees: int = 600
    balanced_trees: int = 600
    selector_trees: int = 300
    boosting_rounds: int = 250
    boosting_step: float = 0.05
    max_depth: int = 10  # of forests; the published ones are bounded by leaves of two rows only
    neighbours: int = 9
    parallel: int = 4  # models and folds that are evaluated side by side
