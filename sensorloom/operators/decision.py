"""Rule-based alerts from predictions and personal features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .prep import percentiles

#: Fixed values, as are the limits of the rules below. Candidate columns in order of preference; the first that a table has is read, even where it is null.
HR_DELTA = ("hr_mean_delta_base", "bvp_derived_hr_mean_delta_base", "hr_median_delta_base", "bvp_derived_hr_median_delta_base")
HR_Z = ("hr_mean_z_personal", "bvp_derived_hr_mean_z_personal")
EDA_DELTA = ("eda_mean_delta_base", "eda_median_delta_base")
EDA_Z = ("eda_mean_z_personal", "eda_median_z_personal")
ACC_Z = ("acc_activity_z_personal", "acc_dyn_mag_mean_z_personal", "acc_mag_std_z_personal")
ACC = ("acc_activity", "acc_dyn_mag_mean", "acc_mag_std")

#: State, recommendation.
ACTIONS = {
    "physical_activity_delay": "delay_alert_keep_monitoring",
    "critical_alert": "stop_task_short_break_breathing_support",
    "persistent_stress": "short_break_water_slow_breathing",
    "rising_stress": "short_break_water_slow_breathing",
    "monitor_more": "measure_more_before_alert",
    "low_confidence_normal": "continue_monitoring",
    "normal": "no_action",
}
TIME = ("window_start_ts", "window_start_sec")


def first_existing(columns: list[str], names: tuple[str, ...]) -> Column | None:
    return next((F.col(n) for n in names if n in columns), None)


def _over(column: Column | None, test) -> Column:
    return F.lit(False) if column is None else F.coalesce(test(column), F.lit(False))


def context_flags(df: DataFrame, batch: list[str] | None = None, acc_threshold: float | None = None) -> DataFrame:
    """Adds hr_high, eda_high and active; what is null is not high.

    active compares with the 75th percentile of activity in the batch (grouped by `batch`, one row
    each, or over all), or with a given threshold.
    """
    pick = lambda names: first_existing(df.columns, names)
    activity = pick(ACC)
    out = df
    if activity is not None and acc_threshold is None:
        keys = batch or []
        limits = percentiles(df.select(*keys, activity.alias("_activity")), keys, "_activity", 0.75).withColumnRenamed("q", "_limit")
        if keys:
            out = df.join(F.broadcast(limits), keys, "left")  # one row for each part of the batch, such as a model and fold
        else:
            # One number for the batch, as a scalar subquery: no product of tables.
            out = df.withColumn("_limit", limits.scalar())
    else:
        out = df.withColumn("_limit", F.lit(acc_threshold).cast("double"))
    return out.withColumns(
        {
            "hr_high": _over(pick(HR_DELTA), lambda c: c >= 10.0) | _over(pick(HR_Z), lambda c: c >= 1.0),
            "eda_high": _over(pick(EDA_DELTA), lambda c: c > 0.05) | _over(pick(EDA_Z), lambda c: c >= 1.0),
            "active": _over(pick(ACC_Z), lambda c: c >= 1.5) | _over(activity, lambda c: c >= F.col("_limit")),
        }
    ).drop("_limit")


def stress_like(binary: bool, pred: str = "pred_label", confidence: str = "confidence") -> Column:
    label, sure = F.coalesce(F.col(pred), F.lit(0)), F.coalesce(F.col(confidence), F.lit(0.0))
    return (label >= (1 if binary else 2)) | ((label >= 1) & (sure >= 0.65))


def streak(df: DataFrame, flag: str, keys: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """Adds streak: how many rows in a row, up to this one, have the flag, per person in time order (nulls last).

    It runs on over the sessions of a person.
    """
    keys, order = keys or ["source", "subject_id"], order or [c for c in TIME if c in df.columns]
    time = [F.col(c).asc_nulls_last() for c in order]
    island = F.sum((~F.col(flag)).cast("int")).over(Window.partitionBy(*keys).orderBy(*time).rowsBetween(Window.unboundedPreceding, 0))
    count = F.sum(F.col(flag).cast("int")).over(Window.partitionBy(*keys, "_island").orderBy(*time).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_island", island).withColumn("streak", count.cast("int")).drop("_island")


def state_columns(df: DataFrame, binary: bool, pred: str = "pred_label", confidence: str = "confidence") -> DataFrame:
    """Adds alert_state, recommendation and decision_adjusted_label from the flags and the streak."""
    label, sure = F.coalesce(F.col(pred), F.lit(0)), F.coalesce(F.col(confidence), F.lit(0.0))
    high = label >= (1 if binary else 2)
    state = (
        F.when(F.col("stress_like") & F.col("active") & F.col("hr_high") & ~F.col("eda_high"), "physical_activity_delay")
        .when(high & (F.col("streak") >= 3) & (sure >= 0.70), "critical_alert")
        .when(high & (sure >= 0.55) & (F.col("streak") >= 2), "persistent_stress")
        .when(high & (sure >= 0.55), "rising_stress")
        .when(label >= 1, "monitor_more")
        .when(sure < 0.45, "low_confidence_normal")
        .otherwise("normal")
    )
    out = df.withColumn("alert_state", state)
    action = F.lit(None).cast("string")
    for name, text in ACTIONS.items():
        action = F.when(F.col("alert_state") == name, text).otherwise(action)
    adjusted = F.when(F.col("alert_state") == "physical_activity_delay", F.least(label, F.lit(1))).when(F.col("alert_state").isin("critical_alert", "persistent_stress", "rising_stress"), 2).when(F.col("alert_state") == "monitor_more", 1).otherwise(0)
    return out.withColumns({"recommendation": action, "decision_adjusted_label": adjusted.cast("int")})


def alert_state(df: DataFrame, batch: list[str] | None = None, acc_threshold: float | None = None) -> DataFrame:
    """Flags, streaks, states, recommendations and adjusted labels of predictions."""
    binary = "proba_1" in df.columns and "proba_2" not in df.columns
    flagged = context_flags(df, batch, acc_threshold).withColumn("stress_like", stress_like(binary))
    return state_columns(streak(flagged, "stress_like", [*(batch or []), "source", "subject_id"]), binary)
