"""Personal baselines: each feature against the first windows of its person."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.columns import EPS, let

PERSON = ["source", "subject_id"]
TIME = ["window_start_ts", "window_start_sec"]


def _in_time() -> list:
    return [F.col(c).asc_nulls_last() for c in TIME]


def _beside(windows: DataFrame, people: DataFrame, how: str) -> DataFrame:
    """Join one row for each person; null ids meet null ids."""
    named = people.withColumnsRenamed({k: f"_p_{k}" for k in PERSON})
    return windows.join(named, F.col("source").eqNullSafe(F.col("_p_source")) & F.col("subject_id").eqNullSafe(F.col("_p_subject_id")), how)


def baseline_rows(windows: DataFrame, minutes: float = 10.0, lab: str = "lab") -> DataFrame:
    """The first N windows of each person, N = max(1, ceil(minutes * 60 / max(median duration, 1))).

    Lab rows with the protocol label 1 are preferred where a person has any. Times that are null
    come last.
    """
    person = Window.partitionBy(*PERSON)
    calm = (F.col("source") == lab) & F.coalesce(F.col("protocol_label") == 1, F.lit(False)) if "protocol_label" in windows.columns else F.lit(False)
    limits = windows.groupBy(*PERSON).agg(F.greatest(F.lit(1), F.ceil(F.lit(minutes * 60.0) / F.greatest(F.percentile("window_duration_sec", F.lit(0.5)), F.lit(1.0))).cast("int")).alias("_most"), F.max(calm).alias("_any"))
    rows = _beside(windows, limits, "inner").select(*windows.columns, "_most", "_any").filter(~F.col("_any") | calm)
    ranked = rows.withColumn("_rank", F.row_number().over(person.orderBy(*_in_time())))
    return ranked.filter("_rank <= _most").drop("_rank", "_most", "_any")


def _person_stats(rows: DataFrame, features: list[str]) -> DataFrame:
    """_stats, a struct of median and scale for each feature in turn, and baseline_quality_n. The baseline rows of a person, which are few, come as one array each."""
    cells = F.array(*[F.col(f).cast("double") for f in features])
    people = rows.groupBy(*PERSON).agg(F.collect_list(cells).alias("_rows"), F.count("*").cast("int").alias("baseline_quality_n"))

    def one(j: Column) -> Column:
        return let(F.sort_array(A.present(F.transform("_rows", lambda r: F.get(r, j)))), scaled)

    def scaled(q: Column) -> Column:
        n = F.size(q)
        scale = F.coalesce(F.nullif(A.quantile(q, 0.75) - A.quantile(q, 0.25), F.lit(0.0)), F.nullif(A.deviation(q) * F.sqrt(F.try_divide(n, n - 1)), F.lit(0.0)), F.lit(1.0))
        return F.struct(A.quantile(q, 0.5).alias("med"), scale.alias("scale"))

    places = F.sequence(F.lit(0), F.lit(len(features) - 1)) if features else F.array().cast("array<int>")
    return people.select(*PERSON, F.transform(places, one).alias("_stats"), "baseline_quality_n")


def baseline_stats(rows: DataFrame, features: list[str]) -> DataFrame:
    """Median, scale and count of the baseline rows, wide: <feature>_med and <feature>_scale, baseline_quality_n.

    The scale is the interquartile range, else the sample deviation, else 1; 0 counts as missing.
    """
    cells = [F.col("_stats")[j][x].alias(f"{f}_{x}") for j, f in enumerate(features) for x in ("med", "scale")]
    return _person_stats(rows, features).select(*PERSON, *cells, "baseline_quality_n")


def add_personal_baseline(windows: DataFrame, features: list[str], minutes: float = 10.0, lab: str = "lab") -> DataFrame:
    """Adds delta_base, ratio_base and z_personal of each feature, and baseline_quality_n: one aggregate, one join, one projection."""
    stats = _person_stats(baseline_rows(windows, minutes, lab), features)
    out = []
    for j, f in enumerate(features):
        x, med, scale = F.col(f), F.col("_stats")[j]["med"], F.col("_stats")[j]["scale"]
        out += [(x - med).alias(f"{f}_delta_base"), F.try_divide(x + EPS, med + EPS).alias(f"{f}_ratio_base"), ((x - med) / (scale + EPS)).alias(f"{f}_z_personal")]
    return _beside(windows, stats, "left").select(*windows.columns, *out, "baseline_quality_n")
