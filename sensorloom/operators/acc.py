"""Motion features from three axes."""

from __future__ import annotations

from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import samples as S
from ..functions.columns import EPS, no_nan
from .stats import stat_columns

AXES = ("x", "y", "z")
#: What motion() gives, in this order, after the eight statistics of these.
SERIES = ("acc_x", "acc_y", "acc_z", "acc_mag", "acc_dyn_mag", "acc_jerk")
CONTEXT = ("activity", "posture_tilt", "stationary_ratio", "active_ratio", "signal_magnitude_area", "vector_magnitude_area", "jerk_zero_cross_rate")


def normalize_acc(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with all three axes, in g: a window with a value beyond 8 holds counts, 64 to a g."""
    clean = df.select("*", *[no_nan(F.col(a)).alias(f"_{a}") for a in AXES]).filter(" and ".join(f"_{a} is not null" for a in AXES))
    peak = F.max(F.greatest(*[F.abs(f"_{a}") for a in AXES])).over(Window.partitionBy(*keys))
    unit = F.when(peak > 8.0, 64.0).otherwise(1.0)
    return clean.withColumn("_unit", unit).select(*[F.col(c) for c in df.columns if c not in AXES], *[(F.col(f"_{a}") / F.col("_unit")).alias(a) for a in AXES])


def acc_magnitudes(df: DataFrame, keys: list[str]) -> DataFrame:
    """Adds mag and dyn_mag, the length of the axes less their medians in the window."""
    whole = Window.partitionBy(*keys)
    square = lambda cs: F.sqrt(sum((c * c for c in cs[1:]), cs[0] * cs[0]))
    out = df.withColumns({f"_m{a}": F.percentile(a, F.lit(0.5)).over(whole) for a in AXES})
    return out.withColumns({"mag": square([F.col(a) for a in AXES]), "dyn_mag": square([F.col(a) - F.col(f"_m{a}") for a in AXES])}).drop(*[f"_m{a}" for a in AXES])


def acc_jerk(df: DataFrame, keys: list[str], order: list[str], fs: Column | float = 1.0) -> DataFrame:
    """Adds jerk (change of mag times fs; null for the first) and crossed (its sign differs from the one before; 0 is positive)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn("jerk", (F.col("mag") - F.lag("mag").over(w)) * fs)
    before = F.lag("jerk").over(w)
    return out.withColumn("crossed", F.when(before.isNotNull(), ((F.col("jerk") < 0) != (before < 0)).cast("double")))


def _moved(df: DataFrame, keys: list[str], order: list[str], fs: Column | float) -> DataFrame:
    """Magnitudes, jerk, and the window's limits: _still, below which motion is rest, and _mid, the median of mag."""
    whole = Window.partitionBy(*keys)
    still = F.greatest(F.lit(0.03), F.percentile("dyn_mag", F.lit(0.25)).over(whole) + 0.5 * F.stddev_pop("dyn_mag").over(whole))
    return acc_jerk(acc_magnitudes(df, keys), keys, order, fs).withColumns({"_still": still, "_mid": F.percentile("mag", F.lit(0.5)).over(whole)})


def _context_columns() -> list[Column]:
    return [
        (F.stddev_pop("dyn_mag") + F.coalesce(F.avg(F.abs("jerk")), F.lit(0.0))).alias("acc_activity"),
        (F.avg("z") / (F.avg("mag") + EPS)).alias("acc_posture_tilt"),
        F.avg((F.col("dyn_mag") < F.col("_still")).cast("double")).alias("acc_stationary_ratio"),
        F.avg((F.col("dyn_mag") > 0.15).cast("double")).alias("acc_active_ratio"),
        F.avg(F.abs("x") + F.abs("y") + F.abs("z")).alias("acc_signal_magnitude_area"),
        F.avg(F.abs(F.col("mag") - F.col("_mid"))).alias("acc_vector_magnitude_area"),
        F.when(F.count("jerk") > 0, F.coalesce(F.avg("crossed"), F.lit(0.0))).alias("acc_jerk_zero_cross_rate"),
    ]


def acc_context(df: DataFrame, keys: list[str], order: list[str], fs: Column | float = 1.0) -> DataFrame:
    """Activity, tilt, stationary and active shares, magnitude areas and zero crossings of each window."""
    return _moved(df, keys, order, fs).groupBy(*keys).agg(*_context_columns())


def acc_features(df: DataFrame, keys: list[str], order: list[str], fs: Column | float = 1.0) -> DataFrame:
    """All motion features, eight statistics of six series and the context, in one aggregate.

    Medians and limits are windows over the same keys, so rows are dealt and sorted once.
    """
    series = {"acc_x": "x", "acc_y": "y", "acc_z": "z", "acc_mag": "mag", "acc_dyn_mag": "dyn_mag", "acc_jerk": "jerk"}
    moved = _moved(normalize_acc(df, keys), keys, order, fs)
    return moved.groupBy(*keys).agg(*[c for prefix, name in series.items() for c in stat_columns(F.col(name), prefix)], *_context_columns())


def _length(p: np.ndarray) -> np.ndarray:
    return np.sqrt(p[:, :, 0] * p[:, :, 0] + p[:, :, 1] * p[:, :, 1] + p[:, :, 2] * p[:, :, 2])


def _motion(p: np.ndarray, fs: np.ndarray) -> np.ndarray:
    """acc_features of windows of one size: p[window, sample, axis]."""
    p = p / np.where(np.abs(p).max(axis=(1, 2)) > 8.0, 64.0, 1.0)[:, None, None]
    middle = np.stack([S.quantile(np.sort(p[:, :, i], axis=1), 0.5) for i in range(3)], axis=1)
    mag, moved = _length(p), _length(p - middle[:, None, :])
    jerk = np.diff(mag, axis=1) * fs[:, None]
    found = [S.stats(x) for x in (p[:, :, 0], p[:, :, 1], p[:, :, 2], mag, moved, jerk)]
    std, still = found[4][:, 1], S.quantile(np.sort(moved, axis=1), 0.25)
    crossed = S.mean((jerk[:, 1:] < 0) != (jerk[:, :-1] < 0), 0.0) if jerk.shape[1] else np.full(len(p), np.nan)
    context = [
        std + S.mean(np.abs(jerk), 0.0),
        found[2][:, 0] / (found[3][:, 0] + EPS),
        S.mean(moved < np.maximum(0.03, still + 0.5 * std)[:, None]),
        S.mean(moved > 0.15),
        S.mean(np.abs(p).sum(axis=2)),
        S.mean(np.abs(mag - found[3][:, 2:3])),
        crossed,
    ]
    return np.concatenate([*found, np.stack(context, axis=1)], axis=1)


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def motion(x: pa.Array, y: pa.Array, z: pa.Array, fs: pa.Array) -> pa.Array:
    """acc_features of windows from the samples of their axes; those that lack an axis don't count."""
    axes = [S.present(a) for a in (x, y, z)]
    span = max(place.max(initial=0) for _, _, place in axes) + 1
    keys = [np.repeat(np.arange(len(n)), n) * span + place for _, n, place in axes]
    whole = reduce(partial(np.intersect1d, assume_unique=True), keys)
    p = np.stack([v[np.searchsorted(key, whole)] for key, (v, _, _) in zip(keys, axes, strict=True)], axis=1)
    return S.column(S.by_size(p, np.bincount(whole // span, minlength=len(x)), 8 * len(SERIES) + len(CONTEXT), _motion, S.numbers(fs)))
