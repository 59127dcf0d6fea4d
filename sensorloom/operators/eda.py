"""Skin conductance: tonic level by a centred rolling median, phasic part, and its peaks."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import samples as S
from .stats import flag_peaks, stat_columns

#: What conductance() gives, in this order: of the level, then, after the eight statistics of the tonic and the phasic part, of the parts.
LEVEL = ("eda_rise_rate", "eda_abs_diff_mean", "eda_peak_count", "eda_peak_rate")
PARTS = ("eda_tonic_slope", "eda_phasic_auc", "eda_phasic_positive_ratio", "eda_scr_peak_count", "eda_scr_peak_rate", "eda_scr_amp_mean", "eda_scr_amp_max")


def tonic_width(n: float, fs: float) -> int:
    """Samples of the rolling median for a window of n samples."""
    return max(3, int(round(min(20.0, max(4.0, n / fs / 3.0)) * fs)))


def tonic_phasic(df: DataFrame, keys: list[str], value: str, order: list[str], width: int) -> DataFrame:
    """Adds tonic and phasic. Near the edges the median is of what is there; an even width reaches one further back."""
    ahead = (width - 1) // 2
    present = df.filter(F.col(value).isNotNull())
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(width - 1 - ahead), ahead)
    tonic = present.withColumn("tonic", F.percentile(F.col(value), F.lit(0.5)).over(w))
    return tonic.withColumn("phasic", F.col(value) - F.col("tonic"))


def phasic_features(parts: DataFrame, keys: list[str], order: list[str], fs: Column | float = 1.0) -> DataFrame:
    """The 23 tonic and phasic features of each window of rows with tonic and phasic; windows of under four samples have none."""
    parts = parts.withColumns({"_up": F.greatest(F.col("phasic"), F.lit(0.0)), "_fs": F.lit(fs).cast("double")})
    peaks = flag_peaks(parts, keys, "_up", order, 0.25)
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = peaks.withColumn("_area", (F.col("_up") + F.lead("_up").over(w)) / 2 / F.col("_fs"))
    place, n, top, rate = F.struct(*order), F.count("*"), F.when(F.col("peak"), F.col("_up")), F.max("_fs")
    return (
        rows.groupBy(*keys)
        .agg(
            n.alias("_n"),
            *stat_columns(F.col("tonic"), "eda_tonic"),
            *stat_columns(F.col("phasic"), "eda_phasic"),
            F.try_divide(F.max_by("tonic", place) - F.min_by("tonic", place), (n - 1) / rate).alias("eda_tonic_slope"),
            F.coalesce(F.sum("_area"), F.lit(0.0)).alias("eda_phasic_auc"),
            F.avg((F.col("phasic") > 0).cast("double")).alias("eda_phasic_positive_ratio"),
            F.count(top).alias("eda_scr_peak_count"),
            (F.count(top) / (n / rate)).alias("eda_scr_peak_rate"),
            F.coalesce(F.avg(top), F.lit(0.0)).alias("eda_scr_amp_mean"),
            F.coalesce(F.max(top), F.lit(0.0)).alias("eda_scr_amp_max"),
        )
        .filter("_n >= 4")
        .drop("_n")
    )


def eda_decompose(df: DataFrame, keys: list[str], value: str, order: list[str], width: int, fs: float = 1.0) -> DataFrame:
    """The tonic and phasic features, with one width of the median for all windows."""
    return phasic_features(tonic_phasic(df, keys, value, order, width), keys, order, fs)


def level_features(df: DataFrame, keys: list[str], value: str, order: list[str], fs: Column | float = 1.0) -> DataFrame:
    """Share of rises, mean absolute change, and peaks of the conductance itself, for each window."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = flag_peaks(df, keys, value, order, 0.25).withColumns({"_d": F.col(value) - F.lag(value).over(w), "_fs": F.lit(fs).cast("double")})
    count = F.sum(F.col("peak").cast("long"))
    rise = F.avg(F.when(F.col("_d").isNotNull(), (F.col("_d") > 0).cast("double")))
    return rows.groupBy(*keys).agg(rise.alias("eda_rise_rate"), F.avg(F.abs("_d")).alias("eda_abs_diff_mean"), count.alias("eda_peak_count"), (count / (F.count("*") / F.max("_fs"))).alias("eda_peak_rate"))


def _tonic(x: np.ndarray, fs: np.ndarray) -> np.ndarray:
    """The rolling median of each row, with the width chosen from its size and rate; a frame of rows needs a fixed width."""
    out, width = np.empty(x.shape), np.array([tonic_width(x.shape[1], rate) for rate in fs])
    for w in np.unique(width):
        out[width == w] = pd.DataFrame(x[width == w].T).rolling(int(w), min_periods=1, center=True).median().to_numpy().T
    return out


def _conductance(x: np.ndarray, fs: np.ndarray) -> np.ndarray:
    """level_features and phasic_features of windows of one size; the latter need four samples."""
    n, step, count = x.shape[1], np.diff(x, axis=1), S.peaks(x, 0.25).sum(axis=1)
    level = np.stack([S.mean(step > 0), S.mean(np.abs(step)), count, count / (n / fs)], axis=1)
    if n < 4:
        return np.concatenate([level, np.full((len(x), 16 + len(PARTS)), np.nan)], axis=1)
    tonic = _tonic(x, fs)
    phasic = x - tonic
    up = np.maximum(phasic, 0.0)
    top = S.peaks(up, 0.25)
    high, count = np.where(top, up, 0.0), top.sum(axis=1)
    area = S.total((up[:, :-1] + up[:, 1:]) / 2 / fs[:, None])
    parts = [(tonic[:, -1] - tonic[:, 0]) / ((n - 1) / fs), area, S.mean(phasic > 0), count, count / (n / fs), S.total(high) / np.maximum(count, 1), high.max(axis=1)]
    return np.concatenate([level, S.stats(tonic), S.stats(phasic), np.stack(parts, axis=1)], axis=1)


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def conductance(values: pa.Array, fs: pa.Array) -> pa.Array:
    """level_features and phasic_features of windows from their samples."""
    return S.column(S.by_size(*S.present(values)[:2], len(LEVEL) + 16 + len(PARTS), _conductance, S.numbers(fs)))
