"""Statistics of the signals in a window. Missing values go first, so gaps close before differences are taken."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import samples as S
from ..functions.columns import no_nan


def stat_columns(value: Column, prefix: str) -> list[Column]:
    """The eight basic statistics: population deviation, linear percentiles; null where nothing is there."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))  # one map of values for all three
    return [
        F.avg(value).alias(f"{prefix}_mean"),
        F.stddev_pop(value).alias(f"{prefix}_std"),
        q[1].alias(f"{prefix}_median"),
        F.min(value).alias(f"{prefix}_min"),
        F.max(value).alias(f"{prefix}_max"),
        (q[2] - q[0]).alias(f"{prefix}_iqr"),
        (F.max(value) - F.min(value)).alias(f"{prefix}_range"),
        F.avg(value * value).alias(f"{prefix}_energy"),
    ]


def basic_stats(df: DataFrame, keys: list[str], value: str, prefix: str = "value") -> DataFrame:
    """Percentiles keep a map of values for each group: meant for windows, whose samples are bounded."""
    return df.groupBy(*keys).agg(F.count(no_nan(F.col(value))).alias("n"), *stat_columns(no_nan(F.col(value)), prefix))


def slope(df: DataFrame, keys: list[str], value: str, order: list[str], fs: Column | None = None) -> DataFrame:
    """(last - first) / ((n - 1) / fs) over the values that are there; null for fewer than two."""
    v = no_nan(F.col(value))
    place = F.struct(*order)
    n = F.count(v)
    rate = F.lit(1.0) if fs is None else F.max(fs)
    rise = F.max_by(v, F.when(v.isNotNull(), place)) - F.min_by(v, F.when(v.isNotNull(), place))
    return df.groupBy(*keys).agg(n.alias("n"), F.when(n >= 2, rise / ((n - 1) / rate)).alias("slope"))


def _steps(df: DataFrame, keys: list[str], value: str, order: list[str]) -> tuple[DataFrame, Window]:
    present = df.withColumn("_v", no_nan(F.col(value))).filter(F.col("_v").isNotNull())
    return present, Window.partitionBy(*keys).orderBy(*order)


def diff_features(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """Share of rises and mean absolute change from one value to the next; null for a single value."""
    present, w = _steps(df, keys, value, order)
    d = present.withColumn("_d", F.col("_v") - F.lag("_v").over(w))
    return d.groupBy(*keys).agg(F.avg(F.when(F.col("_d").isNotNull(), (F.col("_d") > 0).cast("double"))).alias("rise_rate"), F.avg(F.abs("_d")).alias("abs_diff_mean"))


def flag_peaks(df: DataFrame, keys: list[str], value: str, order: list[str], k: float = 0.5) -> DataFrame:
    """Adds peak: above the value before, not below the one after, and above mean + k deviations of the window."""
    present, w = _steps(df, keys, value, order)
    whole = Window.partitionBy(*keys)
    high = F.col("_v") > F.avg("_v").over(whole) + k * F.stddev_pop("_v").over(whole)
    before, after = F.lag("_v").over(w), F.lead("_v").over(w)
    return present.withColumn("peak", F.coalesce((F.col("_v") > before) & (F.col("_v") >= after) & high, F.lit(False))).drop("_v")


def peak_count(df: DataFrame, keys: list[str], value: str, order: list[str], k: float = 0.5) -> DataFrame:
    return flag_peaks(df, keys, value, order, k).groupBy(*keys).agg(F.sum(F.col("peak").cast("long")).alias("peak_count"))


def trapezoid(df: DataFrame, keys: list[str], value: str, order: list[str], dx: float = 1.0) -> DataFrame:
    """Area under the values by the trapezoid rule at equal distances; 0 for a single value."""
    present, w = _steps(df, keys, value, order)
    part = (F.col("_v") + F.lead("_v").over(w)) / 2 * dx
    return present.withColumn("_a", part).groupBy(*keys).agg(F.coalesce(F.sum("_a"), F.lit(0.0)).alias("area"))


def _plain(x: np.ndarray, fs: np.ndarray) -> np.ndarray:
    rise = (x[:, -1] - x[:, 0]) / ((x.shape[1] - 1) / fs) if x.shape[1] > 1 else np.full(len(x), np.nan)
    return np.concatenate([S.stats(x), rise[:, None]], axis=1)


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def plain(values: pa.Array, fs: pa.Array) -> pa.Array:
    """The eight statistics and the slope of windows from their samples."""
    return S.column(S.by_size(*S.present(values)[:2], 9, _plain, S.numbers(fs)))
