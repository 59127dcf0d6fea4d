"""Samples of windows in Arrow batches: windows of equal size are computed together, so a window's result doesn't depend on its batch."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Samples that are computed together.
LIMIT = 500_000


def present(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The samples that are there, of all windows one behind another, how many each window has, and their places in it. column: a window's pieces in order, as windows.window_lists has them."""
    count, pieces = _sizes(column), column.flatten()
    first, values = pieces.field("i").to_numpy(zero_copy_only=False), pieces.field("v")
    sizes = _sizes(values)
    place = np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    values = values.flatten().to_numpy(zero_copy_only=False)
    keep = ~np.isnan(values)
    window = np.repeat(np.repeat(np.arange(len(count)), count), sizes)
    return values[keep], np.bincount(window[keep], minlength=len(count)), place[keep]


def _sizes(column: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(float)


def column(rows: np.ndarray) -> pa.Array:
    """Each row of numbers as a list, NaN as null."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(rows.ravel(), pa.float64(), from_pandas=True))


def chosen(keep: np.ndarray, values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lists of the values to keep."""
    return values[keep], np.bincount(np.repeat(np.arange(len(sizes)), sizes)[keep], minlength=len(sizes))


def by_size(values: np.ndarray, sizes: np.ndarray, width: int, use: Callable[..., np.ndarray], *beside: np.ndarray) -> np.ndarray:
    """A row of `width` numbers for each list, NaN for empty ones. use gets the values of lists of one size as a matrix, and their part of `beside`."""
    out, starts = np.full((len(sizes), width), np.nan), np.cumsum(sizes) - sizes
    for n in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == n)
        for part in np.array_split(rows, -(-len(rows) * int(n) // LIMIT)):
            out[part] = use(values[starts[part][:, None] + np.arange(n)], *(b[part] for b in beside))
    return out


def quantile(ordered: np.ndarray, p: float) -> np.ndarray:
    """The linear percentile of each row of sorted values."""
    place = (ordered.shape[1] - 1) * p
    low, high = int(np.floor(place)), int(np.ceil(place))
    return ordered[:, low] if low == high else (high - place) * ordered[:, low] + (place - low) * ordered[:, high]


def total(x: np.ndarray) -> np.ndarray:
    """The sum of each row, in order, as Spark's sum and avg have it: means that differ in the last bit only would count as a spread of a person's baseline."""
    return np.cumsum(x, axis=1, dtype=float)[:, -1] if x.shape[1] else np.zeros(len(x))


def mean(x: np.ndarray, empty: float = np.nan) -> np.ndarray:
    """The mean of each row."""
    return total(x) / x.shape[1] if x.shape[1] else np.full(len(x), empty)


def squares(x: np.ndarray) -> np.ndarray:
    """The sum of squared distances from the mean of each row, updated value by value as in Spark's deviations; exactly 0 where all are equal."""
    middle = out = np.zeros(len(x))
    for i, v in enumerate(np.ascontiguousarray(x.T), 1):
        away = v - middle
        middle, out = middle + away / i, out + away * (away - away / i)
    return out


def deviation(x: np.ndarray) -> np.ndarray:
    """The population deviation of each row."""
    return np.sqrt(squares(x) / x.shape[1])


def stats(x: np.ndarray) -> np.ndarray:
    """The eight basic statistics of each row, as stats.stat_columns has them."""
    if not x.shape[1]:
        return np.full((len(x), 8), np.nan)
    q = np.sort(x, axis=1)
    low, high = q[:, 0], q[:, -1]
    return np.stack([mean(x), deviation(x), quantile(q, 0.5), low, high, quantile(q, 0.75) - quantile(q, 0.25), high - low, mean(x * x)], axis=1)


def peaks(x: np.ndarray, k: float) -> np.ndarray:
    """Where each row has a peak, as stats.flag_peaks has it: above the value before, not below the one after, above mean + k deviations."""
    out, inner, high = np.zeros(x.shape, dtype=bool), x[:, 1:-1], mean(x) + k * deviation(x)
    out[:, 1:-1] = (inner > x[:, :-2]) & (inner >= x[:, 2:]) & (inner > high[:, None])
    return out
