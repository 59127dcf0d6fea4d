"""Windows of sessions, aligned signals, label purity and regular grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import laid
from ..functions.columns import no_nan

SESSION = ["source", "subject_id", "session_id"]


def align_signals(readings: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """Shift the samples of late signals: sample_idx counts from the earliest start of the session.

    readings: source, subject_id, session_id, signal, fs, start_ts, sample_idx, value. The starts are
    one row for each session, so the join side is small next to the samples; spans may give them.
    """
    starts = readings.groupBy(SESSION).agg(F.min("start_ts").alias("session_start")) if spans is None else spans.select(*SESSION, "session_start")
    joined = readings.join(starts, SESSION)
    return joined.withColumn("sample_idx", F.col("sample_idx") + F.bround((F.col("start_ts") - F.col("session_start")) * F.col("fs")).cast("long"))


def assign_windows(readings: DataFrame, window_sec: float, step_sec: float) -> DataFrame:
    """Readings with the windows of their session that hold them: window_id, window_start_sec, window_end_sec and window_start_ts.

    readings: source, subject_id, session_id, signal, ts_sec, value, ... Windows start at multiples of
    the step from the session's first reading; only those that end within its duration (and 1e-6 s)
    are kept. Works by arithmetic on each row: the only shuffle is the small one for session starts.
    """
    spans = readings.groupBy(SESSION).agg(F.min("ts_sec").alias("session_start"), F.max("ts_sec").alias("session_end"))
    t = F.col("ts_sec") - F.col("session_start")
    first = F.greatest(F.lit(0), F.floor((t - window_sec) / step_sec).cast("int") + 1)
    last = F.least(F.floor(t / step_sec), F.floor((F.col("session_end") - F.col("session_start") + 1e-6 - window_sec) / step_sec)).cast("int")
    placed = readings.join(spans, SESSION).withColumn("window_id", F.explode(F.when(first <= last, F.sequence(first, last))))
    start = F.col("window_id") * F.lit(float(step_sec))
    return placed.select(
        *[F.col(c) for c in readings.columns],
        "window_id",
        start.alias("window_start_sec"),
        (start + window_sec).alias("window_end_sec"),
        (F.col("session_start") + start).alias("window_start_ts"),
        (F.col("session_start") + start + window_sec).alias("window_end_ts"),
    )


def session_spans(aligned: DataFrame) -> DataFrame:
    """session_start and duration of each session: the earliest start and the longest signal of aligned samples."""
    return aligned.groupBy(SESSION).agg(F.min("start_ts").alias("session_start"), F.max((F.col("sample_idx") + 1) / F.col("fs")).alias("duration"))


def late_spans(readings: DataFrame) -> DataFrame:
    """session_spans(align_signals(readings)) from one aggregate, without a join of samples: all samples of a start and a rate are shifted alike."""
    last = readings.groupBy(*SESSION, "start_ts", "fs").agg(F.max("sample_idx").alias("_last"))
    found = last.groupBy(SESSION).agg(F.min("start_ts").alias("session_start"), F.collect_set(F.struct("start_ts", "fs", "_last")).alias("_s"))
    shift = lambda s: F.bround((s["start_ts"] - F.col("session_start")) * s["fs"]).cast("long")
    ends = F.transform("_s", lambda s: (s["_last"] + shift(s) + 1) / s["fs"])
    return found.select(*SESSION, "session_start", F.array_max(ends).alias("duration"))


def blocks(readings: DataFrame, sec: float = 60.0) -> DataFrame:
    """Readings with the samples of so many seconds of a signal in one row: n values from sample_idx on, null where one is missing.

    Joins and shuffles behind it move blocks, not samples. Readings that are blocks already stay as they are.
    """
    if "values" in readings.columns:
        return readings
    size = F.greatest(F.lit(1.0), F.round(F.col("fs") * sec))
    pieces = F.sort_array(F.collect_list(F.struct(F.col("sample_idx").alias("i"), F.array(no_nan(F.col("value"))).alias("v"))))
    held = readings.groupBy(*SESSION, "signal", "fs", "start_ts", F.floor(F.col("sample_idx") / size).alias("_b")).agg(F.min("sample_idx").alias("sample_idx"), pieces.alias("_s"))
    rows = held.select(*SESSION, "signal", "fs", "start_ts", "sample_idx", laid(F.col("_s"), F.col("sample_idx")).alias("values"))
    return rows.withColumn("n", F.size("values"))


def block_spans(held: DataFrame) -> DataFrame:
    """late_spans of blocks; no values are read."""
    return late_spans(held.select(*SESSION, "start_ts", "fs", (F.col("sample_idx") + F.col("n") - 1).alias("sample_idx")))


def cut_windows(held: DataFrame, window_sec: float, step_sec: float, spans: DataFrame, align: bool = False) -> DataFrame:
    """The pieces of blocks that lie in each window of their session: window_id, i (places from the window's first) and v.

    Windows are those of assign_sampled_windows, or, with align, of align_signals before it.
    """
    start, fs = F.col("session_start"), F.col("fs")
    shift = F.bround((F.col("start_ts") - start) * fs).cast("long") if align else F.lit(0)
    rows = held.join(spans.select(*SESSION, "session_start", "duration"), SESSION).withColumn("_i", F.col("sample_idx") + shift)
    first = F.greatest(F.lit(0), F.floor((F.col("_i") / fs - window_sec) / step_sec).cast("int"))
    last = F.least(F.floor((F.col("_i") + F.col("n") - 1) / fs / step_sec) + 1, F.floor((F.col("duration") + 1e-6 - window_sec) / step_sec)).cast("int")
    rows = rows.withColumn("window_id", F.explode(F.when(first <= last, F.sequence(first, last))))
    low = F.bround(F.col("window_id") * F.lit(float(step_sec)) * fs).cast("long")
    high = F.bround((F.col("window_id") * F.lit(float(step_sec)) + window_sec) * fs).cast("long")
    rows = rows.withColumns({"_low": low, "_a": F.greatest("_i", low), "_z": F.least(F.col("_i") + F.col("n"), high)}).filter("_a < _z")
    v = F.slice("values", (F.col("_a") - F.col("_i") + 1).cast("int"), (F.col("_z") - F.col("_a")).cast("int"))
    return rows.select(*SESSION, "signal", "fs", "window_id", (F.col("_a") - F.col("_low")).alias("i"), v.alias("v"))


def window_lists(pieces: DataFrame, keys: list[str], signals: tuple[str, ...]) -> DataFrame:
    """One row for each window, from cut_windows: the pieces of each signal in order as an array of (i, v), and its rate as <signal>_fs."""
    of = lambda s: F.col("signal") == s
    lists = [F.sort_array(F.collect_list(F.when(of(s), F.struct("i", "v")))).alias(s) for s in signals]
    return pieces.groupBy(*keys).agg(*lists, *[F.max(F.when(of(s), F.col("fs"))).alias(f"{s}_fs") for s in signals])


def session_windows(spans: DataFrame, window_sec: float, step_sec: float) -> DataFrame:
    """All windows that end within the duration of their session, with or without samples."""
    last = F.floor((F.col("duration") + 1e-6 - window_sec) / step_sec).cast("int")
    rows = spans.withColumn("window_id", F.explode(F.when(last >= 0, F.sequence(F.lit(0), last))))
    start = F.col("window_id") * F.lit(float(step_sec))
    return rows.select(
        *SESSION,
        "window_id",
        start.alias("window_start_sec"),
        (start + window_sec).alias("window_end_sec"),
        F.lit(float(window_sec)).alias("window_duration_sec"),
        (F.col("session_start") + start).alias("window_start_ts"),
        (F.col("session_start") + start + window_sec).alias("window_end_ts"),
    )


def assign_sampled_windows(readings: DataFrame, window_sec: float, step_sec: float, spans: DataFrame | None = None) -> DataFrame:
    """As assign_windows, for aligned samples with fs: window k holds the indices from round(k step fs) up to round((k step + window) fs), halves to even.

    spans (duration of each session) decides how many windows there are; unset, the samples do.
    """
    ends = readings.groupBy(SESSION).agg(F.max((F.col("sample_idx") + 1) / F.col("fs")).alias("duration")) if spans is None else spans.select(*SESSION, "duration")
    t = F.col("sample_idx") / F.col("fs")
    first = F.greatest(F.lit(0), F.floor((t - window_sec) / step_sec).cast("int"))
    last = F.least(F.floor(t / step_sec) + 1, F.floor((F.col("duration") + 1e-6 - window_sec) / step_sec)).cast("int")
    placed = readings.join(ends, SESSION).withColumn("window_id", F.explode(F.when(first <= last, F.sequence(first, last))))
    low = F.bround(F.col("window_id") * F.lit(float(step_sec)) * F.col("fs"))
    high = F.bround((F.col("window_id") * F.lit(float(step_sec)) + window_sec) * F.col("fs"))
    start = F.col("window_id") * F.lit(float(step_sec))
    return placed.filter((F.col("sample_idx") >= low) & (F.col("sample_idx") < high)).select(*readings.columns, "window_id", start.alias("window_start_sec"), (start + window_sec).alias("window_end_sec"))


def mode_and_purity(samples: DataFrame, keys: list[str], label: str, order: str) -> DataFrame:
    """The most frequent label of each group (the one seen first, if several) and its share of the finite labels."""
    counts = samples.filter(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.count("*").alias("n"), F.min(order).alias("seen"))
    best = F.max_by(F.col(label), F.struct(F.col("n"), -F.col("seen")))
    return counts.groupBy(*keys).agg(best.alias("label"), (F.max("n") / F.sum("n")).alias("purity"))


def ibi_grid(beats: DataFrame) -> DataFrame:
    """Beat intervals on a grid of one second: the last value of each second, filled forward, then back at the start.

    beats: subject_id, session_id, rel_t, ibi. The grid runs from 0 to the second of the last beat.
    """
    keys = ["subject_id", "session_id"]
    good = beats.filter(F.col("rel_t").isNotNull() & F.col("ibi").isNotNull() & (F.col("rel_t") >= 0))
    seconds = good.groupBy(*keys, F.floor("rel_t").cast("int").alias("sec")).agg(F.max_by("ibi", F.struct("rel_t", "ibi")).alias("ibi"))
    grid = seconds.groupBy(*keys).agg(F.max("sec").alias("last")).select(*keys, F.explode(F.sequence(F.lit(0), F.col("last"))).alias("sec"))
    w = Window.partitionBy(*keys).orderBy("sec")
    forward = F.last("ibi", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    back = F.first("ibi", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return grid.join(seconds, [*keys, "sec"], "left").select(*keys, "sec", F.coalesce(forward, back).alias("ibi"))


def beat_readings(beats: DataFrame, source: str = "field") -> DataFrame:
    """Beat intervals as readings of the signal ibi at 1 Hz. beats: subject_id, session_id, start_ts, rel_t, ibi."""
    keys = ["subject_id", "session_id"]
    starts = beats.groupBy(*keys).agg(F.min("start_ts").alias("start_ts"))
    return ibi_grid(beats).join(starts, keys).select(F.lit(source).alias("source"), *keys, F.lit("ibi").alias("signal"), F.lit(1.0).alias("fs"), "start_ts", F.col("sec").cast("long").alias("sample_idx"), F.col("ibi").alias("value"))
