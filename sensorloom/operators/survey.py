"""Survey intervals, the offset scan, and labels of windows by overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import normalize_subject_id, parse_clock, parse_date


def survey_intervals(raw: DataFrame, offset_hours: float = 0.0) -> DataFrame:
    """Intervals in epoch seconds UTC from survey rows as text: ID, date, Start time, End time, Stress level.

    Rows without id, with a level outside 0, 1, 2, or with a date or time that can't be read are left
    out. An end before its start is of the next day. The local time is `offset_hours` ahead of UTC.
    """
    row = F.struct(
        normalize_subject_id(F.col("ID")).alias("subject_id"),
        F.unix_date(parse_date(F.col("date"))).alias("day"),
        parse_clock(F.col("Start time")).alias("start"),
        parse_clock(F.col("End time")).alias("end"),
        F.trim(F.col("Stress level").cast("string")).try_cast("double").try_cast("int").alias("nurse_label"),
    )
    # The test stands inside the array, so that the parsing isn't written out again for a filter below.
    whole = lambda x: (x["subject_id"] != "") & x["nurse_label"].isin(0, 1, 2) & x["day"].isNotNull() & x["start"].isNotNull() & x["end"].isNotNull()
    good = raw.select(F.inline(F.filter(F.array(row), whole)))
    base = F.col("day") * F.lit(86400.0) - F.lit(3600.0 * offset_hours)
    end = F.when(F.col("end") < F.col("start"), F.col("end") + 86400).otherwise(F.col("end"))
    return good.select("subject_id", (base + F.col("start")).alias("survey_start_ts"), (base + end).alias("survey_end_ts"), "nurse_label")


def scan_offsets(sessions: DataFrame, intervals: DataFrame, offsets: list[int] | None = None) -> DataFrame:
    """For each offset in hours: sessions whose start lies in a shifted interval of their subject (ends included), and their subjects.

    intervals are those of offset 0. A start meets the intervals that some offset can bring it into, by
    an equi-join on subject and day, and each pair gives the offsets that fit, out of a literal array.
    """
    offsets = list(range(-12, 15)) if offsets is None else offsets
    low, high = 3600.0 * min(offsets), 3600.0 * max(offsets)
    day = lambda c: F.floor(c / 86400.0)
    starts = sessions.select("subject_id", "session_id", "start_ts", day(F.col("start_ts")).alias("_day"))
    near = intervals.withColumn("_day", F.explode(F.sequence(day(F.col("survey_start_ts") - high), day(F.col("survey_end_ts") - low))))
    fits = lambda o: (F.col("survey_start_ts") <= F.col("start_ts") + o * 3600.0) & (F.col("start_ts") + o * 3600.0 <= F.col("survey_end_ts"))
    inside = starts.join(near, ["subject_id", "_day"]).select("subject_id", "session_id", F.explode(F.filter(F.array(*[F.lit(float(o)) for o in offsets]), fits)).alias("offset"))
    found = inside.groupBy("offset").agg(F.count_distinct("subject_id", "session_id").alias("m"), F.count_distinct("subject_id").alias("s"))
    every = sessions.sparkSession.createDataFrame([(float(o),) for o in offsets], "survey_offset_hours double")
    joined = every.join(F.broadcast(found), every["survey_offset_hours"] == found["offset"], "left")  # one row for each offset
    return joined.select("survey_offset_hours", F.coalesce("m", F.lit(0)).cast("int").alias("matched_session_starts"), F.coalesce("s", F.lit(0)).cast("int").alias("matched_subjects"))


def best_offset(scan: DataFrame) -> DataFrame:
    """The offset with most sessions, then most subjects, then the lowest."""
    return scan.orderBy(F.desc("matched_session_starts"), F.desc("matched_subjects"), "survey_offset_hours").limit(1)


def label_by_overlap(windows: DataFrame, intervals: DataFrame, min_overlap: float = 0.5, bucket_sec: float | None = None) -> DataFrame:
    """Adds nurse_label and label_overlap_ratio: the interval of the subject that covers most of a window labels it.

    The ratio of the best interval is always given (0 without one), the label only from min_overlap.
    Of equal ratios the earliest interval wins, then the lowest label. windows: window_start_ts,
    window_end_ts and keys that tell rows apart. With bucket_sec, which should be the window length
    or more, both sides are cut into buckets of time, so that the join is on (subject, bucket) and a
    subject with a long history is dealt to many tasks.
    """
    keys = ["source", "subject_id", "session_id", "window_id"]
    w, i = windows.select(*keys, "window_start_ts", "window_end_ts"), intervals
    on = ["subject_id"]
    if bucket_sec:
        cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bucket_sec), F.floor(F.col(b) / bucket_sec)))
        w, i, on = w.withColumn("_cell", cells("window_start_ts", "window_end_ts")), i.withColumn("_cell", cells("survey_start_ts", "survey_end_ts")), ["subject_id", "_cell"]
    hits = w.join(i, on).filter((F.col("survey_end_ts") > F.col("window_start_ts")) & (F.col("survey_start_ts") < F.col("window_end_ts")))
    cover = F.greatest(F.lit(0.0), F.least("window_end_ts", "survey_end_ts") - F.greatest("window_start_ts", "survey_start_ts"))
    ratio = cover / F.greatest(F.col("window_end_ts") - F.col("window_start_ts"), F.lit(1e-8))
    rated = hits.withColumn("_ratio", ratio).filter("_ratio > 0")
    best = rated.groupBy(*keys).agg(F.max("_ratio").alias("_ratio"), F.max_by("nurse_label", F.struct("_ratio", -F.col("survey_start_ts"), -F.col("nurse_label"))).alias("_label"))
    out = windows.join(best, keys, "left")
    return out.select(*windows.columns, F.when(F.col("_ratio") >= min_overlap, F.col("_label")).alias("nurse_label"), F.coalesce("_ratio", F.lit(0.0)).alias("label_overlap_ratio"))


def map_field_labels(df: DataFrame) -> DataFrame:
    """target3 is the survey's level, target_binary whether it is 1 or more; null stays null."""
    return df.withColumns({"target3": F.col("nurse_label"), "target_binary": F.when(F.col("nurse_label").isNotNull(), (F.col("nurse_label") >= 1).cast("int"))})


def map_lab_labels(df: DataFrame, purity: float = 0.8) -> DataFrame:
    """Windows of protocol labels 1, 2, 3 that are pure enough: 2 is target3 = 2 and stress, 1 and 3 are neither."""
    kept = df.filter((F.col("purity") >= purity) & F.col("label").isin(1, 2, 3))
    return kept.withColumns({"target3": F.when(F.col("label") == 2, 2).otherwise(0), "target_binary": F.when(F.col("label") == 2, 1).otherwise(0)})


def labelled_only(df: DataFrame, keep: bool = False) -> DataFrame:
    return df if keep else df.filter(F.col("target3").isNotNull())
