"""The driver's tables read as sensor readings, survey rows, predictions and feature vectors."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import epoch_seconds, iso_utc, no_nan
from ..operators.baseline import add_personal_baseline
from ..operators.decision import alert_state
from ..operators.windows import assign_windows
from .scratch import shared_dir

DAY = 86_400.0
#: Features that window_rows has.
FEATURES = ["hr_mean", "eda_mean", "acc_activity"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as readings: a user is a subject with one session, the event type is the signal."""
    user = F.col("user_id").cast("string")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.when(F.col("user_id") % 2 == 0, "lab").otherwise("field").alias("source"),
        user.alias("subject_id"),
        user.alias("session_id"),
        F.col("event_type").alias("signal"),
        epoch_seconds(F.col("ts")).alias("ts_sec"),
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three consecutive events of a user as one sample of three axes."""
    n = F.row_number().over(Window.partitionBy("subject_id").orderBy("ts_sec", "event_id")) - 1
    rows = readings(spark, sf_dir).withColumn("n", n)
    axis = lambda i: F.max(F.when(F.col("n") % 3 == i, F.col("value")))
    return rows.groupBy("source", "subject_id", F.floor(F.col("n") / 3).cast("int").alias("sample")).agg(axis(0).alias("x"), axis(1).alias("y"), axis(2).alias("z"))


def survey_rows(spark: SparkSession, sf_dir: str, offset_hours: float = -4.0) -> DataFrame:
    """Purchases as survey rows of text, in a local time offset_hours from UTC; each lasts 1 to 20 hours."""
    rows = readings(spark, sf_dir).filter("signal = 'purchase'")
    local = F.floor("ts_sec") + offset_hours * 3600.0
    start, end = iso_utc(local), iso_utc(local + (F.col("k") % 20 + 1) * 3600.0)
    level = F.when(F.col("k") % 10 == 9, F.lit("na")).otherwise((F.col("k") % 3).cast("string"))
    return rows.select(
        F.concat(F.lit(" "), "subject_id", F.lit(".0")).alias("ID"),
        F.substring(start, 1, 10).alias("date"),
        F.substring(start, 12, 8).alias("Start time"),
        F.substring(end, 12, 8).alias("End time"),
        level.alias("Stress level"),
    )


def window_rows(readings: DataFrame, window_sec: float, step_sec: float) -> DataFrame:
    """Windows of events with a few columns named as features: events are too sparse for real ones (see recordings).

    The mean stands for heart rate, the deviation for conductance, the maximum for motion.
    """
    placed = assign_windows(readings, window_sec, step_sec)
    keys = ["source", "subject_id", "session_id", "window_id", "window_start_sec", "window_end_sec", "window_start_ts", "window_end_ts"]
    return placed.groupBy(*keys).agg(
        F.lit(float(window_sec)).alias("window_duration_sec"),
        F.count("*").alias("n_samples"),
        F.avg("value").alias("hr_mean"),
        (F.stddev_pop("value") / 100).alias("eda_mean"),
        F.max("value").alias("acc_activity"),
    )


def personal_rows(readings: DataFrame, window_sec: float, step_sec: float, minutes: float) -> DataFrame:
    rows = window_rows(readings, window_sec, step_sec)
    rows = rows.withColumn("protocol_label", F.when(F.col("source") == "lab", F.when(F.col("window_id") % 3 == 1, 1).otherwise(2)))
    return add_personal_baseline(rows, FEATURES, minutes)


def alert_rows(readings: DataFrame, window_sec: float, step_sec: float, minutes: float) -> DataFrame:
    """Alert states of these windows, with label and confidence by the sample count in place of a model."""
    rows = personal_rows(readings, window_sec, step_sec, minutes)
    scored = rows.withColumns({"pred_label": (F.col("n_samples") % 3).cast("int"), "confidence": (F.col("n_samples") % 11) / 10.0})
    return alert_state(scored, ["source"])


#: Rate of the motion and pulse signals of recordings(), and the start of the first.
RATE, EPOCH = 4.0, 1_600_000_000.0


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as sample instants: a supplier and line status is a session; even suppliers are lab subjects with one session."""
    rows = table(spark, sf_dir, "lineitem").filter("l_suppkey % 2 = 1 or l_linestatus = 'F'")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
    n = F.row_number().over(Window.partitionBy("l_suppkey", "l_linestatus").orderBy(*order)) - 1
    lab, name = F.col("l_suppkey") % 2 == 0, F.col("l_suppkey").cast("string")
    start = EPOCH + F.col("l_suppkey") * 100_000.0 + F.when(F.col("l_linestatus") == "O", 40_000.0).otherwise(0.0)
    return rows.select(
        "l_suppkey",
        "l_linestatus",
        F.when(lab, "lab").otherwise("field").alias("source"),
        name.alias("subject_id"),
        F.when(lab, name).otherwise(F.concat(name, F.lit("_"), "l_linestatus")).alias("session_id"),
        F.when(lab, 0.0).otherwise(start).alias("start_ts"),
        n.cast("long").alias("n"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
    )


def _fast(s) -> dict:
    """Motion and pulse of a sample; s gives its columns."""
    return {"acc_x": s("quantity"), "acc_y": s("discount") * 100, "acc_z": s("tax") * 100, "bvp": s("price") / 1000}


def _slow(s) -> dict:
    return {"eda": s("quantity") / 10, "temp": 30 + s("tax") * 10, "hr": 60 + s("quantity"), "ibi": 0.4 + s("discount") * 10}


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All signals of the sessions of lineitem: motion and pulse at 4 Hz, the others at 1 Hz; the heart rate of field sessions starts 10 s late."""
    fast, slow = _fast(F.col), _slow(F.col)
    one = lambda name, fs, i, value: F.struct(F.lit(name).alias("signal"), F.lit(fs).alias("fs"), i.alias("sample_idx"), value.cast("double").alias("value"))
    of_fast = [one(k, RATE, F.col("n"), v) for k, v in fast.items()]
    of_slow = [one(k, 1.0, F.floor(F.col("n") / 4), v) for k, v in slow.items()]
    late = F.when((F.col("s.signal") == "hr") & (F.col("source") == "field"), 10.0).otherwise(0.0)
    rows = _samples(spark, sf_dir).withColumn("s", F.explode(F.when(F.col("n") % 4 == 0, F.array(*of_fast, *of_slow)).otherwise(F.array(*of_fast))))
    return rows.select("source", "subject_id", "session_id", "s.signal", "s.fs", (F.col("start_ts") + late).alias("start_ts"), "s.sample_idx", "s.value")


#: Samples at RATE in a row of recording_blocks(): a minute.
BLOCK = 240


def recording_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """windows.blocks of recordings(): the samples are gathered before they are laid out by signal, where numbering has put them already."""
    names, fast, slow = ["source", "subject_id", "session_id", "start_ts"], _fast(F.col), _slow(F.col)
    sample = lambda of: F.struct("n", *[no_nan(v).alias(k) for k, v in of.items()])
    lists = [F.sort_array(F.collect_list(sample(fast))).alias("_fast"), F.sort_array(F.collect_list(F.when(F.col("n") % 4 == 0, sample(slow)))).alias("_slow")]
    held = _samples(spark, sf_dir).groupBy("l_suppkey", "l_linestatus", F.floor(F.col("n") / BLOCK).alias("_b")).agg(*[F.first(c).alias(c) for c in names], *lists)

    def one(name: str, fs: float, samples: str, first: Column) -> Column:
        late = F.when(F.col("source") == "field", 10.0).otherwise(0.0) if name == "hr" else F.lit(0.0)
        return F.struct(F.lit(name).alias("signal"), F.lit(fs).alias("fs"), (F.col("start_ts") + late).alias("start_ts"), first.cast("long").alias("sample_idx"), F.col(f"{samples}.{name}").alias("values"), F.size(samples).alias("n"))

    signals = [one(k, RATE, "_fast", F.col("_b") * BLOCK) for k in fast] + [one(k, 1.0, "_slow", F.col("_b") * (BLOCK // 4)) for k in slow]
    return held.select("source", "subject_id", "session_id", F.inline(F.array(*signals)))


def block_labels(blocks: DataFrame) -> DataFrame:
    """recording_labels() in blocks, from those of the pulse, which has a sample for each label."""
    pulse = blocks.filter("source = 'lab' and signal = 'bvp'")
    labels = F.transform(F.sequence(F.col("sample_idx"), F.col("sample_idx") + F.col("n") - 1), lambda i: (F.floor(i / 120) % 3 + 1).cast("double"))
    return pulse.select("subject_id", "fs", "sample_idx", labels.alias("values"), "n")


def recording_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Protocol labels of the lab sessions, at 4 Hz: half a minute of each in turn."""
    return _samples(spark, sf_dir).filter("source = 'lab'").select("subject_id", F.col("n").alias("sample_idx"), (F.floor(F.col("n") / 120) % 3 + 1).cast("int").alias("label"), F.lit(RATE).alias("fs"))


def recording_survey(spark: SparkSession, sf_dir: str, offset_hours: float = -4.0) -> DataFrame:
    """The first 40 s of each field session as survey rows of text, in a local time offset_hours from UTC."""
    starts = _samples(spark, sf_dir).filter("source = 'field'").groupBy("subject_id", "session_id").agg(F.min("start_ts").alias("t"))
    start, end = (iso_utc(F.col("t") + offset_hours * 3600.0 + x) for x in (0.0, 40.0))
    return starts.select(F.col("subject_id").alias("ID"), F.substring(start, 1, 10).alias("date"), F.substring(start, 12, 8).alias("Start time"), F.substring(end, 12, 8).alias("End time"), (F.col("subject_id").cast("int") % 3).cast("string").alias("Stress level"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as predictions of two models over three folds."""
    score = F.round(F.col("l_discount") * 5 + F.col("l_quantity") / 100, 4)
    rows = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("m"), (F.col("l_suppkey") % 2).cast("string")).alias("model"),
        (F.col("l_linenumber") % 3).cast("int").alias("fold"),
        F.col("l_linestatus").alias("source"),
        (F.col("l_returnflag") == "R").cast("int").alias("y_true"),
        score.alias("proba_1"),
    )
    return rows.withColumn("pred_label", (F.col("proba_1") >= 0.5).cast("int"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as feature vectors: e0 to e63 with holes, and the whole vector."""
    cells = [F.when(F.col("vec_id") % 7 != i % 11, F.col("embedding")[i].cast("double")).alias(f"e{i}") for i in range(64)]
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label", (F.col("label") >= 5).cast("int").alias("target_binary"), (F.col("vec_id") % 20).cast("string").alias("group_id"), *cells)


def feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as a feature table of three classes (label % 3), with holes, two sources and 20 groups."""
    cells = [F.when(F.col("vec_id") % 7 != i % 11, F.col("embedding")[i].cast("double")).alias(f"v{i:02d}") for i in range(64)]
    group = (F.col("vec_id") % 20).cast("string")
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.when(F.col("vec_id") % 2 == 0, "lab").otherwise("field").alias("source"),
        group.alias("subject_id"),
        group.alias("group_id"),
        F.col("vec_id").cast("double").alias("window_start_ts"),
        (F.col("label") % 3).cast("int").alias("target3"),
        (F.col("label") % 3 > 0).cast("int").alias("target_binary"),
        *cells,
    )


def event_files(spark: SparkSession, sf_dir: str, parts: int = 4, delayed: bool = False, rows_per_file: int = 250_000) -> tuple[str, int]:
    """events as a folder of files that arrive one after another, and how many arrive together: several micro-batches.

    Each part of the time is written as so many files, of rows_per_file rows at most on average, so that
    no task writes or reads a part alone, and a batch keeps all cores busy. delayed: every third event comes a part later than it should.
    """
    rows = table(spark, sf_dir, "events")
    sec = epoch_seconds(F.col("ts"))
    ends = rows.agg(F.min(sec).alias("a"), F.max(sec).alias("b"), F.count("*").alias("n")).first()
    part = F.floor((sec - ends["a"]) / (ends["b"] - ends["a"] + 1e-6) * parts)
    part = F.least(F.lit(parts - 1), part + (F.col("event_id") % 3 == 0).cast("int") if delayed else part)
    path, files = f"{shared_dir(spark)}/events-{uuid.uuid4().hex}", max(1, math.ceil(ends["n"] / parts / rows_per_file))
    for i in range(parts):
        rows.filter(part == i).repartition(files, "event_id").write.mode("append").parquet(path)
    return path, files


def half_span(spark: SparkSession, sf_dir: str) -> str:
    """Half the time that events span, in whole seconds and one more, as an interval: no delayed event is later."""
    sec = epoch_seconds(F.col("ts"))
    row = table(spark, sf_dir, "events").agg((F.max(sec) - F.min(sec)).alias("s")).first()
    return f"{int(row['s'] / 2) + 1} seconds"


def event_buckets(spark: SparkSession, sf_dir: str, rows: int = 10_000) -> int:
    """So many buckets of people that one has so many events on average, and 32 at least."""
    return max(32, math.ceil(table(spark, sf_dir, "events").count() / rows))
