"""Streams whose rows come out of order, against batch results over what the watermark has passed."""

import os
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom import catalogue
from sensorloom.operators import decision, windows
from sensorloom.sources import driver_tables
from sensorloom.streaming import streams

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle import check

ROW = "event_id long, source string, subject_id string, session_id string, signal string, ts timestamp, value double, pred_label int, confidence double"


def files(spark, path, batches):
    """One file for each batch of rows, in that order."""
    for b in batches:
        df = spark.createDataFrame([(i, "lab", s, e, "eda", None, float(v), int(p), 0.5) for i, s, e, t, v, p in b], ROW)
        at = spark.createDataFrame([(i, float(t)) for i, _, _, t, _, _ in b], "event_id long, t double")
        df.drop("ts").join(at, "event_id").withColumn("ts", F.timestamp_micros((F.col("t") * 1e6).cast("long"))).drop("t").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.fixture(scope="module")
def batches():
    """Three people, two sessions each, in five batches that overlap in time; a gap in the second session."""
    rng = np.random.default_rng(9)
    rows, n = [], 0
    for s in range(3):
        for e, (a, b) in enumerate(((0, 400), (450, 1000))):
            t = a + np.cumsum(rng.exponential(4, 400))
            for x in t[(t < b) & ((t < 600) | (t > 720))]:
                rows.append((n, f"s{s}", f"s{s}e{e}", round(float(x), 3), rng.normal(), int(rng.integers(0, 3))))
                n += 1
    arrival = np.array([r[3] for r in rows]) + rng.uniform(0, 150, len(rows))
    order = np.argsort(arrival)
    return [[rows[i] for i in part] for part in np.array_split(order, 5)]


def scored(df):
    return df.withColumns({"window_start_ts": F.unix_micros("ts") / 1e6, "hr_mean_z_personal": F.col("value"), "acc_activity": F.col("value")})


def test_streaks_in_event_time(spark, tmp_path, batches):
    stream = scored(files(spark, f"{tmp_path}/in", batches))
    got = streams.run_to_table(streams.stream_alerts_in_time(stream, 1.0, late="200 seconds"), f"{tmp_path}/out").toPandas()
    rows = spark.read.parquet(f"{tmp_path}/in")
    end = rows.agg(F.max(F.unix_micros("ts"))).first()[0]
    want = decision.alert_state(scored(rows), acc_threshold=1.0).filter(F.unix_micros("ts") <= end - 200_000_000).toPandas()
    assert len(got) == len(want) > 300 and got["event_id"].is_unique
    cols = ["event_id", "streak", "alert_state", "recommendation", "hr_high", "active", "value", "ts"]
    a, b = (df[cols].sort_values("event_id", ignore_index=True) for df in (got, want))
    assert a.equals(b.astype(a.dtypes.to_dict()))


def test_late_and_idle_rows(spark, tmp_path):
    """A row behind the watermark is dropped; a streak is forgotten when a person is idle in event time."""
    first = [(0, "a", "x", 1000, 0, 2), (1, "a", "x", 1001, 0, 2), (2, "b", "y", 1500, 0, 2)]
    second = [(4, "b", "y", 1501, 0, 2), (5, "b", "y", 3000, 0, 2)]
    third = [(3, "a", "x", 1002, 0, 2), (6, "a", "x", 3001, 0, 2), (7, "b", "y", 5000, 0, 2)]
    for idle, again in ((None, 3), ("100 seconds", 1)):
        stream = scored(files(spark, f"{tmp_path}/in{idle}", [first, second, third, [(8, "c", "z", 9000, 0, 0)]]))
        out = streams.stream_alerts_in_time(stream, 1.0, late="10 seconds", idle=idle)
        got = {r["event_id"]: r["streak"] for r in streams.run_to_table(out, f"{tmp_path}/out{idle}").collect()}
        assert 3 not in got and (got[0], got[1]) == (1, 2) and got[6] == again


@pytest.mark.parametrize("width, step", [(60.0, 60.0), (90.0, 30.0)])
def test_windows_from_the_start_of_a_session(spark, tmp_path, batches, width, step):
    stream = files(spark, f"{tmp_path}/in", batches)
    got = streams.run_to_table(streams.stream_session_windows(stream, width, step, late="200 seconds"), f"{tmp_path}/out").toPandas()
    rows = spark.read.parquet(f"{tmp_path}/in").withColumn("ts_sec", F.unix_micros("ts") / 1e6)
    end = rows.agg(F.max("ts_sec")).first()[0]
    want = windows.assign_windows(rows, width, step).filter(F.col("window_end_ts") <= end - 200).toPandas()
    key = ["session_id", "window_id", "event_id"]
    a, b = (df[[*key, "window_start_sec", "window_end_ts", "value"]].sort_values(key, ignore_index=True) for df in (got, want))
    assert len(a) == len(b) > 200 and a[key].equals(b[key]) and np.allclose(a["window_end_ts"], b["window_end_ts"]) and (a["value"] == b["value"]).all()


def test_idle_sessions_are_forgotten(spark, tmp_path):
    """A pause longer than `idle` starts a session anew; without it windows count on from the first start."""
    parts = [[(0, "a", "x", 1000, 1, 0), (1, "a", "x", 1005, 1, 0)], [(2, "b", "y", 4000, 1, 0)], [(3, "a", "x", 4003, 1, 0), (4, "a", "x", 4014, 1, 0)], [(5, "c", "z", 9000, 1, 0)]]
    for idle, want in (("60 seconds", {(3, 4003.0)}), (None, {(0, 1000.0), (1, 1000.0), (3, 4000.0)})):
        stream = files(spark, f"{tmp_path}/in{idle}", parts)
        got = streams.run_to_table(streams.stream_session_windows(stream, 10.0, 10.0, late="1 seconds", idle=idle), f"{tmp_path}/out{idle}").collect()
        assert {(r["event_id"], r["window_start_ts"]) for r in got} == want


@pytest.mark.parametrize("name", ["stream_window_stats", "stream_alerts", "stream_alerts_in_time"])
def test_parts_of_several_files(spark, sf_dir, name, monkeypatch):
    """Each part of the time arrives as several files at once; the result is that of one file."""
    kept, told = driver_tables.event_files, []

    def many(*args, **kinds):
        told.append(kept(*args, **kinds, rows_per_file=60))
        return told[-1]

    monkeypatch.setattr(driver_tables, "event_files", many)
    check(spark, sf_dir, catalogue.QUERIES[name], catalogue.SQL[name])
    path, together = told[0]
    assert together > 2 and len(spark.read.parquet(path).inputFiles()) == 4 * together


def test_watermark_follows_all_signals(spark, tmp_path):
    """The newest row is of a signal that is left out; the rows of the other that it has passed are given on all the same."""
    old = [(0, "a", "x", 1000, 0, 2), (1, "a", "x", 1001, 0, 2)]
    rows = files(spark, f"{tmp_path}/in", [old, [(2, "b", "y", 1020, 0, 0)]])
    named = rows.withColumn("signal", F.when(F.col("event_id") == 2, "other").otherwise("eda")).withWatermark("ts", "10 seconds")
    out = streams.stream_alerts_in_time(scored(streams.signal_only(named, "eda")), 1.0, late=None)
    got = {r["event_id"]: r["streak"] for r in streams.run_to_table(out, f"{tmp_path}/out").collect()}
    assert got == {0: 1, 1: 2}


@pytest.mark.parametrize("job", ["streaks", "windows", "alerts"])
def test_state_by_buckets(spark, tmp_path, job):
    """Many sessions share a bucket: the state holds a row for each bucket, not one for each session, and the results don't depend on buckets."""
    rows = [[(60 * t + s, f"s{s}", f"e{s % 2}", 1000 + 10 * t + s / 100, s, (t + s) % 3) for t in range(a, b) for s in range(60)] for a, b in ((0, 6), (6, 12))]
    stream = files(spark, f"{tmp_path}/in", rows)
    made = {"streaks": lambda n: streams.stream_alerts_in_time(scored(stream), 1.0, late="10 seconds", buckets=n), "windows": lambda n: streams.stream_session_windows(stream, 20.0, 10.0, late="10 seconds", buckets=n), "alerts": lambda n: streams.stream_alerts(scored(stream), 1.0, buckets=n)}[job]
    run = made(4).writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    assert 0 < max(o["numRowsTotal"] for p in run.recentProgress for o in p["stateOperators"]) <= 4
    key = ["event_id", "window_id" if job == "windows" else "streak"]
    few, many = (streams.run_to_table(made(n), f"{tmp_path}/out").select(*key).toPandas().sort_values(key, ignore_index=True) for n in (4, 1000))
    assert len(few) > 300 and few.equals(many)


def test_a_part_of_many_events_is_dealt_to_files(spark, tmp_path):
    """1.2 million events: each of the four parts is written and read by two tasks, and no event is lost."""
    rows = spark.range(1_200_000).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id")).alias("ts"), (F.col("id") % 50).alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"))
    rows.write.parquet(f"{tmp_path}/events.parquet")
    path, together = driver_tables.event_files(spark, str(tmp_path))
    there = spark.read.parquet(path)
    assert together == 2 and len(there.inputFiles()) == 8 and there.select("event_id").distinct().count() == 1_200_000


def test_one_map_of_values_for_all_percentiles(spark):
    """The state of a window holds its values once for the median and both quartiles."""
    got = spark.createDataFrame([("a", float(v)) for v in (1, 2, 4, 9)], "k string, v double").groupBy("k").agg(*streams.stat_columns(F.col("v"), "v"))
    assert got._jdf.queryExecution().executedPlan().toString().count("partial_percentile(") == 1
    assert got.select("v_median", "v_iqr").first() == (3.0, 3.5)
