"""Online use: window statistics, personal features and alerts on streams."""

from __future__ import annotations

import math
import uuid
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, StructField, StructType

from ..functions.columns import EPS
from ..operators.decision import context_flags, state_columns, stress_like
from ..operators.stats import stat_columns

#: Buckets that the keys of a stream with state are dealt to.
BUCKETS = 256


def stream_readings(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A folder of event files as a stream of readings with a timestamp, in the order in which they were written."""
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    source = F.when(F.col("user_id") % 2 == 0, "lab").otherwise("field")
    return rows.select("event_id", source.alias("source"), F.col("user_id").cast("string").alias("subject_id"), F.col("event_type").alias("signal"), F.col("ts").cast("timestamp").alias("ts"), "value")


def signal_only(stream: DataFrame, signal: str, time: str = "ts") -> DataFrame:
    """The rows of one signal, for a stream that has its watermark already, which goes on following the rows of all signals.

    The test reads the time too: a filter that doesn't would be moved below the watermark.
    """
    return stream.filter(F.col("signal") == F.when(F.col(time).isNotNull(), signal))


def stream_window_stats(stream: DataFrame, window: str = "60 seconds", slide: str | None = None, watermark: str = "10 minutes") -> DataFrame:
    """The eight statistics of each subject and signal in windows aligned to the epoch; rows later than the watermark are dropped.

    Unlike batch windows these don't start with the session. Works on a batch table too.
    """
    rows = stream.withWatermark("ts", watermark) if stream.isStreaming else stream
    span = F.window("ts", window, slide or window)
    stats = rows.groupBy(span.alias("w"), "source", "subject_id", "signal").agg(F.count("value").alias("n"), *stat_columns(F.col("value"), "value"))
    return stats.select("source", "subject_id", "signal", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", *[c for c in stats.columns if c.startswith("value_")])


def stream_personalise(stream: DataFrame, baseline: DataFrame, features: list[str]) -> DataFrame:
    """Personal columns from stored baselines: <feature>_med and <feature>_scale by source and subject. A person without one has nulls."""
    known = baseline.withColumnsRenamed({"source": "_b_source", "subject_id": "_b_subject"})
    joined = stream.join(known, (F.col("source") == F.col("_b_source")) & (F.col("subject_id") == F.col("_b_subject")), "left")
    out = []
    for f in features:
        x, med, scale = F.col(f), F.col(f"{f}_med"), F.col(f"{f}_scale")
        out += [(x - med).alias(f"{f}_delta_base"), F.try_divide(x + EPS, med + EPS).alias(f"{f}_ratio_base"), ((x - med) / (scale + EPS)).alias(f"{f}_z_personal")]
    return joined.select(*stream.columns, *out)


def runs(codes: np.ndarray, flags: np.ndarray, start: np.ndarray) -> np.ndarray:
    """How many flags in a row end at each row. Rows of a key lie together, in order; start: each key's run before its first row."""
    n, first = np.arange(len(codes)), np.r_[True, codes[1:] != codes[:-1]]
    base = np.where(flags, n - 1 - np.where(first, start[codes], 0), n)
    return n - base[np.maximum.accumulate(np.where(first | ~flags, n, 0))]


def stream_alerts(scored: DataFrame, acc_threshold: float, binary: bool = False, idle: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Alert states of a stream of predictions; the streak of each person is kept from batch to batch.

    scored: source, subject_id, window_start_ts, pred_label, confidence and personal features. Within a
    batch rows go in time order; a row that is older than one seen before goes on from the streak as it
    is. Motion is held against a fixed threshold, as a stream has no whole batch. `idle` (such as
    '7 days') drops the streak of a person who sends nothing for so long in processing time. `buckets`: so
    many that a task can hold a batch's rows of one.
    """
    flagged = context_flags(scored, acc_threshold=acc_threshold).withColumn("stress_like", stress_like(binary))
    names = flagged.columns
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in flagged.schema.fields)}, streak int"
    wait = _milliseconds(idle) if idle else None

    def count(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs() if wait else 0
        known = {k: (run, seen) for k, run, seen in zip(*state.get, strict=True) if not wait or now - seen < wait} if state.exists else {}
        if not state.hasTimedOut:
            rows = pd.concat(list(batches), ignore_index=True)
            codes, people = pd.factorize(rows["state_key"])
            rows = rows.assign(state_key=codes).sort_values(["state_key", "window_start_ts"], kind="stable")
            codes = rows["state_key"].to_numpy()
            streak = runs(codes, rows["stress_like"].eq(True).to_numpy(dtype=bool), np.array([known.get(p, (0, 0))[0] for p in people], dtype=np.int64))
            last = np.flatnonzero(np.r_[codes[1:] != codes[:-1], True])
            known |= {people[codes[i]]: (int(streak[i]), now) for i in last}
            yield rows[names].assign(streak=streak.astype("int32"))
        if not known:
            state.remove()
            return
        state.update((list(known), [run for run, _ in known.values()], [seen for _, seen in known.values()]))
        if wait:
            state.setTimeoutDuration(max(1, min(seen for _, seen in known.values()) + wait - now))

    timeout = GroupStateTimeout.ProcessingTimeTimeout if wait else GroupStateTimeout.NoTimeout
    dealt = _in_buckets(flagged, ["source", "subject_id"], buckets)
    kept = dealt.groupBy("state_bucket").applyInPandasWithState(count, schema, "people array<string>, runs array<int>, seen array<long>", "append", timeout)
    return state_columns(kept, binary)


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _milliseconds(text: str) -> int:
    return int(pd.Timedelta(text).total_seconds() * 1000)


def _packed(rows: list[tuple], names: list[str]) -> bytes | None:
    """Rows as an Arrow stream."""
    if not rows:
        return None
    table = pa.table({n: pa.array(list(c)) for n, c in zip(names, zip(*rows, strict=True), strict=True)})
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as stream:
        stream.write_table(table)
    return out.getvalue().to_pybytes()


def _unpacked(data: bytes | None) -> list[tuple]:
    return list(zip(*[c.to_pylist() for c in pa.ipc.open_stream(bytes(data)).read_all().columns], strict=True)) if data else []


def _in_buckets(rows: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """rows with state_key, the values of keys in one text, and state_bucket, which holds many keys: a call of the state for each key costs more than its rows."""
    return rows.withColumns({"state_key": F.to_json(F.struct(*keys)), "state_bucket": F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")})


class _InTime(StatefulProcessor):
    """Rows of a bucket of keys, held back until the watermark has passed them, then given on for each key in the order of their time.

    Subclasses say what happens to released rows. Rows are tuples of `fields`, of which `state_key` is the key
    and `at` the time in microseconds. A bucket's state is read and written as a whole, once for each batch
    that brings rows or passes its timer, which waits for its earliest row.
    """

    def __init__(self, fields: StructType, at: str, idle: int | None):
        self.fields, self.names, self.idle = fields, fields.fieldNames(), idle
        self.place, self.key = self.names.index(at), self.names.index("state_key")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("bucket", StructType([StructField("waiting", BinaryType()), StructField("carried", BinaryType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [r for pdf in rows for r in pdf[self.names].astype(object).where(pdf[self.names].notna(), None).itertuples(index=False, name=None)]
        yield from self._step(new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._step([], timerValues.getCurrentWatermarkInMs())

    def _step(self, new: list[tuple], watermark: int) -> Iterator[pd.DataFrame]:
        waiting, carried = self.state.get() if self.state.exists() else (None, None)
        before = {key: tuple(kept) for key, *kept in _unpacked(carried)}
        held: dict[str, list[tuple]] = {key: [] for key in before}
        for r in sorted([*_unpacked(waiting), *new], key=lambda r: r[self.place]):
            held.setdefault(r[self.key], []).append(r)
        out, still, now, times = [], [], [], []
        for key, rows in held.items():
            known = before.get(key)
            if not rows and self.idle and watermark * 1000 > known[0] + self.idle * 1000:
                continue
            cut = bisect_right(rows, watermark * 1000, key=lambda r: r[self.place])
            due, later = rows[:cut], rows[cut:]
            made, known, kept = self.released(due, later, known, watermark)
            out += made
            still += [*kept, *later]
            if known is not None:
                now.append((key, *known))
            ahead = self.next_time(later, known, watermark)
            if ahead is None and self.idle and known is not None:
                ahead = known[0] // 1000 + self.idle + 1
            if ahead is not None:
                times.append(ahead)
        if still or now:
            self.state.update((_packed(still, self.names), _packed(now, ["state_key", *self.carry])))
        else:
            self.state.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if times:
            self.handle.registerTimer(max(min(times), watermark + 1))
        if out:
            yield pd.DataFrame(out, columns=[*self.names, *self.more]).astype(self.kinds).drop(columns="state_key")

    def idled(self, before: int | None, at: int) -> bool:
        return self.idle is not None and before is not None and at - before > self.idle * 1000

    def next_time(self, later: list[tuple], carried, watermark: int) -> int | None:
        return -(-later[0][self.place] // 1000) if later else None

    def close(self) -> None:
        pass


class _Streaks(_InTime):
    """How many rows in a row have the flag. carried: time of the last row given on, streak."""

    carry, more, kinds = ["last", "run"], ["streak"], {"streak": "int32"}

    def released(self, due, later, carried, watermark):
        last, run = carried or (None, 0)
        flag, rows = self.names.index("stress_like"), []
        for r in due:
            run = (0 if self.idled(last, r[self.place]) else run) + 1 if r[flag] else 0
            last = r[self.place]
            rows.append((*r, run))
        return rows, None if last is None else (last, run), []


def stream_alerts_in_time(scored: DataFrame, acc_threshold: float, binary: bool = False, time: str = "ts", late: str | None = "10 minutes", idle: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """As stream_alerts, with streaks in the order of event time, however rows arrive.

    A row waits in a list state until the watermark, `late` behind the newest row of all, has passed it;
    a row behind the watermark of the batch before is dropped. An event-time timer releases what
    waits. A person without rows for longer than `idle`, in event time, starts anew. `late` None: the
    stream has its watermark already, from before rows were left out (see signal_only). `buckets`: so many
    that a task can hold the waiting rows of one.
    """
    scored.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = scored.withWatermark(time, late) if late else scored
    flagged = context_flags(rows, acc_threshold=acc_threshold).withColumn("stress_like", stress_like(binary)).withColumn("at_us", F.unix_micros(time))
    given = [f for f in flagged.schema.fields if f.name != time]
    dealt = _in_buckets(flagged, ["source", "subject_id"], buckets)
    held = _Streaks(StructType([*given, dealt.schema["state_key"]]), "at_us", _milliseconds(idle) if idle else None)
    kept = dealt.groupBy("state_bucket").transformWithStateInPandas(held, StructType([*given, StructField("streak", IntegerType())]), "append", "eventTime")
    return state_columns(kept.withColumn(time, F.timestamp_micros("at_us")).drop("at_us"), binary)


class _SessionWindows(_InTime):
    """Rows with the closed windows that hold them, from the session's first row on. carried: last time, start, first window that isn't closed."""

    carry, more, kinds = ["last", "start", "window"], ["window_id", "window_start_sec", "window_end_sec", "window_start_ts", "window_end_ts"], {"window_id": "int32"}

    def __init__(self, fields: StructType, at: str, idle: int | None, width: float, step: float):
        super().__init__(fields, at, idle)
        self.width, self.step = width, step

    def end(self, start: int, k: int) -> float:
        return start / 1e6 + k * self.step + self.width

    def released(self, due, later, carried, watermark):
        last, start, first = carried or (None, None, 0)
        runs: list[list[tuple]] = [[]]
        times = []
        for r in due:
            if self.idled(times[-1] if times else None, r[self.place]):
                runs.append([])
            runs[-1].append(r)
            times.append(r[self.place])
        rows, kept = [], []
        for i, run in enumerate(runs):
            if i or start is None or (run and not kept and self.idled(last, run[0][self.place])):
                if not run:
                    continue
                start, first, last = run[0][self.place], 0, run[0][self.place]
            for r in run if i + 1 < len(runs) else [*run, *later]:
                if self.idled(last, r[self.place]):
                    break
                last = max(last, r[self.place])
            after = first
            while self.end(start, after) <= min(watermark / 1000, last / 1e6 + 1e-6):
                after += 1
            kept = []
            for r in run:
                t = (r[self.place] - start) / 1e6
                low, high = max(0, math.floor((t - self.width) / self.step) + 1), math.floor(t / self.step)
                rows += [(*r, k, k * self.step, k * self.step + self.width, start / 1e6 + k * self.step, self.end(start, k)) for k in range(max(low, first), min(high, after - 1) + 1)]
                if high >= after:
                    kept.append(r)
            first = after
        return rows, None if start is None else (last, start, first), kept

    def next_time(self, later, carried, watermark):
        ends = [math.ceil(self.end(carried[1], carried[2]) * 1000)] if carried and self.end(carried[1], carried[2]) <= carried[0] / 1e6 + 1e-6 else []
        return min([*ends, *([-(-later[0][self.place] // 1000)] if later else [])], default=None)


def stream_session_windows(stream: DataFrame, window_sec: float, step_sec: float, time: str = "ts", late: str = "10 minutes", idle: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """assign_windows on a stream: readings with the windows of their session that hold them, once these are closed.

    The state of a session holds its start, from which windows count, and the readings of windows that
    aren't closed yet. A window closes when the watermark has passed its end and the session has a
    reading at its end or later; readings behind the watermark of the batch before are dropped. A session
    without readings for longer than `idle`, in event time, starts anew, and its open windows are lost.
    `buckets`: so many that a task can hold the waiting readings of one.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = stream.withWatermark(time, late).withColumn("at_us", F.unix_micros(time))
    given = [f for f in rows.schema.fields if f.name != time]
    dealt = _in_buckets(rows, ["source", "subject_id", "session_id"], buckets)
    named = [StructField("window_id", IntegerType()), *[StructField(n, DoubleType()) for n in ("window_start_sec", "window_end_sec", "window_start_ts", "window_end_ts")]]
    held = _SessionWindows(StructType([*given, dealt.schema["state_key"]]), "at_us", _milliseconds(idle) if idle else None, float(window_sec), float(step_sec))
    out = dealt.groupBy("state_bucket").transformWithStateInPandas(held, StructType([*given, *named]), "append", "eventTime")
    return out.withColumn(time, F.timestamp_micros("at_us")).drop("at_us")


def run_to_table(stream: DataFrame, base: str) -> DataFrame:
    """Run a stream over all that is there now into Parquet below `base`, and read that."""
    spark = stream.sparkSession
    path = f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"
    run = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
