"""Device session archives and survey sheets as tables."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from contextlib import suppress
from itertools import batched, islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import no_nan, normalize_subject_id
from ..schema import READINGS, SURVEY_RAW

#: File of an archive, and the signals that its columns hold.
FILES = {"ACC": ("acc_x", "acc_y", "acc_z"), "EDA": ("eda",), "TEMP": ("temp",), "BVP": ("bvp",), "HR": ("hr",)}


#: Rows that a reader gives on at once.
CHUNK = 65_536


def session_index(paths: DataFrame, column: str = "path") -> DataFrame:
    """Adds subject_id, session_name and start_ts from paths like <subject>/<name>_<epoch>.zip; others are left out."""
    pattern = r"([^/]+)/([^/]+)_(\d+)\.zip$"
    part = lambda i: F.regexp_extract(column, pattern, i)
    return paths.filter(F.col(column).rlike(pattern)).withColumns({"subject_id": normalize_subject_id(part(1)), "session_name": part(2), "start_ts": part(3).cast("double")})


def number(text: str) -> float | None:
    try:
        x = float(text)
    except ValueError:
        return None
    return x if x == x and abs(x) != float("inf") else None


def samples(lines: Iterable[str], names: tuple[str, ...]) -> Iterator[tuple[str, float, float, int, float | None]]:
    """(signal, rate, start, index, value) from the lines of one file, one after another: starts, rates, then samples; what is no number is missing."""
    rows = (line.split(",") for line in lines if line.strip())
    head = list(islice(rows, 2))
    start, rate = (number(r[0]) for r in head) if len(head) == 2 else (None, None)
    if start is None or not rate or rate <= 0:
        return
    for i, row in enumerate(rows):
        for name, cell in zip(names, [*row, *[""] * len(names)], strict=False):
            yield name, rate, start, i, number(cell)


def parse_csv(data: bytes, names: tuple[str, ...]) -> Iterator[tuple[str, float, float, int, float | None]]:
    return samples(io.TextIOWrapper(io.BytesIO(data), "utf-8", "replace"), names)


def parse_beats(data: bytes) -> Iterator[tuple[float, float, float]]:
    """(start, seconds since then, interval) of the beat file: a line of start, then pairs."""
    lines = [line.split(",") for line in data.decode("utf-8", "replace").splitlines() if line.strip()]
    try:
        start = float(lines[0][0])
    except (IndexError, ValueError):
        return
    for line in lines[1:]:
        try:
            yield start, float(line[0]), float(line[1])
        except (IndexError, ValueError):
            continue


#: What a damaged, encrypted or unknown archive raises.
DAMAGE = (zipfile.BadZipFile, zlib.error, EOFError, RuntimeError, NotImplementedError, OSError)


def _files(content: bytes) -> dict[str, bytes]:
    """The files of an archive that can be read."""
    out = {}
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for n in z.namelist():
                if n.lower().endswith(".csv"):
                    with suppress(*DAMAGE):
                        out[n.rsplit("/", 1)[-1].removesuffix(".csv").upper()] = z.read(n)
    except DAMAGE:
        return out
    return out


def _archives(spark: SparkSession, glob: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(glob).select("path", "content")
    return session_index(files).select("subject_id", F.concat_ws("_", "session_name", F.col("start_ts").cast("long").cast("string")).alias("session_id"), "content")


def read_sessions(spark: SparkSession, glob: str, source: str = "field") -> DataFrame:
    """Samples of all session archives in long form. One archive is parsed at a time, in the task that holds it.

    A file that is absent, empty, damaged or no CSV gives no rows, a broken archive none at all. Archives
    too large for a task's memory are read by archives.py.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for subject, session, content in pdf.itertuples(index=False):
                held = _files(content)
                for name, signals in FILES.items():
                    for rows in batched(parse_csv(held.get(name, b""), signals), CHUNK, strict=False):
                        out = pd.DataFrame(rows, columns=["signal", "fs", "start_ts", "sample_idx", "value"])
                        yield out.assign(source=source, subject_id=subject, session_id=session)

    return _archives(spark, glob).mapInPandas(parse, READINGS).withColumn("value", no_nan(F.col("value")))


def read_beats(spark: SparkSession, glob: str) -> DataFrame:
    """Beat intervals of all session archives: subject_id, session_id, start_ts, rel_t, ibi."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for subject, session, content in pdf.itertuples(index=False):
                if rows := list(parse_beats(_files(content).get("IBI", b""))):
                    yield pd.DataFrame(rows, columns=["start_ts", "rel_t", "ibi"]).assign(subject_id=subject, session_id=session)

    return _archives(spark, glob).mapInPandas(parse, "subject_id string, session_id string, start_ts double, rel_t double, ibi double")


def read_survey(spark: SparkSession, path: str) -> DataFrame:
    """The survey sheet, exported as CSV with a header or as Parquet, as text columns."""
    if path.endswith(".parquet"):
        rows = spark.read.parquet(path)
        return rows.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in ("ID", "date", "Start time", "End time", "Stress level")])
    return spark.read.csv(path, header=True, schema=SURVEY_RAW, enforceSchema=False)


def read_lab(spark: SparkSession, path: str, rates: dict[str, float], label_rate: float = 700.0) -> tuple[DataFrame, DataFrame]:
    """Lab readings and sample labels from Parquet with one row for each subject and an array for each signal and `label`."""
    rows = spark.read.parquet(path)
    parts = [
        rows.select(F.lit("lab").alias("source"), "subject_id", F.col("subject_id").alias("session_id"), F.lit(name).alias("signal"), F.lit(float(fs)).alias("fs"), F.lit(0.0).alias("start_ts"), F.posexplode(name).alias("i", "value"))
        for name, fs in rates.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    readings = out.select("source", "subject_id", "session_id", "signal", "fs", "start_ts", F.col("i").cast("long").alias("sample_idx"), no_nan(F.col("value")).alias("value"))
    labels = rows.select("subject_id", F.posexplode("label").alias("sample_idx", "label")).withColumn("fs", F.lit(label_rate))
    return readings, labels
