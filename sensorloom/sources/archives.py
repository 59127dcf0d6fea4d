"""Session archives as a data source, in batches and as a stream: a task reads one file of one archive, sample by sample.

    spark.dataSource.register(SessionArchives)
    spark.read.format("session_archives").option("path", "/data/*/*.zip").load()

Archives may lie wherever pyarrow's file systems reach (local, HDFS, object stores).
"""

from __future__ import annotations

import io
import re
import time
import zipfile
from collections.abc import Iterator
from fnmatch import fnmatch
from itertools import batched

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..functions.columns import normalize_subject_id
from ..schema import READINGS
from .sessions import CHUNK, DAMAGE, FILES, samples

#: Readings, and what kept a file from being read to its end.
SCHEMA = f"{READINGS}, error string"
_ARROW = pa.schema([(n, {"string": pa.string(), "double": pa.float64(), "long": pa.int64()}[k]) for n, k in (f.split() for f in SCHEMA.split(", "))])
#: A file too short for an archive makes the store's own files refuse a place.
_BROKEN = (*DAMAGE, pa.ArrowInvalid)
_NAME = re.compile(r"([^/]+)/([^/]+_\d+)\.zip$")


class Member(InputPartition):
    """One file of an archive, or the archive itself if it can't be opened."""

    def __init__(self, path: str, name: str | None):
        self.path, self.name = path, name


def _split(pattern: str) -> tuple[fs.FileSystem, str]:
    """The file system of a pattern, and the pattern within it."""
    scheme, sep, rest = pattern.partition("://")
    if not sep:
        return fs.LocalFileSystem(), pattern
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    fixed = pattern.split("*", 1)[0].rsplit("/", 1)[0]
    store, base = fs.FileSystem.from_uri(fixed)
    return store, base.rstrip("/") + pattern[len(fixed) :]


def listed(pattern: str) -> list[tuple[int, str]]:
    """(time of writing, path) of all archives that the pattern fits, in that order. `*` stays within a folder."""
    store, inner = _split(pattern)
    base = inner.split("*", 1)[0].rsplit("/", 1)[0] or "/"
    parts = inner.split("/")
    fits = lambda p: len(p.split("/")) == len(parts) and all(fnmatch(a, b) for a, b in zip(p.split("/"), parts, strict=True))
    found = store.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
    return sorted((int(f.mtime_ns or 0), f.path) for f in found if f.type == fs.FileType.File and fits(f.path) and _NAME.search(f.path))


class _Reader:
    def __init__(self, options: dict):
        self.pattern, self.source = options["path"], options.get("source", "field")
        self.settled = float(options.get("settle_seconds", "0"))

    def members(self, paths: list[str]) -> list[Member]:
        """Only the directories at the ends of archives are read here."""
        store, out = _split(self.pattern)[0], []
        for path in paths:
            try:
                with store.open_input_file(path) as f, zipfile.ZipFile(f) as z:
                    out += [Member(path, n) for n in z.namelist() if n.rsplit("/", 1)[-1].removesuffix(".csv").upper() in FILES]
            except _BROKEN:
                out.append(Member(path, None))
        return out

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        subject, session = _NAME.search(partition.path).groups()
        name = (partition.name or "").rsplit("/", 1)[-1].removesuffix(".csv").upper()

        def batch(rows: list[tuple], error: str | None = None) -> pa.RecordBatch:
            full = [(self.source, subject, session, s, rate, start, i, v, error) for s, rate, start, i, v in rows]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*full, strict=True), _ARROW, strict=True)], schema=_ARROW)

        done = 0
        try:
            with _split(self.pattern)[0].open_input_file(partition.path) as f, zipfile.ZipFile(f) as z, z.open(partition.name or "") as raw:
                for rows in batched(samples(io.TextIOWrapper(raw, "utf-8", "replace"), FILES[name]), CHUNK, strict=False):
                    yield batch(list(rows))
                    done = rows[-1][3] + 1
        except (KeyError, *_BROKEN) as e:
            yield batch([(name or "archive", None, None, done, None)], f"{type(e).__name__}: {e}"[:200])


class _Batch(_Reader, DataSourceReader):
    def partitions(self) -> list[Member]:
        return self.members([p for _, p in listed(self.pattern)])


class _Stream(_Reader, DataSourceStreamReader):
    """Offsets are the time and path of the last archive that was taken."""

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        ready = [x for x in listed(self.pattern) if x[0] <= (time.time() - self.settled) * 1e9]
        return {"time": ready[-1][0], "path": ready[-1][1]} if ready else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Member]:
        after, upto = ((o["time"], o["path"]) for o in (start, end))
        return self.members([p for t, p in listed(self.pattern) if after < (t, p) <= upto])

    def commit(self, end: dict) -> None:
        pass


class SessionArchives(DataSource):
    """Options: path (a pattern like <folder>/*/*.zip), source, and settle_seconds, for which a new archive is left alone by a stream."""

    @classmethod
    def name(cls) -> str:
        return "session_archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)


def _cleaned(rows: DataFrame) -> DataFrame:
    return rows.withColumn("subject_id", normalize_subject_id(F.col("subject_id")))


def read_archives(spark: SparkSession, path: str, source: str = "field") -> DataFrame:
    """Readings and error: a file that breaks off gives its samples so far and one row that says why, with the number of samples as sample_idx.

    An archive that can't be opened at all gives one such row, with signal `archive`.
    """
    spark.dataSource.register(SessionArchives)
    return _cleaned(spark.read.format("session_archives").option("path", path).option("source", source).load())


def stream_archives(spark: SparkSession, path: str, source: str = "field", settle_seconds: float = 1.0) -> DataFrame:
    """As read_archives, on archives as they arrive; each is taken once."""
    spark.dataSource.register(SessionArchives)
    return _cleaned(spark.readStream.format("session_archives").option("path", path).option("source", source).option("settle_seconds", str(settle_seconds)).load())


def archive_errors(rows: DataFrame) -> DataFrame:
    """How many files broke off, by signal and kind of error."""
    return rows.filter("error is not null").groupBy("signal", F.substring_index("error", ":", 1).alias("kind")).agg(F.count("*").alias("n"))
