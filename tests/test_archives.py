"""Archives as a data source: equal to the reader of whole archives, damaged ones counted, large ones in little memory, arriving ones once."""

import io
import tracemalloc
import zipfile

import pytest
from pyspark.sql import functions as F

from sensorloom.schema import READINGS
from sensorloom.sources import archives, sessions
from sensorloom.streaming import streams

NAMES = [f.split()[0] for f in READINGS.split(", ")]


def packed(files, damage=None):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(name, text)
    raw = bytearray(held.getvalue())
    if damage:
        with zipfile.ZipFile(io.BytesIO(bytes(raw))) as z:
            info = z.getinfo(damage)
        at = info.header_offset + 30 + len(info.filename) + info.compress_size // 2
        raw[at : at + 40] = bytes(40)
    return bytes(raw)


HR = "100.0\n1.0\n" + "".join(f"{i % 90}.{i % 7}\n" for i in range(40_000))


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "7.0").mkdir()
    (tmp_path / "8").mkdir()
    (tmp_path / "7.0" / "dev_100.zip").write_bytes(packed({"ACC.csv": "100,100,100\n32,32,32\n1,2,3\n4,x\n", "x/HR.csv": HR, "IBI.csv": "100,IBI\n1,2\n", "EDA.csv": "", "TEMP.csv": "100\n0\n1\n"}))
    (tmp_path / "8" / "dev_200.zip").write_bytes(packed({"HR.csv": HR, "BVP.csv": "1\n64\n5\n"}, damage="HR.csv"))
    (tmp_path / "8" / "dev_300.zip").write_bytes(b"broken")
    (tmp_path / "8" / "notes.zip").write_bytes(b"no session")
    return tmp_path


def key(r):
    return r["session_id"], r["signal"], r["sample_idx"], r["value"]


def test_source_equals_the_reader_of_whole_archives(spark, folder):
    rows = archives.read_archives(spark, f"{folder}/*/*.zip").cache()
    whole = sessions.read_sessions(spark, f"{folder}/*/*.zip")
    fine = rows.filter("error is null and not (session_id = 'dev_200' and signal = 'hr')").select(*NAMES)
    assert sorted(map(key, fine.collect()), key=str) == sorted(map(key, whole.collect()), key=str) and whole.count() == 40_007
    assert {r["subject_id"] for r in whole.select("subject_id").distinct().collect()} == {r["subject_id"] for r in fine.select("subject_id").distinct().collect()} == {"7", "8"}
    broken = {(r["session_id"], r["signal"]): r for r in rows.filter("error is not null").collect()}
    assert set(broken) == {("dev_200", "HR"), ("dev_300", "archive")}
    cut = broken["dev_200", "HR"]
    assert cut["sample_idx"] == rows.filter("session_id = 'dev_200' and signal = 'hr'").count() < 40_000
    assert {(r["signal"], r["n"]) for r in archives.archive_errors(rows).collect()} == {("HR", 1), ("archive", 1)}


def test_one_partition_for_each_file(folder):
    reader = archives.SessionArchives({"path": f"{folder}/*/*.zip"}).reader(None)
    assert sorted((m.path.rsplit("/", 1)[-1], m.name) for m in reader.partitions() if m.name) == [("dev_100.zip", "ACC.csv"), ("dev_100.zip", "EDA.csv"), ("dev_100.zip", "TEMP.csv"), ("dev_100.zip", "x/HR.csv"), ("dev_200.zip", "BVP.csv"), ("dev_200.zip", "HR.csv")]


def test_a_large_file_takes_little_memory(tmp_path):
    """Three million samples pass by; what is held at a time is one chunk."""
    (tmp_path / "1").mkdir()
    with zipfile.ZipFile(tmp_path / "1" / "dev_1.zip", "w", zipfile.ZIP_DEFLATED) as z, z.open("BVP.csv", "w") as f:
        f.write(b"1.0\n64.0\n")
        for _ in range(300):
            f.write(b"12.5\n" * 10_000)
    reader = archives.SessionArchives({"path": f"{tmp_path}/*/*.zip"}).reader(None)
    tracemalloc.start()
    n = sum(b.num_rows for b in reader.read(reader.partitions()[0]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 3_000_000 and peak < 64 << 20


def test_arriving_archives_are_read_once(spark, folder):
    stream = archives.stream_archives(spark, f"{folder}/*/*.zip", settle_seconds=0).filter("error is null").select(*NAMES)
    out, state = f"{folder}/out", f"{folder}/state"

    def run():
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(once=True).start().awaitTermination()
        return {r["session_id"]: r["n"] for r in spark.read.parquet(out).filter("signal <> 'hr'").groupBy("session_id").agg(F.count("*").alias("n")).collect()}

    assert run() == {"dev_100": 6, "dev_200": 1}
    (folder / "8" / "dev_400.zip").write_bytes(packed({"EDA.csv": "1\n4\n1\n2\n"}))
    assert run() == {"dev_100": 6, "dev_200": 1, "dev_400": 2}
    assert run() == {"dev_100": 6, "dev_200": 1, "dev_400": 2}
    assert streams.ROCKS
