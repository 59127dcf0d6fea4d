"""Folds and percentiles whose work is never in one task."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.operators import prep, splits


def test_balanced_folds_equal_a_plain_greedy(spark):
    """Every group by itself, with many alike; classes are spread better than by whole shares of groups at random."""
    rng = np.random.default_rng(5)
    shapes = [(12, 1, 0), (3, 3, 3), (0, 9, 1), (40, 2, 5)]
    groups = [shapes[i] for i in rng.integers(0, 4, 60)]
    rows = [(f"g{i}", c) for i, g in enumerate(groups) for c, n in enumerate(g) for _ in range(n)]
    got = splits.folds_balanced(spark.createDataFrame(rows, "g string, y int"), 5, "g", "y").groupBy("g").agg(F.min("fold").alias("a"), F.max("fold").alias("b")).toPandas()
    assert len(got) == 60 and (got["a"] == got["b"]).all()
    counts, total = np.array(groups, float), np.array(groups, float).sum(axis=0)
    held, want = np.zeros((5, 3)), []
    for i in sorted(range(60), key=lambda i: (-round(counts[i].std(), 9), groups[i])):
        def score(f, i=i):
            trial = held.copy()
            trial[f] += counts[i]
            return round((trial / total).std(axis=0).mean(), 9), held[f].sum(), f
        best = min(range(5), key=score)
        held[best] += counts[i]
        want.append((groups[i], best))
    fold = dict(zip(got["g"], got["a"], strict=True))
    assert sorted((g, int(fold[f"g{i}"])) for i, g in enumerate(groups)) == sorted(want)
    assert (held / total).std(axis=0).max() < 0.03


def test_balanced_fold_edges(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 1), ("c", None)], "g string, y int")
    got = {r["g"]: r["fold"] for r in splits.folds_balanced(df, 5, "g", "y").collect()}
    assert set(got) == {"a", "b"} and set(got.values()) == {0, 1}
    assert splits.folds_balanced(df.limit(0), 5, "g", "y").count() == 0


def test_places_over_partitions(spark):
    df = spark.range(5000).select(F.format_string("%05d", (F.col("id") * 7919) % 5000).alias("k")).repartition(6)
    got = splits.sorted_place(df, "k").toPandas()
    assert (got["k"].astype(int) == got["place"]).all() and len(got) == 5000
    assert splits.sorted_place(df.limit(0), "k").count() == 0


@pytest.mark.parametrize("q", [0.0, 0.37, 0.75, 1.0])
def test_percentiles_by_several_passes(spark, monkeypatch, q):
    """Brackets that narrow again and again, ties that can't be parted, and a group without values."""
    monkeypatch.setattr(prep, "RANKED", 20)
    monkeypatch.setattr(prep, "_STEPS", 20)
    passes, kept = [], prep._narrowed
    monkeypatch.setattr(prep, "_narrowed", lambda *a: passes.append(1) or kept(*a))
    rng = np.random.default_rng(1)
    groups = {"wide": rng.normal(size=60_000), "ties": np.repeat(3.0, 60_000), "some": np.r_[np.repeat(1.0, 50_000), rng.normal(size=2000)], "few": np.array([2.0, 5.0])}
    df = spark.createDataFrame([(k, float(v)) for k, x in groups.items() for v in x] + [("none", None)], "g string, v double")
    got = {r["g"]: r["q"] for r in prep.percentiles(df, ["g"], "v", q).collect()}
    assert got.pop("none") is None and passes
    assert all(abs(got[k] - np.percentile(x, 100 * q)) < 1e-12 for k, x in groups.items()) and len(got) == 4
    assert abs(prep.percentiles(df.filter("g = 'wide'"), [], "v", q).first()["q"] - got["wide"]) < 1e-12


def test_percentile_of_many_values(spark, monkeypatch):
    """10^7 different values, ranked 200 at a time in the end."""
    monkeypatch.setattr(prep, "RANKED", 200)
    df = spark.range(10_000_000).select(((F.col("id") * 7_368_787) % 10_000_019).cast("double").alias("v"))
    low = df.filter("v <= 5000000").count()
    got = prep.percentiles(df, [], "v", 0.5).first()["q"]
    place = 0.5 * (10_000_000 - 1)
    assert df.filter(F.col("v") < got).count() == int(place) + 1 and low > 0
