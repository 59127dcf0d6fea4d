"""Preparing features: columns, labels, weights, imputing, scaling, neighbours, oversampling, naive Bayes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import staged
from .neighbours import nearest
from .splits import draw_rank

#: Names that are never model inputs, parts of names that rule a column out, and names of time columns that are let in on request.
EXACT = ("source", "subject_id", "session_id", "group_id", "target3", "target_binary", "window_id", "fold", "model")
PARTS = ("label", "target", "subject", "session", "source", "group", "utc", "recommendation", "alert", "window", "offset")
TIME_NAMES = ("hour", "dayofweek", "month")
#: Names, and beginnings of names, that get no personal baseline.
BASELINE_EXACT = ("window_start_ts", "window_end_ts", "window_start_sec", "window_end_sec", "window_id")
BASELINE_PREFIXES = ("target", "label", "source", "subject", "session", "group", "window_start_utc", "window_end_utc")


def _numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def feature_columns(df: DataFrame, include_time: bool = False) -> list[str]:
    """Numeric columns that may be model inputs, in table order."""
    keep = [c for c in _numeric(df) if c not in EXACT and not any(p in c.lower() for p in PARTS)]
    return [c for c in keep if include_time or c.lower() not in TIME_NAMES]


def baseline_columns(df: DataFrame) -> list[str]:
    """Numeric columns that get a personal baseline: another rule, which keeps window_duration_sec and survey_offset_hours."""
    return [c for c in _numeric(df) if c.lower() not in BASELINE_EXACT and not c.lower().startswith(BASELINE_PREFIXES) and "label" not in c.lower()]


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing feature columns: {', '.join(missing)}")
    return df


def encode_labels(df: DataFrame, label: str) -> DataFrame:
    """Adds label_index: the place of the label among the sorted labels."""
    labels = df.select(label).filter(F.col(label).isNotNull()).distinct().withColumn("label_index", (F.row_number().over(Window.orderBy(label)) - 1).cast("int"))
    return df.join(labels, label, "left")


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """Adds weight: rows / (classes * rows of the class)."""
    sizes = df.groupBy(label).agg(F.count("*").alias("_n"))
    total = sizes.agg(F.sum("_n") / F.count("*")).scalar()
    return df.join(F.broadcast(sizes.withColumn("weight", total / F.col("_n")).drop("_n")), label)  # one row for each class


#: Values inside a bracket that are ranked together in the end.
RANKED = 10_000
_STEPS = 500


def percentiles(df: DataFrame, keys: list[str], value: str, q: float) -> DataFrame:
    """keys and q: the exact linear percentile of the values of each group, null if it has none.

    A first pass brackets the percentile to within a few rows in ten thousand. As long as a bracket
    holds more than RANKED values and still narrows, a further pass counts what is below and inside
    and takes percentiles of the inside, which leaves under a hundredth. In the end the values inside
    are counted, and those below and above as a whole. So no task holds or sorts the values of a group.
    """
    near, v = 2e-4, F.col(value).cast("double")
    spread = F.percentile_approx(v, F.array(F.lit(max(0.0, q - near)), F.lit(min(1.0, q + near))), 10_000)
    limits = staged(df.groupBy(*keys).agg(F.struct(F.count(v).alias("n"), spread.alias("b")).alias("_l")))
    values = df.select(*keys, v.alias("_v")).filter(F.col("_v").isNotNull())
    place = F.lit(q) * (F.col("_l.n") - 1)
    if (limits.agg(F.max("_l.n")).first()[0] or 0) * 2.5 * near > RANKED:
        limits = _narrowed(values, limits, keys, place)
    rows = _bracketed(values, limits, keys)
    side = F.when(F.col("_v") < F.col("_l.b")[0], -1).when(F.col("_v") > F.col("_l.b")[1], 1).otherwise(0)
    cells = rows.groupBy(*keys, side.alias("_s"), F.when(side == 0, F.col("_v")).alias("_x")).agg(F.count("*").alias("_c"), F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.first("_l").alias("_l"))
    cells = cells.withColumn("_v", F.when(F.col("_s") == 1, F.col("_low")).otherwise(F.col("_high")))
    upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_s", "_x").rowsBetween(Window.unboundedPreceding, 0))
    at = lambda n: F.min(F.when(F.col("_u") > n, F.col("_v")))
    part = F.max(place - F.floor(place))
    found = cells.withColumn("_u", upto).groupBy(*keys).agg(((1 - part) * at(F.floor(place)) + part * at(F.ceil(place))).alias("q"))
    if not keys:
        return found
    return limits.select(*keys).join(found.withColumnsRenamed({k: f"_k_{k}" for k in keys}), _same(keys), "left").select(*keys, "q")


def _bracketed(values: DataFrame, limits: DataFrame, keys: list[str]) -> DataFrame:
    if keys:
        return values.join(limits.withColumnsRenamed({k: f"_k_{k}" for k in keys}), _same(keys)).select(*keys, "_v", "_l")
    return values.withColumn("_l", limits.select("_l").scalar())


def _narrowed(values: DataFrame, limits: DataFrame, keys: list[str], place: Column) -> DataFrame:
    """limits with brackets that hold RANKED values at most, or equal values that can't be parted."""
    before = None
    shares = [i / _STEPS for i in range(_STEPS + 1)]
    while True:
        rows = _bracketed(values, limits, keys)
        low, high = F.col("_l.b")[0], F.col("_l.b")[1]
        inside = (F.col("_v") >= low) & (F.col("_v") <= high)
        found = staged(rows.groupBy(*keys).agg(F.first("_l").alias("_l"), F.count_if(F.col("_v") < low).alias("below"), F.count_if(inside).alias("m"), F.percentile_approx(F.when(inside, F.col("_v")), shares, 10_000).alias("e")))
        held = found.agg(F.max("m").alias("most"), F.sum("m").alias("all")).first()
        if held["most"] is None or held["most"] <= RANKED or held["all"] == before:
            return limits
        before = held["all"]
        step = F.floor((place - F.col("below")) / F.greatest(F.col("m") - 1, F.lit(1)) * _STEPS).cast("int")
        bracket = F.array(F.get("e", F.greatest(step - 2, F.lit(0))), F.get("e", F.least(step + 3, F.lit(_STEPS))))
        narrow = F.when(F.col("m") > RANKED, bracket).otherwise(F.col("_l.b"))
        fresh = found.select(*keys, F.struct(F.col("_l.n").alias("n"), narrow.alias("b")).alias("_l"))
        empty = limits.filter("_l.n = 0") if keys else None  # groups without values
        limits = staged(fresh.unionByName(empty) if empty is not None else fresh)


def _same(keys: list[str]) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return on


def fit_medians(train: DataFrame, columns: list[str]) -> dict[str, float]:
    """Exact medians; a column without values gets 0."""
    cells = train.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("x.*")
    found = {r["c"]: r["q"] for r in percentiles(cells, ["c"], "v", 0.5).collect()}  # one row for each column
    return {c: 0.0 if found.get(c) is None else float(found[c]) for c in columns}


def apply_medians(df: DataFrame, medians: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(m)) for c, m in medians.items()})


def fit_scaler(train: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation (1 where it is 0) of each column, in one pass."""
    row = train.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    return {c: (float(row[f"m_{c}"] or 0.0), float(row[f"s_{c}"] or 0.0) or 1.0) for c in columns}


def apply_scaler(df: DataFrame, scaler: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - m) / s for c, (m, s) in scaler.items()})


def select_top_k(importances: DataFrame, k: int) -> DataFrame:
    """idx and importance of the k largest importances, in column order; all if k is no less than their number or all are 0."""
    w = Window.orderBy(F.desc("importance"), "idx")
    whole = importances.agg((F.count("*") <= k) | (F.max("importance") <= 0)).scalar()
    return importances.withColumn("_r", F.row_number().over(w)).filter(whole | (F.col("_r") <= k)).select("idx", "importance").orderBy("idx")


def knn_votes(train: DataFrame, test: DataFrame, k: int = 9) -> DataFrame:
    """q_id, label and w: the inverse-distance weight of each class among the k nearest; exact hits outvote all others. train: id, vec, label. test: id, vec."""
    near = nearest(test, train, k).join(train.select("id", "label"), "id")
    near = near.withColumn("_hit", F.max((F.col("d2") == 0).cast("int")).over(Window.partitionBy("q_id")))
    weight = F.when(F.col("_hit") == 1, (F.col("d2") == 0).cast("double")).otherwise(1.0 / F.sqrt("d2"))
    return near.groupBy("q_id", "label").agg(F.sum(weight).alias("w"))


def knn_predict(train: DataFrame, test: DataFrame, k: int = 9) -> DataFrame:
    """q_id and pred: the class with most weight; ties by the lower class."""
    votes = knn_votes(train, test, k)
    return votes.groupBy("q_id").agg(F.max_by("label", F.struct(F.round("w", 9), -F.col("label"))).cast("int").alias("pred"))


def knn_probabilities(train: DataFrame, test: DataFrame, k: int, classes: int) -> DataFrame:
    """q_id and prob: the share of each class 0, 1, ... in the weight."""
    held = knn_votes(train, test, k).groupBy("q_id").agg(F.sum("w").alias("_all"), *[F.coalesce(F.sum(F.when(F.col("label") == c, F.col("w"))), F.lit(0.0)).alias(f"_w{c}") for c in range(classes)])
    return held.select("q_id", F.array(*[F.col(f"_w{c}") / F.col("_all") for c in range(classes)]).alias("prob"))


def smote(df: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """New rows (label, base_id, copy, neighbour_id, u, vec) that bring each class to the size of the largest. df: id, label, vec.

    Bases come in drawn order, round and round; the neighbour and the step u come from md5 too. k is
    at most the smallest class less one; with a class under three rows nothing is made.
    """
    counts = df.groupBy("label").agg(F.count("*").alias("n"))
    sizes = {r["label"]: r["n"] for r in counts.collect()}  # one row for each class
    if not sizes or min(sizes.values()) < 3:
        return df.sparkSession.createDataFrame([], "label int, base_id long, copy int, neighbour_id long, u double, vec array<double>")
    k, most = min(k, min(sizes.values()) - 1), max(sizes.values())
    need = df.sparkSession.createDataFrame([(c, most - n, n) for c, n in sizes.items() if n < most] or [(None, 0, 1)], "label int, need int, n int")
    small = df.join(F.broadcast(need), "label")
    ranked = draw_rank(small, ["label"], "id", seed).withColumn("_r", F.col("_r") - 1)
    copies = F.floor((F.col("need") - F.col("_r") + F.col("n") - 1) / F.col("n")).cast("int")
    bases = ranked.withColumn("_m", copies).filter("_m > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)))
    coin = lambda name: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f"{seed}{name}"), F.col("id").cast("string"), F.col("copy").cast("string"))), 1, 8), 16, 10).cast("double")
    picked = bases.select(F.col("label"), F.col("id").alias("base_id"), "copy", F.col("vec").alias("_x"), (F.pmod(coin("n"), F.lit(float(k))) + 1).cast("int").alias("rank"), (coin("u") / 4294967296.0).alias("u"))
    near = nearest(small.select("id", "vec", "label"), small.select("id", "vec", "label"), k, same="label").select(F.col("q_id").alias("base_id"), F.col("id").alias("neighbour_id"), "rank")
    other = small.select(F.col("id").alias("neighbour_id"), F.col("vec").alias("_y"))
    joined = picked.join(near, ["base_id", "rank"]).join(other, "neighbour_id")
    made = F.transform(F.arrays_zip("_x", "_y"), lambda p: p["_x"] + F.col("u") * (p["_y"] - p["_x"]))
    return joined.select("label", "base_id", "copy", "neighbour_id", "u", made.alias("vec"))


def gnb_fit(train: DataFrame, columns: list[str], label: str) -> DataFrame:
    """One row for each class: prior, and means and variances (with 1e-8 of the largest variance added) as arrays."""
    spread = train.agg(F.greatest(*[F.var_pop(c) for c in columns], F.lit(0.0))).scalar()
    parts = train.groupBy(label).agg(F.count("*").alias("_n"), F.array(*[F.avg(c) for c in columns]).alias("mean"), F.array(*[F.var_pop(c) for c in columns]).alias("_v"))
    total = train.agg(F.count("*")).scalar()
    parts = parts.select(F.col(label).alias("label"), (F.col("_n") / total).alias("prior"), "mean", "_v", spread.alias("_s"))
    return parts.select("label", "prior", "mean", F.transform("_v", lambda v: v + 1e-8 * F.col("_s")).alias("var"))


def gnb_log_likelihoods(classes: list[dict], x: Column) -> list[tuple[int, Column]]:
    """(label, log likelihood of the array x) of each class, in the order given."""
    terms = []
    for c in classes:
        constant = math.log(c["prior"]) - 0.5 * sum(math.log(2 * math.pi * v) for v in c["var"])
        away = F.aggregate(F.zip_with(F.zip_with(x, F.array(*[F.lit(m) for m in c["mean"]]), lambda a, b: (a - b) * (a - b)), F.array(*[F.lit(v) for v in c["var"]]), lambda d, v: d / v), F.lit(0.0), lambda s, v: s + v)
        terms.append((c["label"], F.lit(constant) - 0.5 * away))
    return terms


def gnb_predict(model: DataFrame, df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, pred and log_likelihood of the likeliest class (ties: the lower)."""
    classes = [r.asDict() for r in model.orderBy("label").collect()]  # one row for each class
    terms = gnb_log_likelihoods(classes, F.array(*[F.col(n).cast("double") for n in columns]))
    best = df.withColumn("_b", F.array_max(F.array(*[F.struct(t.alias("ll"), F.lit(-label).alias("l")) for label, t in terms])))
    return best.select(key, (-F.col("_b.l")).cast("int").alias("pred"), F.col("_b.ll").alias("log_likelihood"))


def combine_sources(*tables: DataFrame) -> DataFrame:
    """All rows of tables with differing columns; what a table lacks is null."""
    out = tables[0]
    for other in tables[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def task_rows(df: DataFrame, target: str, source: str = "all") -> DataFrame:
    """Rows of one source (or all) that have the target, which becomes the int column `target`."""
    rows = df if source == "all" else df.filter(F.col("source") == source)
    return rows.filter(F.col(target).isNotNull()).withColumn("target", F.col(target).cast("int"))
