"""Quality classifier: a factorisation machine over hashed words, structure statistics and text metadata.

score = sigmoid(b + w.x + 0.5 * sum_f((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)), in time linear in
the features of a text.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import whole_text

#: Hash buckets of words; the structure statistics have columns of their own behind them.
BUCKETS = 1 << 14
STRUCTURE = ("bias", "log_words", "word_chars", "symbols", "capitals", "digits", "ends", "same_lines", "same_words", "high_bytes", "line_words", "n_chars")
FACTORS = 8
#: Most labelled rows that a fit takes, those with the smallest hash of their id.
MAX_TRAIN = 4000
_KEYS: dict[bytes, int] = {}


@dataclass(frozen=True)
class Machine:
    """A fitted machine: bias, linear weights and factors, all of fixed size."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def scores(self, index: list[np.ndarray], value: list[np.ndarray]) -> np.ndarray:
        """The scores of several texts at once; each has a column at least."""
        if not index:
            return np.zeros(0)
        cols, x = np.concatenate(index), np.concatenate(value)
        starts = np.cumsum([0] + [len(i) for i in index[:-1]])
        part = self.factors[cols] * x[:, None]
        pairs = 0.5 * (np.add.reduceat(part, starts, axis=0) ** 2 - np.add.reduceat(part**2, starts, axis=0)).sum(axis=1)
        return 1.0 / (1.0 + np.exp(-np.clip(self.bias + np.add.reduceat(self.linear[cols] * x, starts) + pairs, -30, 30)))

    def score(self, index: np.ndarray, value: np.ndarray) -> float:
        return float(self.scores([index], [value])[0])


def features(text: str | None, n_chars: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Columns and values of a whole text and its recorded length: words weigh 1 in norm together, the others lie in about -1 to 2."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    counts = Counter(words)
    hashed: dict[int, float] = {}
    if len(_KEYS) > 200_000:  # a cache only
        _KEYS.clear()
    for word, n in counts.items():
        key = _KEYS.get(word)
        if key is None:
            key = _KEYS[word] = zlib.crc32(word.lower()) % BUCKETS
        hashed[key] = hashed.get(key, 0.0) + n
    index = np.fromiter(hashed.keys(), dtype=np.int64, count=len(hashed))
    value = np.sqrt(np.fromiter(hashed.values(), dtype=np.float64, count=len(hashed)))
    if len(value):
        value /= np.sqrt((value**2).sum())
    n = max(1, len(words))
    size = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    chars = max(1, int(size[33:].sum()))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    share = np.array(
        [
            1.0,
            np.log1p(len(words)) / 5 - 1,
            chars / n / 6 - 1,
            4 * sum(int(size[b]) for b in b"#*$%&|<>!") / chars,
            2 * int(size[65:91].sum()) / chars,
            4 * int(size[48:58].sum()) / chars,
            4 * sum(int(size[b]) for b in b".,;:?") / chars - 0.2,
            1 - len(set(lines)) / max(1, len(lines)),
            1 - len(counts) / n,
            int(size[128:].sum()) / chars,
            np.log1p(n / max(1, len(lines))) / 4 - 1,
            0.0 if n_chars is None or not n_chars >= 0 else np.log1p(n_chars) / 6 - 1,
        ]
    )
    return np.concatenate([index, BUCKETS + np.arange(len(share))]), np.concatenate([value, np.clip(share, -1, 2)])


def fit(index: list[np.ndarray], value: list[np.ndarray], label: np.ndarray, epochs: int = 12, rate: float = 0.05, decay: float = 1e-4, seed: int = 7) -> Machine:
    """Logistic loss by Adagrad over small batches; deterministic."""
    rng = np.random.default_rng(seed)
    width = BUCKETS + len(STRUCTURE)
    linear, factors, bias = np.zeros(width), rng.normal(0, 0.02, (width, FACTORS)), 0.0
    g_linear, g_factors, g_bias = np.full(width, 1e-2), np.full((width, FACTORS), 1e-2), 1e-2
    if len(label) == 0:
        return Machine(0.0, linear, np.zeros_like(factors))
    for _ in range(epochs):
        order = rng.permutation(len(label))
        for at in range(0, len(order), 64):
            rows = order[at : at + 64]
            cols = np.concatenate([index[r] for r in rows])
            x = np.concatenate([value[r] for r in rows])
            starts = np.cumsum([0] + [len(index[r]) for r in rows[:-1]])
            owner = np.repeat(np.arange(len(rows)), [len(index[r]) for r in rows])
            part = factors[cols] * x[:, None]
            total = np.add.reduceat(part, starts, axis=0)
            z = bias + np.add.reduceat(linear[cols] * x, starts) + 0.5 * (total**2 - np.add.reduceat(part**2, starts, axis=0)).sum(axis=1)
            error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[rows]
            unique, place = np.unique(cols, return_inverse=True)
            d_linear = np.bincount(place, error[owner] * x, len(unique)) / len(rows) + decay * linear[unique]
            grad = error[owner][:, None] * x[:, None] * (total[owner] - part)
            d_factors = np.stack([np.bincount(place, grad[:, f], len(unique)) for f in range(FACTORS)], axis=1) / len(rows) + decay * factors[unique]
            g_linear[unique] += d_linear**2
            g_factors[unique] += d_factors**2
            g_bias += error.mean() ** 2
            linear[unique] -= rate * d_linear / np.sqrt(g_linear[unique])
            factors[unique] -= rate * d_factors / np.sqrt(g_factors[unique])
            bias -= rate * error.mean() / np.sqrt(g_bias)
    return Machine(float(bias), linear, factors)


def held_out(doc_id: Column) -> Column:
    """True for rows that no label may be learned from; null ids are not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1, F.lit(False))


def _with_length(docs: DataFrame) -> Column:
    """The recorded length, null where the table has none."""
    return F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Machine:
    """Fit on at most max_train labelled documents that aren't held out, taken by the hash of their id.

    Of rows that repeat an id the one whose text has the least hash is taken, map-side. Only the
    features of the sample reach the driver. Labels that are null, rows without a document, and ids
    that are null are left out; an id with several labels counts by the largest. Without rows every
    score is 0.5.
    """
    chosen = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_train)
    )

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [features(t, n) for t, n in zip(pdf["text"], pdf["size"], strict=True)]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "quality": pdf["quality"], "cols": [f[0] for f in found], "vals": [f[1] for f in found]})

    picked = docs.select("doc_id", "text", _with_length(docs).alias("size")).join(F.broadcast(chosen), "doc_id")  # at most max_train ids
    least = F.min_by(F.struct("text", "size"), F.struct(F.xxhash64("text"), "size")).alias("d")
    single = picked.groupBy("doc_id").agg(F.first("quality").alias("quality"), least).select("doc_id", "quality", "d.*")
    rows = single.mapInPandas(extract, "doc_id long, quality int, cols array<int>, vals array<double>").toPandas().sort_values("doc_id", kind="stable")
    return fit([np.asarray(c, dtype=np.int64) for c in rows["cols"]], [np.asarray(v, dtype=np.float64) for v in rows["vals"]], rows["quality"].to_numpy(dtype=np.float64))


def score_column(machine: Machine, docs: DataFrame) -> Column:
    """The score of whole texts of docs; null and empty texts get the score of their structure alone."""
    shared = docs.sparkSession.sparkContext.broadcast((machine.bias, machine.linear.astype(np.float32), machine.factors.astype(np.float32)))  # about 0.6 MB, whatever the input

    @F.pandas_udf(T.DoubleType())
    def score(text: pd.Series, size: pd.Series) -> pd.Series:
        bias, linear, factors = shared.value
        model, out = Machine(bias, linear, factors), [np.zeros(0)]
        for at in range(0, len(text), 128):
            found = [features(t, n) for t, n in zip(text[at : at + 128], size[at : at + 128], strict=True)]
            out.append(model.scores([f[0] for f in found], [f[1] for f in found]))
        return pd.Series(np.concatenate(out), dtype="float64")

    return score(whole_text(F.col("text")), _with_length(docs))


def classify(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; rows that repeat are scored each, and an empty table gives none."""
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_column(machine, docs).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accepted(docs: DataFrame, machine: Machine) -> DataFrame:
    """The documents that the machine accepts, with all their columns."""
    return docs.filter(score_column(machine, docs) >= 0.5)
