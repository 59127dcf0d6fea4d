"""Language of a text by hierarchical discrimination: first the family, then one-versus-one linear
support vector machines between the languages of the family. Families meet one versus one as well.

Features are hashed byte trigrams of the lower-cased letters of the whole text, the root of their
counts at length 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Families of languages. A language that isn't listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"),
    "romance": ("fr", "es", "pt", "it", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk"),
    "baltic": ("lt", "lv"),
    "uralic": ("fi", "et", "hu"),
    "indic": ("hi", "mr", "ne", "bn", "ur", "pa", "gu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "semitic": ("ar", "he", "mt"),
}
#: Buckets of trigrams, as a power of two; one column behind them is 1.
BUCKET_BITS = 12
#: Most labelled texts that a fit takes, dealt evenly to languages, and most languages, those with the most rows.
MAX_TRAIN, MAX_LANGUAGES = 2000, 64
UNKNOWN = "und"
_LETTERS = "\\p{L}"
#: Bytes that keep their value; others are a space.
_KEPT = np.full(256, 32, dtype=np.uint8)
_KEPT[97:123] = np.arange(97, 123)
_KEPT[128:] = np.arange(128, 256)
_PART = 1 << 20  # bytes of a long text that are counted at once


def family(lang: str) -> str:
    return next((name for name, langs in FAMILIES.items() if lang in langs), lang)


def trigrams(text: str | None) -> np.ndarray:
    """Counts of the trigrams of a whole text by bucket, taken part by part; spaces alone don't count."""
    raw = np.frombuffer((text or "").lower().encode("utf-8", "replace"), dtype=np.uint8)
    total = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
    for at in range(0, max(0, len(raw) - 2), _PART):
        a = _KEPT[raw[at : at + _PART + 2]].astype(np.uint32)
        code = a[:-2] | a[1:-1] << 8 | a[2:] << 16
        code = code[code != 0x202020]
        total += np.bincount((code * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS), minlength=len(total))
    return total


def vectors(texts: list) -> np.ndarray:
    out = np.zeros((len(texts), (1 << BUCKET_BITS) + 1), dtype=np.float32)
    for i, t in enumerate(texts):
        counts = trigrams(t)
        out[i, :-1] = np.sqrt(counts / max(1, counts.sum()))
    out[:, -1] = 1.0
    return out


def fit_machine(x: np.ndarray, positive: np.ndarray, cost: float = 10.0, rounds: int = 20, seed: int = 11) -> np.ndarray:
    """Weights of a linear support vector machine with squared hinge loss, by dual coordinate descent; deterministic."""
    rng = np.random.default_rng(seed)
    sign = np.where(positive, 1.0, -1.0)
    slack = 0.5 / cost
    norms = (x.astype(np.float64) ** 2).sum(axis=1) + slack
    w, alpha = np.zeros(x.shape[1]), np.zeros(len(x))
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(x)):
            gradient = sign[i] * float(x[i] @ w) - 1 + slack * alpha[i]
            new = max(0.0, alpha[i] - gradient / norms[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * sign[i] * x[i]
                moved, alpha[i] = max(moved, abs(new - alpha[i])), new
        if moved < 1e-3:
            break
    return w


@dataclass(frozen=True)
class Machines:
    """Machines between all pairs of some classes: those for the first of a pair are positive."""

    classes: tuple[str, ...]
    weights: np.ndarray  # a row for each pair

    def decide(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The class with most wins (ties: largest sum of margins, then first) and its least likely win, as a logistic of the margin."""
        n = len(self.classes)
        if n == 1:
            return np.zeros(len(x), dtype=int), np.ones(len(x))
        margins = x @ self.weights.T.astype(np.float32)
        wins, sums, least = np.zeros((len(x), n)), np.zeros((len(x), n)), np.full((len(x), n), np.inf)
        for p, (a, b) in enumerate(combinations(range(n), 2)):
            m = margins[:, p]
            wins[:, a] += m > 0
            wins[:, b] += m <= 0
            for c, own in ((a, m), (b, -m)):
                sums[:, c] += own
                least[:, c] = np.minimum(least[:, c], own)
        best = np.where(wins == wins.max(axis=1, keepdims=True), sums, -np.inf).argmax(axis=1)
        return best, 1 / (1 + np.exp(-np.clip(4 * least[np.arange(len(x)), best], -30, 30)))


def fit_pairs(x: np.ndarray, labels: np.ndarray) -> Machines:
    classes = tuple(sorted(set(labels)))
    rows = [np.isin(labels, pair) for pair in combinations(classes, 2)]
    weights = [fit_machine(x[r], labels[r] == a) for r, (a, _) in zip(rows, combinations(classes, 2), strict=True)]
    return Machines(classes, np.array(weights) if weights else np.zeros((0, x.shape[1])))


@dataclass(frozen=True)
class Hierarchy:
    """Machines between families and, for each family, between its languages. Without classes nothing was learned."""

    families: Machines
    languages: dict[str, Machines]

    def predict(self, texts: list) -> list[tuple[str, float]]:
        out = []
        for at in range(0, len(texts), 256):
            x = vectors(texts[at : at + 256])
            chosen, sure = self.families.decide(x)
            lang, inner = np.empty(len(x), dtype=object), np.ones(len(x))
            for f, name in enumerate(self.families.classes):
                rows = np.flatnonzero(chosen == f)
                if len(rows):
                    best, share = self.languages[name].decide(x[rows])
                    lang[rows], inner[rows] = np.array(self.languages[name].classes, dtype=object)[best], share
            out += list(zip(lang.tolist(), (sure * inner).tolist(), strict=True))
        return out


def held_out(doc_id: Column) -> Column:
    """True for rows that no language may be learned from; null ids are not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, max_train: int = MAX_TRAIN, max_languages: int = MAX_LANGUAGES) -> Hierarchy:
    """Fit on at most max_train different texts that have a language and letters and aren't held out.

    Each language gives its share of them, those with the smallest hash of the text. Counts of at
    most max_languages languages and the features of the sample reach the driver.
    """
    rows = docs.filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").rlike(_LETTERS))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages).collect()}
    if not counts:
        return Hierarchy(Machines((), np.zeros((0, 0))), {})
    quota = max(1, max_train // len(counts))
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 40)) / float(1 << 40)
    shares = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, 1.5 * quota / n)])
    few = rows.select("lang", "text", place.alias("place")).filter(F.col("place") < F.try_element_at(shares, F.col("lang"))).dropDuplicates(["lang", "place"])

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [trigrams(t) for t in pdf["text"]]
            yield pd.DataFrame({"lang": pdf["lang"], "place": pdf["place"], "cols": [np.flatnonzero(f).astype(np.int32) for f in found], "counts": [f[f > 0] for f in found]})

    sample = few.mapInPandas(extract, "lang string, place double, cols array<int>, counts array<long>").orderBy("place", "lang").limit(2 * max_train).toPandas()
    sample = sample.groupby("lang", sort=True).head(quota)
    x = np.zeros((len(sample), (1 << BUCKET_BITS) + 1), dtype=np.float32)
    x[:, -1] = 1.0
    for i, (cols, n) in enumerate(zip(sample["cols"], sample["counts"], strict=True)):
        x[i, np.asarray(cols, dtype=np.int64)] = np.sqrt(np.asarray(n) / max(1, sum(n)))
    langs = sample["lang"].to_numpy()
    kin = np.array([family(v) for v in langs])
    return Hierarchy(fit_pairs(x, kin), {f: fit_pairs(x[kin == f], langs[kin == f]) for f in sorted(set(kin))})


def identify(docs: DataFrame, model: Hierarchy) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row.

    `und` at score 0 where the text is null or has no letter, or where nothing was learned. A single
    language that was learned is always predicted, at score 1. Rows that repeat are judged each, ids
    that are null pass through, and empty tables give no rows. lang and source aren't read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 32 KB for each pair of languages or families, of at most MAX_LANGUAGES

    @F.pandas_udf("lang string, score double")
    def judged(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(shared.value.predict(text.tolist()), columns=["lang", "score"])

    known = F.coalesce(F.col("text").rlike(_LETTERS), F.lit(False)) & F.lit(bool(model.families.classes))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), known.alias("known"), F.when(known, F.col("text")).alias("text"))
    if not model.families.classes:
        return rows.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    found = rows.select("doc_id", "held_out", "known", judged("text").alias("f"))
    return found.select("doc_id", "held_out", F.when(F.col("known"), F.col("f.lang")).otherwise(UNKNOWN).alias("lang_pred"), F.when(F.col("known"), F.col("f.score")).otherwise(0.0).alias("score"))
