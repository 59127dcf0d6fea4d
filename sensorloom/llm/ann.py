"""Approximate nearest neighbours by multi-index hashing over learned rotated binary codes.

Vectors are centred, turned onto their principal axes and rotated so that signs lose least (fitted
on a bounded sample). The code of 128 bits is cut into eight substrings. Codes within a Hamming radius r
differ in at most r // 8 bits in some substring (and the first substrings or the rest may be probed
one bit less), so probing the values near each substring finds every code within r. These are
reranked on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Vectors that codes and radius are learned from.
SAMPLE = 4096
#: Rows of a block of the index and bytes of its vectors, at most, and queries that a task streams past it.
INDEX_BLOCK, INDEX_BYTES, QUERY_BLOCK = 65_536, 1 << 27, 16_384
#: Tasks of the search, at most; they take several blocks in turn.
TASKS = 20_000
BITS, PARTS = 128, 8
#: Values of a substring.
VALUES = 1 << (BITS // PARTS)


@dataclass(frozen=True)
class Coder:
    mean: np.ndarray
    turn: np.ndarray
    radius: int

    @property
    def dim(self) -> int:
        return len(self.mean)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """One row of BITS // 8 bytes for each vector."""
        return np.packbits((x - self.mean) @ self.turn > 0, axis=1)


def _words(codes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(codes).view(np.uint64)


def _parts(codes: np.ndarray) -> np.ndarray:
    """The substrings of each code."""
    return np.ascontiguousarray(codes).view(np.uint16)


def usable(vector, dim: int | None = None) -> np.ndarray | None:
    """The vector in double precision; None if it is null, zero, of another length, or holds null or non-finite values."""
    if vector is None:
        return None
    try:
        x = np.asarray(vector, dtype=np.float64)
    except (TypeError, ValueError):
        return None
    return x if x.ndim == 1 and len(x) and (dim is None or len(x) == dim) and np.isfinite(x).all() and x.any() else None


def _rotated(axes: np.ndarray, seen: np.ndarray, rounds: int, seed: int) -> np.ndarray:
    """The axes in a rotation in which the signs of the sample are near to its values."""
    rotation = np.linalg.qr(np.random.default_rng(seed).standard_normal((axes.shape[1], axes.shape[1])))[0]
    for _ in range(rounds):
        u, _, vt = np.linalg.svd(np.where(seen @ rotation > 0, 1.0, -1.0).T @ seen)
        rotation = (u @ vt).T
    return axes @ rotation


def learn(sample: np.ndarray, k: int, recall: float, rounds: int = 30, seed: int = 3) -> Coder:
    """Codes for vectors of any length, and the radius that holds a share `recall` of the sample's own neighbours.

    With fewer axes than bits, several rotations of the axes stand side by side. Neighbours in a sample
    lie further apart than those among all rows, so the radius is on the safe side.
    """
    mean = sample.mean(axis=0)
    _, axes = np.linalg.eigh(np.cov((sample - mean).T).reshape(len(mean), len(mean)))
    axes = axes[:, ::-1][:, :BITS]
    seen = (sample - mean) @ axes
    turn = np.concatenate([_rotated(axes, seen, rounds, seed + i) for i in range(-(-BITS // axes.shape[1]))], axis=1)[:, :BITS]
    coder = Coder(mean, turn, BITS)
    code = _words(coder.codes(sample))
    own = np.arange(0, len(sample), max(1, len(sample) // 256))
    near = sample[own] @ sample.T
    near[np.arange(len(own)), own] = -np.inf
    top = np.argsort(-near, axis=1, kind="stable")[:, : min(k, len(sample) - 1)]
    bits = np.bitwise_count(code[own][:, None] ^ code[top]).sum(axis=2, dtype=np.int64).ravel()
    return Coder(mean, turn, int(np.quantile(bits, recall, method="higher")) if len(bits) else BITS)


@lru_cache(maxsize=32)
def _flips(most: int) -> np.ndarray:
    """The substrings with at most `most` bits set: what a probe turns over."""
    values = np.arange(VALUES, dtype=np.uint16)
    return values[np.bitwise_count(values).astype(np.int64) <= most]


class BlockIndex:
    """Substring tables of one block of codes: for each part, where the rows of each value start among the rows in order of value.

    A probe looks up the values near its own, so the number of lookups depends on the radius, not on the rows.
    """

    def __init__(self, codes: np.ndarray):
        self.codes = _words(codes)
        self.lookups = 0
        self.tables = []
        for part in _parts(codes).T:
            start = np.concatenate([[0], np.cumsum(np.bincount(part, minlength=VALUES))])
            self.tables.append((start, np.argsort(part, kind="stable")))

    def probed(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows that have a substring near enough to that of the code."""
        most, rest = divmod(radius, PARTS)
        seen = np.zeros(len(self.codes), dtype=bool)
        for p, ((start, order), own) in enumerate(zip(self.tables, _parts(code), strict=True)):
            values = (_flips(most if p <= rest else most - 1) ^ own).astype(np.int64)
            self.lookups += len(values)
            first, size = start[values], start[values + 1] - start[values]
            before = np.cumsum(size) - size
            seen[order[np.repeat(first - before, size) + np.arange(size.sum())]] = True
        return np.nonzero(seen)[0]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Every row whose code differs from `code` in at most radius bits."""
        rows = self.probed(code, radius)
        return rows[np.bitwise_count(self.codes[rows] ^ _words(code)).sum(axis=1, dtype=np.int64) <= radius]


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """The k best places: by score, then by smaller id."""
    if len(ids) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.nonzero(scores >= edge)[0]
    else:
        keep = np.arange(len(ids))
    return keep[np.lexsort((ids[keep], -scores[keep]))][:k]


def search(vectors: DataFrame, every: int = 20, k: int = 20, recall: float = 0.95) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest rows found for each query, by largest inner product.

    Queries are the rows whose vec_id divides by `every`; candidates are all rows with another
    vec_id. Vectors that are null, zero, of another length than most of the sample, or that hold
    null or non-finite values take no part, nor do rows without vec_id. Rows that repeat a vec_id
    count each; as queries they are answered together. A block of the index with too few codes within the radius for k rows widens the
    radius until it has k or all its rows. An empty table gives no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    picked = [x for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect() if (x := usable(r["embedding"])) is not None]
    out = "query_id long, rank int, vec_id long, score double"
    if not picked:
        return spark.createDataFrame([], out)
    dims = [len(x) for x in picked]
    dim = max(sorted(set(dims)), key=dims.count)
    coder = learn(np.stack([x for x in picked if len(x) == dim]), k, recall) if dims.count(dim) > 1 else Coder(np.zeros(dim), np.zeros((dim, BITS)), BITS)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [(i, x) for i, v in zip(pdf["vec_id"], pdf["embedding"], strict=True) if (x := usable(v, dim)) is not None]
            if found:
                x = np.stack([v for _, v in found])
                yield pd.DataFrame({"vec_id": [i for i, _ in found], "embedding": list(x), "code": [c.tobytes() for c in coder.codes(x)]})

    # Rows and queries are dealt by their place in the written index, so rows that repeat are spread, too.
    index = staged(rows.mapInPandas(encode, "vec_id long, embedding array<double>, code binary").withColumn("place", F.monotonically_increasing_id()))
    queries = index.filter(F.col("vec_id") % every == 0)
    n_rows, n_queries = index.count(), queries.count()
    blocks = max(1, -(-n_rows // max(1, min(INDEX_BLOCK, INDEX_BYTES // (8 * dim)))))
    parts = max(1, -(-n_queries // QUERY_BLOCK), -(-spark.sparkContext.defaultParallelism // blocks))
    dealt = lambda n, salt: F.pmod(F.xxhash64("place", F.lit(salt)), F.lit(n)).cast("int")
    every_one = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = index.withColumn("b", dealt(blocks, 1)).withColumn("q", every_one(parts)).withColumn("asks", F.lit(False))
    asked = queries.withColumn("q", dealt(parts, 2)).withColumn("b", every_one(blocks)).withColumn("asks", F.lit(True))
    columns = ["b", "q", "asks", "vec_id", "embedding", "code"]
    tasks = min(TASKS, blocks * parts)
    met = held.select(*columns).union(asked.select(*columns))
    met = met.repartitionById(tasks, F.pmod(F.col("b").cast("long") * parts + F.col("q"), F.lit(tasks)).cast("int")).sortWithinPartitions("b", "q", "asks")

    def answers(block: tuple, asked: pd.DataFrame) -> pd.DataFrame:
        ids, x, tables = block
        found = []
        for query, vector, code in zip(asked["vec_id"], asked["embedding"], asked["code"], strict=True):
            radius, others = coder.radius, int((ids != query).sum())
            while True:
                near = tables.within(np.frombuffer(code, dtype=np.uint8), radius)
                near = near[ids[near] != query]
                if len(near) >= min(k, others):
                    break
                radius += 4
            # The same sum in the same order for equal vectors, so that ties are ties.
            scores = np.einsum("ij,j->i", x[near], vector, optimize=False)
            top = _best(ids[near], scores, k)
            found.append(pd.DataFrame({"query_id": query, "vec_id": ids[near][top], "score": scores[top]}))
        return pd.concat(found)

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows of a block come before its queries: its tables are built once, then the queries stream past."""
        place, rows, block = None, [], None
        for pdf in batches:
            for (b, q, asks), part in pdf.groupby(["b", "q", "asks"]):
                if (b, q) != place:
                    place, rows, block = (b, q), [], None
                if not asks:
                    rows.append((part["vec_id"].to_numpy(), np.stack(part["embedding"].to_numpy()), b"".join(part["code"])))
                    continue
                if block is None and rows:
                    ids, x, codes = zip(*rows, strict=True)
                    rows = []
                    block = np.concatenate(ids), np.concatenate(x), BlockIndex(np.frombuffer(b"".join(codes), dtype=np.uint8).reshape(-1, BITS // 8))
                if block is not None:
                    yield answers(block, part)

    near = met.mapInPandas(probe, "query_id long, vec_id long, score double")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", best).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
