"""Exact nearest neighbours by metric partitioning.

A bounded sample of rows gives pivots. Rows belong to the cell of their nearest pivot, and cells are cut
into blocks of bounded size by distance to the pivot. The triangle inequality bounds how near a block
can be to a query, so a query first meets the blocks that look nearest and then, in a second round,
those that its k-th distance still leaves open.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import staged

#: Rows in a block and queries that meet it at once, pivots, and blocks beyond which blocks grow instead.
BLOCK, MAX_PIVOTS, MAX_BLOCKS = 4096, 256, 100_000
#: Blocks grow up to WIDER times beyond SHARES of them, as long as they hold VALUES at most: a query that leaves all open is sent to fewer.
SHARES, WIDER, VALUES = 32, 8, 2**21
#: Queries and rows multiplied at once, and pairs measured exactly at once.
_QUERIES, _ROWS, _PAIRS = 512, 2048, 65_536
#: Shares of a cell at which rings may begin.
_RINGS = 64


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All squared distances by a matrix product: near, not exact."""
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ y.T + (y**2).sum(1), 0)


@dataclass(frozen=True)
class Blocks:
    """Pivots, and for each block its class, pivot, nearest and farthest row from it, and rows."""

    pivots: np.ndarray
    group: np.ndarray
    pivot: np.ndarray
    low: np.ndarray
    high: np.ndarray
    size: np.ndarray

    def bounds(self, x: np.ndarray, mine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How near the nearest row of each block can be to a query, and how far the farthest; with room for rounding."""
        d = np.sqrt(squared(x, self.pivots))
        room = 1e-7 * (1 + d.max(initial=0.0) + self.high.max(initial=0.0))
        to = d[:, self.pivot[mine]]
        return np.maximum(np.maximum(to - self.high[mine], self.low[mine] - to), 0) - room, to + self.high[mine] + room

    def first(self, low: np.ndarray, high: np.ndarray, mine: np.ndarray, enough: int) -> np.ndarray:
        """The blocks that a query meets first: the nearest by bound, until they hold enough rows."""
        order = np.lexsort((high, low))
        upto = int(np.searchsorted(np.cumsum(self.size[mine][order]), enough)) + 1
        return order[:upto]


def _vectors(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64).reshape(len(column), -1)


def closest(x: np.ndarray, y: np.ndarray, k: int, place: np.ndarray, edge: np.ndarray, names: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in x and y, and squared distance, of the k nearest rows y of each query x within its edge (squared too), ties by `place`.

    names: numbers that name queries and rows; a query doesn't find rows of its own name. Products in single precision, where the values allow it,
    leave out what is farther than k rows even if all rounding went one way; what stays is measured exactly.
    """
    xx, yy = (x**2).sum(1), (y**2).sum(1)
    largest = np.sqrt(yy.max(initial=0.0))
    kind = np.float32 if max(largest, np.sqrt(xx.max(initial=0.0))) < 1e15 else np.float64
    room = (x.shape[1] + 8) * np.finfo(kind).eps * (np.sqrt(xx) + largest) ** 2 + 1e-36
    a, b = np.c_[x, np.ones(len(x))].astype(kind), np.c_[2 * y, -yy].astype(kind)
    edge, need = edge.astype(np.float64), k + (int(np.bincount(names[1]).max(initial=0)) if names else 0)
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for at in range(0, len(x), _QUERIES):
        part = slice(at, min(at + _QUERIES, len(x)))
        kept, fresh, waiting = out[0], [], 0
        for start in range(0, len(y), _ROWS):
            near = a[part] @ b[start : start + _ROWS].T  # the square of x less that of the distance
            open_ = at + np.flatnonzero(np.isinf(edge[part]))
            if len(open_) and near.shape[1] >= need:
                edge[open_] = xx[open_] + room[open_] - np.partition(near[open_ - at], near.shape[1] - need, axis=1)[:, near.shape[1] - need]
            hits = np.flatnonzero(near >= (xx - edge - room)[part].astype(kind)[:, None])
            for h in range(0, len(hits), _PAIRS):
                q, i = np.divmod(hits[h : h + _PAIRS], near.shape[1])
                q, i = at + q, start + i
                exact = ((y[i] - x[q]) ** 2).sum(1)
                good = (exact <= edge[q]) & np.isfinite(exact)
                if names:
                    good &= names[0][q] != names[1][i]
                fresh.append((q[good], i[good], exact[good]))
                waiting += int(good.sum())
                if waiting > k * _QUERIES:
                    kept, fresh, waiting = _merged(kept, fresh, k, place, edge), [], 0
        out.append(_merged(kept, fresh, k, place, edge))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _merged(kept: tuple, fresh: list, k: int, place: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of each query among those kept and fresh ones, in order; edge moves to the k-th."""
    q, i, exact = (np.concatenate(c) for c in zip(kept, *fresh, strict=True))
    order = np.lexsort((place[i], exact, q))
    q, i, exact = q[order], i[order], exact[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    last = rank == k - 1
    edge[q[last]] = exact[last]
    return q[rank < k], i[rank < k], exact[rank < k]


def _placed(rows: DataFrame, total: int, size: int) -> tuple[DataFrame, Blocks]:
    """Rows with their block, written once, and the blocks. rows: id, vec, _c."""
    spark = rows.sparkSession
    count = min(MAX_PIVOTS, math.ceil(total / size))
    if count == 1:
        known = {r["_c"]: r["n"] for r in rows.groupBy("_c").agg(F.count("*").alias("n")).collect()}  # one row for each class, of one block of rows
        groups = sorted(known, key=str)
        place = F.array_position(F.array(*[F.lit(g) for g in groups]), F.col("_c")) - 1
        n = len(groups)
        width = rows.select(F.max(F.size("vec"))).first()[0]
        return rows.withColumn("block", place.cast("int")), Blocks(np.zeros((1, width)), np.array(groups), np.zeros(n, int), np.zeros(n), np.full(n, np.inf), np.array([known[g] for g in groups]))
    sample = rows.orderBy(F.xxhash64("id"), "id").select("vec").limit(count).toPandas()  # at most MAX_PIVOTS rows
    shared = spark.sparkContext.broadcast(_vectors(sample["vec"]))

    @F.pandas_udf("cell int, dist double")
    def cell(vec: pd.Series) -> pd.DataFrame:
        d = squared(_vectors(vec), shared.value)
        best = d.argmin(axis=1)
        return pd.DataFrame({"cell": best, "dist": np.sqrt(d[np.arange(len(d)), best])})

    dealt = staged(rows.withColumn("_p", cell("vec")).select("id", "vec", "_c", "_p.cell", "_p.dist"))
    shares = [i / _RINGS for i in range(1, _RINGS)]
    cells = staged(dealt.groupBy("_c", "cell").agg(F.percentile_approx("dist", shares, 10_000).alias("e"), F.count("*").alias("n")))  # once: the shares may differ from run to run
    rings = F.least(F.lit(_RINGS), F.ceil(F.col("n") / size)).cast("int")
    edges = F.when(rings > 1, F.transform(F.sequence(F.lit(1), rings - 1), lambda i: F.get("e", F.floor(i * _RINGS / rings).cast("int") - 1))).otherwise(F.array().cast("array<double>"))
    ringed = dealt.join(F.broadcast(cells.select("_c", "cell", edges.alias("edges"))), ["_c", "cell"])  # a row for each class and pivot
    ringed = ringed.withColumn("ring", F.size(F.filter("edges", lambda e: e < F.col("dist")))).drop("edges")
    held = ringed.groupBy("_c", "cell", "ring").agg(F.count("*").alias("n"), F.min("dist").alias("low"), F.max("dist").alias("high")).toPandas()  # at most 64 for each class and pivot
    parts = np.ceil(held["n"] / size).astype(int)
    begin = np.cumsum(parts) - parts
    table = spark.createDataFrame(held[["_c", "cell", "ring"]].assign(begin=begin, parts=parts))
    out = ringed.join(F.broadcast(table), ["_c", "cell", "ring"]).select("id", "vec", "_c", (F.col("begin") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int").alias("block"))
    every = np.repeat(np.arange(len(held)), parts)
    take = lambda c: held[c].to_numpy()[every]
    return out, Blocks(shared.value, take("_c"), take("cell"), take("low"), take("high"), np.ceil(take("n") / parts.to_numpy()[every]).astype(int))


def _visits(queries: DataFrame, blocks: Blocks, k: int, again: bool) -> DataFrame:
    """Queries with each block that they meet in a round. queries: q_id, q_vec, _c and reach, null where k rows aren't known."""
    shared = queries.sparkSession.sparkContext.broadcast(blocks)  # at most MAX_PIVOTS pivots and about MAX_BLOCKS blocks

    @F.pandas_udf("array<int>")
    def met(vec: pd.Series, group: pd.Series, reach: pd.Series) -> pd.Series:
        held, out = shared.value, [[]] * len(vec)
        for g, places in group.groupby(group).indices.items():
            mine = np.flatnonzero(held.group == g)
            for at in range(0, len(places) if len(mine) else 0, 64):
                few = places[at : at + 64]
                low, high = held.bounds(_vectors(vec.iloc[few]), mine)
                for n, i in enumerate(few):
                    first = held.first(low[n], high[n], mine, k + 1)
                    if again:
                        open_ = low[n] <= (np.inf if pd.isna(reach.iloc[i]) else reach.iloc[i])
                        open_[first] = False
                        out[i] = mine[np.flatnonzero(open_)].astype(np.int32)
                    else:
                        out[i] = mine[first].astype(np.int32)
        return pd.Series(out, dtype=object)

    return queries.select("q_id", "q_vec", "reach", F.explode(met("q_vec", "_c", "reach")).alias("block"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _measured(visits: DataFrame, rows: DataFrame, k: int, apart: bool, size: int) -> DataFrame:
    """q_id, id and d2 of the nearest, k at most and within reach, of each query in each block that it meets; block by block, for a part of the queries each."""
    met = F.broadcast(staged(visits.groupBy("block").agg(F.ceil(F.count("*") / size).cast("int").alias("_n"))))  # a row for each block
    q = visits.join(met, "block").withColumn("_q", F.pmod(F.xxhash64("q_id"), F.col("_n")).cast("int")).drop("_n")
    r = rows.join(met, "block").select("id", "vec", "block", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_q"))

    def near(a: pa.Table, b: pa.Table) -> pa.Table:
        asked, ids, exact = a["q_id"][:0], b["id"][:0], np.zeros(0)
        if len(a) and len(b):
            x, y = _matrix(a["q_vec"]), _matrix(b["vec"])
            with np.errstate(over="ignore", invalid="ignore"):
                good, known = (np.flatnonzero(np.isfinite((v**2).sum(1))) for v in (x, y))  # others are near nothing
            asked, ids, reach = a["q_id"].take(good), b["id"].take(known), a["reach"].to_numpy()[good]
            place = np.empty(len(ids), dtype=np.int64)
            place[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
            edge = np.where(np.isnan(reach), np.inf, reach) ** 2 * (1 + 1e-9)
            names = np.split(pd.factorize(np.concatenate([asked.to_numpy(), ids.to_numpy()]))[0], [len(asked)]) if apart else None
            q, i, exact = closest(x[good], y[known], k, place, edge, names)
            asked, ids = asked.take(q), ids.take(i)
        return pa.table({"q_id": asked, "id": ids, "d2": exact})

    kinds = f"q_id {visits.schema['q_id'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, d2 double"
    return q.groupBy("block", "_q").cogroup(r.groupBy("block", "_q")).applyInArrow(near, kinds)


def nearest(queries: DataFrame, rows: DataFrame, k: int, same: str | None = None) -> DataFrame:
    """q_id, rank, id, d2 of the k nearest rows of each query, ties by id. Both: id, vec array<double>, and `same` where only rows of an equal value count.

    A row isn't its own neighbour where `same` is set. Exact: a block is left out only if none of its
    rows can be as near as the k-th row found. Data that point everywhere leave all blocks open.
    """
    known = rows.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("width")).first()
    total = known["n"]
    wider = max(BLOCK, min(math.ceil(total / SHARES), WIDER * BLOCK, VALUES // max(1, known["width"] or 1)))
    size = max(wider, math.ceil(total / MAX_BLOCKS))
    tag = F.col(same).cast("string") if same else F.lit("")
    placed, blocks = _placed(rows.select("id", "vec", tag.alias("_c")).filter("_c is not null"), total, size) if total else (rows.withColumn("block", F.lit(0)), None)
    asked = queries.select(F.col("id").alias("q_id"), F.col("vec").alias("q_vec"), tag.alias("_c"), F.lit(None).cast("double").alias("reach"))
    if blocks is None:
        blocks = Blocks(np.zeros((1, 1)), np.array([]), *[np.array([], dtype=int)] * 4)
    best = Window.partitionBy("q_id").orderBy("d2", "id")
    found = _measured(_visits(asked, blocks, k, again=False), placed, k, same is not None, size)
    found = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    if len(blocks.size) > len(set(blocks.group)):
        found = staged(found)
        reach = found.filter(F.col("rank") == k).select("q_id", F.sqrt("d2").alias("reach"))
        later = _visits(asked.drop("reach").join(reach, "q_id", "left"), blocks, k, again=True)
        found = found.drop("rank").unionByName(_measured(later, placed, k, same is not None, size))
        found = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return found.select("q_id", "id", "d2", "rank")
