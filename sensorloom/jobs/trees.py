"""Trees grown level by level: extra trees, class-balanced forests and joint boosting.

In each level a task routes its rows through the trees so far and sums what the open nodes need, by
numpy over Arrow batches. The sums of a node meet in one task, which picks its split, and only splits
reach the driver. A model has at most trees * 2^(depth + 1) nodes, whatever the rows. All draws are
hashes of a seed with the row's id or the node's path, so partitions don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import discard, staged

#: Rows in a partition of a training set, and trees that a task handles at once.
PART_ROWS, TREE_CHUNK = 20_000, 32
#: Bins of a feature where splits are searched, not drawn.
BINS = 64
#: Rounds of boosting between two writes of the scores so far.
STAGE_ROUNDS = 25
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A hash of 64 bits to 64 bits (splitmix)."""
    with np.errstate(over="ignore"):
        x = np.asarray(x, dtype=np.uint64) + _ODD
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def uniform(x: np.ndarray) -> np.ndarray:
    return (mixed(x) >> np.uint64(11)).astype(np.float64) / float(1 << 53)


@dataclass
class Trees:
    """All nodes of all trees in flat arrays. A node without a feature (-1) is a leaf; the right child follows the left."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray

    @classmethod
    def planted(cls, trees: int, width: int) -> Trees:
        return cls(np.arange(trees, dtype=np.int32), np.full(trees, -1, np.int32), np.zeros(trees), np.full(trees, -1, np.int32), np.zeros((trees, width)))

    def split(self, nodes: np.ndarray, feature: np.ndarray, threshold: np.ndarray) -> np.ndarray:
        """Give nodes two children each; returns the left ones."""
        first = len(self.feature) + 2 * np.arange(len(nodes), dtype=np.int32)
        self.feature[nodes], self.threshold[nodes], self.left[nodes] = feature, threshold, first
        more = 2 * len(nodes)
        self.feature = np.append(self.feature, np.full(more, -1, np.int32))
        self.threshold = np.append(self.threshold, np.zeros(more))
        self.left = np.append(self.left, np.full(more, -1, np.int32))
        self.value = np.vstack([self.value, np.zeros((more, self.value.shape[1]))])
        return first

    def leaves(self, x: np.ndarray, roots: np.ndarray) -> np.ndarray:
        """The node that each row reaches in each tree."""
        at = np.broadcast_to(roots, (len(x), len(roots))).copy()
        rows = np.arange(len(x))[:, None]
        while True:
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                return at
            right = x[rows, np.maximum(f, 0)] > self.threshold[at]
            at = np.where(inner, self.left[at] + right, at)

    def frame(self, spark: SparkSession) -> DataFrame:
        roots = np.isin(np.arange(len(self.feature)), self.roots)
        return spark.createDataFrame(pd.DataFrame({"node": np.arange(len(self.feature)), "root": roots, "feature": self.feature, "threshold": self.threshold, "left": self.left, "value": list(self.value.tolist())}))

    @classmethod
    def read(cls, df: DataFrame) -> Trees:
        t = df.orderBy("node").toPandas()  # bounded by trees and depth
        return cls(t.loc[t["root"], "node"].to_numpy(np.int32), t["feature"].to_numpy(np.int32), t["threshold"].to_numpy(), t["left"].to_numpy(np.int32), np.array(t["value"].tolist()).reshape(len(t), -1))


@dataclass
class Level:
    """What tasks need for one level: the trees so far, the open nodes, and what to sum."""

    trees: Trees
    open_: np.ndarray  # node of each slot
    drawn: np.ndarray  # features of each slot
    kind: str  # range, count or bins
    cuts: np.ndarray | None = None  # count: a threshold for each slot and drawn feature
    edges: np.ndarray | None = None  # bins: upper edges of each feature
    slots: np.ndarray = field(init=False)

    def __post_init__(self):
        self.slots = np.full(len(self.trees.feature), -1, np.int32)
        self.slots[self.open_] = np.arange(len(self.open_))


#: (batch, trees) -> what each row adds to each tree: rows x trees x sums.
Stats = Callable[[pd.DataFrame, np.ndarray], np.ndarray]


def _sums(level: Level, stats: Stats, pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """slot, cell and the sums of a batch. Cells are drawn features, or drawn features by bin."""
    x = np.array(pdf["vec"].tolist(), dtype=np.float64).reshape(len(pdf), -1)
    m = level.drawn.shape[1]
    binned = np.stack([np.searchsorted(e, v, side="left") for e, v in zip(level.edges, x.T, strict=True)], axis=1) if level.kind == "bins" else None
    for start in range(0, len(level.trees.roots), TREE_CHUNK):
        chunk = np.arange(start, min(start + TREE_CHUNK, len(level.trees.roots)))
        slot = level.slots[level.trees.leaves(x, level.trees.roots[chunk])]
        sums = stats(pdf, chunk)
        row, tree = np.nonzero((slot >= 0) & (sums != 0).any(axis=2))
        if not len(row):
            continue
        at, sums = slot[row, tree], sums[row, tree]
        order = np.argsort(at, kind="stable")
        row, at, sums = row[order], at[order], sums[order]
        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        own, f = at[starts], level.drawn[at]
        n, wide = len(starts), sums.shape[1]
        cells = {"slot": np.repeat(own, m), "cell": np.tile(np.arange(m), n)}
        if level.kind == "range":
            v = x[row[:, None], f]
            yield pd.DataFrame(cells | {"s0": np.minimum.reduceat(v, starts).ravel(), "s1": np.maximum.reduceat(v, starts).ravel()})
        elif level.kind == "count":
            left = x[row[:, None], f] <= level.cuts[at]
            whole = np.add.reduceat(sums, starts)
            parts = {f"s{c}": np.add.reduceat(left * sums[:, c : c + 1], starts).ravel() for c in range(wide)}
            yield pd.DataFrame(cells | parts | {f"s{wide + c}": np.repeat(whole[:, c], m) for c in range(wide)})
        else:
            place = np.repeat(np.arange(n), np.diff(np.r_[starts, len(at)]))
            size = level.edges.shape[1] + 1
            code = ((place[:, None] * m + np.arange(m)) * size + binned[row[:, None], f]).ravel()
            if n * m * size <= 4 * len(code):  # few nodes: all their cells at once, without a sort
                there = np.bincount(code, minlength=n * m * size) > 0
                held, code = np.flatnonzero(there), (np.cumsum(there) - 1)[code]
            else:
                held, code = np.unique(code, return_inverse=True)
            parts = {f"s{c}": np.bincount(code, np.repeat(sums[:, c], m), len(held)) for c in range(wide)}
            yield pd.DataFrame({"slot": own[held // (m * size)], "cell": held % (m * size)} | parts)


def _entropy(w: np.ndarray) -> np.ndarray:
    """Total weight times entropy of each row."""
    total = w.sum(axis=-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(total > 0, total * np.log2(np.where(total > 0, total, 1)), 0) - np.where(w > 0, w * np.log2(np.where(w > 0, w, 1)), 0).sum(axis=-1)


@dataclass
class Chooser:
    """The best split of each node from its sums: by weighted entropy of class counts, or by the spread of mean gradients."""

    classes: int | None  # None: sums are rows, gradients and curvatures
    least: int  # rows in a child
    factor: np.ndarray | None = None  # slots x classes: the weight of a row of a class
    size: int = 1  # bins of a feature; 1: cells hold the left side

    def gains(self, left: np.ndarray, whole: np.ndarray, slot: np.ndarray) -> np.ndarray:
        right = whole - left
        if self.classes is None:
            n, r = left[:, 0], right[:, 0]
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = n * r / (n + r) * (left[:, 1] / n - right[:, 1] / r) ** 2
        else:
            n, r, f = left.sum(axis=1), right.sum(axis=1), self.factor[slot]
            gain = _entropy(whole * f) - _entropy(left * f) - _entropy(right * f)
        return np.where((n >= self.least) & (r >= self.least), gain, -np.inf)

    def best(self, slot: np.ndarray, cell: np.ndarray, sums: np.ndarray) -> pd.DataFrame:
        """Sorted by slot and cell, with all cells of the slots that are there."""
        first = np.flatnonzero(np.r_[True, (slot[1:] != slot[:-1]) | (cell[1:] != cell[:-1])])
        slot, cell, sums = slot[first], cell[first], np.add.reduceat(sums, first)
        if self.size == 1:
            wide = sums.shape[1] // 2
            left, whole = sums[:, :wide], sums[:, wide:]
        else:
            feature = cell // self.size
            starts = np.flatnonzero(np.r_[True, (slot[1:] != slot[:-1]) | (feature[1:] != feature[:-1])])
            group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(slot)]))
            total = np.cumsum(sums, axis=0)
            before = np.vstack([np.zeros((1, sums.shape[1])), total])[starts]
            left, whole = total - before[group], np.add.reduceat(sums, starts)[group]
        gain = self.gains(left, whole, slot)
        own = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
        top = np.maximum.reduceat(gain, own)
        near = gain >= np.repeat(top - 1e-12 * np.abs(np.where(np.isfinite(top), top, 0)), np.diff(np.r_[own, len(slot)]))
        place = np.minimum.reduceat(np.where(near, np.arange(len(slot)), len(slot)), own)
        return pd.DataFrame({"slot": slot[own], "cell": np.where(np.isfinite(top), cell[place], -1), "gain": top, "whole": whole[own].tolist(), "part": left[place].tolist()})

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            rest = pdf if rest is None else pd.concat([rest, pdf])
            if not len(rest):
                continue
            slot = rest["slot"].to_numpy()
            cut = int(np.searchsorted(slot, slot[-1], side="left"))
            if cut:
                yield self._of(rest.iloc[:cut])
                rest = rest.iloc[cut:]
        if rest is not None and len(rest):
            yield self._of(rest)

    def _of(self, pdf: pd.DataFrame) -> pd.DataFrame:
        return self.best(pdf["slot"].to_numpy(), pdf["cell"].to_numpy(), pdf[[c for c in pdf.columns if c[0] == "s" and c != "slot"]].to_numpy(np.float64))


_SPLITS = "slot int, cell int, gain double, whole array<double>, part array<double>"


def _summed(rows: DataFrame, level: Level, stats: Stats, columns: int) -> DataFrame:
    """slot, cell and the sums of every batch."""
    shared = rows.sparkSession.sparkContext.broadcast(level)  # the model so far, bounded by trees and depth

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield from _sums(shared.value, stats, pdf)

    return rows.mapInPandas(run, "slot int, cell int, " + ", ".join(f"s{c} double" for c in range(columns)))


def _splits(rows: DataFrame, level: Level, stats: Stats, columns: int, chooser: Chooser) -> pd.DataFrame:
    """One row for each open node: its sums, and the best split (cell -1: none)."""
    sums = _summed(rows, level, stats, columns).repartition("slot").sortWithinPartitions("slot", "cell")
    return sums.mapInPandas(chooser.__call__, _SPLITS).toPandas()  # one row for each open node


def _splits_of_few(rows: DataFrame, level: Level, stats: Stats, chooser: Chooser) -> pd.DataFrame:
    """As _splits, in one task without a shuffle: for PART_ROWS rows at most, and open nodes that are few."""
    shared = rows.sparkSession.sparkContext.broadcast(level)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = [part for pdf in batches for part in _sums(shared.value, stats, pdf)]
        if sums:
            yield chooser._of(pd.concat(sums).sort_values(["slot", "cell"], kind="stable"))

    return rows.coalesce(1).mapInPandas(run, _SPLITS).toPandas()  # one row for each open node


def prepared(train: DataFrame) -> DataFrame:
    """id's hash, y and vec in partitions of bounded size, written once."""
    rows = train.select(F.xxhash64("id").alias("key"), F.col("y").cast("int").alias("y"), "vec")
    return staged(rows.repartition(max(1, math.ceil(train.count() / PART_ROWS)), "key"))


def _width(rows: DataFrame) -> int:
    return rows.select(F.max(F.size("vec"))).first()[0] or 0


def drawn_features(paths: np.ndarray, width: int, count: int) -> np.ndarray:
    """The features of each node: those with the least hashes with its path, in that order."""
    out = np.empty((len(paths), count), dtype=np.int32)
    for at in range(0, len(paths), 4096):
        h = mixed(paths[at : at + 4096, None] ^ mixed(np.arange(width, dtype=np.uint64))[None, :])
        out[at : at + 4096] = np.argsort(h, axis=1, kind="stable")[:, :count]
    return out


def root_paths(trees: int, seed: int) -> np.ndarray:
    return mixed(np.arange(trees, dtype=np.uint64) ^ mixed(np.uint64(seed)))


def child_paths(paths: np.ndarray) -> np.ndarray:
    """Left and right of each node, in turn."""
    return np.stack([mixed(paths ^ np.uint64(1)), mixed(paths ^ np.uint64(2))], axis=1).ravel()


def _grow(rows: DataFrame, trees: int, classes: int, depth: int, least: int, seed: int, stats: Stats, factor: np.ndarray, extra: bool) -> tuple[Trees, np.ndarray]:
    """A forest of class shares and the importance of each feature. factor: trees x classes."""
    width = _width(rows)
    tried = max(1, int(math.sqrt(width)))
    model, importance = Trees.planted(trees, classes), np.zeros((trees, width))
    nodes, owner, paths = model.roots.copy(), np.arange(trees), root_paths(trees, seed)
    edges = None if extra else bin_edges(rows)
    for level in range(depth + 1):
        if not len(nodes):
            break
        drawn = drawn_features(paths, width, tried)
        chooser = Chooser(classes, least, factor[owner], 1 if extra else edges.shape[1] + 1)
        if extra:
            low_high = _summed(rows, Level(model, nodes, drawn, "range"), stats, 2).groupBy("slot", "cell").agg(F.min("s0").alias("low"), F.max("s1").alias("high")).toPandas()  # one row for each open node and drawn feature
            low, high = np.zeros(drawn.shape), np.zeros(drawn.shape)
            low[low_high["slot"], low_high["cell"]], high[low_high["slot"], low_high["cell"]] = low_high["low"], low_high["high"]
            cuts = low + uniform(paths[:, None] ^ mixed(drawn.astype(np.uint64) + np.uint64(1 << 32))) * (high - low)
            cuts = np.where(cuts >= high, low, cuts)
            found = _splits(rows, Level(model, nodes, drawn, "count", cuts=cuts), stats, 2 * classes, chooser)
        else:
            found = _splits(rows, Level(model, nodes, drawn, "bins", edges=edges), stats, classes, chooser)
        slot, cell = found["slot"].to_numpy(), found["cell"].to_numpy()
        whole = np.array(found["whole"].tolist()).reshape(len(slot), classes)
        weighed = whole * factor[owner[slot]]
        model.value[nodes[slot]] = weighed / weighed.sum(axis=1, keepdims=True)
        goes_on = (cell >= 0) & ((whole > 0).sum(axis=1) > 1) & (level < depth)
        slot, cell, part, gain = slot[goes_on], cell[goes_on], np.array(found["part"].tolist()).reshape(-1, classes)[goes_on], found["gain"].to_numpy()[goes_on]
        j = cell if extra else cell // chooser.size
        f = drawn[slot, j]
        threshold = cuts[slot, j] if extra else edges[f, np.minimum(cell % chooser.size, chooser.size - 2)]
        np.add.at(importance, (owner[slot], f), gain)
        first = model.split(nodes[slot], f, threshold)
        children, sums = np.stack([first, first + 1], axis=1).ravel(), np.stack([part, whole[goes_on] - part], axis=1).reshape(-1, classes)
        weighed = sums * np.repeat(factor[owner[slot]], 2, axis=0)
        model.value[children] = weighed / weighed.sum(axis=1, keepdims=True)
        still = (sums.sum(axis=1) >= 2 * least) & ((sums > 0).sum(axis=1) > 1)
        nodes, owner, paths = children[still], np.repeat(owner[slot], 2)[still], child_paths(paths[slot])[still]
        if level + 1 >= depth:
            break
    share = importance / np.maximum(importance.sum(axis=1, keepdims=True), 1e-300)
    return model, share.mean(axis=0)


def _class_counts(rows: DataFrame, classes: int) -> np.ndarray:
    out = np.zeros(classes)
    for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect():  # one row for each class
        out[r["y"]] = r["n"]
    return out


def extra_trees(train: DataFrame, trees: int, classes: int, depth: int, least: int = 2, seed: int = 42) -> tuple[Trees, np.ndarray]:
    """Each node draws features, and for each one threshold between its least and largest value there; the best of these splits it.

    All rows take part in each tree, with balanced class weights. Features that are constant in a
    node can't split it. train: id, y, vec without nulls.
    """
    rows = prepared(train)
    counts = _class_counts(rows, classes)
    factor = np.where(counts > 0, counts.sum() / (classes * np.maximum(counts, 1)), 0.0)

    def stats(pdf: pd.DataFrame, chunk: np.ndarray) -> np.ndarray:
        one = np.eye(classes)[pdf["y"].to_numpy()]
        return np.broadcast_to(one[:, None, :], (len(pdf), len(chunk), classes))

    out = _grow(rows, trees, classes, depth, least, seed, stats, np.tile(factor, (trees, 1)), extra=True)
    discard(rows)
    return out


def draw_counts(keys: np.ndarray, salts: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """How often each tree draws each row: Poisson numbers of the rows' rates, by hash. keys: of rows; salts: of trees."""
    u = uniform(keys[:, None] ^ salts[None, :])
    upto = np.cumsum(np.exp(-rates)[:, None] * np.cumprod(np.c_[np.ones(len(rates)), rates[:, None] / np.arange(1, 20)], axis=1), axis=1)
    out = np.zeros(u.shape)
    for k in range(upto.shape[1]):
        out += u >= upto[:, k : k + 1]
    return out


def balanced_draws(rows: DataFrame, trees: int, classes: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Salts of trees, rates of classes, and the factor of each tree and class that makes the drawn weight of all classes equal to the size of the smallest."""
    counts = _class_counts(rows, classes)
    least = counts[counts > 0].min()
    rates = np.where(counts > 0, least / np.maximum(counts, 1), 0.0)
    salts = root_paths(trees, seed ^ 0x5EED)
    while True:
        shared = rows.sparkSession.sparkContext.broadcast((salts, rates))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            salt, rate = shared.value
            for pdf in batches:
                y = pdf["y"].to_numpy()
                drawn = draw_counts(pdf["key"].to_numpy().view(np.uint64), salt, rate[y])
                sums = np.stack([drawn[y == c].sum(axis=0) for c in range(classes)], axis=1)
                yield pd.DataFrame({"tree": np.repeat(np.arange(len(salt)), classes), "y": np.tile(np.arange(classes), len(salt)), "n": sums.ravel()})

        found = rows.select("key", "y").mapInPandas(run, "tree int, y int, n double").groupBy("tree", "y").agg(F.sum("n").alias("n")).toPandas()  # one row for each tree and class
        sums = np.zeros((trees, classes))
        sums[found["tree"], found["y"]] = found["n"]
        empty = ((sums == 0) & (counts > 0)).any(axis=1)
        if not empty.any():
            return salts, rates, np.where(sums > 0, least / np.maximum(sums, 1), 0.0)
        salts[empty] = mixed(salts[empty])  # a tree without a class draws anew


def balanced_forest(train: DataFrame, trees: int, classes: int, depth: int, least: int = 2, seed: int = 42) -> Trees:
    """Each tree draws from each class, with replacement, as many rows as the smallest class has.

    A row's number of draws in a tree is a Poisson number by hash, so no row is copied, and factors
    make the weights of all classes in a tree equal. The best bin edge of the drawn features splits a node.
    """
    rows = prepared(train)
    salts, rates, factor = balanced_draws(rows, trees, classes, seed)

    def stats(pdf: pd.DataFrame, chunk: np.ndarray) -> np.ndarray:
        y = pdf["y"].to_numpy()
        drawn = draw_counts(pdf["key"].to_numpy().view(np.uint64), salts[chunk], rates[y])
        return drawn[:, :, None] * np.eye(classes)[y][:, None, :]

    out = _grow(rows, trees, classes, depth, least, seed, stats, factor, extra=False)[0]
    discard(rows)
    return out


def bin_edges(rows: DataFrame, bins: int = BINS) -> np.ndarray:
    """Upper edges of the bins of each feature, at approximate percentiles; a row is in the first bin whose edge it doesn't exceed."""
    shares = [i / bins for i in range(1, bins)]
    cells = rows.select(F.posexplode("vec").alias("f", "v")).groupBy("f").agg(F.percentile_approx("v", shares, 10_000).alias("e")).orderBy("f")
    return np.array([r["e"] for r in cells.collect()], dtype=np.float64)  # one row for each feature


# Boosting ------------------------------------------------------------------------------------------


@dataclass
class Boosting:
    """Scores start at base; the trees of a round (one a class, or one for two classes) add step times their leaf."""

    base: np.ndarray
    step: float
    trees: Trees

    def scores(self, x: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
        width = len(self.base)
        out = np.tile(self.base, (len(x), 1)) if start is None else start.copy()
        for at in range(0, len(self.trees.roots), 16 * width):
            leaf = self.trees.value[self.trees.leaves(x, self.trees.roots[at : at + 16 * width]), 0]
            for c in range(width):
                out[:, c] += self.step * leaf[:, c::width].sum(axis=1)
        return out

    @staticmethod
    def shares(scores: np.ndarray) -> np.ndarray:
        if scores.shape[1] == 1:
            p = 1 / (1 + np.exp(-scores[:, 0]))
            return np.stack([1 - p, p], axis=1)
        e = np.exp(scores - scores.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def boosting(train: DataFrame, rounds: int, step: float, classes: int, depth: int = 3, seed: int = 42) -> Boosting:
    """Joint boosting of all classes: softmax gradients, a tree for each class in each round (two classes: one), grown together from shared histograms.

    A level of a round is one pass of sums over rows, which carry their scores of some rounds ago and
    are routed through the trees since. Leaves are Newton steps. A training set of one partition takes
    no shuffle for a level.
    """
    rows = prepared(train)
    counts = _class_counts(rows, classes)
    width = 1 if classes == 2 else classes
    share = np.maximum(counts / counts.sum(), 1e-300)
    base = np.array([math.log(share[1] / share[0])]) if width == 1 else np.log(share)
    edges, features = bin_edges(rows), _width(rows)
    scored = rows.withColumn("score", F.array(*[F.lit(float(b)) for b in base]))
    whole, recent = Boosting(base, step, Trees.planted(0, 1)), Boosting(base, step, Trees.planted(0, 1))
    for r in range(rounds):
        if r and r % STAGE_ROUNDS == 0:
            before, scored, recent = scored, _rescored(scored, recent), Boosting(base, step, Trees.planted(0, 1))
            discard(before)

        def stats(pdf: pd.DataFrame, chunk: np.ndarray, recent=recent) -> np.ndarray:
            x = np.array(pdf["vec"].tolist(), dtype=np.float64)
            p = Boosting.shares(recent.scores(x, np.array(pdf["score"].tolist())))[:, -width:]
            y = pdf["y"].to_numpy()
            hit = (y == 1).astype(float)[:, None] if width == 1 else np.eye(classes)[y]
            return np.stack([np.ones(p.shape), hit - p, p * (1 - p)], axis=2)[:, chunk]

        grown = _boosted_trees(scored, width, classes, depth, stats, edges, features, few=counts.sum() <= PART_ROWS)
        whole.trees, recent.trees = _appended(whole.trees, grown), _appended(recent.trees, grown)
    discard(scored)
    return whole


def _boosted_trees(rows: DataFrame, width: int, classes: int, depth: int, stats: Stats, edges: np.ndarray, features: int, few: bool) -> Trees:
    model = Trees.planted(width, 1)
    nodes, every = model.roots.copy(), np.arange(features, dtype=np.int32)
    ratio = 1.0 if classes == 2 else (classes - 1) / classes
    newton = lambda s: np.where(s[:, 2] > 1e-150, ratio * s[:, 1] / np.maximum(s[:, 2], 1e-150), 0.0)
    for _ in range(depth):
        if not len(nodes):
            break
        chooser = Chooser(None, 1, size=edges.shape[1] + 1)
        level = Level(model, nodes, np.tile(every, (len(nodes), 1)), "bins", edges=edges)
        found = _splits_of_few(rows, level, stats, chooser) if few else _splits(rows, level, stats, 3, chooser)
        slot, cell, whole, part = found["slot"].to_numpy(), found["cell"].to_numpy(), np.array(found["whole"].tolist()).reshape(-1, 3), np.array(found["part"].tolist()).reshape(-1, 3)
        model.value[nodes[slot], 0] = newton(whole)
        on = (cell >= 0) & (found["gain"].to_numpy() > 0)
        slot, cell, whole, part = slot[on], cell[on], whole[on], part[on]
        f = cell // chooser.size
        first = model.split(nodes[slot], f, edges[f, cell % chooser.size])
        model.value[first, 0], model.value[first + 1, 0] = newton(part), newton(whole - part)
        children, sizes = np.stack([first, first + 1], axis=1).ravel(), np.stack([part[:, 0], whole[:, 0] - part[:, 0]], axis=1).ravel()
        nodes = children[sizes >= 2]
    return model


def _appended(a: Trees, b: Trees) -> Trees:
    n = len(a.feature)
    return Trees(np.append(a.roots, b.roots + n).astype(np.int32), np.append(a.feature, b.feature), np.append(a.threshold, b.threshold), np.append(a.left, np.where(b.left >= 0, b.left + n, -1)).astype(np.int32), np.vstack([a.value, b.value]))


def _rescored(rows: DataFrame, recent: Boosting) -> DataFrame:
    """Rows with their scores behind the trees so far, written: the lineage of later rounds begins here."""

    @F.pandas_udf("array<double>")
    def score(vec: pd.Series, start: pd.Series) -> pd.Series:
        return pd.Series(recent.scores(np.array(vec.tolist(), dtype=np.float64), np.array(start.tolist())).tolist())

    return staged(rows.withColumn("score", score("vec", "score")))


# Scoring -------------------------------------------------------------------------------------------


def saved_forest(spark: SparkSession, path: str, classes: int) -> Trees:
    """The nodes of a saved built-in forest, with class shares as values."""
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    shares = [(F.get("impurityStats", F.lit(c)) / F.aggregate("impurityStats", F.lit(0.0), lambda s, x: s + x)).alias(f"v{c}") for c in range(classes)]
    cut = F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold")
    t = nodes.select("treeID", "id", "leftChild", "rightChild", "split.featureIndex", cut, *shares).orderBy("treeID", "id").toPandas()  # bounded by trees and depth
    first, inner = np.flatnonzero(t["id"] == 0), np.flatnonzero(t["leftChild"] >= 0)
    start = first[np.cumsum(t["id"] == 0) - 1][inner]
    left, place = len(first) + 2 * np.arange(len(inner)), np.empty(len(t), np.int64)
    place[first], place[start + t["leftChild"].iloc[inner]], place[start + t["rightChild"].iloc[inner]] = np.arange(len(first)), left, left + 1
    out = Trees(np.arange(len(first), dtype=np.int32), np.full(len(t), -1, np.int32), np.zeros(len(t)), np.full(len(t), -1, np.int32), np.zeros((len(t), classes)))
    out.value[place] = t[[f"v{c}" for c in range(classes)]].to_numpy()
    out.feature[place[inner]], out.threshold[place[inner]], out.left[place[inner]] = t["featureIndex"].iloc[inner], t["threshold"].iloc[inner], left
    return out


def forest_probabilities(df: DataFrame, model: Trees) -> DataFrame:
    """df with prob: the mean of the class shares of the leaves that vec reaches."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by trees and depth

    @F.pandas_udf("array<double>")
    def prob(vec: pd.Series) -> pd.Series:
        x, m = np.array(vec.tolist(), dtype=np.float64).reshape(len(vec), -1), shared.value
        total = np.zeros((len(x), m.value.shape[1]))
        for at in range(0, len(m.roots), TREE_CHUNK):
            total += m.value[m.leaves(x, m.roots[at : at + TREE_CHUNK])].sum(axis=1)
        return pd.Series((total / len(m.roots)).tolist())

    return df.withColumn("prob", prob("vec"))


def boosting_probabilities(df: DataFrame, model: Boosting) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by rounds and depth

    @F.pandas_udf("array<double>")
    def prob(vec: pd.Series) -> pd.Series:
        x = np.array(vec.tolist(), dtype=np.float64).reshape(len(vec), -1)
        return pd.Series(Boosting.shares(shared.value.scores(x)).tolist())

    return df.withColumn("prob", prob("vec"))
