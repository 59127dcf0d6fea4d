"""SimHash near-duplicates by sharded vantage-point trees.

Fingerprints are cut into chunks: two that differ in at most b bits differ in at most b // c bits in
one of c chunks. For each chunk a vantage-point tree, learned from a bounded sample, deals the
fingerprints to shards by Hamming distance. A fingerprint also visits each later shard that its ball
reaches across a boundary (triangle bound), and a tree inside the shard finds the pairs. A shard
returns a spanning forest of its links, never all pairs; components follow by joins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, whole_text
from .components import components
from .fingerprints import shingle_hashes, simhash_words
from .jaccard import WORDS, prefixes, similar_groups

#: Fingerprints that trees are learned from, and that a shard and a block of a crowded shard hold about.
SAMPLE, SHARD, BLOCK = 8192, 8192, 16_384


@dataclass(frozen=True)
class Chunk:
    word: int
    shift: int
    width: int

    def of(self, prints: np.ndarray) -> np.ndarray:
        return (prints[:, self.word] >> np.uint64(self.shift)) & np.uint64((1 << self.width) - 1)


@dataclass(frozen=True)
class Tree:
    """A full binary tree in heap order: inside means at most `radius` bits from the point."""

    point: np.ndarray
    radius: np.ndarray
    depth: int


def _distance(a, b):
    return np.bitwise_count(a ^ b).astype(np.int16)


def fingerprints(docs: DataFrame, shingle_words: int = 3, words: int = 1) -> DataFrame:
    """doc_id, node and f0, f1, ... of every row; equal fingerprints have equal nodes. Texts without words have the fingerprint zero."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = np.array([simhash_words(shingle_hashes(t, shingle_words), words) for t in pdf["text"]], dtype=np.uint64).reshape(-1, words).view(np.int64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64")} | {f"f{w}": found[:, w] for w in range(words)})

    names = [f"f{w}" for w in range(words)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(F.col("text")).alias("text")).mapInPandas(run, "doc_id long, " + ", ".join(f"{n} long" for n in names))
    return rows.withColumn("node", F.col("f0") if words == 1 else F.xxhash64(*names))


def learn_tree(values: np.ndarray, depth: int) -> Tree:
    """Split each part of a sample at the distance from its first value that comes nearest to halves."""
    point, radius = np.zeros((1 << depth) - 1, dtype=np.uint64), np.full((1 << depth) - 1, 64, dtype=np.int16)
    parts = {0: values}
    for node in range((1 << depth) - 1):
        part = parts.pop(node, values[:0])
        inside = np.ones(len(part), dtype=bool)
        if len(part):
            point[node] = part[0]
            d = _distance(part, part[0])
            share = np.cumsum(np.bincount(d, minlength=65)) / len(part)
            radius[node] = int(np.argmin(np.abs(share - 0.5)))
            inside = d <= radius[node]
        parts[2 * node + 1], parts[2 * node + 2] = part[inside], part[~inside]
    return Tree(point, radius, depth)


def route(tree: Tree, values: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The home leaf of each value, and (row, leaf) of the later leaves that a ball of `reach` bits meets."""
    home = np.zeros(len(values), dtype=np.int64)
    row, node = np.arange(len(values)), np.zeros(len(values), dtype=np.int64)
    for _ in range(tree.depth):
        home = 2 * home + 1 + (_distance(values, tree.point[home]) > tree.radius[home])
        d = _distance(values[row], tree.point[node])
        left, right = d - reach <= tree.radius[node], d + reach > tree.radius[node]
        row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
    first = (1 << tree.depth) - 1
    later = node > home[row]
    return home - first, row[later], node[later] - first


def _merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Give the parts that pairs (i, j) link one label, the least."""
    while len(i):
        a, b = label[i], label[j]
        differ = a != b
        if not differ.any():
            return
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            short = label[label]
            if (short == label).all():
                break
            label[:] = short


def _link(label, prints, left, right, most_bits: int) -> None:
    """Compare every left row with every right row, in blocks of bounded size."""
    rows = max(1, 2_000_000 // max(1, len(right)))
    for at in range(0, len(left), rows):
        part = left[at : at + rows]
        bits = np.zeros((len(part), len(right)), dtype=np.uint16)
        for w in range(prints.shape[1]):
            bits += np.bitwise_count(prints[part, w][:, None] ^ prints[right, w][None, :])
        i, j = np.nonzero(bits <= most_bits)
        _merge(label, part[i], right[j])


def search_shard(prints: np.ndarray, values: np.ndarray, left: np.ndarray, right: np.ndarray, reach: int, most_bits: int, label: np.ndarray) -> None:
    """Link rows of left and right within most_bits, by a vantage-point tree over left that prunes right."""
    stack = [(left, right)]
    while stack:
        left, right = stack.pop()
        if not len(left) or not len(right):
            continue
        if len(left) > 48:
            d = _distance(values[left], values[left[len(left) // 2]])
            radius = int(np.argmin(np.abs(np.cumsum(np.bincount(d, minlength=65)) / len(left) - 0.5)))
            inside = d <= radius
            if inside.any() and not inside.all():
                e = _distance(values[right], values[left[len(left) // 2]])
                stack += [(left[inside], right[e - reach <= radius]), (left[~inside], right[e + reach > radius])]
                continue
        _link(label, prints, left, right, most_bits)


def link_prints(nodes: DataFrame, words: int, most_bits: int, chunks: tuple[Chunk, ...], reach: int | None = None) -> DataFrame:
    """Edges (u, v) that connect all fingerprints which differ in at most most_bits bits.

    nodes: node and f0, f1, ..., one row each. With reach unset the search is exact. Trees come from
    a bounded sample; every fingerprint is dealt. Shards that hold more than BLOCK are cut into
    blocks, and each pair of blocks is a group of its own, so no group grows with the data.
    """
    reach = most_bits // len(chunks) if reach is None else reach
    names = [f"f{w}" for w in range(words)]
    count = nodes.count()
    depth = min(10, max(0, int(np.ceil(np.log2(max(1, count / SHARD))))))
    sample = nodes.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select(*names).toPandas().to_numpy(dtype=np.int64).view(np.uint64).reshape(-1, words)
    trees = [learn_tree(c.of(sample), depth) for c in chunks]

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            prints = np.ascontiguousarray(pdf[names].to_numpy(dtype=np.int64)).view(np.uint64)
            for c, (chunk, tree) in enumerate(zip(chunks, trees, strict=True)):
                home, row, leaf = route(tree, chunk.of(prints), reach)
                pick = np.concatenate([np.arange(len(prints)), row])
                out = pdf.iloc[pick][["node", *names]].reset_index(drop=True)
                out.insert(0, "chunk", np.int32(c))
                out.insert(1, "leaf", np.concatenate([home, leaf]).astype(np.int32))
                out.insert(2, "side", np.repeat([0, 1], [len(prints), len(row)]).astype(np.int32))
                yield out

    dealt = nodes.select("node", *names).mapInPandas(deal, "chunk int, leaf int, side int, node long, " + ", ".join(f"{n} long" for n in names))
    # One row for each shard and side: at most 2 * 1024 * chunks, whatever the input.
    loads = {(r["chunk"], r["leaf"], r["side"]): r["n"] for r in dealt.groupBy("chunk", "leaf", "side").agg(F.count("*").alias("n")).collect()}
    crowded = []
    for c, leaf in {k[:2] for k in loads}:
        own, visits = loads.get((c, leaf, 0), 0), loads.get((c, leaf, 1), 0)
        if own > BLOCK or visits > 4 * BLOCK:
            crowded.append((c, leaf, -(-own // BLOCK), max(1, -(-visits // BLOCK))))
    plan = nodes.sparkSession.createDataFrame(crowded, "chunk int, leaf int, own int, visits int")
    dealt = dealt.join(F.broadcast(plan), ["chunk", "leaf"], "left").withColumn("spread", F.xxhash64("node", F.lit(1)))
    mine = F.when(F.col("side") == 0, F.pmod("spread", F.col("own"))).otherwise(F.col("own") + F.pmod("spread", F.col("visits"))).cast("int")
    pair = lambda a, b, s: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"), F.lit(s).alias("s"))
    others = F.sequence(F.lit(0), F.col("own") + F.col("visits") - 1)
    spots = (
        F.when(F.col("own").isNull(), F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), F.col("side").alias("s"))))
        .when(F.col("side") == 1, F.transform(F.filter(others, lambda a: a < F.col("own")), lambda a: pair(a, F.col("mine"), 1)))
        .otherwise(F.transform(others, lambda o: F.when(o < F.col("mine"), pair(o, F.col("mine"), 1)).otherwise(pair(F.col("mine"), o, 0))))
    )
    placed = dealt.withColumn("mine", mine).withColumn("spot", F.explode(spots)).select("chunk", "leaf", F.col("spot.a").alias("a"), F.col("spot.b").alias("b"), F.col("spot.s").alias("s"), "node", *names)

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        prints = np.ascontiguousarray(pdf[names].to_numpy(dtype=np.int64)).view(np.uint64)
        values, node, side = chunks[int(pdf["chunk"].iloc[0])].of(prints), pdf["node"].to_numpy(), pdf["s"].to_numpy()
        label, left, right = np.arange(len(pdf)), np.nonzero(side == 0)[0], np.nonzero(side == 1)[0]
        if pdf["a"].iloc[0] == pdf["b"].iloc[0]:
            right = np.arange(len(pdf))
        search_shard(prints, values, left, right, reach, most_bits, label)
        linked = np.nonzero(label != np.arange(len(pdf)))[0]
        return pd.DataFrame({"u": node[linked], "v": node[label[linked]]})

    return placed.groupBy("chunk", "leaf", "a", "b").applyInPandas(pairs, "u long, v long")


#: Sixteen chunks of a wide fingerprint: of two that differ in at most 31 bits, one chunk differs in one at most.
SIXTEENTHS = tuple(Chunk(w, s, 16) for w in range(WORDS) for s in (0, 16, 32, 48))
NEAR_BITS = 2 * len(SIXTEENTHS) - 1
#: Two halves for 64 bits and 3 differing ones: one half differs in at most one bit.
HALVES = (Chunk(0, 0, 32), Chunk(0, 32, 32))


def near_duplicates(docs: DataFrame, shingle_words: int = 3, words: int = 1, most_bits: int = 3, chunks: tuple[Chunk, ...] = HALVES, reach: int | None = None) -> DataFrame:
    """doc_id, f0, f1, ... and component_id of every row.

    component_id is the smallest doc_id that links of at most most_bits bits reach. Null and empty
    texts have the fingerprint zero and link like any other. Rows that repeat fall into one
    component. Null ids take part in links but are never the smallest; a component with no other id
    has a null one. An empty table gives no rows. Columns other than doc_id and text are not read.
    """
    names = [f"f{w}" for w in range(words)]
    rows = staged(fingerprints(docs, shingle_words, words))
    nodes = staged(rows.groupBy("node", *names).agg(F.min("doc_id").alias("first_id")))  # copies go map-side
    roots = components(link_prints(nodes, words, most_bits, chunks, reach))
    rooted = nodes.select("node", "first_id").join(roots, F.col("node") == F.col("u"), "left").select("node", "first_id", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rows.join(rooted.join(least, "root").select("node", "component_id"), "node").select("doc_id", *names, "component_id")


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """One document of each group of near-duplicates (sets of five-word shingles, Jaccard of 0.8 or more).

    Groups are the components of all pairs of rows at 0.8 or more. Vantage-point trees over wide
    fingerprints of the sets link what differs in at most NEAR_BITS bits, the whole sets decide on these
    links, and jaccard finds the pairs that are further apart; texts without words are alike. The row with the smallest id stays, nulls last; among
    rows that repeat an id, one by the digest of the text. Every row is judged by its own text. All
    columns come along, and an empty table stays empty.
    """
    copy = F.unhex(F.md5(whole_text(F.col("text"))))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), copy.alias("copy"), whole_text(F.col("text")).alias("text"))
    rows = staged(prefixes(texts, 5))
    nodes = rows.select("node", *[f"f{w}" for w in range(WORDS)]).dropDuplicates(["node"])
    near = link_prints(nodes, WORDS, NEAR_BITS, SIXTEENTHS)
    found = rows.select("doc_id", "copy", "node").join(similar_groups(rows, texts, 5, near), "node", "left").withColumn("root", F.coalesce("root", "node"))
    cells = found.groupBy("root", "doc_id", "copy").agg(F.count("*").alias("n"))
    first = cells.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "copy")).alias("first"))
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("copy") == F.col("first.copy"))
    judged = staged(cells.join(first, "root").select(F.col("doc_id").alias("_id"), F.col("copy").alias("_copy"), "n", stays.alias("stays")).filter("not stays or n > 1"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (copy == F.col("_copy"))
    if judged.filter("stays").isEmpty():
        return docs.join(judged, same, "left_anti")
    # One of the rows that are equal in id and text, by their other columns.
    whole = F.struct(*[docs[c] for c in docs.columns])
    again = docs.join(judged.filter("stays"), same).groupBy("_id", "_copy").agg(F.min_by(whole, F.to_json(whole)).alias("row")).select("row.*")
    return docs.join(judged, same, "left_anti").unionByName(again)
