"""Exact links between texts whose sets of word shingles have a Jaccard similarity of 4/5 or more.

Near fingerprints come first (see simhash). For the pairs that these leave apart, each set is put in
one order: shingles that a bounded sample holds often come last, the rest go by hash. With a and b
shingles, a pair at 4/5 shares o = ceil(4 (a + b) / 9) of them, and the first p = a // 5 + 1 of each set
share at least min(p_a - a, p_b - b) + o, whatever the order. So an equi-join over these prefixes meets
every pair, and the whole sets decide. The sample is a matter of speed only.

The join lets only likely pairs through. Sets at 4/5 differ in at most (a + b) / 9 elements, and so do
their parity maps in bits, which is exact. Their fingerprints of 256 bits differ in 39 bits on average
(48 for the smallest sets), with a deviation of 6: FAR_BITS is over six deviations away.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, staged, whole_text
from .components import components
from .fingerprints import parity_words, shingle_hashes, simhash_words

#: Texts in the sample, about, and shingles that it may put last.
SAMPLE, LAST = 8192, 400_000
#: Least sets that a set is compared with before all its pairs are; a matter of speed only, too.
STARS = 4
#: 64-bit words of a fingerprint and of a parity map, and the most bits in which fingerprints of a pair differ.
WORDS, FAR_BITS = 4, 88
PRINT, PARITY = tuple(f"f{w}" for w in range(WORDS)), tuple(f"m{w}" for w in range(WORDS))
_OWN = ("node", "a", *PRINT, *PARITY)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """The hashes of the distinct shingles, sorted."""
    return np.unique(shingle_hashes(text, k))


def _node(found: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), 42)).view(np.int64))


def _whole_sets(texts: DataFrame, k: int) -> DataFrame:
    """node and shingles (sorted longs, as bytes), one row for each different set of the texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [shingle_set(t, k) for t in pdf["text"]]
            yield pd.DataFrame({"node": np.array([_node(s) for s in found], dtype=np.int64), "shingles": [s.tobytes() for s in found]})

    return texts.mapInPandas(run, "node long, shingles binary").dropDuplicates(["node"])


def _common(texts: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several sets of the sample hold, sorted, and in how many."""
    count = texts.count()
    limit = min(1 << 32, int((1 << 32) * SAMPLE / max(1, count)))
    sample = _whole_sets(texts.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 32)) < limit), k)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"shingle": np.frombuffer(b"".join(pdf["shingles"]), dtype=np.int64)})

    often = sample.mapInPandas(run, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).filter("n > 1").orderBy(F.desc("n"), "shingle").limit(LAST).toPandas()
    shingle = often["shingle"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(shingle)
    return shingle[order], often["n"].to_numpy(dtype=np.int64)[order]


def prefixes(rows: DataFrame, k: int) -> DataFrame:
    """The columns of rows without text, with node, a (shingles in the set), head (the prefix, as bytes), fingerprint and parity map."""
    often, times = _common(rows.select("text"), k)
    names = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            node, size, head, maps = [], [], [], []
            for text in pdf["text"]:
                found = shingle_set(text, k)
                late = np.zeros(len(found), dtype=np.int64)
                if len(often):
                    at = np.minimum(np.searchsorted(often, found), len(often) - 1)
                    late = np.where(often[at] == found, times[at], 0)
                node.append(_node(found))
                size.append(len(found))
                head.append(found[np.argsort(late, kind="stable")[: len(found) // 5 + 1]].tobytes())
                maps.append(np.concatenate([simhash_words(found, WORDS), parity_words(found, WORDS)]))
            out = pdf[names].copy()
            if "doc_id" in names:
                out["doc_id"] = out["doc_id"].astype("Int64")
            words = np.array(maps, dtype=np.uint64).reshape(-1, 2 * WORDS).view(np.int64)
            yield out.assign(node=np.array(node, dtype=np.int64), a=np.array(size, dtype=np.int64), head=head, **{n: words[:, i] for i, n in enumerate(PRINT + PARITY)})

    kept = rows.select(*names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return rows.mapInPandas(run, f"{schema}, node long, a long, head binary, " + ", ".join(f"{n} long" for n in PRINT + PARITY))


def _verified(pairs: DataFrame, rows: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """Those pairs (u, v) whose whole sets are at 4/5 or more. Sets are made anew, of texts in pairs only."""
    used = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct()
    copy = rows.groupBy("node").agg(F.min("copy").alias("copy")).join(used, "node").select("copy")
    sets = staged(_whole_sets(texts.join(copy, "copy", "left_semi").select("text"), k))
    left = sets.select(F.col("node").alias("u"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("v"), F.col("shingles").alias("y"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = []
            for x, y in zip(pdf["x"], pdf["y"], strict=True):
                both = np.intersect1d(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64), assume_unique=True)
                keep.append(9 * len(both) >= 4 * ((len(x) + len(y)) // 8))
            yield pdf.loc[np.array(keep, dtype=bool), ["u", "v"]]

    done = staged(pairs.join(right, "v").join(left, "u").mapInPandas(run, "u long, v long"))
    discard(sets)
    return done


def _likely(x: str, y: str) -> str:
    """Whether rows x and y of the columns _OWN can be a pair: sizes, fingerprints, parity maps."""
    bits = lambda names: " + ".join(f"bit_count({x}.{n} ^ {y}.{n})" for n in names)
    return f"5 * least({x}.a, {y}.a) >= 4 * greatest({x}.a, {y}.a) and {bits(PRINT)} <= {FAR_BITS} and 9 * ({bits(PARITY)}) <= {x}.a + {y}.a"


def similar_groups(rows: DataFrame, texts: DataFrame, k: int, near: DataFrame) -> DataFrame:
    """node and root of every node that is not a root. rows: as made by prefixes(), with copy; texts: copy and text; near: links (u, v) to start with.

    The links to start with are decided by the whole sets. Then every prefix shingle links its sets to
    the least of them, so that large groups join without all their pairs; then pairs of sets that are
    still apart are taken, all of them.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n = pdf["head"].str.len().to_numpy(dtype=np.int64) // 8
            out = {"key": np.frombuffer(b"".join(pdf["head"]), dtype=np.int64)}
            yield pd.DataFrame(out | {c: np.repeat(pdf[c].to_numpy(), n) for c in ("node", "root")})

    sets = staged(rows.select(*_OWN, "head").dropDuplicates(["node"]))
    first = _verified(staged(near.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()), rows, texts, k)
    rooted = lambda df, roots: df.join(roots.select(F.col("u").alias("node"), "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    roots = staged(components(first))
    own = F.struct(*_OWN)
    # Only keys that different groups hold matter, and of keys that the same sets hold only one, with
    # their number. Its sets then get their maps.
    places = staged(rooted(sets.select("node", "head"), roots).mapInPandas(run, "key long, node long, root long"))
    holders = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"h{i}") for i in (1, 2)]
    keys = places.groupBy("key").agg(F.count("*").alias("held"), *holders, F.min("root").alias("x"), F.max("root").alias("y")).filter("x != y")
    keys = keys.groupBy("held", "h1", "h2").agg(F.min("key").alias("key"), F.count("*").alias("times")).select("key", "times")
    met = staged(places.join(keys, "key").join(sets.select(*_OWN), "node").select("key", "times", "root", own.alias("s")))
    discard(places)
    # At least n of the two prefixes are shared by a pair at 4/5: o less what the prefixes leave out.
    enough = "n >= ceil(4 * (a + b) / 9) + least(a div 5 + 1 - a, b div 5 + 1 - b)"
    counted = lambda df: df.groupBy(F.col("s.node").alias("u"), F.col("t.node").alias("v")).agg(F.sum("times").alias("n"), F.first("s.a").alias("a"), F.first("t.a").alias("b"))
    hub = met.groupBy("key").agg(F.min_by(F.struct("root", F.col("s").alias("t")), F.col("s.node")).alias("h")).select("key", F.col("h.root").alias("other"), "h.t")
    stars = counted(met.join(hub, "key").filter("root != other").filter(F.expr(_likely("s", "t"))))
    best = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("n"), "v"))
    stars = stars.filter(enough.replace("n >=", "8 * n >=", 1)).withColumn("best", best).filter(F.col("best") <= STARS)
    second = _verified(staged(stars.select("u", "v")), rows, texts, k)
    roots = staged(components(first.union(second)))
    # Sets that share a prefix shingle share its hub, the least set that holds it. Shingles of one
    # family of texts have few hubs, so pairs meet once for each hub, not once for each shingle.
    held = met.join(hub.select("key", F.col("t.node").alias("hub")), "key").groupBy("hub", F.col("s.node").alias("node")).agg(F.first("s").alias("s"))
    again = staged(rooted(held, roots))
    discard(met)
    apart = again.groupBy("hub").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x != y").select("hub")
    left = staged(again.join(apart, "hub").select("hub", "root", "s"))
    discard(again)
    right = left.select("hub", F.col("root").alias("other"), F.col("s").alias("t"))
    pairs = left.join(right, "hub").filter("root < other").filter(F.expr(_likely("s", "t"))).select(F.col("s.node").alias("u"), F.col("t.node").alias("v"))
    third = _verified(staged(pairs.distinct()), rows, texts, k)
    discard(left)
    return components(first.union(second).union(third)).withColumnRenamed("u", "node")
