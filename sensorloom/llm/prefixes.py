"""Prefix trie of conversations: what shared beginnings save, rolled up to all ancestors by pointer jumping.

A node is the digest of its turns: the xor of one SHA-256 for each (depth, turn), of which 128 bits are
kept, so prefixes are a running xor and texts never leave the scan. Only nodes with two members or more
take part in the rounds: below a node with one member there is a single chain with one leaf and
nothing to save. In round k each node at least 2^k deep adds its sums to the ancestor 2^k above and
then points 2^k further, so there are as many rounds as the depth has bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, staged
from .ordered import numbered
from .repair import crc32_sql

#: Conversations that share a beginning, and one more than the longest share.
GROUP, SHARES = 5, 9
#: Turns of a conversation that one window task sees, as a power of two; blocks meet by their totals.
BLOCK_BITS = 10
_KEY = ["k0", "k1"]


def turn_digests(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (the order over the table), mark (SHA-256 of role and text) and size (bytes of the text). Rows without conv_id take no part."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    mark = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), mark.alias("mark"), F.octet_length(text).cast("long").alias("size"))
    return numbered(rows, "conv_id", "turn", "mark")


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, length) and their turns (conv_id, depth, mark, size, length), built from the first turns of the group's head and their own later ones.

    rows: as of turn_digests. A head has at most eight turns in each of at most five conversations.
    """
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(SHARES))
    own = rows.groupBy("conv_id").agg(F.min("pos").alias("start"), F.count("*").alias("n")).withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % GROUP})
    heads = own.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    shared = F.least("h", F.coalesce("base_n", F.lit(0)))
    convs = staged(own.join(heads, "base", "left").withColumn("k", shared).withColumn("length", F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))))
    placed = rows.join(convs.select("conv_id", "start", "h", "k", "length"), "conv_id").withColumn("i", F.col("pos") - F.col("start"))
    later = placed.filter("i >= h").select("conv_id", (F.col("k") + F.col("i") - F.col("h") + 1).alias("depth"), "mark", "size", "length")
    first = placed.filter(F.col("i") < SHARES - 1).select(F.col("conv_id").alias("base"), "i", "mark", "size")
    taken = first.join(convs.filter("k > 0").select("conv_id", "base", "k", "length"), "base").filter("i < k")
    return convs, later.unionByName(taken.select("conv_id", (F.col("i") + 1).alias("depth"), "mark", "size", "length"))


def _lane(hexed: Column, at: int) -> Column:
    return F.conv(F.substring(hexed, at, 16), 16, -10).cast("long")


def prefixed(turns: DataFrame) -> DataFrame:
    """turns with the node of each prefix (k0, k1) and of the prefix before (p0, p1)."""
    step = F.sha2(F.concat(F.concat(F.col("depth").cast("string"), F.lit(":")).cast("binary"), "mark"), 256)
    rows = turns.withColumn("_s", step).withColumns({"g0": _lane(F.col("_s"), 1), "g1": _lane(F.col("_s"), 17), "block": F.shiftright(F.col("depth") - 1, BLOCK_BITS)}).drop("_s", "mark")
    inside = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows_in = rows.withColumns({k: F.bit_xor(g).over(inside) for k, g in (("k0", "g0"), ("k1", "g1"))})
    totals = rows.filter(F.col("length") > (1 << BLOCK_BITS)).groupBy("conv_id", "block").agg(F.bit_xor("g0").alias("t0"), F.bit_xor("g1").alias("t1"))
    above = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("conv_id", "block", F.bit_xor("t0").over(above).alias("b0"), F.bit_xor("t1").over(above).alias("b1")).filter("block > 0")
    later = rows_in.filter("block > 0").join(before, ["conv_id", "block"]).withColumns({"k0": F.col("k0").bitwiseXOR(F.col("b0")), "k1": F.col("k1").bitwiseXOR(F.col("b1"))}).drop("b0", "b1")
    out = rows_in.filter("block = 0").unionByName(later)
    return out.select("conv_id", "depth", "size", "length", *_KEY, F.col("k0").bitwiseXOR(F.col("g0")).alias("p0"), F.col("k1").bitwiseXOR(F.col("g1")).alias("p1"))


def rolled_up(nodes: DataFrame, deepest: int, *sums: str) -> DataFrame:
    """k0, k1 and the sums over each node's subtree. nodes: k0, k1, p0, p1, depth and the nodes' own sums."""
    state, step = staged(nodes.select(*_KEY, F.col("p0").alias("to0"), F.col("p1").alias("to1"), "depth", *sums)), 1
    while step <= deepest:
        up = state.filter(F.col("depth") >= step)
        given = up.groupBy(F.col("to0").alias("k0"), F.col("to1").alias("k1")).agg(*[F.sum(c).alias(f"_{c}") for c in sums])
        added = state.join(given, _KEY, "left").select(*_KEY, "to0", "to1", "depth", *[(F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0))).alias(c) for c in sums])
        further = up.select(F.col("k0").alias("to0"), F.col("k1").alias("to1"), F.col("to0").alias("n0"), F.col("to1").alias("n1"))
        jumping = added.filter(F.col("depth") >= 2 * step).join(further, ["to0", "to1"]).select(*_KEY, F.col("n0").alias("to0"), F.col("n1").alias("to1"), "depth", *sums)
        before, state = state, staged(added.filter(F.col("depth") < 2 * step).unionByName(jumping))
        discard(before)
        step *= 2
    return state.select(*_KEY, *sums)


def _end_digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The digest of the ids that end at each node; rows stream by in order, and none are held."""
    key, hashed, rows = None, None, []
    for pdf in batches:
        for k0, k1, conv_id in zip(pdf["k0"].tolist(), pdf["k1"].tolist(), pdf["conv_id"].tolist(), strict=True):
            if (k0, k1) == key:
                hashed.update(b",%d" % conv_id)
                continue
            if key is not None:
                rows.append((*key, hashed.hexdigest()))
                if len(rows) >= 4096:
                    yield pd.DataFrame(rows, columns=["k0", "k1", "ends"])
                    rows = []
            key, hashed = (k0, k1), hashlib.sha256(b"%d" % conv_id)
    if key is not None:
        rows.append((*key, hashed.hexdigest()))
    yield pd.DataFrame(rows, columns=["k0", "k1", "ends"])


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256.

    Turns go by turn (nulls first), those of one turn by the digest of role and text. Null role and text
    are empty; rows without conv_id take no part; an empty table has no nodes. Repeated rows are turns
    like others. A conversation of any length is dealt by blocks, and a node with any number of members
    is counted map-side; only the ids that end at one node stream through one task, since their
    digest can't be cut.
    """
    rows = turn_digests(conversations)
    convs, turns = rebuilt(rows)
    laid = staged(prefixed(turns))
    nothing = F.lit(None).cast("long")
    roots = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("size"), "length", F.lit(0).cast("long").alias("k0"), F.lit(0).cast("long").alias("k1"), nothing.alias("p0"), nothing.alias("p1"))
    every = laid.unionByName(roots)
    nodes = staged(
        every.groupBy(*_KEY, "depth").agg(
            F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("length").alias("longest"), F.first("size").alias("size"), F.first("p0").alias("p0"), F.first("p1").alias("p1")
        )
    )
    children = nodes.filter("depth > 0").groupBy(F.col("p0").alias("k0"), F.col("p1").alias("k1")).agg(F.count("*").alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("single"))
    met = staged(nodes.filter("n_convs > 1").join(children, _KEY, "left").fillna(0, ["n_children", "single"]))
    own = met.select(*_KEY, "p0", "p1", "depth", (F.col("single") + (F.col("n_children") == 0).cast("long")).alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved_tokens"))
    deepest = met.agg(F.max("depth")).first()[0] or 0
    sums = rolled_up(own, deepest, "n_leaves", "saved_tokens")
    ending = every.filter("depth = length").select(*_KEY, "conv_id").join(met.select(*_KEY), _KEY, "left_semi")
    ends = ending.repartition(*_KEY).sortWithinPartitions(*_KEY, "conv_id").mapInPandas(_end_digests, "k0 long, k1 long, ends string")
    told = ["k0", "k1", "p0", "p1", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    empty = F.sha2(F.lit(""), 256)
    shared = met.join(sums, _KEY).join(ends, _KEY, "left").withColumn("ends_sha256", F.coalesce("ends", empty)).select(*told)
    last = F.col("longest") == F.col("depth")
    single = nodes.filter("n_convs = 1").withColumns(
        {
            "n_children": F.when(last, 0).otherwise(1).cast("long"),
            "n_leaves": F.lit(1).cast("long"),
            "saved_tokens": F.lit(0).cast("long"),
            "ends_sha256": F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(empty),
        }
    )
    parents = met.select(F.col("k0").alias("p0"), F.col("k1").alias("p1"), F.col("conv_id").alias("_parent"))
    out = shared.unionByName(single.select(*told)).join(parents, ["p0", "p1"], "left")
    parent = F.when(F.col("depth") > 0, F.coalesce("_parent", "conv_id")).alias("parent_conv_id")  # a parent with one member has the same one
    return out.select("conv_id", "depth", parent, "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def oracle_sql() -> str:
    """The same with whole sequences as nodes, each counted once for every prefix."""
    return f"""
WITH turns AS (
  SELECT conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS mark, octet_length(encode(coalesce(text, '')))::BIGINT AS size
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list(mark ORDER BY turn NULLS FIRST, mark) AS marks, list(size ORDER BY turn NULLS FIRST, mark) AS sizes,
    {crc32_sql("conv_id::VARCHAR")} % 9 AS h FROM turns GROUP BY conv_id
), built AS (
  SELECT o.conv_id, list_concat(coalesce(b.marks, [])[1:o.h], o.marks[o.h + 1:]) AS marks, list_concat(coalesce(b.sizes, [])[1:o.h], o.sizes[o.h + 1:]) AS sizes
  FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 5
), members AS (
  SELECT conv_id, d, marks[1:d] AS node, CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS size, len(marks) = d AS ends FROM (SELECT *, unnest(generate_series(0, len(marks))) AS d FROM built)
), nodes AS (
  SELECT node, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM members GROUP BY node, d
), children AS (
  SELECT node[1:depth - 1] AS node, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1
), flagged AS (
  SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.node = n.node
), sums AS (
  SELECT node[1:d] AS node, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM (SELECT *, unnest(generate_series(0, depth)) AS d FROM flagged) GROUP BY 1
)
SELECT f.conv_id, f.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, f.ends_sha256
FROM flagged f JOIN sums s ON s.node = f.node LEFT JOIN nodes p ON f.depth > 0 AND p.node = f.node[1:f.depth - 1]"""
