"""Structure repair of conversations: cheapest edits that give roles `(s?(ua)+)?`, by a scan of min-plus matrices.

A turn is a 4x4 matrix over the states start, system, user, assistant; its elements are (cost, audit),
added by min and multiplied by summing costs and joining audits, and it starts with the closure of
inserts. The product is associative, so the turns of a segment are multiplied in a task, segments
meet in a tree over (conversation, node), and a pass down the tree gives each segment the states that
it is entered and left by. No task holds a conversation. Two audits of equal cost are never prefixes of
each other (the audit gives the cost), so the least of them stays least in any product.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, staged
from .ordered import numbered

#: Rows of the numbered table in a segment, as a power of two, and children of a node of the tree.
SEGMENT_BITS, NODE_BITS = 10, 6
DAMAGES = 20
INSERT, REROLE, DELETE, TRUNCATED = 3, 3, 4, 3
_BLANK = " \t\n\x0b\x0c\r"
_SIDES = "sua"
#: By state: where an inserted or reroled turn leads to, and its role.
_NEXT = {0: 2, 1: 2, 2: 3, 3: 2}
_ROLE = {2: "user", 3: "assistant"}
#: By initial: the moves between states that a kept turn makes.
_MOVES = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
_FINAL = (0, 3)

Matrix = list  # 16 elements (cost, audit), None where no edits lead from one state to the other


def _sum(a: tuple | None, b: tuple | None) -> tuple | None:
    return b if a is None else a if b is None else min(a, b)


def times(a: Matrix, b: Matrix) -> Matrix:
    out: Matrix = [None] * 16
    for i in range(4):
        for k in range(4):
            left = a[4 * i + k]
            if left is not None:
                for j in range(4):
                    right = b[4 * k + j]
                    if right is not None:
                        out[4 * i + j] = _sum(out[4 * i + j], (left[0] + right[0], left[1] + right[1]))
    return out


def _unit() -> Matrix:
    return [(0, "") if i % 5 == 0 else None for i in range(16)]


def _closure() -> Matrix:
    """Any number of inserts; more than three only go round."""
    step = _unit()
    for i, j in _NEXT.items():
        step[4 * i + j] = _sum(step[4 * i + j], (INSERT, "I"))
    return times(times(step, step), step)


CLOSURE = _closure()


def turn_matrix(code: str) -> Matrix:
    """The edits of one turn behind the closure. code: A + 4 * side (s, u, a, other) + fault (none, blank, duplicate, truncated)."""
    side, fault = divmod(ord(code) - 65, 4)
    out: Matrix = [None] * 16
    for i in range(4):
        out[5 * i] = (DELETE, "D")
        if fault not in (1, 2):
            extra = TRUNCATED if fault == 3 else 0
            kept = _MOVES[_SIDES[side]].get(i) if side < 3 else None
            if kept is not None:
                out[4 * i + kept] = _sum(out[4 * i + kept], (extra, "K"))
            out[4 * i + _NEXT[i]] = _sum(out[4 * i + _NEXT[i]], (REROLE + extra, "R"))
    return times(CLOSURE, out)


_TURNS = {chr(65 + i): turn_matrix(chr(65 + i)) for i in range(16)}


@lru_cache(maxsize=4096)
def _short(codes: str) -> Matrix:
    return times(_short(codes[:-1]), _TURNS[codes[-1]]) if codes else _unit()


def segment_matrix(codes: str) -> Matrix:
    """The product of the turns of a segment; short ones are remembered."""
    out = _short(codes[:8])
    for c in codes[8:]:
        out = times(out, _TURNS[c])
    return out


def joined(parts: list[dict]) -> dict:
    """The summary of neighbouring parts: matrix, illegal pairs and turns, with what their seams add."""
    out = dict(parts[0])
    for p in parts[1:]:
        out["matrix"] = times(out["matrix"], p["matrix"])
        out["illegal"] += p["illegal"] + bool(out["last"] and p["first"] and out["last"] + p["first"] not in ("su", "ua", "au"))
        out["first"], out["last"] = out["first"] or p["first"], p["last"] or out["last"]
        out["turns"] += p["turns"] - (out["hi"] is not None and out["hi"] == p["lo"])
        out["lo"] = p["lo"] if out["lo"] is None else out["lo"]
        out["hi"] = out["hi"] if p["hi"] is None else p["hi"]
        for name in ("blank", "duplicate", "truncated"):
            out[name] += p[name]
    return out


def damaged(conversations: DataFrame) -> DataFrame:
    """key, turn, role and text after the damage; dropped rows stay, without role and text, so that no conversation is lost."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn"))), F.lit(DAMAGES))
    rows = conversations.select(word("conv_id").alias("key"), F.col("turn").cast("long").alias("turn"), word("role").alias("role"), word("text").alias("text"), kind.alias("kind"))
    rows = rows.withColumns(
        {
            "role": F.when(F.col("kind") == 4, "user").when(F.col("kind") != 0, F.col("role")),
            "text": F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).when(F.col("kind") != 0, F.col("text")),
        }
    )
    return rows.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("kind", "copy")


def undamaged(conversations: DataFrame) -> DataFrame:
    """The rows as they are, for repair without a test's damage; nulls read as one space."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return conversations.select(word("conv_id").alias("key"), F.col("turn").cast("long").alias("turn"), word("role").alias("role"), word("text").alias("text"))


def _faults(rows: DataFrame) -> DataFrame:
    shown = F.rtrim(F.col("text"), F.lit(_BLANK))
    initial = F.substring("role", 1, 1)
    side = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    mark = F.sha2(F.concat(F.length("key").cast("string"), F.lit(":"), "key", F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    fault = F.when(shown == "", 1).when(~F.substring(shown, -1, 1).isin(".", "!", "?"), 3).otherwise(0)
    return rows.withColumns({"side": F.when(F.col("role").isNotNull(), side), "fault": F.when(F.col("role").isNotNull(), fault), "mark": F.unhex(mark)})


def _leaf_kind(pdf: pd.DataFrame) -> Iterator[dict]:
    for r in pdf.to_dict("records"):
        codes = r.pop("codes")
        sides = ["sua-"[(ord(c) - 65) // 4] for c in codes]
        r["first"], r["last"] = (sides[0], sides[-1]) if sides else ("", "")
        r["illegal"] = sum(a + b not in ("su", "ua", "au") for a, b in zip(sides, sides[1:], strict=False))
        r["matrix"] = segment_matrix(codes)
        yield r


_SUMMARY = "lo string, hi string, turns long, blank long, duplicate long, truncated long, first string, last string, illegal long, costs array<long>, audits array<string>"
_NODE = f"key string, node long, {_SUMMARY}"
_FIELDS = [f.split()[0] for f in _NODE.split(", ")]


def _packed(rows: list[dict], columns: list[str]) -> pd.DataFrame:
    for r in rows:
        matrix = r.pop("matrix")
        r["costs"], r["audits"] = [m and m[0] for m in matrix], [m and m[1] for m in matrix]
    return pd.DataFrame(rows, columns=columns)


def _matrix(costs, audits) -> Matrix:
    return [None if a is None else (int(c), a) for c, a in zip(costs, audits, strict=True)]


def _leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield _packed(list(_leaf_kind(pdf)), _FIELDS)


def _opened(parts) -> list[dict]:
    out = []
    for p in parts:
        d = {k: p[k] for k in _FIELDS[1:] if k not in ("costs", "audits")}
        d["matrix"] = _matrix(p["costs"], p["audits"])
        out.append(d)
    return out


def _parents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for key, node, parts in zip(pdf["key"], pdf["up"], pdf["parts"], strict=True):
            rows.append(joined(_opened(parts)) | {"key": key, "node": node})
        yield _packed(rows, _FIELDS)


def _steps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For a node with its way in and out: the ways of its children."""
    for pdf in batches:
        rows = []
        for key, parts, entry, leave, tail in zip(pdf["key"], pdf["parts"], pdf["entry"], pdf["leave"], pdf["tail"], strict=True):
            matrices = [_matrix(p["costs"], p["audits"]) for p in parts]
            best = {entry: (0, "", [entry])}
            for m in matrices:
                reached: dict = {}
                for k, (cost, audit, way) in best.items():
                    for j in range(4):
                        if (e := m[4 * k + j]) is not None and (j not in reached or (cost + e[0], audit + e[1]) < reached[j][:2]):
                            reached[j] = (cost + e[0], audit + e[1], [*way, j])
                best = reached
            way = best[leave][2]
            rows += [(key, p["node"], way[i], way[i + 1], tail if i + 1 == len(parts) else "") for i, p in enumerate(parts)]
        yield pd.DataFrame(rows, columns=["key", "node", "entry", "leave", "tail"])


def _roots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """cost, audit and the way through each conversation."""
    for pdf in batches:
        rows = []
        for costs, audits in zip(pdf["costs"], pdf["audits"], strict=True):
            m = _matrix(costs, audits)
            rows.append(min((m[k][0] + CLOSURE[4 * k + j][0], m[k][1] + CLOSURE[4 * k + j][1], k, CLOSURE[4 * k + j][1]) for k in range(4) if m[k] for j in _FINAL if CLOSURE[4 * k + j]))
        yield pdf.drop(columns=["costs", "audits", "first", "last"]).assign(cost=[r[0] for r in rows], audit=[r[1] for r in rows], entry=0, leave=[r[2] for r in rows], tail=[r[3] for r in rows])


def _with_children(level: DataFrame) -> DataFrame:
    part = F.struct("node", *[c for c in _FIELDS if c not in ("key", "node")])
    return level.groupBy("key", F.shiftright("node", NODE_BITS).alias("up")).agg(F.sort_array(F.collect_list(part)).alias("parts"))  # at most 64 children


class Repair:
    """The repair of a table of key, turn, role and text: report and segments are one row for each conversation and segment."""

    def __init__(self, rows: DataFrame):
        self.rows = numbered(_faults(rows), "key", "turn", "role", "mark").withColumn("node", F.shiftright("pos", SEGMENT_BITS))
        shown = self.rows.filter(F.col("fault").isin(0, 3))
        again = shown.groupBy("mark").agg(F.min("pos").alias("earliest"), F.count("*").alias("n")).filter("n > 1").drop("n")
        light = self.rows.select("key", "node", "pos", "turn", "side", "fault", F.when(F.col("fault") != 1, F.col("mark")).otherwise(F.unhex(F.hex("pos"))).alias("mark"))  # else a key of its own
        fault = F.when(F.col("pos") > F.col("earliest"), 2).otherwise(F.col("fault"))
        coded = light.join(again, "mark", "left").withColumn("fault", fault)
        code = F.when(F.col("side").isNotNull(), F.char(65 + 4 * F.col("side") + F.col("fault")))
        counts = {name: F.count(F.when(F.col("fault") == i, 1)) for i, name in enumerate(("blank", "duplicate", "truncated"), 1)}
        turns = F.when(F.col("side").isNotNull(), F.col("turn"))
        leaves = coded.groupBy("key", "node").agg(  # at most 1,024 rows
            F.sort_array(F.collect_list(F.when(code.isNotNull(), F.struct("pos", code.alias("code"))))).alias("codes"),
            F.min(turns).cast("string").alias("lo"),
            F.max(turns).cast("string").alias("hi"),
            F.size(F.collect_set(turns)).cast("long").alias("turns"),
            *[c.alias(name) for name, c in counts.items()],
        )
        leaves = leaves.withColumn("codes", F.array_join(F.transform("codes", lambda x: x["code"]), ""))
        self.leaves = staged(leaves.mapInPandas(_leaves, _NODE))
        self._grow()

    def _grow(self) -> None:
        """Up the tree, as long as a conversation has several nodes, and down again to the way through each segment."""
        several = self.leaves.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
        level, levels = self.leaves.join(several, "key", "left_semi"), []
        while not level.isEmpty():
            levels.append(level)
            level = staged(_with_children(level).mapInPandas(_parents, _NODE))
            if level.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
                break
        whole = self.leaves.join(several, "key", "left_anti")
        found = "key string, node long, lo string, hi string, turns long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, entry int, leave int, tail string"
        self.report = staged((whole.unionByName(level) if levels else whole).mapInPandas(_roots, found))
        way = "key string, node long, entry int, leave int, tail string"
        ways = self.report.select("key", "node", "entry", "leave", "tail")
        if levels:
            alone, down = ways.join(several, "key", "left_anti"), ways.join(several, "key", "left_semi")
            for lower in reversed(levels):
                met = _with_children(lower).join(down.withColumnRenamed("node", "up"), ["key", "up"])
                down = staged(met.mapInPandas(_steps, way))
            ways = alone.unionByName(down)
        piece = F.concat(F.get("audits", 4 * F.col("entry") + F.col("leave")), "tail")
        self.segments = self.leaves.select("key", "node", "audits").join(ways, ["key", "node"]).select("key", "node", "entry", piece.alias("piece"))
        self._levels = levels[1:] + ([level] if levels else [])

    def _stream(self, *dealt: str) -> DataFrame:
        """Rows behind the edits of their segment, in order."""
        edits = self.segments.select("key", "node", F.lit(-1).cast("long").alias("pos"), "entry", "piece", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
        rows = self.rows.filter("side is not null").select("key", "node", "pos", F.lit(0).alias("entry"), F.lit(None).cast("string").alias("piece"), "role", "text")
        return edits.unionByName(rows).repartition(*dealt).sortWithinPartitions("key", "node", "pos")

    def turns(self) -> DataFrame:
        """The repaired turns: conv_id, segment and place (their order), edit, role and text. No key meets as a whole."""
        out = self._stream("key", "node").mapInPandas(_repaired, "key string, segment long, place long, edit string, role string, text string")
        return out.select(_conv_id(), "segment", "place", "edit", "role", "text")

    def digests(self) -> DataFrame:
        """key and the SHA-256 of each repaired conversation, whose turns stream by in order; a digest can't be cut, but nothing is held."""
        return self._stream("key").mapInPandas(_digests, "key string, repaired_sha256 string")

    def discard(self) -> None:
        """Delete the tables between steps, once results are written."""
        for t in (self.rows, self.leaves, *self._levels):
            discard(t)


def _conv_id() -> Column:
    return F.expr("try_cast(key as long)").alias("conv_id")


def _edits(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """(key, segment, edit, role, text) of each edit in order; ("key", segment, "", None, None) where a segment begins."""
    key = node = None
    state, piece, at = 0, "", 0

    def inserts() -> Iterator[tuple]:
        nonlocal state, at
        while at < len(piece) and piece[at] == "I":
            state, at = _NEXT[state], at + 1
            yield key, node, "I", _ROLE[state], ""

    for pdf in batches:
        for k, n, pos, entry, own, role, text in zip(*(pdf[c].tolist() for c in ("key", "node", "pos", "entry", "piece", "role", "text")), strict=True):
            if pos < 0:
                key, node, state, piece, at = k, n, entry, own, 0
                yield key, node, "", None, None
                yield from inserts()
                continue
            letter, at = piece[at], at + 1
            if letter == "K":
                state = _MOVES[role[0]][state]
            elif letter == "R":
                state = _NEXT[state]
                role = _ROLE[state]
            yield key, node, letter, role, text
            yield from inserts()


def _repaired(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["key", "segment", "place", "edit", "role", "text"]
    rows, size, place = [], 0, 0
    for key, node, edit, role, text in _edits(batches):
        if edit == "":
            place = 0
        elif edit != "D":
            rows.append((key, node, place, edit, role, text))
            place, size = place + 1, size + len(text)
        if len(rows) >= 4096 or size > 1 << 23:
            yield pd.DataFrame(rows, columns=names)
            rows, size = [], 0
    yield pd.DataFrame(rows, columns=names)


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows, key, hashed, any_yet = [], None, None, False
    for k, _, edit, role, text in _edits(batches):
        if k != key:
            if key is not None:
                rows.append((key, hashed.hexdigest()))
                if len(rows) >= 4096:
                    yield pd.DataFrame(rows, columns=["key", "repaired_sha256"])
                    rows = []
            key, hashed, any_yet = k, hashlib.sha256(), False
        if edit and edit != "D":
            hashed.update(f"{chr(10) if any_yet else ''}{role}:{text}".encode("utf-8", "replace"))
            any_yet = True
    if key is not None:
        rows.append((key, hashed.hexdigest()))
    yield pd.DataFrame(rows, columns=["key", "repaired_sha256"])


def reports(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of each conversation.

    Rows go by turn, nulls first; rows of one turn by role, then by the digest of role and text. Null
    role, text and ids read as one space, and the rows without an id are one conversation, whose id
    is null. A conversation whose rows are all dropped has zeros, no audit and the digest of nothing.
    Empty tables give no rows. Other columns are not read, and texts are read whole.
    """
    done = Repair(rows)
    gaps = F.coalesce(F.col("hi").cast("long") - F.col("lo").cast("long") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    kept = ["blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    return done.report.join(done.digests(), "key").select(_conv_id(), gaps, *kept, "repaired_sha256")


_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split({0}, ''), lambda c: ord(c)::BIGINT)),
    lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned crc32 of an ASCII text that isn't empty."""
    return _CRC.format(text)


def oracle_sql() -> str:
    """The same by dynamic programming over turns, and roles from the parity of what is left."""
    return f"""
WITH RECURSIVE named AS (
  SELECT conv_id, coalesce(conv_id::VARCHAR, ' ') AS key, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind FROM conversations
), hurt AS (
  SELECT key, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM named WHERE kind <> 0
), placed AS (
  SELECT key, turn, role, text, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS shown,
    row_number() OVER (PARTITION BY key ORDER BY turn NULLS FIRST, role, sha256(length(key) || ':' || key || length(role) || ':' || role || text)) AS rn
  FROM hurt
), faulty AS (
  SELECT key, turn, role, text, rn, CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE '-' END AS side,
    CASE WHEN shown = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY key, role, text ORDER BY rn) > 1 THEN 'duplicate' WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault
  FROM placed
), closure(i, k, cost, audit) AS (
  VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 3, 'I'), (0, 3, 6, 'II'), (1, 2, 3, 'I'), (1, 3, 6, 'II'), (2, 3, 3, 'I'), (3, 2, 3, 'I')
), kept(side, k, j) AS (VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)
), edits AS (
  SELECT fault, '' AS side, k, k AS j, 4 AS cost, 'D' AS audit FROM (VALUES ('none'), ('truncated'), ('blank'), ('duplicate')) f(fault), (VALUES (0), (1), (2), (3)) s(k)
  UNION ALL SELECT fault, side, k, j, extra, 'K' FROM kept, (VALUES ('none', 0), ('truncated', 3)) f(fault, extra)
  UNION ALL SELECT fault, '', k, j, 3 + extra, 'R' FROM (VALUES (0, 2), (1, 2), (2, 3), (3, 2)) s(k, j), (VALUES ('none', 0), ('truncated', 3)) f(fault, extra)
), steps AS (
  SELECT e.fault, e.side, c.i, e.j, c.cost + e.cost AS cost, c.audit || e.audit AS audit FROM closure c JOIN edits e USING (k)
), ways AS (
  SELECT DISTINCT key, 0::BIGINT AS rn, 0 AS state, {{'cost': 0, 'audit': ''}} AS best FROM named
  UNION ALL
  SELECT w.key, f.rn, s.j, min({{'cost': w.best.cost + s.cost, 'audit': w.best.audit || s.audit}})
  FROM ways w JOIN faulty f ON f.key = w.key AND f.rn = w.rn + 1 JOIN steps s ON s.fault = f.fault AND s.i = w.state AND (s.side = '' OR s.side = f.side)
  GROUP BY w.key, f.rn, s.j
), sizes AS (
  SELECT n.key, any_value(n.conv_id) AS conv_id, coalesce(max(f.n), 0) AS n FROM named n LEFT JOIN (SELECT key, count(*) AS n FROM faulty GROUP BY key) f ON f.key = n.key GROUP BY n.key
), done AS (
  SELECT z.key, z.conv_id, min({{'cost': w.best.cost + c.cost, 'audit': w.best.audit || c.audit}}) AS best
  FROM sizes z JOIN ways w ON w.key = z.key AND w.rn = z.n JOIN closure c ON c.i = w.state WHERE c.k IN (0, 3) GROUP BY z.key, z.conv_id
), letters AS (
  SELECT key, p, best.audit[p] AS letter, length(replace(best.audit, 'D', '')) AS total,
    length(replace(best.audit[1:p], 'I', '')) AS rn, length(replace(best.audit[1:p], 'D', '')) AS place
  FROM (SELECT key, best, unnest(generate_series(1, length(best.audit))) AS p FROM done)
), rebuilt AS (
  SELECT l.key, string_agg(CASE WHEN letter = 'K' THEN f.role WHEN (place + total) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE f.text END, chr(10) ORDER BY p) AS whole
  FROM letters l LEFT JOIN faulty f ON f.key = l.key AND f.rn = l.rn WHERE letter <> 'D' GROUP BY l.key
), counted AS (
  SELECT key, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT *, lag(side) OVER (PARTITION BY key ORDER BY rn) || side AS pair FROM faulty) GROUP BY key
)
SELECT d.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, d.best.cost::BIGINT AS cost, d.best.audit AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM done d LEFT JOIN counted c ON c.key = d.key LEFT JOIN rebuilt r ON r.key = d.key"""
