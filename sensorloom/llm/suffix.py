"""Suffix-array dedup of byte strings by a logarithmic family of indexes.

Batches of candidate runs (see passages) get sparse suffix arrays: for each anchor key, its runs in
the order of the bytes that follow the anchor, and of those before it. A new batch is merge-scanned
against each existing level, which finds the strings that both have, and levels of equal size merge,
so there are about log2(batches) levels. A level is a table in the shared folder, one row for each
different run, with one bit for each of its windows. Only merges write a level. A scan against a
larger level writes what it found, as bits of runs that stand once, beside the levels: so a run is
written once with its batch and once for each merge, log2(batches) times at most.

Neighbours in both orders tell how many bytes a run shares with any other on either side, so for a
given distance of window and anchor, equal windows are runs in one group of both orders: groups are
numbered, never compared in pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged
from .passages import Passages, Runs, byte_units, covered, encoded, filed, listed, pieces, spans_of, windows_of

#: Bytes of a window, and of the grams that anchors are chosen from.
WINDOW, GRAM = 200, 16
#: Different runs of one key that stay together; the runs of a larger key are cut by what their windows share.
CROWD = 32_768
#: Rows that a task scans at once, about; keys are never cut.
_ROWS = 16_384
_LEVEL = "key long, run binary, anchor int, n int, doc long, copy long, start int, found binary"
_NAMES = [f.split()[0] for f in _LEVEL.split(", ")]


def _groups(sides: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows by (key, side), and what each shares with the one before it: -1 for another key."""
    wide = np.concatenate([key.astype(">u4").view(np.uint8).reshape(-1, 4), sides], axis=1)
    wide = np.concatenate([wide, np.zeros((len(wide), -wide.shape[1] % 8), dtype=np.uint8)], axis=1)
    order = np.lexsort(np.ascontiguousarray(wide).view(">u8").astype(np.uint64).T[::-1])
    sides, key = sides[order], key[order]
    differ = sides[1:] != sides[:-1]
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), sides.shape[1])
    return order, np.where(key[1:] == key[:-1], shared, -1)


def shared_windows(key: np.ndarray, runs: list[bytes], anchor: np.ndarray, window: int, gram: int) -> np.ndarray:
    """For rows in order of their key: a flag for each window of each run that another row's run has too."""
    reach = window - gram
    flags = np.zeros((len(runs), reach + 1), dtype=bool)
    change = np.concatenate([[True], key[1:] != key[:-1], [True]])
    some = np.nonzero(~(change[:-1] & change[1:]))[0]  # a key with one row has no other to share with
    if not len(some):
        return flags
    runs, key, anchor = [runs[i] for i in some.tolist()], key[some], anchor[some]
    length = np.fromiter(map(len, runs), dtype=np.int64, count=len(runs))
    count = length - window + 1
    data = np.frombuffer(b"".join([bytes(window), *runs, bytes(window)]), dtype=np.uint8)
    at = window + np.cumsum(length) - length + anchor
    number = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
    # Bytes beyond a run's ends stand behind those that its windows have, so no window reads them.
    right, right_shared = _groups(data[at[:, None] + np.arange(window)], number)
    left, left_shared = _groups(data[at[:, None] - 1 - np.arange(reach)], number)
    rank_right, rank_left = np.empty_like(right), np.empty_like(left)
    rank_right[right], rank_left[left] = np.arange(len(runs)), np.arange(len(runs))
    for before in range(reach + 1):
        rows = np.nonzero((before <= anchor) & (before > anchor - count))[0]
        if len(rows) < 2:
            continue
        same_right = np.concatenate([[0], np.cumsum(right_shared < window - before)])[rank_right[rows]]
        same_left = np.concatenate([[0], np.cumsum(left_shared < before)])[rank_left[rows]]
        both = same_right * len(runs) + same_left
        order = np.argsort(both)
        equal = both[order[1:]] == both[order[:-1]]
        rows = rows[order]
        for found in (rows[1:][equal], rows[:-1][equal]):
            flags[some[found], anchor[found] - before] = True
    return flags


def _whole_keys(settle: Callable[[pa.Table], pa.Table]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows that come in order of their key go through settle, about _ROWS at once, and never a part of a key."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < _ROWS:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            key = table.column("key").to_numpy()
            cut = int(np.nonzero(key != key[-1])[0][-1]) + 1 if key[0] != key[-1] else 0  # the last key may go on
            if cut:
                yield from settle(table.slice(0, cut)).combine_chunks().to_batches()
            held = table.slice(cut).to_batches()
        if held:
            yield from settle(pa.Table.from_batches(held).combine_chunks()).combine_chunks().to_batches()

    return scan


@dataclass(frozen=True)
class Level:
    """So many batches as one stored table of runs."""

    size: int
    rows: DataFrame


class IndexFamily:
    """The levels of the family, the newest last, and what scans against larger levels found. Batches have the columns of a level, without found."""

    def __init__(self, window: int = WINDOW, gram: int = GRAM):
        self.window, self.gram = window, gram
        self.levels: list[Level] = []
        self.findings: list[DataFrame] = []
        #: Batches in each level written so far.
        self.written: list[int] = []

    def _level(self, size: int, rows: DataFrame) -> Level:
        """Flag windows that several runs of a key have, make one row of equal runs, and write the level."""
        window, gram = self.window, self.gram

        def settle(table: pa.Table) -> pa.Table:
            key = table.column("key").to_numpy()
            runs, anchor = table.column("run").to_pylist(), table.column("anchor").to_numpy().astype(np.int64)
            flags = np.packbits(shared_windows(key, runs, anchor, window, gram), axis=1)
            flags |= np.frombuffer(b"".join(table.column("found").to_pylist()), dtype=np.uint8).reshape(flags.shape)
            table = table.set_column(table.schema.get_field_index("found"), "found", pa.array([f.tobytes() for f in flags], pa.binary()))
            first, n = {}, table.column("n").to_numpy().copy()
            for i, name in enumerate(zip(key.tolist(), anchor.tolist(), runs, strict=True)):
                j = first.setdefault(name, i)
                if i != j:
                    n[j] = 2
            if len(first) < len(runs):
                table = table.set_column(table.schema.get_field_index("n"), "n", pa.array(n, pa.int32())).take(pa.array(list(first.values())))
            return table

        self.written.append(size)
        return Level(size, staged(rows.select(*_NAMES).repartition("key").sortWithinPartitions("key").mapInArrow(_whole_keys(settle), _LEVEL)))

    def _found(self, level: Level, new: Level) -> DataFrame:
        """doc, copy, start, count and found of the runs of either that stand once and have windows that the other has, too."""
        window, gram = self.window, self.gram

        def settle(table: pa.Table) -> pa.Table:
            key, fresh = table.column("key").to_numpy(), table.column("fresh").to_numpy().astype(np.int64)
            start = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0][: len(key)]
            count = np.diff(np.append(start, len(key)))
            of_new = np.add.reduceat(np.append(fresh, 0), start) if len(start) else count
            table = table.filter(pa.array(np.repeat((of_new > 0) & (of_new < count), count)))  # keys that both have
            runs, anchor = table.column("run").to_pylist(), table.column("anchor").to_numpy().astype(np.int64)
            flags = np.packbits(shared_windows(table.column("key").to_numpy(), runs, anchor, window, gram), axis=1)
            if len(runs):
                flags &= ~np.frombuffer(b"".join(table.column("found").to_pylist()), dtype=np.uint8).reshape(flags.shape)
            some = np.nonzero(flags.any(axis=1) & (table.column("n").to_numpy() == 1))[0]
            table = table.take(pa.array(some))
            length = np.array([len(runs[i]) for i in some], dtype=np.int32)
            return pa.table(
                {
                    **{c: table.column(c) for c in ("doc", "copy", "start")},
                    "count": pa.array(length - np.int32(window - 1), pa.int32()),
                    "found": pa.array([flags[i].tobytes() for i in some], pa.binary()),
                }
            )

        rows = level.rows.select(*_NAMES, F.lit(False).alias("fresh")).union(new.rows.select(*_NAMES, F.lit(True).alias("fresh")))
        return staged(rows.repartition("key").sortWithinPartitions("key").mapInArrow(_whole_keys(settle), "doc long, copy long, start int, count int, found binary"))

    def built(self, batch: DataFrame) -> Level:
        """The suffix array of a batch, as a level of its own."""
        empty = F.lit(bytes(-(-(self.window - self.gram + 1) // 8)))
        return self._level(1, batch.select(*_NAMES[:-1], empty.alias("found")))

    def add(self, new: Level) -> None:
        """Scan a batch against the larger levels, then merge it with that of its size, and so on."""
        kept, size = len(self.levels), new.size
        while kept and self.levels[kept - 1].size == size:
            kept, size = kept - 1, 2 * size
        self.findings += [self._found(level, new) for level in self.levels[:kept]]
        while len(self.levels) > kept:
            level = self.levels.pop()
            merged = self._level(level.size + new.size, level.rows.select(*_NAMES).union(new.rows.select(*_NAMES)))
            discard(level.rows)
            discard(new.rows)
            new = merged
        self.levels.append(new)

    def alone(self) -> DataFrame:
        """doc, copy, run and later: start, count and found of each run that stands once (run), and of what larger scans found of it (later)."""
        kind = "struct<start: int, count: int, found: binary>"
        run = F.struct("start", (F.length("run") - (self.window - 1)).cast("int").alias("count"), "found").cast(kind)
        parts = [level.rows.filter("n = 1").select("doc", "copy", run.alias("run"), F.lit(None).cast(kind).alias("later")) for level in self.levels]
        parts += [found.select("doc", "copy", F.lit(None).cast(kind).alias("run"), F.struct("start", "count", "found").cast(kind).alias("later")) for found in self.findings]
        return reduce(DataFrame.union, parts)


def _collapsed(runs: DataFrame) -> DataFrame:
    """One row for each different run of a batch and key; copies go map-side. A run's row is read only where n is 1."""
    least = [F.min(c).alias(c) for c in ("doc", "copy", "start")]
    return runs.groupBy("batch", "depth", "key", "run", "anchor").agg(F.least(F.sum("n"), F.lit(2)).cast("int").alias("n"), *least)


def refined(runs: DataFrame, window: int, gram: int, crowd: int) -> DataFrame:
    """The same windows with at most about `crowd` different runs for a key.

    Windows of a crowded key are cut by their distance to the anchor, into cells of a quarter of the
    width at each step, and the bytes that all windows of a cell share go into the key. Equal windows
    stay together. A cell of width one holds equal windows only, which are one row of each batch.
    """
    done, depth, width = None, 0, window - gram + 1
    while True:
        sizes = runs.groupBy("key").agg(F.count("*").alias("different")).filter(F.col("different") > crowd).drop("different")
        if width == 1 or sizes.isEmpty():
            return runs if done is None else done.union(runs)
        depth, width = depth + 1, -(-width // 4)

        def cut(batches: Iterator[pa.RecordBatch], width=width, depth=depth) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for key, run, anchor, n, doc, copy, start, number in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    least = anchor - (len(run) - window)
                    for cell in range(least // width, anchor // width + 1):
                        low, high = max(least, cell * width), min(anchor, (cell + 1) * width - 1)
                        core = run[anchor - cell * width : anchor + window + 1 - (cell + 1) * width]
                        hashed = xxhash.xxh64_intdigest(b"%d %d %b" % (key, cell, core)) - (1 << 63)
                        out.append((hashed, run[anchor - high : anchor - low + window], high, n, doc, copy, start + anchor - high, number, depth))
                columns = list(zip(*out, strict=True)) or [[]] * 9
                kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

        names = ["key", "run", "anchor", "n", "doc", "copy", "start", "batch", "depth"]
        rest = runs.join(sizes, "key", "left_anti").select(*names)
        done = rest if done is None else done.union(rest)
        parts = runs.join(sizes, "key", "left_semi").select(*names[:-1])
        schema = "key long, run binary, anchor int, n int, doc long, copy long, start int, batch int, depth int"
        runs = staged(_collapsed(parts.mapInArrow(cut, schema))).select(*names)


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = 4) -> DataFrame:
    """doc_id, n_bytes, n_removed, kept (the bytes left) and removed (spans of bytes) of every row.

    A byte goes if a string of `window` bytes covers it that also starts anywhere else, in the same
    or another row. Null texts count as empty. Every row is judged by itself, whatever its id: rows
    that repeat count each, so both lose what they share; rows without an id and rows that repeat an
    id with other texts are documents of their own. An empty table gives no rows. Columns other than
    doc_id and text are not read.
    """
    passages = Passages(byte_units, window, gram)
    rows = filed(docs)
    keyed = passages.repeated_keys(rows)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs_, copies = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for raws, at in pieces(encoded(batch.column(2))):
                _, found = passages.runs(raws)
                found = found.among(listed(batch.column(3).slice(at, len(raws))))
                seen: dict = {}
                for text, key, first, count, anchor in zip(found.text.tolist(), found.key.tolist(), found.first.tolist(), found.count.tolist(), found.anchor.tolist(), strict=True):
                    run = raws[text][first : first + count + window - 1]
                    held = seen.get((key, run, anchor))
                    if held is None:
                        seen[key, run, anchor] = [1, docs_[at + text], copies[at + text], first]
                    else:
                        held[0] += 1
                columns = [*([k[i] for k in seen] for i in range(3)), *([h[i] for h in seen.values()] for i in range(4))]
                kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["key", "run", "anchor", "n", "doc", "copy", "start"])

    found = rows.join(keyed, "place").select("doc", "copy", "text", "keys").mapInArrow(cut, "key long, run binary, anchor int, n int, doc long, copy long, start int")
    dealt = found.withColumn("batch", F.pmod(F.xxhash64("doc", "copy", F.lit(5)), F.lit(batches)).cast("int")).withColumn("depth", F.lit(0))
    known = staged(_collapsed(dealt))
    open_ = refined(known, window, gram, CROWD)
    family = IndexFamily(window, gram)
    for b in range(batches):
        new = family.built(open_.filter(F.col("batch") == b))
        if b == batches - 1:
            discard(known)
        family.add(new)
    settled = family.alone().groupBy("doc", "copy").agg(F.collect_list("run").alias("alone"), F.collect_list("later").alias("later"))

    def clear(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raws, at in pieces(encoded(batch.column(1))):
                part = batch.slice(at, len(raws))
                held = part.column(2).is_valid().to_pylist()
                units, found = passages.runs([r if h else b"" for r, h in zip(raws, held, strict=True)])  # the rest stays as it is
                found = found.among(listed(part.column(2)))
                twice = np.zeros(len(units.units), dtype=bool)
                twice[windows_of(found, units.start)] = True
                twice[_windows(part.column(3), units.start, False)] = False
                twice[_windows(part.column(4), units.start, True)] = True
                gone = covered(twice, window)
                removed = np.add.reduceat(np.concatenate([gone, [False]]).astype(np.int64), units.start[:-1]) * (np.diff(units.start) > 0)
                left, spans = [], []
                for i, raw in enumerate(raws):
                    cuts = spans_of(gone[units.start[i] : units.start[i + 1]]) if removed[i] else []
                    ends = [0, *(x for c in cuts for x in c), None]
                    spans.append([{"start": a, "end": b} for a, b in cuts])
                    left.append(b"".join(raw[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)) if cuts else raw)
                place = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(r) for r in raws], pa.int64()), pa.array(removed), pa.array(left, pa.binary()), pa.array(spans, place)], names=["doc_id", "n_bytes", "n_removed", "kept", "removed"])

    done = rows.join(keyed, "place", "left").join(settled, ["doc", "copy"], "left").select("id", "text", "keys", "alone", "later")
    return done.mapInArrow(clear, "doc_id long, n_bytes long, n_removed long, kept binary, removed array<struct<start: int, end: int>>")


def _windows(column: pa.Array, start: np.ndarray, flagged: bool) -> np.ndarray:
    """For lists of (start, count, found) of each text: the windows with a flag, or those without, counted over all texts."""
    held = column.flatten()
    if not len(held):
        return np.zeros(0, dtype=np.int64)
    text = pc.list_parent_indices(column).to_numpy(zero_copy_only=False)
    first, count = (held.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("start", "count"))
    at = windows_of(Runs(text, text, first, count, text), start)
    flags = np.unpackbits(np.frombuffer(b"".join(held.field("found").to_pylist()), dtype=np.uint8).reshape(len(held), -1), axis=1)
    return at[flags[np.arange(flags.shape[1]) < count[:, None]] == flagged]
