"""Candidate passages: where a window of fixed length can occur twice, found by content-chosen anchors.

Each window takes the k-gram of least hash in it as its anchor (the first of equals). Equal windows
have equal anchors at equal offsets, so a window whose anchor occurs once occurs once. Windows in a
row with one anchor make a run; a run's units are all that is needed to compare its windows. Hashes
only choose candidates: texts are compared as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged, whole_text

#: Odd multipliers of the rolling and the finishing step.
_ROLL, _FINISH = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: Windows that one numpy step handles (arrays that fit a core's cache); places in it fit into 24 bits.
_STEP = 1 << 16
#: Bytes of texts that are handled at once, and that are hashed at once.
_BATCH, _HASHED = 4 << 20, 1 << 17
_BYTE = np.array([xxhash.xxh64_intdigest(bytes([b]), 7) for b in range(256)], dtype=np.uint64)
_PLACE = np.array([pow(_ROLL, i, 1 << 64) for i in range(64)], dtype=np.uint64)
_SPACE = np.isin(np.arange(256), np.frombuffer(b" \t\n\x0b\x0c\r", dtype=np.uint8))

#: Hashes of bytes in words; white space adds nothing.
_LETTER = np.where(_SPACE, np.uint64(0), _BYTE)


def grams(units: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k consecutive units (uint64), built by joining grams of doubling length."""
    out, width, power = units, 1, _ROLL
    made, made_width = None, 0
    bits = k
    while bits:
        if bits & 1:
            if made is None:
                made, made_width = out, width
            else:
                n = len(units) - made_width - width + 1
                made = made[:n] + out[made_width : made_width + n] * np.uint64(pow(_ROLL, made_width, 1 << 64))
                made_width += width
        bits >>= 1
        if bits:
            n = len(units) - 2 * width + 1
            out = out[:n] + out[width : width + n] * np.uint64(power)
            width, power = 2 * width, power * power % (1 << 64)
    made = (made ^ (made >> np.uint64(32))) * np.uint64(_FINISH)
    return made ^ (made >> np.uint64(29))


def _sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    width = 1
    while 2 * width <= w:
        v = np.minimum(v[:-width], v[width:])
        width *= 2
    return np.minimum(v[: len(v) - (w - width)], v[w - width :]) if w > width else v


@dataclass(frozen=True)
class Units:
    """The units of several texts after each other: uint64 each, or bytes, and where each text starts (and the last ends)."""

    units: np.ndarray
    start: np.ndarray


def byte_units(raws: list[bytes]) -> Units:
    return Units(np.frombuffer(b"".join(raws), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raws])]).astype(np.int64))


def word_units(raws: list[bytes]) -> Units:
    """A hash of each word: bytes by their place in it, summed."""
    found, count, at = [np.zeros(0, dtype=np.uint64)], [], 0
    while at < len(raws):
        end, size = at, 0
        while end < len(raws) and (end == at or size + len(raws[end]) < _HASHED):
            size += len(raws[end])
            end += 1
        limits = np.cumsum([len(r) + 1 for r in raws[at:end]])
        data = np.frombuffer(b"\n".join([*raws[at:end], b""]), dtype=np.uint8)
        space = _SPACE[data]
        first = np.nonzero(~space & np.concatenate([[True], space[:-1]]))[0]
        if len(first):
            last = np.nonzero(~space & np.concatenate([space[1:], [True]]))[0] + 1
            size = last - first
            begin = np.zeros(len(data), dtype=np.int32)
            begin[first] = first
            inner = np.arange(len(data), dtype=np.int32) - np.maximum.accumulate(begin)
            value = _LETTER[data] * _PLACE[inner & 63]
            found.append(np.add.reduceat(value, first) + size.astype(np.uint64))
        count.append(np.diff(np.concatenate([[0], np.searchsorted(first, limits)])))
        at = end
    return Units(np.concatenate(found), np.concatenate([[0], np.cumsum(np.concatenate(count))]).astype(np.int64) if count else np.zeros(1, dtype=np.int64))


@dataclass(frozen=True)
class Runs:
    """Runs of several texts: the text's place, the key, the first window in the text, how many windows, and how far behind the first window's start the anchor is."""

    text: np.ndarray
    key: np.ndarray
    first: np.ndarray
    count: np.ndarray
    anchor: np.ndarray

    def among(self, keys: np.ndarray) -> Runs:
        keep = np.isin(self.key, keys)
        return Runs(self.text[keep], self.key[keep], self.first[keep], self.count[keep], self.anchor[keep])


def runs(cut: Units, window: int, k: int) -> Runs:
    n = len(cut.units) - window + 1
    empty = np.zeros(0, dtype=np.int64)
    keys, firsts, counts, anchors = [empty], [empty], [empty], [empty]
    if n > 0:
        # Windows that reach over the end of their text are none.
        edge = np.zeros(n + 1, dtype=np.int64)
        ends = cut.start[1:]
        starts = np.maximum(cut.start[:-1], ends - window + 1)
        np.add.at(edge, np.minimum(starts, n), 1)
        np.add.at(edge, np.minimum(ends, n), -1)
        inside = np.cumsum(edge[:-1]) == 0
        for at in range(0, n, _STEP):
            here = np.nonzero(inside[at : at + _STEP])[0]
            if not len(here):
                continue
            part = cut.units[at : min(len(cut.units), at + _STEP + window - 1)]
            part = grams(_BYTE[part] if part.dtype == np.uint8 else part, k)
            # The hash above, the place below: the least is the first of the least.
            least = _sliding_min((part & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(part), dtype=np.uint64), window - k + 1)
            place = (least & np.uint64(0xFFFFFF)).astype(np.int64)[here]
            first = np.concatenate([[0], np.nonzero((np.diff(place) != 0) | (np.diff(here) != 1))[0] + 1])
            keys.append(part[place[first]].view(np.int64))
            firsts.append(here[first] + at)
            counts.append(np.diff(np.concatenate([first, [len(place)]])))
            anchors.append(place[first] - here[first])
    key, first, count = np.concatenate(keys), np.concatenate(firsts), np.concatenate(counts)
    text = np.searchsorted(cut.start, first, side="right") - 1
    return Runs(text, key, first - cut.start[text], count, np.concatenate(anchors))


class Passages:
    """Candidate search for one kind of unit: `cut` turns texts as bytes into Units."""

    def __init__(self, cut, window: int, k: int):
        self.cut, self.window, self.k = cut, window, k

    def runs(self, raws: list[bytes]) -> tuple[Units, Runs]:
        cut = self.cut(raws)
        return cut, runs(cut, self.window, self.k)

    def anchors(self, rows: DataFrame) -> DataFrame:
        """key, place and n (runs with that key in the row): one row for each key of a row."""

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for raws, at in pieces(encoded(batch.column(1))):
                    _, found = self.runs(raws)
                    order = np.lexsort((found.key, found.text))
                    text, key = found.text[order], found.key[order]
                    first = np.nonzero(np.concatenate([[True], (np.diff(text) != 0) | (np.diff(key) != 0)]))[0] if len(key) else np.zeros(0, dtype=np.int64)
                    n = np.diff(np.concatenate([first, [len(key)]])).astype(np.int32)
                    ids = batch.column(0).slice(at, len(raws)).to_numpy(zero_copy_only=False)
                    yield pa.RecordBatch.from_arrays([pa.array(key[first]), pa.array(ids[text[first]]), pa.array(n)], names=["key", "place", "n"])

        return rows.select("place", "text").mapInArrow(find, "key long, place long, n int")

    def repeated_keys(self, rows: DataFrame) -> DataFrame:
        """place and the list of its keys that occur more than once in all texts together.

        Rows whose places are equal by chance share their lists: keys more, which cost time only.
        """
        found = staged(self.anchors(rows))
        twice = found.groupBy("key").agg(F.sum("n").alias("all")).filter(F.col("all") > 1).select("key")
        keyed = staged(found.join(twice, "key").groupBy("place").agg(F.collect_set("key").alias("keys")))
        discard(found)
        return keyed


def encoded(column: pa.Array) -> list[bytes]:
    """A column of strings as bytes; a lone surrogate can't be in it."""
    return column.cast(pa.binary()).to_pylist()


def pieces(raws: list[bytes], most: int = _BATCH) -> Iterator[tuple[list[bytes], int]]:
    """Texts in groups of about `most` bytes or one text, and the place of each group's first."""
    at = 0
    while at < len(raws):
        end, size = at, 0
        while end < len(raws) and (end == at or size + len(raws[end]) < most):
            size += len(raws[end])
            end += 1
        yield raws[at:end], at
        at = end


def listed(column: pa.Array) -> np.ndarray:
    """All values of a column of lists."""
    return column.flatten().to_numpy(zero_copy_only=False) if len(column) else np.zeros(0, dtype=np.int64)


def places_of(column: pa.Array, name: str, start: np.ndarray) -> np.ndarray:
    """For lists of (start, offsets) of each text: start + offset, counted over all texts; what lies beyond a text is left out."""
    held = column.flatten()
    if not len(held):
        return np.zeros(0, dtype=np.int64)
    text = pc.list_parent_indices(column).to_numpy(zero_copy_only=False)
    inner = held.field(name)
    owner = pc.list_parent_indices(inner).to_numpy(zero_copy_only=False)
    first = held.field("start").to_numpy(zero_copy_only=False).astype(np.int64)
    at = start[text[owner]] + first[owner] + inner.flatten().to_numpy(zero_copy_only=False)
    return at[at < start[text[owner] + 1]]


def filed(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows that are told apart by what they hold, never by doc_id alone.

    id (as it is), doc (the id, the smallest long for null) and copy (a hash of the text) name a row;
    place is one hash of both. Rows equal in id and text have equal names and get equal results.
    text is empty for null; columns to carry along get names of their own.
    """
    text = whole_text(F.col("text"))
    id_ = F.col("doc_id").cast("long")
    named = docs.select(id_.alias("id"), F.coalesce(id_, F.lit(-(1 << 63))).alias("doc"), F.xxhash64(text).alias("copy"), text.alias("text"), *[F.col(c).alias(f"carry_{c}") for c in carry])
    return named.withColumn("place", F.xxhash64("doc", "copy"))


def windows_of(found: Runs, start: np.ndarray) -> np.ndarray:
    """All window starts of runs, counted over all texts."""
    total = int(found.count.sum())
    first = found.first + start[found.text]
    return np.repeat(first - (np.cumsum(found.count) - found.count), found.count) + np.arange(total) if total else np.zeros(0, dtype=np.int64)


def covered(windows: np.ndarray, window: int) -> np.ndarray:
    """Which units the flagged windows cover; a flag for each unit, that of the window that starts there."""
    edge = np.zeros(len(windows) + window, dtype=np.int32)
    at = np.nonzero(windows)[0]
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return np.cumsum(edge)[: len(windows)] > 0


def spans_of(gone: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
    return list(zip(np.nonzero(edge == 1)[0].tolist(), np.nonzero(edge == -1)[0].tolist(), strict=True))
