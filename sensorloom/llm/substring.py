"""Substring dedup over words by suffix automata of reference shards.

The reference of a text is what stands before it. It is cut into shards by anchor key (see
passages), so a text only streams through automata that can match it, and each automaton is built in
the tasks that stream its shard. Matching statistics tell the longest match that ends at each word;
spans whose windows all match are removed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, staged
from .passages import Passages, covered, encoded, filed, listed, pieces, places_of, spans_of, windows_of, word_units

#: Words of a window, and of the grams that anchors are chosen from.
WINDOW, GRAM = 20, 6
#: Different runs of one key that stay together; beyond, runs are cut into windows and dealt by their hash.
SHARD_RUNS = 2000


class SuffixAutomaton:
    """All substrings of the token sequences that were added."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, link: int, moves: dict) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _copy(self, p: int, q: int, token) -> int:
        """Split the state q for the strings that end in p + token."""
        made = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = made
        while p != -1 and self.next[p].get(token) == q:
            self.next[p][token] = made
            p = self.link[p]
        return made

    def add(self, tokens) -> None:
        last = 0
        for token in tokens:
            q = self.next[last].get(token)
            if q is not None:  # known from another sequence
                last = q if self.length[q] == self.length[last] + 1 else self._copy(last, q, token)
                continue
            made = self._state(self.length[last] + 1, 0, {})
            p = last
            while p != -1 and token not in self.next[p]:
                self.next[p][token] = made
                p = self.link[p]
            if p != -1:
                q = self.next[p][token]
                self.link[made] = q if self.length[q] == self.length[p] + 1 else self._copy(p, q, token)
            last = made

    def matches(self, tokens) -> list[int]:
        """The length of the longest added substring that ends at each token."""
        state, size, out = 0, 0, []
        for token in tokens:
            while state and token not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            move = self.next[state].get(token)
            state, size = (0, 0) if move is None else (move, size + 1)
            out.append(size)
        return out


def first_windows(runs: list[list], window: int) -> list[list[int]]:
    """For the tokens of runs, the earliest first: the windows of each that no earlier run has."""
    automaton, out = SuffixAutomaton(), []
    for i, tokens in enumerate(runs):
        size = automaton.matches(tokens) if i else [0] * len(tokens)
        out.append([w for w in range(len(tokens) - window + 1) if size[w + window - 1] < window])
        if i + 1 < len(runs):
            automaton.add(tokens)
    return out


def cut_out(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """A text without the given spans of words and the white space after them."""
    at = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    out, last = [], 0
    for start, end in spans:
        out.append(raw[last : at[start][0]])
        last = at[end][0] if end < len(at) else len(raw)
    return b"".join([*out, raw[last:]])


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, layout: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space) and removed (spans of words) of every row.

    A word goes if a window of `window` words covers it whose words also start earlier: in a smaller
    doc_id, or earlier in the document. Null and empty texts have no words. Null ids come first. Every
    row is judged by itself, whatever its id: rows that share one, or have none, and differ in their
    texts come in the order of a hash of these. Rows equal in id and text count as one document and
    get equal results. With layout, kept is the text itself without the spans, white space and all.
    Columns named in carry come along unchanged; others are not read. An empty table gives no rows.
    """
    passages = Passages(word_units, window, gram)
    rows = filed(docs, carry)
    carried = [f for f in docs.schema.fields if f.name in carry]
    keyed = passages.repeated_keys(rows)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            for raws, at in pieces(encoded(batch.column(2))):
                _, found = passages.runs(raws)
                found = found.among(listed(batch.column(3).slice(at, len(raws))))
                words, last, least = [], -1, {}
                for text, key, first, count in zip(found.text.tolist(), found.key.tolist(), found.first.tolist(), found.count.tolist(), strict=True):
                    if text != last:
                        words, last = raws[text].split(), text
                    run, place = (key, b" ".join(words[first : first + count + window - 1])), (*names[at + text], first)
                    if run not in least or place < least[run]:  # the first of equals stands for all
                        least[run] = place
                columns = [*([k[i] for k in least] for i in range(2)), *([p[i] for p in least.values()] for i in range(3))]
                kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["key", "run", "doc", "copy", "start"])

    def first_of(runs: DataFrame, *keys: str) -> DataFrame:
        """The earliest place of equal runs, map-side first."""
        return runs.groupBy(*keys).agg(F.min(F.struct("doc", "copy", "start")).alias("at")).select(*keys, "at.*")

    found = rows.join(keyed, "place").select("doc", "copy", "text", "keys").mapInArrow(cut, "key long, run binary, doc long, copy long, start int")
    known = staged(first_of(found, "key", "run"))
    sizes = known.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    shared = known.join(sizes, "key", "left")

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            windows = [list(range(r.count(b" ") - window + 2)) for r in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(windows, pa.list_(pa.int32()))], names=["doc", "copy", "start", "windows"])

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, run, doc, copy, start, n in pdf[["key", "run", "doc", "copy", "start", "n"]].itertuples(index=False):
                words, parts = run.split(), -(-n // SHARD_RUNS)
                for i in range(len(words) - window + 1):
                    one = b" ".join(words[i : i + window])
                    out.append((key, xxhash.xxh3_64_intdigest(one) % parts, one, doc, copy, start + i))
            yield pd.DataFrame(out, columns=["key", "part", "run", "doc", "copy", "start"])

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, held = None, []
        names = ["doc", "copy", "start", "windows"]

        def settle():
            return [(*at, w) for (at, _), w in zip(held, first_windows([tokens for _, tokens in held], window), strict=True) if w]

        for pdf in batches:
            out = []
            for key, part, run, *at in pdf[["key", "part", "run", "doc", "copy", "start"]].itertuples(index=False):
                if (key, part) != shard:
                    out += settle()
                    shard, held = (key, part), []
                held.append((at, run.split()))
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame(settle(), columns=names)

    place, of_shard = "doc long, copy long, start int, windows array<int>", ["key", "part", "run", "doc", "copy", "start"]
    single = shared.filter(F.col("n").isNull()).select("doc", "copy", "start", "run").mapInArrow(alone, place)
    small = shared.filter(F.col("n") <= SHARD_RUNS).withColumn("part", F.lit(0)).select(*of_shard)
    crowded = shared.filter(F.col("n") > SHARD_RUNS).mapInPandas(deal, "key long, part int, run binary, doc long, copy long, start int")
    dealt = small.union(first_of(crowded, "key", "part", "run").select(*of_shard))  # equal windows meet before a shard gathers them
    firsts = dealt.repartition("key", "part").sortWithinPartitions("key", "part", "doc", "copy", "start").mapInPandas(stream, place)
    kept = staged(firsts.union(single).groupBy("doc", "copy").agg(F.collect_list(F.struct("start", "windows")).alias("firsts")))
    discard(known)

    def clear(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raws, at in pieces(encoded(batch.column(1))):
                part = batch.slice(at, len(raws))
                held = part.column(2).is_valid().to_pylist()
                units, found = passages.runs([r if h else b"" for r, h in zip(raws, held, strict=True)])  # the rest stays as it is
                found = found.among(listed(part.column(2)))
                again = np.zeros(len(units.units), dtype=bool)
                again[windows_of(found, units.start)] = True
                again[places_of(part.column(3), "windows", units.start)] = False
                gone = covered(again, window)
                removed = np.add.reduceat(np.concatenate([gone, [False]]).astype(np.int64), units.start[:-1]) * (np.diff(units.start) > 0)
                left, spans, count = [], [], np.diff(units.start)
                for i, raw in enumerate(raws):
                    cuts = spans_of(gone[units.start[i] : units.start[i + 1]]) if removed[i] else []
                    spans.append([{"start": a, "end": b} for a, b in cuts])
                    if layout and held[i]:
                        left.append(cut_out(raw, cuts) if cuts else raw)
                        continue
                    words, ends = raw.split(), [0, *(x for c in cuts for x in c), None]
                    count[i] = len(words)
                    left.append(raw if layout else b" ".join(words if not cuts else [w for a, b in zip(ends[::2], ends[1::2], strict=True) for w in words[a:b]]))
                place = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(count), pa.array(removed), pa.array(left, pa.binary()).cast(pa.string()), pa.array(spans, place), *part.columns[4:]], names=["doc_id", "n_words", "n_removed", "kept", "removed", *(f.name for f in carried)])

    schema = T.StructType.fromDDL("doc_id long, n_words long, n_removed long, kept string, removed array<struct<start: int, end: int>>")
    done = rows.join(keyed, "place", "left").join(kept, ["doc", "copy"], "left").select("id", "text", "keys", "firsts", *[f"carry_{f.name}" for f in carried])
    return done.mapInArrow(clear, T.StructType(schema.fields + carried))


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents, all columns, with repeated spans cut out of their texts; n_chars follows where text is cut."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    done = remove_repeats(docs, window, layout=True, carry=others)
    new = {"text": F.col("kept"), "n_chars": F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(F.col("n_chars")) if "n_chars" in others else None}
    return done.select(*[(new[f.name] if f.name in new else F.col(f.name)).cast(f.dataType).alias(f.name) for f in docs.schema.fields])
