"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text

#: Largest rank file that is broadcast.
MAX_RANK_BYTES = 64 << 20
#: Texts above this many characters are cut before the pattern sees them.
PIECE_CHARS = 65_536
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Where a match never crosses: before white space, since only matches that start with it hold any; and
#: between a letter or digit and a sign after it. The pattern looks ahead for white space only, and never
#: back. Signs are cut off before, never after them: an apostrophe belongs to what follows.
_SAFE = re.compile(rf"(?<=[^{_WHITE}])(?=[{_WHITE}])|(?<=[A-Za-z0-9])(?=[!-/:-@\[-`{{-~])|(?<=[\u3040-\u30ff\u4e00-\u9fff\uac00-\ud7a3])(?=[\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f\u300c-\u300f])")
#: Runs of white space from this length on are one piece, found without the pattern, whose engine recurses over them.
_RUN = re.compile(rf"[{_WHITE}]{{{PIECE_CHARS},}}")
#: Rows, and bytes of text, in a batch that goes back to Spark.
_ROWS, _BYTES = 512, 8 << 20


def safe_pieces(text: str, most: int = PIECE_CHARS) -> Iterator[str]:
    """Cut a long text where the pattern always cuts too; a run of letters without such a place is one match and stays whole."""
    start = 0
    while len(text) - start > most:
        cut = _SAFE.search(text, start + most)
        if not cut:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def matched_pieces(text: str) -> Iterator[tuple[str, bool]]:
    """Parts of a text, and whether each is one match as it is: a long run of white space is, but for its last character if text follows."""
    start = 0
    for run in _RUN.finditer(text) if len(text) >= PIECE_CHARS else ():
        end = run.end() - (run.end() < len(text))
        if start < run.start():
            yield from ((p, False) for p in safe_pieces(text[start : run.start()]))
        yield text[run.start() : end], True
        start = end
    if start < len(text):
        yield from ((p, False) for p in safe_pieces(text[start:]))


def load_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in content.splitlines() if line)}


def encode_documents(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, token_ids (little-endian unsigned 32-bit) and decoded bytes of every row.

    Null texts count as empty and give no ids; texts of any length are encoded whole, also runs of
    one kind of character. Rows that repeat are encoded each, null ids pass through, other columns
    are not read, and an empty table gives no rows. The rank file is read on the driver, its size
    is checked, and it is broadcast.
    """
    with open(rank_path, "rb") as f:
        content = f.read(MAX_RANK_BYTES + 1)
    if len(content) > MAX_RANK_BYTES:
        raise ValueError(f"the rank file is over {MAX_RANK_BYTES} bytes")
    shared = docs.sparkSession.sparkContext.broadcast(content)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        coder = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=load_ranks(shared.value), special_tokens={})

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["doc_id", "n_tokens", "token_ids", "decoded"])

        for batch in batches:
            rows, size = [], 0
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids: list[int] = []
                for piece, one in matched_pieces(text):
                    ids += coder._encode_single_piece(piece) if one else coder.encode_ordinary(piece)
                rows.append((doc_id, len(ids), np.array(ids, dtype="<u4").tobytes(), coder.decode_bytes(ids)))
                size += len(text)
                if len(rows) >= _ROWS or size >= _BYTES:
                    yield packed(rows)
                    rows, size = [], 0
            yield packed(rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(F.col("text")).alias("text")).mapInArrow(encode, "doc_id long, n_tokens long, token_ids binary, decoded binary")
