"""Fingerprints of texts: hashed word shingles, SimHash words and parity maps."""

from __future__ import annotations

import numpy as np

#: The multipliers of the splitmix64 finaliser and its increment.
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """XXH64 (UTF-8, seed 42) of each shingle of k words, repeats included. A-Z are lower-cased; fewer words make one shingle, none makes none."""
    import xxhash

    token = (text or "").encode("utf-8", "replace").lower().split()
    if not token:
        return np.zeros(0, dtype=np.uint64)
    k = min(k, len(token))
    joined, size = b" ".join(token), np.fromiter(map(len, token), dtype=np.int64, count=len(token)) + 1
    end = np.cumsum(size) - 1
    start = (end - size + 1)[: len(token) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(start, end[k - 1 :].tolist(), strict=True)], dtype=np.uint64)


def simhash_words(hashes: np.ndarray, words: int) -> np.ndarray:
    """`words` 64-bit words; a bit is set if it is set in over half of the hashes (none: zero).

    The first word takes the hashes themselves, the others mix them.
    """
    out = np.zeros(words, dtype=np.uint64)
    for w in range(words if len(hashes) else 0):
        h = hashes
        if w:
            h = hashes + np.uint64(w * _MIX[0] % (1 << 64))
            h = (h ^ (h >> np.uint64(30))) * np.uint64(_MIX[1])
            h = (h ^ (h >> np.uint64(27))) * np.uint64(_MIX[2])
            h = h ^ (h >> np.uint64(31))
        total = np.zeros(64, dtype=np.int64)
        for at in range(0, len(h), 32_640):  # 255 rows at most are added up in a byte
            part = np.unpackbits(h[at : at + 32_640].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            whole = len(part) // 255 * 255
            total += part[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
            total += part[whole:].sum(axis=0, dtype=np.int64)
        out[w] = np.packbits(2 * total > len(h), bitorder="little").view("<u8")[0]
    return out


def parity_words(hashes: np.ndarray, words: int) -> np.ndarray:
    """`words` 64-bit words; each hash turns one bit over. Two sets differ in at least as many elements as their maps in bits."""
    turned = np.bincount((hashes >> np.uint64(24)).astype(np.int64) % (64 * words), minlength=64 * words) & 1
    return np.packbits(turned.astype(np.uint8), bitorder="little").view("<u8").astype(np.uint64)
