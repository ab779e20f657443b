"""Vectorised word and shingle hashing over Arrow string batches.

Words are maximal runs of bytes outside [\\x20\\x09-\\x0D]; in UTF-8 no other
character contains these bytes. Whole texts are always read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Of a little-endian 64-bit read the first 0 to 8 bytes.
_FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
#: Bytes of a word that are hashed 8 at a time; longer words go through BLAKE2b.
SHORT = 64


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets (one more than rows) of a string array; null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and len(texts) else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(texts) else data[:0], offsets - offsets[0]


def slices(texts: pa.Array, most: int = 1 << 20) -> list[pa.Array]:
    """The array cut so that each part has about `most` bytes (or one text)."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    out, i = [], 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        out.append(texts.slice(i, j - i))
        i = j
    return out


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, in bytes, and the first word of each text (one more than texts)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    start[cuts] = inside[cuts]
    end = edge
    end[1:] = inside
    end[1:-1] &= ~inside[1:]
    end[cuts] = inside[cuts - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(end)
    return s, e, np.searchsorted(s, offsets)


def word_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of each word, of its A-Z lower-cased bytes if fold; every 8 bytes are mixed in by themselves."""
    if not len(s):
        return np.zeros(0, np.uint64)
    raw = np.zeros(len(data) + 8, np.uint8)
    raw[: len(data)] = LOWER[data] if fold else data
    at = np.ndarray(len(data) + 1, "<u8", raw, 0, (1,))  # the 8 bytes from each place
    size = e - s
    h = mix(size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    h = mix(h ^ (at[s] & _FIRST[np.minimum(size, 8)]))
    long, done = np.flatnonzero(size > 8), 8
    while len(long) and done < SHORT:
        left = size[long] - done
        h[long] = mix(h[long] ^ (at[s[long] + done] & _FIRST[np.minimum(left, 8)]))
        long, done = long[left > 8], done + 8
    for i in long.tolist():
        h[i] = int.from_bytes(hashlib.blake2b(raw[s[i] : e[i]], digest_size=8).digest(), "little")
    return h


def shingle_sets(texts: pa.Array, k: int = 5) -> list[np.ndarray]:
    """The sorted distinct k-word shingles of each text, as 64-bit hashes.

    Fewer than k words: the whole sequence is one shingle; no word: none.
    """
    data, offsets = buffers(texts)
    s, e, first = words(data, offsets)
    h = word_hashes(data, s, e)
    m = len(h)
    full = np.zeros(m, np.uint64)
    for j in range(min(k, m)):
        full[: m - j] = full[: m - j] * np.uint64(0xC2B2AE3D27D4EB4F) + h[j:]
    full = mix(full + np.uint64(k))
    out = []
    for i in range(len(first) - 1):
        a, b = first[i], first[i + 1]
        n = b - a
        if n >= k:
            out.append(np.unique(full[a : b - k + 1]))
        elif n:
            x = np.uint64(n)
            for w in h[a:b]:
                x = mix(np.array([x], np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + w)[0]
            out.append(np.array([x], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
