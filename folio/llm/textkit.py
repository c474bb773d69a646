"""Vectorised byte-level text tools, used inside Arrow batches.

A batch of texts is taken as one UTF-8 byte array plus offsets, so that words, lines and shingles of many texts are
found and hashed with a few numpy passes and no Python loop over words. Null texts count as empty. The white space
that parts words is space, \\t, \\n, \\v, \\f and \\r, nothing else.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_PLACE = np.random.default_rng(5).integers(1, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes handled at once; each byte needs some tens of bytes of working memory.
SLICE_BYTES = 1 << 19
#: Longer spans are hashed by blake2b, one by one.
LONG_SPAN = 2_048


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes, never splitting a text."""
    _, offsets = utf8(column)
    start, n = 0, len(column)
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        yield start, min(end, n)
        start = min(end, n)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes in a row, and the offsets of each text in them."""
    a = column.cast(pa.large_string()).fill_null("")
    if len(a) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data | 0x20, data)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each input bit reaches each output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes that aren't breaks: starts, ends, and the offsets of each text's runs among them."""
    inside = ~breaks[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1] | edge[1:-1]
    closes[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, equal for equal bytes wherever they stand.

    Eight bytes at a time are added and mixed, in all spans at once. The steps aren't linear in the bytes, so no kind
    of text collides by its form.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    size = ends - starts
    out = mix(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    at, done = np.flatnonzero((size > 0) & (size <= LONG_SPAN)), 0
    while len(at):
        left = size[at] - done
        part = eight[starts[at] + done]
        short = left < 8
        part[short] &= (np.uint64(1) << (np.uint64(8) * left[short].astype(np.uint64))) - np.uint64(1)
        out[at] = mix((out[at] ^ part) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(done))
        at, done = at[left > 8], done + 8
    for i in np.flatnonzero(size > LONG_SPAN):
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def windows(hashes: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of k words (none of a shorter text), and each text's offsets in them."""
    counts = np.maximum(np.diff(offsets) - (k - 1), 0)
    out = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    if not out[-1]:
        return np.zeros(0, np.uint64), out
    at = np.arange(out[-1]) + np.repeat(offsets[:-1] - out[:-1], counts)
    total = hashes[at] * _PLACE[0]
    for i in range(1, k):
        total = total + hashes[at + i] * _PLACE[i]
    return mix(total), out


def shingle_sets(column: pa.Array, k: int = 5) -> list[np.ndarray]:
    """Each text's sorted distinct k-word shingle hashes, A-Z lower-cased; with fewer words, the whole sequence as one."""
    data, offsets = utf8(column)
    data = lower_ascii(data)
    starts, ends, of = spans(data, offsets)
    hashes = hash_spans(data, starts, ends)
    runs, at = windows(hashes, of, k)
    out = []
    for i in range(len(column)):
        words = of[i + 1] - of[i]
        if words >= k:
            out.append(np.unique(runs[at[i] : at[i + 1]]))
        elif words:
            out.append(mix((hashes[of[i] : of[i + 1]] * _PLACE[:words]).sum(keepdims=True) + np.uint64(words)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
