"""Vectorised word and shingle hashing over whole batches of texts.

A batch's texts are laid end to end as UTF-8 bytes, A-Z is lower-cased, words
are the runs of bytes other than space and 0x09-0x0D, and every word gets a
64-bit hash from prefix sums of a random byte table times powers of an odd
base.  A shingle's hash mixes the hashes of its words.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.default_rng(20240607)
_TABLE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TABLE[65:91] = _TABLE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_FACTORS = _RNG.integers(1, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = {"n": 0}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which each input bit reaches all output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers["n"] < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _powers[name] = np.multiply.accumulate(out)
        _powers["n"] = size
    return _powers["up"], _powers["down"]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a string array, and where each text's words begin (one more entry than texts)."""
    data, offsets = _bytes(texts)
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    space = _SPACE[data]
    first = np.zeros(n, bool)
    first[offsets[:-1][offsets[:-1] < n]] = True
    starts = np.flatnonzero(~space & (first | np.concatenate(([True], space[:-1]))))
    stop = np.ones(n, bool)
    stop[:-1] = space[1:] | first[1:]
    ends = np.flatnonzero(~space & stop) + 1
    hashes = np.empty(len(starts), np.uint64)
    block = 1 << 20  # powers are kept for so many places; sums run on modulo 2**64 from place to place
    at = 0
    while at < len(starts):
        low = starts[at]
        upto = max(int(np.searchsorted(ends, low + block, "right")), at + 1)
        span = data[low : ends[upto - 1]]
        up, down = _pow(len(span))
        sums = np.zeros(len(span) + 1, np.uint64)
        np.cumsum(_TABLE[span] * up[: len(span)], out=sums[1:])
        a, b = starts[at:upto] - low, ends[at:upto] - low
        hashes[at:upto] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
        at = upto
    return hashes, np.searchsorted(starts, offsets)


def slices(texts: pa.Array, most_bytes: int = 4 << 20) -> Iterator[pa.Array]:
    """The array in parts of about so many bytes, so that temporaries stay small; one text is never cut."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    ends = np.cumsum(np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(float)))
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + most_bytes, "right")))
        yield texts.slice(low, high - low)
        low = high


def small_batches(batches: Iterator[pa.RecordBatch], most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of a task in batches of about so many bytes; afterwards the worker hands free memory back.

    Workers wait for their next task with what they hold, beside a JVM that may need it.
    """
    for batch in batches:
        step = max(1, int(len(batch) * most_bytes / max(batch.nbytes, 1)))
        for low in range(0, len(batch), step):
            yield batch.slice(low, step)
    settle()


def settle() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = (texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts).cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def shingle_sets(texts: pa.Array, words: int = 5) -> list[np.ndarray]:
    """For each text its distinct shingles as sorted 64-bit hashes.

    A text of fewer words gives one shingle, its whole sequence; a text
    without words, or null, gives none.
    """
    return [found for part in slices(texts) for found in _sets(part, words)]


def _sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    hashes, bounds = word_hashes(texts)
    n = len(hashes)
    windows = np.zeros(max(0, n - words + 1), np.uint64)
    for k in range(words):
        windows += hashes[k : n - words + 1 + k] * _FACTORS[k]
    windows = mix(windows)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= words:
            out.append(np.unique(windows[a : b - words + 1]))
        elif b > a:
            out.append(mix(np.array([np.bitwise_xor.reduce(hashes[a:b] * _FACTORS[: b - a]) + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
