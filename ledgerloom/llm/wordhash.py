"""Vectorised word hashing for the operators of this subpackage.

Texts arrive as Arrow string arrays; words are the maximal byte runs free of the six ASCII
white-space bytes, so UTF-8 needs no decoding. Everything here is numpy inside one Spark task:
callers hand over bounded pieces (`pieces`) and never a whole partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_MASK = (1 << 64) - 1
_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD6E8FEB86659FD93
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_places: dict[int, np.ndarray] = {}
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64, so that low and high bits depend on all others."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def _power_tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; kept up to a million entries."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            out, filled = np.ones(size, dtype=np.uint64), 1
            while filled < size:
                out[filled : 2 * filled] = out[:filled] * np.uint64(pow(b, filled, 1 << 64))
                filled *= 2
            made.append(out)
        have = (made[0], made[1])
        if size <= 1 << 20:
            _powers[base] = have
    return have


def pieces(texts: pa.Array, limit: int = 1 << 18) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Cut an Arrow string array into runs of whole texts of about `limit` bytes.

    Yields (index of the first text, bytes, offsets); a null text counts as empty and a text over
    the limit comes alone.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null(b"")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to
    pa.default_memory_pool().release_unused()


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte bounds of each word, and the number of words before each text."""
    solid = np.empty(len(data) + 2, dtype=bool)
    solid[0] = solid[-1] = False
    np.logical_not(_SPACE[data], out=solid[1:-1])
    begins = solid[1:-1] & ~solid[:-2]
    finishes = solid[1:-1] & ~solid[2:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    begins[inner] |= solid[1:-1][inner]
    finishes[inner - 1] |= solid[1:-1][inner - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): a 64-bit hash for each word, and the number of words before each text."""
    starts, ends, first = word_bounds(data, offsets)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), first
    return span_hashes(_LOWER[data] if lower else data, starts, ends), first


def _coefficients(n: int) -> np.ndarray:
    """n fixed random numbers, one for each place in a word; 65536 are kept, more are made for a longer word."""
    held = _places.get(0)
    if held is None:
        held = _places[0] = mix64(np.arange(1, (1 << 16) + 1, dtype=np.uint64) * np.uint64(_BYTE_BASE))
    return held[:n] if n <= len(held) else mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BYTE_BASE))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span data[start:end]; spans ascend and have a byte at least.

    A byte is multiplied by a random number of its place, so that no family of texts is known whose hashes agree.
    """
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    size = ends - starts
    upto = np.cumsum(size)
    place = np.arange(int(upto[-1])) - np.repeat(upto - size, size)
    held = (data[place + np.repeat(starts, size)].astype(np.uint64) + np.uint64(1)) * _coefficients(int(size.max()))[place]
    return mix64(np.add.reduceat(held, upto - size) + size.astype(np.uint64))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of words[i:i+n] for every i; entries that cross texts are the caller's to drop."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    up, down = _power_tables(_WORD_BASE, len(words) + 1)
    total = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * up[: len(words)], out=total[1:])
    return mix64((total[n:] - total[:count]) * down[:count] + np.uint64(n))


def inside(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, counts): the word positions at which n words of one text start, and how many a text has."""
    counts = np.maximum(np.diff(first) - n + 1, 0)
    total = int(counts.sum())
    begins = np.cumsum(counts) - counts
    return np.arange(total) + np.repeat(first[:-1] - begins, counts), counts


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """min(x[i:i+width]) for every i, by doubling."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def minimiser_positions(words: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of the smallest gram in each run of `window` words; the leftmost of equal ones.

    A piece has fewer than 2**22 words, so a position fits in 22 bits below 42 bits of hash.
    """
    grams = gram_hashes(words, gram)
    bits = np.uint64(max(22, int(len(words)).bit_length()))
    packed = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    at = (sliding_min(packed, window - gram + 1) & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    return at, grams
