"""Token ids of whole texts, by the tokenizers library.

The pattern that this byte-level vocabulary splits text by never lets a token cross certain points: before white
space that follows something else, between ASCII letters and other ASCII signs (but for what follows an apostrophe), and after a
line feed that stands alone among other signs. Texts are cut there, but never inside a special token, and each distinct part is encoded by the
library, once per Python worker, and kept in a table of bounded size; ids of a text are those of its parts in a row. Parts that are one word of
ASCII and Latin-1 letters are encoded many at a time, with line feeds between them, which stand alone and are taken out again; others as they are. Parts are told
apart by 64-bit hashes.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np

from ledgerloom.llm.wordhash import span_hashes

#: Classes of bytes: 0 any other, 1 blank, 2 line feed, 3 control signs that some call white space, 4 ASCII letter, 5 ASCII sign, 6 apostrophe.
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = 1
_CLASS[0x0A] = 2
_CLASS[0x1C:0x20] = 3
_CLASS[[*range(65, 91), *range(97, 123)]] = 4
_CLASS[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = 5
_CLASS[0x27] = 6
#: Whether a piece may start between a byte of one class and a byte of the next: [8 * old + new].
_COARSE = np.zeros(64, dtype=bool)
_COARSE[[8 * old + new for old in (0, 4, 5, 6) for new in (1, 2)]] = True
_INNER = np.zeros(64, dtype=bool)
_INNER[[8 * 4 + 5, 8 * 4 + 6, 8 * 5 + 4]] = True
_AFTER_FEED = np.zeros(64, dtype=bool)
_AFTER_FEED[[8 * 2 + 4, 8 * 2 + 5, 8 * 2 + 6]] = True
_MARKER = b"<|endoftext|>"
#: Parts that one call of the library encodes with line feeds between them.
_JOINED = 64
_MOST_KEPT = 1 << 19
_encoders: dict[str, PieceEncoder] = {}


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str) -> PieceEncoder:
    """The worker's encoder for a vocabulary file; it lives as long as the worker."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def _wide_blank_before(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the bytes before each position end a white-space character outside ASCII."""
    one, two, three = (data[np.maximum(at - k, 0)] for k in (1, 2, 3))
    return (
        ((two == 0xC2) & ((one == 0x85) | (one == 0xA0)))
        | ((three == 0xE2) & ((two == 0x80) | (two == 0x81)))
        | ((three == 0xE3) & (two == 0x80) & (one == 0x80))
        | ((three == 0xE1) & (((two == 0x9A) & (one == 0x80)) | ((two == 0xA0) & (one == 0x8E))))
    )


def cut_points(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces start: at each text, and at the points that no token crosses."""
    begins = offsets[:-1][np.diff(offsets) > 0]
    if len(data) < 2:
        return begins
    kind = _CLASS[data]
    both = (kind[:-1] << 3) | kind[1:]
    cut = np.zeros(len(data), dtype=bool)
    cut[1:] = _COARSE[both]
    doubtful = np.flatnonzero(cut[1:] & (data[:-1] >= 0x80)) + 1
    cut[doubtful[_wide_blank_before(data, doubtful)]] = False
    cut[begins] = True
    # a line feed at which a part starts is alone if no white space follows
    cut[1:] |= _INNER[both] | (_AFTER_FEED[both] & cut[:-1])
    raw = data.tobytes()
    at = raw.find(_MARKER)
    while at >= 0:
        cut[at + 1 : at + len(_MARKER)] = False
        at = raw.find(_MARKER, at + 1)
    cut[begins] = True
    return np.flatnonzero(cut)


def lone_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether each part is one word of ASCII letters and the letters U+00C0 to U+00FF, with a blank before it or none."""
    if not len(starts):
        return np.zeros(0, dtype=bool)
    size = ends - starts
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size - starts, size)
    byte, before, after = data[at], data[at - 1], data[np.minimum(at + 1, len(data) - 1)]
    first, last = at == np.repeat(starts, size), at == np.repeat(ends - 1, size)
    lead = (byte == 0xC3) & ~last & (after >= 0x80) & (after <= 0xBF) & (after != 0x97) & (after != 0xB7)
    tail = (before == 0xC3) & ~first & (byte >= 0x80) & (byte <= 0xBF) & (byte != 0x97) & (byte != 0xB7)
    fits = (_CLASS[byte] == 4) | lead | tail | (first & ~last & (byte == 0x20))
    return np.logical_and.reduceat(fits, np.cumsum(size) - size)


class PieceEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self._forget()

    def _forget(self) -> None:
        """An empty table with open addressing: key, first id in the pool and number of ids of each slot."""
        self.slots = 1 << 16
        self.keys = np.zeros(self.slots, dtype=np.uint64)
        self.begin = np.zeros(self.slots, dtype=np.int32)
        self.length = np.zeros(self.slots, dtype=np.int32)
        self.pool = np.zeros(1 << 16, dtype=np.uint32)
        self.used = self.known = 0

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, or -1."""
        mask = np.uint64(self.slots - 1)
        at = (keys & mask).astype(np.int64)
        held = self.keys[at]
        out = np.where(held == keys, at, -1)
        open_ = np.flatnonzero((held != keys) & (held != 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & int(mask)
            held = self.keys[at[open_]]
            same = held == keys[open_]
            out[open_[same]] = at[open_[same]]
            open_ = open_[~same & (held != 0)]
        return out

    def _place(self, keys: np.ndarray, begin: np.ndarray, length: np.ndarray) -> None:
        """Put distinct new keys into free slots; of those that want one slot, one gets it and the rest move on."""
        at, left = (keys & np.uint64(self.slots - 1)).astype(np.int64), np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] == 0]
            self.keys[at[free]] = keys[free]
            won = free[self.keys[at[free]] == keys[free]]
            self.begin[at[won]], self.length[at[won]] = begin[won], length[won]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & (self.slots - 1)

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each), by the library."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        length = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        return np.fromiter(chain.from_iterable(found), dtype=np.uint32, count=int(length.sum())), length

    def _learn(self, data: np.ndarray, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        raw = data.tobytes()
        lone = lone_words(data, starts, ends) if len(self.feed) == 1 else np.zeros(len(starts), dtype=bool)
        order = np.append(np.flatnonzero(lone), np.flatnonzero(~lone))
        keys, starts, ends, n_lone = keys[order], starts[order], ends[order], int(lone.sum())
        parts = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        groups = [b"\n".join(parts[i : min(i + _JOINED, n_lone)] + [b""]).decode() for i in range(0, n_lone, _JOINED)]
        joined = self._ids(groups)[0]
        closing = np.flatnonzero(joined == self.feed[0]) if n_lone else np.zeros(0, dtype=np.int64)
        rest, rest_length = self._ids([p.decode("utf-8", "replace") for p in parts[n_lone:]])
        length = np.append(np.diff(closing, prepend=-1) - 1, rest_length)
        fresh = np.append(np.delete(joined, closing), rest)
        while self.used + len(fresh) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(fresh)] = fresh
        begin = self.used + np.cumsum(length) - length
        self.used += len(fresh)
        self.known += len(keys)
        if 2 * self.known > self.slots:
            old = np.flatnonzero(self.keys)
            kept = self.keys[old], self.begin[old], self.length[old]
            while 2 * self.known > self.slots:
                self.slots *= 2
            self.keys, self.begin, self.length = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.int32), np.zeros(self.slots, np.int32)
            self._place(*kept)
        self._place(keys, begin, length)

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, each closed by end_id; number of ids of each text)."""
        n_texts = len(offsets) - 1
        starts = cut_points(data, offsets)
        if not len(starts):
            return np.full(n_texts, end_id, dtype=np.uint32), np.ones(n_texts, dtype=np.int64)
        ends = np.append(starts[1:], len(data))
        keys = np.maximum(span_hashes(data, starts, ends), np.uint64(1))
        if self.known > _MOST_KEPT:
            self._forget()
        at = self._find(keys)
        missed = np.flatnonzero(at < 0)
        if len(missed):
            new, where = np.unique(keys[missed], return_index=True)
            where = missed[where]
            self._learn(data, new, starts[where], ends[where])
            at = self._find(keys)
        length, begin = self.length[at].astype(np.int64), self.begin[at].astype(np.int64)
        upto = np.cumsum(length)
        total = int(upto[-1])
        before = np.append(0, upto)[np.searchsorted(starts, offsets)]
        counts = np.diff(before)
        # each id moves right by the number of texts that end before it
        text = np.searchsorted(offsets, starts, side="right") - 1
        target = np.arange(total) + np.repeat(text, length)
        out = np.full(total + n_texts, end_id, dtype=np.uint32)
        out[target] = self.pool[np.arange(total) + np.repeat(begin - (upto - length), length)]
        return out, counts + 1
