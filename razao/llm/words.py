"""Words, lines and their hashes over whole Arrow batches of texts, as flat arrays.

Texts are taken as their UTF-8 bytes, as Arrow holds them; a null text is empty. Batches are cut into slices
of bounded bytes (one text may be longer and is then a slice of its own), so memory does not depend on how
many rows a batch has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; one-to-one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        full = np.full(max(n, 2 * len(_powers), 1 << 16), _BASE, np.uint64)
        full[0] = 1
        _powers = np.cumprod(full)
    return _powers


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes (ascending, not overlapping); equal bytes give equal hashes."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + _BLOCK, "right")))
        low, high = int(start[i]), int(end[j - 1])
        power = _power(high - low + 1)
        total = np.empty(high - low + 1, np.uint64)
        total[0] = 0
        # Byte i of the block has weight base ** i; a span's sum is brought to weights from 0 by its start.
        np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * power[: high - low], out=total[1:])
        s, e = start[i:j] - low, end[i:j] - low
        out[i:j] = (total[e] - total[s]) * power[(high - low) - s]
        out[i:j] = mix(out[i:j] * _odd_inverse(high - low) + (e - s).astype(np.uint64))
        i = j
    return out


def _odd_inverse(n: int) -> np.uint64:
    """The inverse of base ** n modulo 2 ** 64, so that blocks of any length give one hash."""
    return np.uint64(pow(_BASE, -n, 1 << 64))


class Words:
    """The words of some texts: bytes `data`, texts' byte bounds `bounds`, words' `start`, `end`, `text`, and
    `first`, the bounds of each text's words. `gap` flags the bytes between words, white space if not given."""

    def __init__(self, texts: pa.Array, lower: bool = False, gap: np.ndarray = _SPACE):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        _, offsets, data = texts.buffers()
        bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.data = data[bounds[0] : bounds[-1]]
        self.bounds = bounds - bounds[0]
        if lower:
            self.data = _LOWER[self.data]
        n = len(self.data)
        word = ~gap[self.data]
        edge = np.zeros(n + 1, bool)
        edge[self.bounds] = True
        begins, ends = word.copy(), word.copy()
        begins[1:] &= ~word[:-1] | edge[1:n]
        ends[:-1] &= ~word[1:] | edge[1:n]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, self.bounds)
        self.count = np.diff(self.first)
        self.text = np.repeat(np.arange(len(texts)), self.count)
        self._word = word
        self._hash = None

    def __len__(self) -> int:
        return len(self.start)

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = hash_spans(self.data, self.start, self.end)
        return self._hash

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every run of n words that lies in one text."""
        m = len(self) - n + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.text[:m] == self.text[n - 1 :])
        return at, self._windows_all(n)[at]

    def _windows_all(self, n: int) -> np.ndarray:
        """Hash of every run of n words, also across texts."""
        m = len(self) - n + 1
        got, have, width, power = None, 0, 1, self.hash
        for bit in range(n.bit_length()):  # hashes of 1, 2, 4, ... words; those that make up n are joined
            if n >> bit & 1:
                part = power[have : have + m]
                got = part if got is None else mix(got * np.uint64(_BASE) + part * np.uint64(3))
                have += width
            if have < n:
                power = mix(power[:-width] * np.uint64(_BASE) + power[width:] * np.uint64(5))
                width *= 2
        return mix(got + np.uint64(n))

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, start and end of every line (split at line feeds) that holds a word."""
        feeds = np.flatnonzero(self.data == 10)
        start = np.sort(np.concatenate([self.bounds[:-1], feeds + 1]))
        text = np.searchsorted(self.bounds, start, "right") - 1
        # A feed that ends a text begins an empty last line there, not a line of the next text.
        end = np.append(start[1:], len(self.data))
        end = end - (np.isin(end - 1, feeds, assume_unique=False) & (end > start))
        holds = np.searchsorted(self.start, start) < np.searchsorted(self.start, end)
        text = np.searchsorted(self.bounds, start[holds], "right") - 1
        return text, start[holds], end[holds]

    def sum_bytes(self, flags: np.ndarray) -> np.ndarray:
        """For each text the number of its bytes that are flagged."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.bounds[1:]] - total[self.bounds[:-1]]

    def word_chars(self) -> np.ndarray:
        """Code points inside words, for each text."""
        return self.sum_bytes(self._word & ((self.data & 0xC0) != 0x80))


def repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether it occurs again elsewhere, and whether an equal one stands before it."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    again, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    again[order[1:]] = same
    later[order[1:]] = same
    again[order[:-1]] |= same
    return again, later


def slices(batch: pa.RecordBatch | pa.Table, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most so many bytes of text, or one text."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = sizes[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(sizes, before + most, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def normal_form(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """All words with one space after each, and the bounds of the words (space included) in it."""
    lengths = words.end - words.start
    bounds = np.zeros(len(words) + 1, np.int64)
    np.cumsum(lengths + 1, out=bounds[1:])
    out = np.full(bounds[-1], 32, np.uint8)
    letters = words.data[words._word]
    out[np.arange(len(letters)) + np.repeat(np.arange(len(words)), lengths)] = letters
    return out, bounds


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """The least of every n neighbours."""
    width = 1
    while width * 2 <= n:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    rest = n - width
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x
