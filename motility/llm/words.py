"""Words of whole texts as NumPy arrays, straight from the UTF-8 bytes of an Arrow column.

Every word class used here is a set of ASCII characters plus all code points from 128 on, so bytes
decide it: the bytes of a multi-byte character are all 128 or more. Work goes in slices of whole texts
of a few megabytes, so memory follows the slice (or one long text), not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 21
_RNG = np.random.default_rng(20240229)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _table(is_word) -> np.ndarray:
    """Random 64-bit values of the word bytes (A-Z as a-z), 0 for bytes between words."""
    values = _RNG_VALUES.copy()
    values[65:91] = values[97:123]
    values[[b for b in range(256) if not is_word(b)]] = 0
    return values


_RNG_VALUES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER_VALUES = _table(lambda b: True)
#: ``[^\x20\x09-\x0D]``, lower-cased.
SPACED = _table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after lower-casing.
ALNUM = _table(lambda b: chr(b) in "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" or b >= 128)

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        for k, base in enumerate((int(_BASE), pow(int(_BASE), -1, 1 << 64))):
            steps = np.full(size, np.uint64(base))
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """Words of the texts ``lo`` to ``hi`` of a batch: bounds in ``data``, 64-bit hashes, and bounds by text."""

    lo: int
    hi: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray  # words of text i of the slice: bounds[i] to bounds[i + 1]

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def text_of_word(self) -> np.ndarray:
        """The slice's text number of each word."""
        return np.repeat(np.arange(self.hi - self.lo), self.counts)

    def prefixes(self, k: int) -> np.ndarray:
        """Hashes of the first k bytes of each word, lower-cased; of all of it where it has fewer."""
        acc = np.full(len(self.starts), np.uint64(k))
        for j in range(k):
            at = self.starts + j
            inside = at < self.ends
            acc *= _STEP
            acc[inside] += _LOWER_VALUES[self.data[at[inside]]]
        return mixed(acc)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all k-word windows that lie in one text, and the word each begins at."""
        n = len(self.hashes) - k + 1
        if n <= 0:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        acc = self.hashes[:n].copy()
        for j in range(1, k):
            acc *= _STEP
            acc += self.hashes[j : n + j]
        text = self.text_of_word()
        at = np.flatnonzero(text[:n] == text[k - 1 :])
        return mixed(acc[at] + np.uint64(k)), at

    def grams_at(self, at: np.ndarray, k: int) -> np.ndarray:
        """Hashes of the k-word windows that begin at these words, as ``grams`` gives them."""
        acc = self.hashes[at].copy()
        for j in range(1, k):
            acc = acc * _STEP + self.hashes[at + j]
        return mixed(acc + np.uint64(k))

    def span(self, first: int, past: int) -> bytes:
        """Words ``first`` to ``past`` lower-cased and joined by one space: equal if and only if the words are."""
        return b" ".join(lowered(self.data[self.starts[i] : self.ends[i]].tobytes()) for i in range(first, past))


def lowered(raw: bytes) -> bytes:
    return raw.translate(_LOWER)


_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def hash_of_words(words: list[str], table: np.ndarray) -> np.ndarray:
    """The hashes that ``slices`` gives these words."""
    return np.concatenate([w.hashes for w in slices(pa.array(words, pa.string()), table)] or [np.empty(0, np.uint64)])


def slices(texts: pa.Array, table: np.ndarray, slice_bytes: int = SLICE_BYTES) -> Iterator[Words]:
    """Words of each slice of whole texts; a null text has none."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1] or b"", np.int64 if wide else np.int32)
    offsets = offsets[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.empty(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + slice_bytes, "right")) - 1)
        hi = min(hi, len(texts))
        yield _words(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], lo, hi, table)
        lo = hi


def _words(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int, table: np.ndarray) -> Words:
    values = table[data]
    is_word = values != 0
    starts, ends = is_word.copy(), is_word.copy()
    starts[1:] &= ~is_word[:-1]
    ends[:-1] &= ~is_word[1:]
    if len(data):
        first = offsets[:-1][offsets[:-1] < len(data)]
        starts[first] = is_word[first]
        last = offsets[1:] - 1
        last = last[last >= 0]
        ends[last] = is_word[last]
    at = np.flatnonzero(starts)
    past = np.flatnonzero(ends) + 1
    if len(at):
        power, inverse = _power_tables(len(data) + 1)
        values *= power[: len(data)]
        hashes = mixed(np.add.reduceat(values, at) * inverse[at] + (past - at).astype(np.uint64))
    else:
        hashes = np.empty(0, np.uint64)
    return Words(lo, hi, data, at, past, hashes, np.searchsorted(at, offsets))
