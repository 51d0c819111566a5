"""Words and shingles of an Arrow text column as numpy arrays, without a Python object per word.

Words are runs of bytes other than space and 0x09-0x0D, lower-cased from A-Z to a-z. Their 64-bit
hashes come from one running polynomial over all bytes; a shingle mixes the hashes of its words with
one odd factor per place. Equal words and shingles have equal hashes everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are turned into arrays at once; a longer text is taken alone.
PIECE_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LETTER = np.zeros(256, dtype=bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit value over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)
place_factors = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def powers(base: np.uint64, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2**64."""
    out = np.empty(max(n, 1), dtype=np.uint64)
    out[0], have = 1, 1
    while have < n:
        more = min(have, n - have)
        out[have: have + more] = out[:more] * (out[have - 1: have] * base)
        have += more
    return out[:n]


class Powers:
    """Growing tables of the powers that a task needs."""

    def __init__(self):
        self.up, self.down = powers(_STEP, 1 << 16), powers(_BACK, 1 << 16)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            self.up, self.down = powers(_STEP, n), powers(_BACK, n)
        return self.up[:n], self.down[:n]


def pieces(batch: pa.RecordBatch, text_col: str, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Ranges of rows of about ``limit`` bytes: first row, end row, their bytes, their offsets (from 0).

    A null text is an empty one.
    """
    col = batch.column(text_col)
    col = (col.fill_null("") if col.null_count else col).cast(pa.large_string())
    if not len(col):
        return
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset: col.offset + len(col) + 1]
    data = col.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(col):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, end, data[offsets[at]: offsets[end]], offsets[at: end + 1] - offsets[at]
        at = end


class Words:
    """Words of some texts: byte ``start`` and ``end``, ``hash``, and ``first[d]``, the first word of text d."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: Powers, letters: bool = False):
        """With ``letters`` a word is a run of ASCII letters and bytes above 0x7F."""
        n = len(data)
        inside = LETTER[data] if letters else ~_SPACE[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        cuts = offsets[:-1][(offsets[:-1] < n)]
        begins[cuts] = inside[cuts]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | begins[1:]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        up, down = table.upto(n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_VALUE[_LOWER[data]] * up[:n], out=sums[1:])
        self.sums, self.down = sums, down
        self.hash = mix((sums[self.end] - sums[self.start]) * down[self.start])

    def byte_grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Number of the word and hash of every run of ``k`` bytes inside a word, lower-cased."""
        count = np.maximum(self.end - self.start - k + 1, 0)
        word = np.repeat(np.arange(len(count)), count)
        at = np.repeat(self.start - (np.cumsum(count) - count), count) + np.arange(len(word))
        return word, mix((self.sums[at + k] - self.sums[at]) * self.down[at] + np.uint64(k))

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the ``k`` words from each word on, and whether they lie in one text.

        Only the first ``len(hash) - k + 1`` words have one.
        """
        m = max(0, len(self.hash) - k + 1)
        acc = np.full(m, np.uint64(k), dtype=np.uint64)
        for j in range(k):
            acc += self.hash[j: j + m] * place_factors[j]
        ok = np.zeros(m, dtype=bool)
        for a, b in zip(self.first[:-1], self.first[1:]):
            ok[a: max(a, b - k + 1)] = True
        return mix(acc), ok

    def shingle_sets(self, k: int) -> list[np.ndarray]:
        """Sorted distinct shingles of each text; a text of fewer words is one shingle, without words none."""
        hashes, _ = self.shingles(k)
        out = []
        for a, b in zip(self.first[:-1].tolist(), self.first[1:].tolist()):
            n = b - a
            if n >= k:
                out.append(np.unique(hashes[a: b - k + 1]))
            elif n:
                out.append(short_shingle(self.hash[a:b]))
            else:
                out.append(np.zeros(0, dtype=np.uint64))
        return out


def short_shingle(hashes: np.ndarray) -> np.ndarray:
    """The one shingle that a whole sequence of few words makes."""
    return mix(np.array([np.uint64(len(hashes)) + (hashes * place_factors[: len(hashes)]).sum(dtype=np.uint64)], dtype=np.uint64))
