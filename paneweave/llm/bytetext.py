"""Vectorised work on the bytes of many texts at once.

Texts arrive as Arrow strings.  A block is a run of whole texts, laid end to end in one byte
array; words, lines and their 64-bit hashes are found with numpy on that array.  A block ends at
the text that fills BLOCK_BYTES, so memory is bounded by that figure plus one text.

Hashes are polynomials modulo 2**64 over a table of random byte values, mixed at the end.  Two
different words agree with a chance of about 2**-55.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 2 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 3)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: bytes of words `[^\x20\x09-\x0D]+`
NOT_SPACE = ~SPACE
#: bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`: digits, a-z and everything beyond ASCII
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse, as far as they have been needed."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, BLOCK_BYTES + 1)
            up, down = np.full(size, _BASE), np.full(size, _INVERSE)
            up[0] = down[0] = 1
            up, down = np.cumprod(up), np.cumprod(down)
            if size > 4 * BLOCK_BYTES:  # for one very long text only
                return up[:n], down[:n]
            cls.up, cls.down = up, down
        return cls.up[:n], cls.down[:n]


class Block:
    """Some whole texts: ``data`` holds their bytes, ``offsets`` where each begins and the last ends."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data = LOWER[data] if lower else data
        self.offsets = offsets
        self.n = len(offsets) - 1
        self._sums: np.ndarray | None = None

    def per_text(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each text are set in ``mask``."""
        total = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def spans(self, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of each maximal run of bytes of the class ``member``; runs end with their text."""
        inside = member[self.data]
        if not len(inside):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edges = self.offsets[(self.offsets > 0) & (self.offsets < len(inside))]
        begins[edges] = inside[edges]
        ends[edges - 1] = inside[edges - 1]
        return np.flatnonzero(begins), np.flatnonzero(ends) + 1

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of each line between line feeds; an empty text has one empty line."""
        feeds = np.flatnonzero(self.data == 10)
        begins = np.sort(np.concatenate([self.offsets[:-1], feeds + 1]), kind="stable")
        ends = np.sort(np.concatenate([self.offsets[1:], feeds]), kind="stable")
        return begins, ends

    def counts(self, begins: np.ndarray) -> np.ndarray:
        """How many of the sorted positions ``begins`` lie in each text."""
        return np.diff(np.searchsorted(begins, self.offsets))

    def hashes(self, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of the bytes of each span."""
        up, down = _Powers.get(len(self.data) + 1)
        if self._sums is None:
            self._sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(_BYTE[self.data] * up[:-1], out=self._sums[1:])
        found = (self._sums[ends] - self._sums[begins]) * down[begins]
        return mix(found + (ends - begins).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def text(self, k: int) -> bytes:
        return self.data[self.offsets[k] : self.offsets[k + 1]].tobytes()


def blocks(texts: pa.Array | pa.ChunkedArray, lower: bool = False, size: int | None = None) -> Iterator[tuple[int, Block]]:
    """(index of the first text, block) for all texts in turn; null counts as empty."""
    size = size or BLOCK_BYTES
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if isinstance(texts, pa.ChunkedArray):  # no chunk at all
        texts = pa.array([], pa.large_string())
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        to = min(to, len(texts))
        yield at, Block(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], lower)
        at = to


def windows(words: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word windows inside each text, and the window's first word.

    ``words`` are word hashes of all texts, ``counts`` the number of words in each text.
    """
    n = len(words)
    if n < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        total = total * np.uint64(0x9FB21C651E98DF25) + words[j : n - k + 1 + j]
    ends = np.repeat(np.cumsum(counts), counts)  # for each word the index after its text's last word
    first = np.flatnonzero(np.arange(n - k + 1) + k <= ends[: n - k + 1])
    return mix(total[first]), first
