"""Whole texts to token ids by way of their distinct words.

Byte-pair encoders treat a text as a chain of stretches that never share a token.  A single space
between two printable characters always begins a new stretch, in byte-level encoders as in those that
write the space as a marker.  So a block of texts is cut at such spaces, each distinct stretch goes
through the tokenizer once, and the ids are laid out again in the order of the texts.  Known stretches
are remembered up to a bound.  Stretches that begin with a space are given to the tokenizer many at a
time, in one string, and its ids are dealt out again by the bytes that each id stands for.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from . import bytetext as bt

REMEMBERED = 1_200_000
ENCODE_BYTES = 8 << 20
TOGETHER = 250

_PLAIN = np.zeros(256, bool)
_PLAIN[0x21:0x7F] = True
#: first bytes of two-byte characters that are neither white space, marks nor controls
_LEAD = np.zeros(256, bool)
_LEAD[0xC3:0xE0] = True
_LEAD[[0xCC, 0xCD, 0xD2, 0xD6, 0xD7, 0xD8, 0xD9, 0xDB, 0xDC, 0xDD, 0xDE, 0xDF]] = False
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[0x41:0x5B] = _ASCII_LETTER[0x61:0x7B] = True
_PUNCTUATION = _PLAIN & ~_ASCII_LETTER
_PUNCTUATION[0x30:0x3A] = False


def cuts(block: bt.Block, punctuation: bool = False) -> np.ndarray:
    """Where stretches begin: at each text's first byte and at spaces between two printable characters.

    With ``punctuation`` also at ASCII punctuation after an ASCII letter, where encoders that split
    letters from other characters begin anew.
    """
    data = block.data
    begins = np.zeros(len(data) + 1, bool)
    if len(data) > 2:
        before = _PLAIN[data].copy()
        before[1:] |= _LEAD[data[:-1]]
        after = _PLAIN[data] | _LEAD[data]
        begins[1:-2] = (data[1:-1] == 0x20) & before[:-2] & after[2:]
    if punctuation and len(data) > 1:
        begins[1:-1] |= _PUNCTUATION[data[1:]] & _ASCII_LETTER[data[:-1]]
    begins[block.offsets] = True
    return np.flatnonzero(begins[:-1])


def _joins(word: str) -> bool:
    """Whether a stretch may stand between others in one string: a space, then printable to the end."""
    return len(word) > 1 and word[0] == " " and ("!" <= word[1] <= "~" or "\u00c0" <= word[1] <= "\u024f") and ("!" <= word[-1] <= "~" or "\u00c0" <= word[-1] <= "\u024f")


class Wordwise:
    """Encodes blocks of texts.

    ``encode`` gives the ids of each of a list of strings, ``bytes_of`` the number of text bytes that
    each id stands for (0 where it depends on the text).  No more than ``remembered`` stretches are kept,
    or those of one block.
    """

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], bytes_of: np.ndarray, prefix: str = "", punctuation: bool = False, remembered: int = REMEMBERED):
        self.encode, self.bytes_of, self.prefix, self.punctuation, self.remembered = encode, bytes_of, prefix, punctuation, remembered
        self._forget()

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of ids of each)."""
        if len(words) > 1:
            texts = ["".join(words[i : i + TOGETHER]) for i in range(0, len(words), TOGETHER)]
            ids = self.encode(texts)
            flat = np.fromiter((x for y in ids for x in y), np.int32, sum(map(len, ids)))
            ends = np.cumsum(self.bytes_of[flat])
            wanted = np.cumsum(np.fromiter((len(w.encode()) for w in words), np.int64, len(words)))
            at = np.searchsorted(ends, wanted)
            if len(ends) and ends[-1] == wanted[-1] and np.array_equal(ends[at], wanted) and self.bytes_of[flat].all():
                return flat, np.diff(at + 1, prepend=0)
        return self._each(words)

    def _each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self.encode(words)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((x for y in ids for x in y), np.int32, int(sizes.sum())), sizes

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.start, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)

    def _look_up(self, words: list[str]) -> np.ndarray:
        if len(self.known) + len(words) > self.remembered:
            self._forget()
        known = self.known
        fresh = list(dict.fromkeys(w for w in words if w not in known))  # with a prefix a word may come twice
        if fresh:
            together = [w for w in fresh if _joins(w)]
            alone = [w for w in fresh if not _joins(w)]
            for part, call in [*((together[i : i + 10_000], self._encode) for i in range(0, len(together), 10_000)), *((alone[i : i + 10_000], self._each) for i in range(0, len(alone), 10_000))]:
                ids, sizes = call(part)
                total, at = len(ids), len(known)
                while self.used + total > len(self.flat):
                    self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
                while at + len(part) > len(self.start):
                    self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
                self.flat[self.used : self.used + total] = ids
                self.start[at : at + len(part)] = self.used + np.cumsum(sizes) - sizes
                self.size[at : at + len(part)] = sizes
                self.used += total
                known.update(zip(part, range(at, at + len(part)), strict=True))
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def block(self, block: bt.Block) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each text)."""
        begins = cuts(block, self.punctuation)
        if not len(begins):
            return np.zeros(0, np.int32), np.zeros(block.n, np.int64)
        ends = np.append(begins[1:], len(block.data))
        pieces = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(np.append(begins, ends[-1]).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(block.data)))
        coded = pieces.dictionary_encode()
        index = np.asarray(coded.indices).astype(np.int64)
        words = coded.dictionary.to_pylist()
        if self.prefix:  # put before each text, so its first stretch is a word of its own
            first = np.searchsorted(begins, block.offsets[:-1][np.diff(block.offsets) > 0])
            heads, back = np.unique(index[first], return_inverse=True)
            index[first] = len(words) + back
            words = words + [self.prefix + words[i] for i in heads.tolist()]
        word = self._look_up(words)[index]
        sizes = self.size[word].astype(np.int64)
        stops = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.start[word] - (stops - sizes), sizes) + np.arange(stops[-1] if len(stops) else 0)]
        ends_at = np.concatenate([[0], stops])
        return ids, np.diff(ends_at[np.searchsorted(begins, block.offsets)])
