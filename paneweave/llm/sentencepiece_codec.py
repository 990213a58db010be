"""SentencePiece models run by the tokenizers library.

The model file's protobuf is parsed here: pieces with scores and types, the trainer's model type and
byte fallback, and the normaliser's rules.  From them a tokenizers backend is built:

* normaliser: the precompiled character map, if any, white space collapsed where the model asks for
  it, and the space written as the marker U+2581, with one in front of the text (dummy prefix);
* unigram models: the pieces' scores as they are;
* byte-pair models: merges in the order of the scores of what they make, which for these models are
  merge ranks and not log probabilities;
* byte fallback: characters without a piece become the pieces of their UTF-8 bytes.

Batches are encoded by the library's threads, each distinct word of a block once.  ``verify`` compares
the ids with those of the sentencepiece library and raises if any differ.  Decoding looks the pieces'
bytes up in a table.

Null and empty texts have no ids and decode to an empty text; repeated rows are each encoded; very
long texts go through in one block of their own; further columns don't matter; an empty table gives an
empty one.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import bytetext as bt
from .runtime import map_arrow, some_texts
from .wordwise import Wordwise

MARK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
THREADS = 2
#: Bytes of one block of texts, of which decoding makes arrays of eight times its size, and words remembered by one
#: worker: two workers stand beside an executor's heap, which is full after earlier stages of a pipeline.
ENCODE_BYTES, REMEMBERED = 1 << 20, 150_000


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            size = varint()
            yield key >> 3, data[at : at + size]
            at += size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            yield key >> 3, data[at : at + size]
            at += size
        else:
            raise ValueError(f"wire type {kind} isn't known")


@dataclass(frozen=True)
class Model:
    """What a SentencePiece model file says."""

    pieces: tuple[tuple[str, float, int], ...]
    kind: int
    byte_fallback: bool
    charsmap: bytes
    dummy_prefix: bool
    collapse_spaces: bool
    unknown: int

    @classmethod
    def read(cls, path: str) -> Model:
        with open(path, "rb") as f:
            data = f.read()
        pieces, trainer, normalizer = [], {}, {}
        for number, value in _fields(data):
            if number == 1:
                got = dict(_fields(value))
                pieces.append((got[1].decode(), struct.unpack("<f", got[2])[0] if 2 in got else 0.0, got.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        unknown = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
        return cls(tuple(pieces), trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)), normalizer.get(2, b""), bool(normalizer.get(3, 1)), bool(normalizer.get(4, 1)), unknown)

    def backend(self):
        """A tokenizers.Tokenizer with the same pieces; the dummy prefix is put in front by the caller."""
        from tokenizers import Regex, Tokenizer, models, normalizers

        if self.kind == UNIGRAM:
            model = models.Unigram([(p, s) for p, s, _ in self.pieces], unk_id=self.unknown, byte_fallback=self.byte_fallback)
        elif self.kind == BPE:
            vocabulary = {p: i for i, (p, _, _) in enumerate(self.pieces)}
            usable = {p: (s, i) for i, (p, s, t) in enumerate(self.pieces) if t in (NORMAL, USER)}
            merges = []
            for piece, (score, number) in usable.items():
                for k in range(1, len(piece)):
                    if piece[:k] in usable and piece[k:] in usable:
                        merges.append((-score, number, usable[piece[:k]][1], usable[piece[k:]][1], piece[:k], piece[k:]))
            merges.sort()
            model = models.BPE(vocabulary, [m[4:] for m in merges], unk_token=self.pieces[self.unknown][0], fuse_unk=True, byte_fallback=self.byte_fallback)
        else:
            raise ValueError("only unigram and byte-pair models are known")
        steps = []
        if self.charsmap:
            steps.append(normalizers.Precompiled(self.charsmap))
        if self.collapse_spaces:
            steps.append(normalizers.Replace(Regex(" {2,}"), " "))
        steps.append(normalizers.Replace(" ", MARK))
        made = Tokenizer(model)
        made.normalizer = normalizers.Sequence(steps)
        return made


class Codec:
    """Encodes and decodes texts with one model."""

    held: dict[str, Codec] = {}

    def __init__(self, path: str, threads: int = THREADS):
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        self.model = Model.read(path)
        made = self.model.backend()
        #: words can go through alone unless the model looks at white space beyond them or merges across it
        self.alone = not self.model.collapse_spaces and not any(MARK in p.lstrip(MARK) for p, _, _ in self.model.pieces)
        self.made = made
        table = [bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else b" \xe2\x81\x87 " if t == UNKNOWN else p.replace(MARK, " ").encode() for p, _, t in self.model.pieces]
        sizes = np.array([0 if t == UNKNOWN else len(x) for (_, _, t), x in zip(self.model.pieces, table, strict=True)], np.int64)
        self.words = Wordwise(lambda words: [e.ids for e in made.encode_batch_fast(words, add_special_tokens=False)], sizes, prefix=" " if self.model.dummy_prefix else "", remembered=REMEMBERED)
        self._bytes = np.frombuffer(b"".join(table), np.uint8)
        self._size = np.fromiter(map(len, table), np.int64, len(table))
        self._start = np.cumsum(self._size) - self._size

    @classmethod
    def get(cls, path: str) -> Codec:
        if path not in cls.held:
            cls.held[path] = cls(path)
        return cls.held[path]

    def block(self, block: bt.Block) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        if self.alone:
            return self.words.block(block)
        texts = [block.text(k).decode() for k in range(block.n)]
        if self.model.collapse_spaces:
            texts = [t.strip(" ") for t in texts]
        if self.model.dummy_prefix:
            texts = [" " + t if t else t for t in texts]
        ids = [e.ids for e in self.made.encode_batch_fast(texts, add_special_tokens=False)]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((x for y in ids for x in y), np.int32, int(counts.sum())), counts

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        out: list[list[int]] = []
        for _, block in bt.blocks(pa.array(texts, pa.large_string()), size=ENCODE_BYTES):
            ids, counts = self.block(block)
            stops = np.cumsum(counts)
            out += [ids[a:b].tolist() for a, b in zip(stops - counts, stops, strict=True)]
        return out

    def decode_bytes(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all texts, offsets of each); the dummy prefix is taken off."""
        sizes = self._size[ids]
        stops = np.cumsum(sizes)
        data = self._bytes[np.repeat(self._start[ids] - (stops - sizes), sizes) + np.arange(stops[-1] if len(stops) else 0)]
        offsets = np.concatenate([[0], stops])[np.concatenate([[0], np.cumsum(counts)])]
        if self.model.dummy_prefix and len(data):
            heads = offsets[:-1][np.diff(offsets) > 0]
            drop = heads[data[heads] == 0x20]
            keep = np.ones(len(data), bool)
            keep[drop] = False
            data, offsets = data[keep], offsets - np.searchsorted(drop, offsets)
        return data, offsets

    def decode(self, ids: list[list[int]]) -> list[str]:
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        data, offsets = self.decode_bytes(np.fromiter((x for y in ids for x in y), np.int64, int(counts.sum())), counts)
        return [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]

    def verify(self, path: str, texts: list[str | None]) -> None:
        """Raise unless the ids are those of the sentencepiece library."""
        import sentencepiece

        wanted = sentencepiece.SentencePieceProcessor(model_file=path).encode([t or "" for t in texts], num_threads=1)
        for text, a, b in zip(texts, self.encode(texts), wanted, strict=True):
            if a != b:
                raise ValueError(f"ids differ from those of sentencepiece for {text[:80]!r}")


def encode(docs: DataFrame, model: str, verify_rows: int = 100) -> DataFrame:
    """One row per document: doc_id, ids, n_tokens, ids_crc32, and whether the ids decode to the text.

    The ids of at most ``verify_rows`` documents are compared with sentencepiece's first.
    """
    Codec.get(model).verify(model, some_texts(docs, verify_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.get(model)
        for batch in batches:
            for at, block in bt.blocks(batch.column(1), size=ENCODE_BYTES):
                ids, counts = codec.block(block)
                data, offsets = codec.decode_bytes(ids, counts)
                stops = np.concatenate([[0], np.cumsum(counts)])
                raw = memoryview(ids.astype("<u4")).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True)]
                if np.array_equal(offsets, block.offsets):
                    wrong = block.per_text(data != block.data) > 0
                else:
                    wrong = np.array([data[offsets[k] : offsets[k + 1]].tobytes() != block.text(k) for k in range(block.n)])
                lists = pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, block.n), lists, pa.array(counts, pa.int64()), pa.array(crc, pa.int64()), pa.array(~wrong)], names=["doc_id", "ids", "n_tokens", "ids_crc32", "decodes"]
                )

    return map_arrow(docs.select(docs["doc_id"].cast("long"), "text"), run, "doc_id long, ids array<int>, n_tokens long, ids_crc32 long, decodes boolean")
