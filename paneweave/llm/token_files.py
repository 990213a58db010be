"""Token ids in compact binary blocks.

Ids are ranked by their frequency in the whole corpus, and the ranks are written in 1 to 4 bytes each:
frequent ids take one byte.  The lengths stand apart from the bytes, as 2 bits each, four to a control
byte, so that numpy decodes a block by table lookup without a branch for each id.

One block holds whole documents and reads by itself::

    "PWTK"  u32 version  u64 documents  u64 ids
    i64 doc_id of each document         u64 ids of each document
    control bytes, (ids + 3) div 4      data bytes

All little-endian.  The blocks are rows of the Parquet table ``blocks`` in the files' folder; the table
``ranks`` beside it holds one row with the format's version, the ids in the order of their ranks and
their checksum, so the folder reads by itself.  A lost task leaves no half-written block, and any file
system serves.

Strings of special tokens in a text are ordinary text, as the tokenizers' own guide sets it: a document
that holds ``<|endoftext|>`` can't end itself.

The corpus is ordered by doc_id by ranges, each range is tokenized once into a draft, the drafts'
frequencies are added up, and the drafts are written anew with the ranks.  Null and empty texts have
just the end id; equal doc_ids stand side by side, ordered by text; a null doc_id comes first; further
columns don't matter; an empty table gives no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bytetext as bt
from .runtime import SLICES, discard, map_arrow, new_path, stored, sum_counts
from .wordwise import ENCODE_BYTES, Wordwise

END = 2
_MAGIC, _VERSION = b"PWTK", 1
_HEAD = struct.Struct("<4sIQQ")
_NULL_ID = -(1 << 63)
#: control byte -> lengths of its four values
_LENGTHS = np.array([[(c >> (2 * i) & 3) + 1 for i in range(4)] for c in range(256)], np.uint8)


def pack(doc_ids: np.ndarray, counts: np.ndarray, ranks: np.ndarray) -> bytes:
    """One block of documents' ranks."""
    values = ranks.astype("<u4")
    lengths = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    codes = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    codes[: len(values)] = lengths - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) < lengths[:, None]]
    head = _HEAD.pack(_MAGIC, _VERSION, len(doc_ids), len(values))
    return b"".join([head, doc_ids.astype("<i8").tobytes(), counts.astype("<u8").tobytes(), control.tobytes(), data.tobytes()])


def unpack(block: bytes | memoryview) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, ids of each, ranks) of one block."""
    magic, version, docs, n = _HEAD.unpack_from(block)
    if magic != _MAGIC or version != _VERSION:
        raise ValueError("not a block of token ids of this version")
    at = _HEAD.size
    doc_ids = np.frombuffer(block, "<i8", docs, at)
    counts = np.frombuffer(block, "<u8", docs, at + 8 * docs).astype(np.int64)
    at += 16 * docs
    control = np.frombuffer(block, np.uint8, -(-n // 4), at)
    data = np.frombuffer(block, np.uint8, -1, at + len(control))
    lengths = _LENGTHS[control].ravel()[:n]
    begins = np.cumsum(lengths, dtype=np.int64) - lengths
    ranks = data[begins].astype(np.uint32) if n else np.zeros(0, np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(lengths > k)
        if not len(more):
            break
        ranks[more] |= data[begins[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return doc_ids, counts, ranks


class _Encoders:
    """One byte-level tokenizer and its remembered words for each Python worker."""

    held: dict[str, tuple[Wordwise, int]] = {}

    @classmethod
    def get(cls, path: str) -> tuple[Wordwise, int]:
        if path not in cls.held:
            from tokenizers import Tokenizer

            made = Tokenizer.from_file(path)
            made.encode_special_tokens = True
            # a byte-level vocabulary writes each byte as one character, and splits letters from punctuation
            sizes = np.zeros(made.get_vocab_size(), np.int64)
            for token, number in made.get_vocab().items():
                sizes[number] = len(token)
            cls.held[path] = Wordwise(lambda words: [e.ids for e in made.encode_batch_fast(words, add_special_tokens=False)], sizes, punctuation=True), len(sizes)
        return cls.held[path]


def _draft(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Blocks of ids in ascending doc_id, and at the end of each task its counts of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, vocabulary = _Encoders.get(tokenizer)
        total = np.zeros(-(-max(vocabulary, END + 1) // SLICES) * SLICES, np.uint64)
        part, seq, start = TaskContext.get().partitionId(), 0, 0
        names = ["part", "seq", "start", "doc_ids", "counts", "low", "rest", "freq"]

        def row(ids=None, counts=None, doc_ids=None, freq=None) -> pa.RecordBatch:
            wide = (ids >> 8).astype(np.uint8 if len(total) <= 1 << 16 else np.uint32) if ids is not None else None
            cells = [doc_ids, counts, ids.astype(np.uint8) if ids is not None else None, wide, freq]
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([start], pa.int64()), *(pa.array([None if x is None else x.tobytes()], pa.binary()) for x in cells)], names=names)

        for batch in batches:
            for at, block in bt.blocks(batch.column(1), size=ENCODE_BYTES):
                ids, counts = words.block(block)
                ids = np.insert(ids, np.cumsum(counts), END)  # after each document's last id
                total += np.bincount(ids, minlength=len(total)).astype(np.uint64)
                doc_ids = batch.column(0).slice(at, block.n).fill_null(_NULL_ID).to_numpy()
                yield row(ids, counts + 1, doc_ids)
                seq, start = seq + 1, start + len(ids)
        if seq:
            yield row(freq=total)

    schema = "part int, seq int, start long, doc_ids binary, counts binary, low binary, rest binary, freq binary"
    return map_arrow(docs.select(docs["doc_id"].cast("long"), "text"), run, schema)


def write(docs: DataFrame, tokenizer: str, path: str | None = None) -> str:
    """Write the corpus in ascending doc_id to a folder, by default a new one in the shared folder; its path.

    ``start`` of a block counts the ids before it within its part; parts follow one another.
    """
    path = path or new_path(docs.sparkSession, "token-files")
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.coalesce("text", F.lit("")))
    draft = stored(_draft(ordered, tokenizer), "draft")
    tables = draft.where("freq is not null").select("part", F.col("freq").alias("counts"))
    freq = sum_counts(tables, 1 + (tables.agg(F.max("part")).first()[0] or 0))
    by_rank = np.lexsort((np.arange(len(freq)), -freq.astype(np.int64))).astype(np.uint32)
    rank = np.empty_like(by_rank)
    rank[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    ranks = docs.sparkSession.sparkContext.broadcast(rank)  # one entry for each id of the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda name, kind, i=i, b=batch: np.frombuffer(b.column(b.schema.get_field_index(name))[i].as_buffer(), kind)
                low = get("low", np.uint8)
                rest = get("rest", np.uint8 if len(ranks.value) <= 1 << 16 else np.uint32)
                block = pack(get("doc_ids", np.int64), get("counts", np.int64), ranks.value[low | rest.astype(np.uint32) << 8])
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, 1) for k in range(3)), pa.array([len(low)], pa.int64()), pa.array([block], pa.binary())], names=["part", "seq", "start", "n_ids", "block"])

    blocks = map_arrow(draft.where("freq is null").drop("freq"), run, "part int, seq int, start long, n_ids long, block binary")
    blocks.write.parquet(f"{path}/blocks")
    raw = by_rank.astype("<u4").tobytes()
    ids = docs.sparkSession.createDataFrame([(_VERSION, zlib.crc32(raw), bytearray(raw))], "version int, crc32 long, ids binary")
    ids.coalesce(1).write.parquet(f"{path}/ranks")
    discard(draft)
    return path


def _rank_table(spark: SparkSession, path: str) -> np.ndarray:
    """The ids in the order of their ranks: one entry for each id of the vocabulary."""
    row = spark.read.parquet(f"{path}/ranks").first()
    if row is None or row["version"] != _VERSION or zlib.crc32(row["ids"]) != row["crc32"]:
        raise ValueError("the table of ranks is not of this version, or damaged")
    return np.frombuffer(bytes(row["ids"]), "<u4")


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per document from the files in a folder: doc_id, start, n_tokens, ids_crc32."""
    blocks = spark.read.parquet(f"{path}/blocks")
    # one row a task of the writing job, of which the scheduler holds a list as well: small enough to broadcast
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    held = spark.sparkContext.broadcast(_rank_table(spark, path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                doc_ids, counts, ranks = unpack(batch.column(1)[i].as_buffer())
                ids = held.value[ranks].astype("<u4")
                stops = np.cumsum(counts)
                starts = stops - counts
                raw = memoryview(ids).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64(), mask=doc_ids == _NULL_ID), pa.array(starts + batch.column(0)[i].as_py(), pa.int64()), pa.array(counts, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    placed = blocks.join(F.broadcast(parts), "part").select((F.col("start") + F.col("before")).alias("start"), "block")
    return map_arrow(placed, run, "doc_id long, start long, n_tokens long, ids_crc32 long")
