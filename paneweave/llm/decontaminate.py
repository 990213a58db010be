"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items' normalised words are numbered and put into one suffix automaton, which then reads the
words of the training texts and tracks the longest match that ends at each word.  A match is taken
when it is as long as a window (``window`` consecutive words of one item) or when it covers the
whole of an item that is shorter.  All words of a taken match are hit.

The automaton has at most two states a word of the items.  Items of up to ``AUTOMATON_BYTES`` bytes of
text make one automaton, which is broadcast.  More are dealt out by hash to several: each is built from
its items alone, sent out and read by itself, and what it finds is stored; then the hits of all are
united.  So the driver and a task hold one automaton at a time, however many items there are.  A long
item is put in as stretches that share ``window`` - 1 words, which hold the same windows.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the lower-cased (A-Z) text.  Null and empty
texts have no words and no hits, an item without words matches nothing, equal items of several ids all
count, rows of one id count as one item and a null id as an empty one,
repeated rows are each answered, an empty item table leaves every text clean, and further columns
are kept by ``clean`` whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytetext as bt
from .runtime import discard, map_arrow, stored

WINDOW = 10
AUTOMATON_BYTES = 1 << 20
STRETCH_WORDS = 50_000


class Automaton:
    """Generalised suffix automaton over the word hashes of items."""

    def __init__(self, items: Iterable[tuple[str, list[int]]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.names: list[str] = []
        own: list[set[int]] = [set()]  # items whose prefix ends in the state
        shorts: dict[int, list[tuple[int, int]]] = {}  # state: (length, item) of short whole items
        pairs: set[int] = set()
        singles: set[int] = set()
        self.shortest = window
        for name, words in items:
            if not words:
                continue
            item = len(self.names)
            self.names.append(name)
            self.shortest = min(self.shortest, len(words))
            state = 0
            for word in words:
                state = self._extend(state, word, own)
                own[state].add(item)
            if len(words) < window:
                shorts.setdefault(state, []).append((len(words), item))
            singles.update(words)
            pairs.update(_pair(a, b) for a, b in zip(words, words[1:], strict=False))
        # an item with a substring of a state has it in all states that the links lead to
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            if self.length[self.link[state]] >= window:
                own[self.link[state]] |= own[state]
        self.items = {s: frozenset(x) for s, x in enumerate(own) if self.length[s] >= window}
        self.shorts = shorts
        self.has_shorts = [False] * len(self.length)
        for state in sorted(range(len(self.length)), key=self.length.__getitem__):
            self.has_shorts[state] = state in shorts or (state > 0 and self.has_shorts[self.link[state]])
        self.pairs = np.array(sorted(pairs), np.uint64)
        self.singles = np.array(sorted(singles), np.uint64)

    def _extend(self, last: int, word: int, own: list[set[int]]) -> int:
        nxt, link, length = self.next, self.link, self.length

        def clone(p: int, q: int) -> int:
            c = len(nxt)
            nxt.append(dict(nxt[q]))
            link.append(link[q])
            length.append(length[p] + 1)
            own.append(set())
            link[q] = c
            while p >= 0 and nxt[p].get(word) == q:
                nxt[p][word] = c
                p = link[p]
            return c

        q = nxt[last].get(word)
        if q is not None:  # another item has come this way
            return q if length[q] == length[last] + 1 else clone(last, q)
        state = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        own.append(set())
        p = last
        while p >= 0 and word not in nxt[p]:
            nxt[p][word] = state
            p = link[p]
        if p >= 0:
            q = nxt[p][word]
            link[state] = q if length[q] == length[p] + 1 else clone(p, q)
        return state

    def scan(self, words: list[int]) -> Iterator[tuple[int, int, set[int]]]:
        """(first word, end, items) of each match that is long enough or a whole short item."""
        nxt, link, length, window = self.next, self.link, self.length, self.window
        state = matched = 0
        for i, word in enumerate(words):
            while state and word not in nxt[state]:
                state = link[state]
                matched = length[state]
            to = nxt[state].get(word)
            if to is None:
                continue
            state, matched = to, matched + 1
            if matched >= window:
                s = state
                while length[link[s]] >= window:
                    s = link[s]
                yield i + 1 - matched, i + 1, self.items[s]
            if self.has_shorts[state]:
                s = state
                while s > 0:
                    for size, item in self.shorts.get(s, ()):
                        if s != state or size <= matched:
                            yield i + 1 - size, i + 1, {item}
                    s = link[s]

    def runs(self, hashes: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, int]]:
        """Stretches of words of one text in which each neighbouring pair is neighbouring in some item."""
        n = len(hashes)
        if not n or not len(self.singles):
            return
        known = _among(hashes, self.singles)
        joined = np.zeros(n, bool)  # with the word before
        if n > 1 and len(self.pairs):
            both = np.flatnonzero(known[1:] & known[:-1] & (doc[1:] == doc[:-1]))
            joined[both + 1] = _among(_pair(hashes[both], hashes[both + 1]), self.pairs)
        begins = np.flatnonzero(known & ~joined)
        ends = np.searchsorted(np.flatnonzero(~joined), begins, "right")
        stops = np.append(np.flatnonzero(~joined), n)[ends]
        long = stops - begins >= self.shortest
        yield from zip(begins[long].tolist(), stops[long].tolist(), strict=True)


def _pair(a, b):
    with np.errstate(over="ignore"):
        out = bt.mix(np.asarray(a, np.uint64) * np.uint64(0x9FB21C651E98DF25) + np.asarray(b, np.uint64))
    return int(out) if out.ndim == 0 else out


def _among(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which of x are in the sorted table; a bitmap of 2**16 entries answers most at once."""
    maybe = np.zeros(1 << 16, bool)
    maybe[table >> np.uint64(48)] = True
    found = maybe[x >> np.uint64(48)]
    at = np.flatnonzero(found)
    pos = np.minimum(np.searchsorted(table, x[at]), len(table) - 1)
    found[at] = table[pos] == x[at]
    return found


def _words(text: str | None) -> list[int]:
    found: list[int] = []
    for _, block in bt.blocks(pa.array([text], pa.large_string()), lower=True):
        found = block.hashes(*block.spans(bt.ALNUM)).tolist()
    return found


def _stretches(items: Iterable[tuple[str | None, str | None]], window: int) -> Iterator[tuple[str, list[int]]]:
    """(name, words) of all items, long ones in stretches that hold the same windows."""
    for name, text in items:
        words = _words(text)
        size = max(STRETCH_WORDS, 2 * window)
        yield name or "", words[:size]
        for at in range(size, len(words), size - window + 1):
            yield name or "", words[at - window + 1 : at + size - window + 1]


class Items:
    """The test items, in parts of bounded size."""

    def __init__(self, benchmark: DataFrame, window: int):
        self.window = window
        self.rows = benchmark.select(benchmark["item_id"].cast("string").alias("item"), benchmark["text"].alias("text")).dropDuplicates()
        total = self.rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.parts = max(1, -(-total // AUTOMATON_BYTES))

    def automaton(self, part: int) -> Automaton:
        mine = self.rows.where(F.expr(f"pmod(xxhash64(item, text), {self.parts}) = {part}"))
        return Automaton(_stretches(sorted(map(tuple, mine.toLocalIterator()), key=repr), self.window), self.window)  # AUTOMATON_BYTES or so


class Hits:
    """What the automata find in the texts of one block."""

    def __init__(self, block: bt.Block, table: Automaton | None):
        self.begins, self.ends = block.spans(bt.ALNUM)
        self.counts = block.counts(self.begins)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        self.hit = np.zeros(len(self.begins), bool)
        self.items: dict[int, set[str]] = {}
        hashes = block.hashes(self.begins, self.ends)
        doc = np.repeat(np.arange(block.n), self.counts)
        for a, b in table.runs(hashes, doc) if table else ():
            for x, y, found in table.scan(hashes[a:b].tolist()):
                self.hit[a + x : a + y] = True
                self.items.setdefault(int(doc[a]), set()).update(table.names[i] for i in found)

    def per_text(self) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(self.hit)])
        return total[self.first[1:]] - total[self.first[:-1]]


    def add(self, k: int, spans: list[int] | None, items: list[str] | None) -> None:
        """What was found in text k before."""
        for a, b in zip(spans[::2], spans[1::2], strict=True) if spans else ():
            self.hit[self.first[k] + a : self.first[k] + b] = True
        if items:
            self.items.setdefault(k, set()).update(items)

    def spans(self, k: int) -> list[int]:
        """Begin and end, in words, of the stretches of hit words of text k."""
        own = self.hit[self.first[k] : self.first[k + 1]].astype(np.int8)
        return np.flatnonzero(np.diff(np.concatenate([[0], own, [0]]))).tolist()


def _keys(names: tuple[str, str]) -> list[Column]:
    return [F.col("doc_id").cast("long").alias(names[0]), F.xxhash64("text").alias(names[1])]


def _all_hits(docs: DataFrame, items: Items) -> DataFrame:
    """(__id, __th, __spans, __items) of the documents in which any part finds something, one part at a time."""
    found = []
    for part in range(items.parts):
        held = docs.sparkSession.sparkContext.broadcast(items.automaton(part))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at, block in bt.blocks(batch.column(2), lower=True):
                    hits = Hits(block, held.value)
                    rows = np.flatnonzero(hits.per_text()).tolist()
                    ids, hashes = (batch.column(i).slice(at, block.n).take(pa.array(rows, pa.int64())) for i in range(2))
                    yield pa.RecordBatch.from_arrays([ids, hashes, pa.array([hits.spans(k) for k in rows], pa.list_(pa.int32())), pa.array([sorted(hits.items[k]) for k in rows], pa.list_(pa.string()))], names=["__id", "__th", "spans", "items"])

        found.append(stored(map_arrow(docs.select(*_keys(("__id", "__th")), "text"), run, "__id long, __th long, spans array<int>, items array<string>"), "hits"))
        held.unpersist()
    united = functools.reduce(DataFrame.unionAll, found).groupBy("__id", "__th")
    out = stored(united.agg(F.flatten(F.collect_set("spans")).alias("__spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("__items")), "hits")
    for done in found:
        discard(done)
    return out


def _with_hits(docs: DataFrame, hits: DataFrame) -> DataFrame:
    keyed = docs.select("*", *_keys(("__id_", "__th_")))
    return keyed.join(hits, keyed["__id_"].eqNullSafe(hits["__id"]) & keyed["__th_"].eqNullSafe(hits["__th"]), "left").select(*docs.columns, "__spans", "__items")


def measure(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: its words, those hit, and the items found in it."""
    items = Items(benchmark, window)
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    one = items.parts == 1
    held = docs.sparkSession.sparkContext.broadcast(items.automaton(0) if one else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, block in bt.blocks(batch.column(1), lower=True):
                hits = Hits(block, held.value)
                if not one:
                    for k in range(block.n):
                        hits.add(k, batch.column(2)[at + k].as_py(), batch.column(3)[at + k].as_py())
                n_hit = hits.per_text()
                names = [sorted(hits.items.get(k, ())) for k in range(block.n)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, block.n),
                        pa.array(hits.counts, pa.int64()),
                        pa.array(n_hit, pa.int64()),
                        pa.array(map(len, names), pa.int64()),
                        pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names], pa.string()),
                        pa.array(n_hit > 0),
                    ],
                    names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
                )

    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    return map_arrow(docs if one else _with_hits(docs, _all_hits(docs, items)), run, schema)


def _without(text: bytes, hits: Hits) -> bytes:
    """One text without its hit words."""
    spans = hits.spans(0)
    parts, at = [], 0
    for a, b in zip(spans[::2], spans[1::2], strict=True):
        parts.append(text[at : hits.begins[a]].rstrip(b" \t"))
        at = int(hits.ends[b - 1])
    return b" ".join([*parts, text[at:].lstrip(b" \t")])


def _one(text: bytes, table: Automaton | None) -> Hits:
    return Hits(bt.Block(np.frombuffer(text, np.uint8), np.array([0, len(text)]), lower=True), table)


def _cut(text: bytes, table: Automaton, max_coverage: float) -> bytes | None:
    """The text without its hit words, cut again until nothing is found; None if too much of it is hit."""
    first = True
    while True:
        hits = _one(text, table)
        if not hits.hit.any():
            return text
        if first and hits.hit.mean() > max_coverage:
            return None
        first, text = False, _without(text, hits)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = 0.8) -> DataFrame:
    """All rows with the matched spans cut out of ``text``; texts hit beyond ``max_coverage`` are left out.

    Cutting can bring words together that match once more; a text is read again until it is clean.
    A text without hits is returned byte for byte; null stays null.
    """
    items = Items(benchmark, window)
    columns, at_text = docs.columns, docs.columns.index("text")

    def with_texts(batch: pa.RecordBatch, changed: dict[int, str | None]) -> pa.RecordBatch:
        """The batch with changed texts; rows changed to None go."""
        if not changed:
            return batch
        column = batch.column(at_text)
        texts = [changed[i] if i in changed else x.as_py() for i, x in enumerate(column)]
        arrays = [*batch.columns]
        arrays[at_text] = pa.array(texts, column.type)
        return pa.RecordBatch.from_arrays(arrays, schema=batch.schema).filter(pa.array([changed.get(i, "") is not None for i in range(len(texts))]))

    if items.parts == 1:
        held = docs.sparkSession.sparkContext.broadcast(items.automaton(0))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                column = batch.column(at_text)
                changed: dict[int, str | None] = {}
                for at, block in bt.blocks(column, lower=True):
                    for k in np.flatnonzero(Hits(block, held.value).per_text()).tolist():
                        cut = _cut(column[at + k].as_py().encode(), held.value, max_coverage)
                        changed[at + k] = None if cut is None else cut.decode()
                yield with_texts(batch, changed)

        return map_arrow(docs, run, docs.schema)

    most, now = max_coverage, docs
    while True:
        hits = _all_hits(now, items)
        if not hits.count():
            return now

        def cut(batches: Iterator[pa.RecordBatch], most=most) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                changed: dict[int, str | None] = {}
                for i, spans in enumerate(batch.column(batch.num_columns - 2).to_pylist()):
                    if spans:
                        text = batch.column(at_text)[i].as_py().encode()
                        own = _one(text, None)
                        own.add(0, spans, None)
                        changed[i] = None if own.hit.mean() > most else _without(text, own).decode()
                yield with_texts(batch.select(columns), changed)

        before, now = now, stored(map_arrow(_with_hits(now, hits), cut, docs.schema), "cleaned")
        discard(before)
        discard(hits)
        most = 1.0
