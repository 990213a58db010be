"""Quality rules as a short-circuit cascade.

Each rule rejects some texts.  On a bounded sample the cascade measures every rule's seconds per
text and the share of texts that it rejects, and then runs the rules in descending order of
rejections per second, each on the texts that the rules before it left.  The order changes the
work, never the verdict: a text is kept if no rule rejects it.

Words are `[^\\x20\\x09-\\x0D]+`.  Rows and columns: null text counts as an empty one (no words, so
rejected for length); repeated rows are judged alike, each by itself; all columns of the input stay
in ``filter`` whatever their names; an empty table gives an empty table.  Texts are read whole, in
blocks of a few MB.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import bytetext as bt
from .runtime import map_arrow, some_texts

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"[#*$%&|<>]")[1:-1]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[0x80:] = True


class Measures:
    """Figures of the texts of one block, each computed when first asked for."""

    def __init__(self, block: bt.Block):
        self.block = block
        self._memo: dict[str, np.ndarray] = {}

    def __getattr__(self, name: str) -> np.ndarray:
        if name not in self._memo:
            self._memo[name] = getattr(self, f"_{name}")()
        return self._memo[name]

    def _spans(self):
        return self.block.spans(bt.NOT_SPACE)

    def _n_words(self) -> np.ndarray:
        return self.block.counts(self.spans[0])

    def _word_chars(self) -> np.ndarray:
        data = self.block.data
        return self.block.per_text(bt.NOT_SPACE[data] & ((data & 0xC0) != 0x80))

    def _n_symbols(self) -> np.ndarray:
        return self.block.per_text(_SYMBOL[self.block.data])

    def _n_upper(self) -> np.ndarray:
        return self.block.per_text(_UPPER[self.block.data])

    def _n_letters(self) -> np.ndarray:
        data = self.block.data
        return self.block.per_text(_LETTER[data] & ((data & 0xC0) != 0x80))

    def _lines(self):
        begins, ends = self.block.lines()
        words = np.diff(np.searchsorted(self.spans[0], np.append(begins, len(self.block.data) + 1)))
        begins, ends = begins[words > 0], ends[words > 0]
        # an empty text shares its offset with the next one; a line with words belongs to the last of them
        return begins, ends, np.searchsorted(self.block.offsets, begins, "right") - 1

    def _n_lines(self) -> np.ndarray:
        return np.bincount(self.lines[2], minlength=self.block.n)

    def _n_dup_lines(self) -> np.ndarray:
        begins, ends, doc = self.lines
        key = bt.mix(self.block.hashes(begins, ends) + doc.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        order = np.argsort(key, kind="stable")
        again = np.zeros(len(key), bool)
        again[order[1:]] = key[order[1:]] == key[order[:-1]]
        return np.bincount(doc[again], minlength=self.block.n)

    def _n_repeat_words(self) -> np.ndarray:
        begins, ends = self.spans
        counts = self.n_words
        grams, first = bt.windows(self.block.hashes(begins, ends), counts, 3)
        doc = np.repeat(np.arange(self.block.n), counts)
        key = bt.mix(grams + doc[first].astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        ordered = np.sort(key)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        marked = np.zeros(len(begins), bool)
        if len(twice):
            at = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
            hit = first[twice[at] == key]
            for j in range(3):
                marked[hit + j] = True
        return np.bincount(doc[marked], minlength=self.block.n)

    def take(self, keep: np.ndarray) -> Measures:
        """The measures of some of the texts; figures already known are carried over."""
        off = self.block.offsets
        index = np.flatnonzero(keep)
        lengths = np.diff(off)[index]
        mask = np.repeat(keep, np.diff(off))
        out = Measures(bt.Block(self.block.data[mask], np.concatenate([[0], np.cumsum(lengths)])))
        out._memo = {k: v[keep] for k, v in self._memo.items() if isinstance(v, np.ndarray) and len(v) == self.block.n and k not in ("spans", "lines")}
        return out


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Measures], np.ndarray]


#: What every kept text must meet whatever the other rules say.
BASE_RULES = (
    Rule("too_short", lambda m: m.n_words < 50),
    Rule("repeats_itself", lambda m: 100 * m.n_repeat_words > 50 * m.n_words),
)

#: Production rules: no other figures than the text's own.
RULES = (
    Rule("symbols", lambda m: 10 * m.n_symbols > 3 * m.n_words),
    Rule("shouting", lambda m: 2 * m.n_upper > m.n_letters),
    Rule("duplicate_lines", lambda m: 2 * m.n_dup_lines > m.n_lines),
    Rule("word_length", lambda m: (m.word_chars < 2 * m.n_words) | (m.word_chars > 15 * m.n_words)),
    Rule("few_letters", lambda m: 2 * m.n_letters < m.word_chars),
)


class Cascade:
    """Rules in the order in which they pay best."""

    def __init__(self, rules: Sequence[Rule] = BASE_RULES + RULES):
        self.rules = tuple(rules)
        self.estimates: dict[str, tuple[float, float]] = {}

    def fit(self, docs: DataFrame, sample_rows: int = 400) -> Cascade:
        """Measure cost and selectivity on at most ``sample_rows`` texts and reorder; the sample decides nothing else."""
        texts = pa.array(some_texts(docs, sample_rows), pa.large_string())
        seconds, rejected, total = dict.fromkeys([r.name for r in self.rules], 0.0), dict.fromkeys([r.name for r in self.rules], 0), 0
        for _, block in bt.blocks(texts):
            total += block.n
            for rule in self.rules:
                began = time.perf_counter()
                rejected[rule.name] += int(rule.rejects(Measures(block)).sum())
                seconds[rule.name] += time.perf_counter() - began
        if total:
            self.estimates = {r.name: (seconds[r.name] / total, rejected[r.name] / total) for r in self.rules}
            self.rules = tuple(sorted(self.rules, key=lambda r: (-self.estimates[r.name][1] / max(self.estimates[r.name][0], 1e-9), r.name)))
        return self

    def verdict(self, measures: Measures, alive: np.ndarray | None = None) -> np.ndarray:
        """Which texts are kept; a rule sees only those that are still in."""
        kept = np.ones(measures.block.n, bool) if alive is None else alive.copy()
        now = measures.take(kept) if not kept.all() else measures
        for rule in self.rules:
            if not kept.any():
                break
            bad = rule.rejects(now)
            if bad.any():
                kept[np.flatnonzero(kept)[bad]] = False
                now = now.take(~bad)
        return kept

    def filter(self, docs: DataFrame) -> DataFrame:
        """The rows whose text is kept, with all their columns."""
        at = docs.columns.index("text")

        def run(batches: Iterator[pa.RecordBatch], cascade=self) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kept = np.zeros(batch.num_rows, bool)
                for first, block in bt.blocks(batch.column(at)):
                    kept[first : first + block.n] = cascade.verdict(Measures(block))
                yield batch.filter(pa.array(kept))

        return map_arrow(docs, run, docs.schema)


FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, cascade: Cascade | None = None) -> DataFrame:
    """One row per document: its figures, whether the base rules fail it, whether it is kept."""
    cascade = cascade or Cascade(RULES).fit(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, block in bt.blocks(batch.column(1)):
                m = Measures(block)
                failed = np.zeros(block.n, bool)
                for rule in BASE_RULES:
                    failed |= rule.rejects(m)
                columns = [batch.column(0).slice(first, block.n), *(pa.array(getattr(m, k), pa.int64()) for k in FIGURES)]
                columns += [pa.array(failed), pa.array(cascade.verdict(m, ~failed))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *FIGURES, "base_failed", "kept"])

    schema = "doc_id long, " + ", ".join(f"{k} long" for k in FIGURES) + ", base_failed boolean, kept boolean"
    return map_arrow(docs.select(docs["doc_id"].cast("long"), "text"), run, schema)
