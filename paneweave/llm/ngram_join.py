"""Exact n-gram Jaccard self-join of documents: classes of copies, links and connected components.

A document's set holds the 64-bit hashes of its distinct five-word shingles.  Equal sets form one
class, named by a 64-bit hash of the set, and are joined as one.  The rest runs in these steps:

1. A table of SKETCH counters, one for each hash prefix, counts the shingles of all documents.  It
   ranks shingles from rare to frequent; its size is fixed, and any ranking gives right results.
2. Prefix filter: two sets that meet the threshold share one of their n - ceil(t n) + 1 rarest
   shingles.  Each class posts those under their hashes, packed in byte blobs for the shuffle.
   Shingles whose counter is very large may be held by very many classes; they are spread over
   further partitions by a salt, so no partition holds an unbounded group.
3. Classes that share a shingle are candidates if their sizes fit and, for the first shingle that
   they have in common, what is left of both sets behind it is as long as the threshold asks for.
   Up to SMALL classes of one shingle become pairs at once.  More of them become tiles, one for each
   band of sizes; sets that meet the threshold fall into one band or into neighbouring ones.
4. A first round of links: each class of the pairs with its least partner, and each class of a tile
   with the tile's probe, the class that shares the most shingles with others, weighed over all its
   tiles: in a family of near copies that is the one closest to the original, which links with
   nearly all.  Further rounds take PROBES probes a tile from what isn't in its main component yet, while the pairs
   left are many times the tiles' rows and a round settles a tenth of the classes.
5. What is left: pairs and classes of tiles in different components.  The classes outside their tile's
   main component, if their number is within a limit, are sent to all members of the tiles, which lie
   together by class, so a pair is made once however many tiles it shares; beyond the limit they are
   joined by tile.  Within a further limit their bitmaps are sent too, so only pairs that may link are made:
   first PICKED of each member, and after these have joined their components all that still lie between two.
6. A pair is compared first by hashed bitmaps of BITS parity bits: the bits that differ bound the
   difference from below and so the overlap from above.  Those that pass are compared by exact
   intersection of the sorted arrays, and links are united to components.

Nulls and texts without words have empty sets and are linked with nothing; fewer than five words
count as one shingle; equal and repeated rows share a class; very long texts are read whole; further
columns don't matter to ``join`` and are kept by ``deduplicate``; an empty table gives an empty one.
Rows with a null doc_id are linked with nothing and get a null component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bytetext as bt
from .components import connected
from .runtime import discard, map_arrow, marked, only_marked, stored, sum_counts

WORDS = 5
NUM, DEN = 75, 100
SKETCH_BITS = 20
BITS = 2048
POSTINGS_EACH = 2_000_000
HOT = 1 << 16
FLUSH = 2_000_000
SMALL = 16
FEW, FEW_SENT = 4, 512
PROBES = 6
SENT_ROWS = 1_000_000
SENT_BITMAPS = 1 << 16
PICKED = 4
EXPAND = 4_000_000


def shingle_sets(block: bt.Block) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of the (lower-cased) block."""
    words = block.hashes(*(spans := block.spans(bt.NOT_SPACE)))
    counts = block.counts(spans[0])
    grams, first = bt.windows(words, counts, WORDS)
    starts = np.concatenate([[0], np.cumsum(counts)])
    at = np.searchsorted(first, starts)
    for k in range(block.n):
        if counts[k] >= WORDS:
            s = np.sort(grams[at[k] : at[k + 1]])
            yield s[np.concatenate([[True], s[1:] != s[:-1]])]
        elif counts[k]:
            few, _ = bt.windows(words[starts[k] : starts[k + 1]], counts[k : k + 1], int(counts[k]))
            yield bt.mix(few + np.uint64(counts[k]))
        else:
            yield np.zeros(0, np.uint64)


def _sketch(docs: DataFrame) -> np.ndarray:
    """Counts of all documents' shingles by the first SKETCH_BITS bits of their hashes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.uint64)
        for batch in batches:
            for _, block in bt.blocks(batch.column(0), lower=True):
                if sets := list(shingle_sets(block)):
                    total += np.bincount((np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)).view(np.int64), minlength=1 << SKETCH_BITS).astype(np.uint64)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "counts"])

    out = sum_counts(map_arrow(docs.select("text"), count, "part int, counts binary"), docs.rdd.getNumPartitions())
    return out if len(out) else np.zeros(1 << SKETCH_BITS, np.uint64)


def class_name(s: np.ndarray) -> int:
    """A 64-bit hash of a set, as a signed number."""
    return int(bt.mix(bt.mix(s).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(s)))[0].view(np.int64))


def parity_bits(s: np.ndarray) -> bytes:
    """For each of BITS places whether the number of elements that fall there is odd."""
    return np.packbits(np.bincount((bt.mix(s ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(BITS - 1)).view(np.int64), minlength=BITS) & 1).tobytes()


def _stats(docs: DataFrame) -> DataFrame:
    """(doc_id, th, n, cls, bits) of each document, th a hash of its text; bits are null for sets that the task has seen before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for at, block in bt.blocks(batch.column(2), lower=True):
                ids = batch.column(0).slice(at, block.n)
                n, cls, bits = [], [], []
                for valid, s in zip(ids.is_valid().to_pylist(), shingle_sets(block), strict=True):
                    n.append(len(s))
                    cls.append(class_name(s))
                    if fresh := valid and len(s) > 0 and cls[-1] not in seen:
                        seen.add(cls[-1])
                    bits.append(parity_bits(s) if fresh else None)
                yield pa.RecordBatch.from_arrays([ids, batch.column(1).slice(at, block.n), pa.array(n, pa.int32()), pa.array(cls, pa.int64()), pa.array(bits, pa.binary())], names=["doc_id", "th", "n", "cls", "bits"])

    return map_arrow(docs.select("doc_id", F.xxhash64("text").alias("th"), "text"), run, "doc_id long, th long, n int, cls long, bits binary")


def _band(n: np.ndarray) -> np.ndarray:
    """Sizes that meet the threshold lie in one band or in neighbouring ones."""
    return np.floor(np.log(n) / np.log(DEN / NUM) + 1e-9).astype(np.int64)


def _fits(na: np.ndarray, pa_: np.ndarray, nb: np.ndarray, pb: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes may meet the threshold if their first common elements have these places."""
    return (DEN * np.minimum(na, nb) >= NUM * np.maximum(na, nb)) & ((NUM + DEN) * np.minimum(na - pa_, nb - pb) >= NUM * (na + nb))


def _candidates(docs: DataFrame, ranks, hot, parts: int) -> DataFrame:
    """Pairs (tile null, a, b) of classes and rows (tile, a, n, p) of the classes of tiles."""
    spread = max(16, parts // 4)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, classes, sizes, count = [], [], [], 0
        seen: set[int] = set()
        shift = np.uint64(64 - SKETCH_BITS)

        def flush() -> pa.RecordBatch:
            lengths = np.array([len(k) for k in keys])
            key, owner = np.concatenate(keys), np.repeat(np.arange(len(keys), dtype=np.int32), lengths)
            place = (np.arange(len(key)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
            names, n = np.array(classes, np.int64), np.array(sizes, np.int32)
            part = (bt.mix(key + np.uint64(7)) % np.uint64(parts)).astype(np.int32)
            often = hot.value[key >> shift]
            if often.any():
                part[often] = parts + ((bt.mix(key[often]) ^ bt.mix(names[owner[often]].view(np.uint64))) % np.uint64(spread)).astype(np.int32)
            order = np.argsort(part, kind="stable")  # owners and places stay in order, which packs well
            edge = np.flatnonzero(np.diff(part[order], prepend=-1))
            key, owner, place, part = (x[order] for x in (key, owner, place, part))
            stop = np.append(edge[1:], len(part))
            keys.clear(), classes.clear(), sizes.clear()
            rows: list[tuple] = []
            for a, b in zip(edge, stop, strict=True):
                mine, local = np.unique(owner[a:b], return_inverse=True)
                rows.append((int(part[a]), key[a:b].tobytes(), local.astype(np.int32).tobytes(), place[a:b].tobytes(), names[mine].tobytes(), n[mine].tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.binary()] * 5), strict=True)], names=["part", "keys", "owners", "places", "classes", "sizes"])

        for batch in batches:
            for _, block in bt.blocks(batch.column(0), lower=True):
                for s in shingle_sets(block):
                    if not len(s) or (name := class_name(s)) in seen:
                        continue
                    seen.add(name)
                    size = len(s)
                    # the prefix in the order of the ranks, ties by hash
                    order = np.argsort(ranks.value[s >> shift], kind="stable")[: size - -(-NUM * size // DEN) + 1]
                    keys.append(s[order])
                    classes.append(name)
                    sizes.append(size)
                    count += len(order)
                if count >= FLUSH:
                    yield flush()
                    count = 0
        if count:
            yield flush()

    def gather(table: pa.Table) -> pa.Table:
        join = lambda name, kind: [np.frombuffer(x.as_buffer(), kind) for x in table.column(name)]
        owners = join("owners", np.int32)
        key, p = np.concatenate(join("keys", np.uint64)), np.concatenate(join("places", np.int32))
        cls = np.concatenate([c[o] for c, o in zip(join("classes", np.int64), owners, strict=True)])
        n = np.concatenate([c[o] for c, o in zip(join("sizes", np.int32), owners, strict=True)])
        whole = table.column("part")[0].as_py() < parts
        pairs = np.zeros((0, 2), np.int64)
        order = np.lexsort((cls, key))
        key, cls, n, p = key[order], cls[order], n[order], p[order]
        keep = np.concatenate([[True], (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])])  # several tasks may have posted it
        key, cls, n, p = key[keep], cls[keep], n[keep], p[keep]
        if whole:
            edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.repeat(np.diff(np.append(edge, len(key))), np.diff(np.append(edge, len(key))))
            few = (size > 1) & (size <= SMALL)
            k, c, m, q = key[few], cls[few], n[few].astype(np.int64), p[few].astype(np.int64)
            found = [pairs]
            for d in range(1, SMALL):
                good = np.flatnonzero((k[d:] == k[:-d]) & _fits(m[d:], q[d:], m[:-d], q[:-d])) if len(k) > d else []
                if len(good):
                    found.append(np.stack([c[good], c[good + d]], 1))  # classes are in order within a key
            pairs = np.concatenate(found)
            if len(pairs):
                order = np.lexsort((pairs[:, 1], pairs[:, 0]))
                pairs = pairs[order]
                pairs = pairs[np.concatenate([[True], (pairs[1:] != pairs[:-1]).any(1)])]
            many = size > SMALL
            key, cls, n, p = key[many], cls[many], n[many], p[many]
        band = _band(n) if len(n) else np.zeros(0, np.int64)
        tile = np.concatenate([bt.mix(key + (band + d).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)) for d in (0, -1)]).view(np.int64)
        # the smaller of a pair is of the tile's own band and has the shingle among its first n - 2 t n / (1 + t)
        early = (NUM + DEN) * (n - p).astype(np.int64) >= 2 * NUM * n.astype(np.int64)
        smaller = np.concatenate([early, np.zeros(len(cls), bool)]).astype(np.int32)
        cls, n, p = np.tile(cls, 2), np.tile(n, 2), np.tile(p, 2)
        if len(tile) and whole:
            order = np.argsort(tile, kind="stable")
            tile, cls, n, p, smaller = tile[order], cls[order], n[order], p[order], smaller[order]
            edge = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]]))
            size = np.diff(np.append(edge, len(tile)))
            good = np.repeat((size > 1) & (np.add.reduceat(smaller, edge) > 0), size)
            tile, cls, n, p = tile[good], cls[good], n[good], p[good]
        none = np.zeros(len(pairs), np.int64)
        cat = lambda x, y, kind, hide: pa.array(np.concatenate([x, y]), kind, mask=np.concatenate([np.full(len(x), hide == 0), np.full(len(y), hide == 1)]))
        return pa.table({"tile": cat(none, tile, pa.int64(), 0), "a": cat(pairs[:, 0], cls, pa.int64(), 2), "b": cat(pairs[:, 1], np.zeros(len(cls), np.int64), pa.int64(), 1), "n": cat(none.astype(np.int32), n, pa.int32(), 0), "p": cat(none.astype(np.int32), p, pa.int32(), 0)})

    posted = map_arrow(docs.where("doc_id is not null").select("text"), post, "part int, keys binary, owners binary, places binary, classes binary, sizes binary")
    return posted.groupBy("part").applyInArrow(gather, "tile long, a long, b long, n int, p int")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cls, set) of the wanted classes (cls, holder).

    Texts aren't shuffled: a bitmap tells most documents that aren't wanted, and a join of the sets leaves
    the others out, as well as rows that share a wanted doc_id but have another set.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            holders = batch.column(0).to_pylist()
            for at, block in bt.blocks(batch.column(1), lower=True):
                rows: list[tuple] = []
                for k, s in enumerate(shingle_sets(block), at):
                    if len(s) and (name := (holders[k], class_name(s))) not in seen:
                        seen.add(name)
                        rows.append((*name, s.tobytes()))
                columns = list(zip(*rows, strict=True)) or [()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["holder", "cls", "set"])

    near = only_marked(docs.select("doc_id", "text"), "doc_id", marked(wanted, "holder"))
    return map_arrow(near, run, "holder long, cls long, set binary").join(wanted, ["holder", "cls"]).select("cls", "set")


def bitmap_bound(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Upper bound of the overlap of sets by the bits in which their bitmaps (rows of uint64) differ."""
    return (n_a + n_b - np.bitwise_count(a ^ b).sum(1, dtype=np.int64)) // 2


def _meets(both: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    return DEN * both >= NUM * (n_a + n_b - both)


def _links(docs: DataFrame, pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) that meet the threshold."""

    def by_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = lambda i, b=batch: np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint64).reshape(b.num_rows, -1)
                na, nb = (batch.column(i).to_numpy().astype(np.int64) for i in (2, 3))
                good = _meets(np.minimum(bitmap_bound(rows(4), rows(5), na, nb), np.minimum(na, nb)), na, nb)
                yield batch.filter(pa.array(good)).select(["a", "b"])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([p, q])
                both.sort(kind="stable")  # two ascending runs are merged
                good.append(bool(_meets(np.int64((both[1:] == both[:-1]).sum()), np.int64(len(p)), np.int64(len(q)))))
            yield batch.filter(pa.array(good, pa.bool_())).select(["a", "b"])

    side = lambda of: classes.select(F.col("cls").alias(of), F.col("n").alias("n" + of), F.col("bits").alias("bits" + of))
    near = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "bitsa", "bitsb")
    near = stored(map_arrow(near, by_bits, "a long, b long"), "near")
    if near.isEmpty():
        return near
    wanted = stored(near.select(F.explode(F.array("a", "b")).alias("cls")).distinct().join(classes.select("cls", "holder"), "cls"), "wanted")
    sets = stored(_sets(docs, wanted), "sets")
    full = near.join(sets.select(F.col("cls").alias("b"), F.col("set").alias("y")), "b").join(sets.select(F.col("cls").alias("a"), F.col("set").alias("x")), "a").select("a", "b", "x", "y")
    out = stored(map_arrow(full, exact, "a long, b long"), "links")
    for done in (near, wanted, sets):
        discard(done)
    return out


def _relabel(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels (cls, comp) after further links; classes that aren't listed are their own component."""
    if labels is None:
        roots = connected(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
        return stored(roots.select(F.col("node").alias("cls"), F.col("root").alias("comp")), "labels")
    edges = links
    for end, name in (("a", "u"), ("b", "v")):
        edges = edges.join(labels.select(F.col("cls").alias(end), F.col("comp").alias("c" + end)), end, "left").withColumn(name, F.coalesce("c" + end, end))
    roots = stored(connected(edges.select("u", "v")), "roots")
    moved = labels.join(roots, labels["comp"] == roots["node"], "left").select("cls", F.coalesce("root", "comp").alias("comp"))
    new = roots.select(F.col("node").alias("cls"), F.col("root").alias("comp")).join(labels.select("cls"), "cls", "left_anti")
    out = stored(moved.unionByName(new), "labels")
    discard(labels)
    discard(roots)
    return out


def _with_comp(table: DataFrame, labels: DataFrame, column: str, comp: str) -> DataFrame:
    found = labels.select(F.col("cls").alias(column), F.col("comp").alias(comp))
    return table.join(found, column, "left").withColumn(comp, F.coalesce(comp, column))


_FITS = f"a != b and {DEN} * least(na, nb) >= {NUM} * greatest(na, nb) and {NUM + DEN} * least(na - pa, nb - pb) >= {NUM} * (na + nb)"
_PAIR = ("least(a, b) as a", "greatest(a, b) as b")


def _tile_side(rows: DataFrame, end: str) -> DataFrame:
    return rows.select("tile", F.col("cls").alias(end), F.col("n").alias("n" + end), F.col("p").alias("p" + end), *([F.col("comp").alias("c" + end)] if "comp" in rows.columns else []))


def _heaviest(rows: DataFrame) -> DataFrame:
    """Each tile's row of the class with the most tiles."""
    head = rows.groupBy("tile").agg(F.max_by(F.struct("cls", "n", "p", *(c for c in ("comp",) if c in rows.columns)), F.struct("w", "cls")).alias("head"))
    return head.select("tile", "head.*")


def _probes(rows: DataFrame) -> DataFrame:
    """Each tile's PROBES rows of the classes with the most tiles; partitions keep their own best first."""
    place = F.row_number().over(Window.partitionBy("tile").orderBy(F.desc("w"), F.desc("cls")))
    return rows.withColumn("place", place).where(F.col("place") <= PROBES).drop("place")


def _across(now: DataFrame, outside: DataFrame, classes: DataFrame, picked: int | None = None) -> DataFrame | None:
    """Candidates (a, b) of the rows outside of their tile's main component with all rows of the tile.

    With the bitmaps of the classes outside, SENT_BITMAPS at most, only those that may link; ``picked``: so many
    of each class, or None if there are too many to send.
    """
    spark = now.sparkSession
    names = outside.select("cls").distinct().join(classes.select("cls", "bits"), "cls")
    few = names.count() <= SENT_BITMAPS
    if picked and not few:
        return None
    table = outside.select("tile", "cls", "n", "p", "comp").toArrow()  # SENT_ROWS at most
    sent = np.stack([c.to_numpy().astype(np.int64) for c in table.columns], 1)
    sent = sent[np.argsort(sent[:, 0], kind="stable")]
    bitmaps = np.zeros((0, BITS // 64), np.uint64)
    if few and len(sent):
        table = names.toArrow().sort_by("cls")
        bitmaps = np.frombuffer(b"".join(table["bits"].to_pylist()), np.uint64).reshape(len(table), -1)
        sent = np.concatenate([sent, np.searchsorted(table["cls"].to_numpy(), sent[:, 1])[:, None]], 1)
    sent, bitmaps = spark.sparkContext.broadcast(sent), spark.sparkContext.broadcast(bitmaps)

    def may_link(mine: np.ndarray, other: np.ndarray, n_mine: np.ndarray, n_other: np.ndarray, bits: pa.Array) -> np.ndarray:
        out = np.zeros(len(mine), bool)
        for at in range(0, len(mine), 16384):
            part = slice(at, at + 16384)
            rows, back = np.unique(mine[part], return_inverse=True)
            x = np.frombuffer(b"".join(bits.take(pa.array(rows)).to_pylist()), np.uint64).reshape(len(rows), -1)[back]
            bound = bitmap_bound(x, bitmaps.value[other[part]], n_mine[part], n_other[part])
            out[part] = _meets(np.minimum(bound, np.minimum(n_mine[part], n_other[part])), n_mine[part], n_other[part])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = sent.value
        for batch in batches:
            tile, cls, n, p, comp = (batch.column(i).to_numpy().astype(np.int64) for i in range(5))
            begin, end = np.searchsorted(x[:, 0], tile, "left"), np.searchsorted(x[:, 0], tile, "right")
            total = np.cumsum(end - begin)
            at, found = 0, [np.zeros((0, 4), np.int64)]
            while at < len(tile):
                to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + EXPAND, "right")))
                many = (end - begin)[at:to]
                row = np.repeat(np.arange(at, to), many)
                other = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(begin[at:to], many)
                good = (cls[row] != x[other, 1]) & (comp[row] != x[other, 4]) & _fits(n[row], p[row], x[other, 2], x[other, 3])
                row, other = row[good], other[good]
                _, once = np.unique(np.stack([cls[row], x[other, 1]], 1), axis=0, return_index=True)
                found.append(np.stack([cls[row[once]], x[other[once], 1], row[once], other[once]], 1))
                at = to
            pairs = np.concatenate(found)
            pairs = pairs[np.unique(pairs[:, :2], axis=0, return_index=True)[1]]
            if few and len(pairs):
                row, other = pairs[:, 2], pairs[:, 3]
                pairs = pairs[may_link(row, x[other, 5], n[row], x[other, 2], batch.column(5))]
            if picked and len(pairs):
                chance = bt.mix(pairs[:, 0].view(np.uint64) ^ bt.mix(np.ascontiguousarray(pairs[:, 1]).view(np.uint64)))
                pairs = pairs[np.lexsort((chance, pairs[:, 0]))]
                first = np.searchsorted(pairs[:, 0], pairs[:, 0], "left")
                pairs = pairs[np.arange(len(pairs)) - first < picked]
            pairs = np.unique(np.sort(pairs[:, :2], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64())], names=["a", "b"])

    rows = now.select("tile", "cls", "n", "p", "comp")
    if few:
        rows = rows.join(classes.select("cls", "bits"), "cls").select("tile", "cls", "n", "p", "comp", "bits")
    return map_arrow(rows.repartition("cls").sortWithinPartitions("cls"), run, "a long, b long")


def _placed(tiles: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows with their component and their tile's main one."""
    now = _with_comp(tiles, labels, "cls", "comp")
    return stored(now.join(_heaviest(now).select("tile", F.col("comp").alias("main")), "tile"), "tiles")


def _tile_rounds(docs: DataFrame, tiles: DataFrame, classes: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Labels after the rounds of probes, and the candidates (a, b) that are left in tiles."""
    while True:
        now = _with_comp(tiles, labels, "cls", "comp")
        kinds = now.groupBy("tile").agg(F.min("comp").alias("least"), F.max("comp").alias("most"), F.count("*").alias("rows")).where("least < most")
        now = now.join(kinds.select("tile", "rows"), "tile")
        now = stored(now.join(_heaviest(now).select("tile", F.col("comp").alias("main")), "tile"), "tiles")
        outside = now.where("comp != main")
        rows, alone, work = now.agg(F.count("*"), F.count_if(F.expr("comp != main")), F.sum(F.when(F.expr("comp != main"), F.col("rows")))).first()
        if not rows:
            return labels, None
        few = (work or 0) <= (FEW_SENT if alone <= SENT_ROWS else FEW) * rows
        if not few:
            probes = _probes(outside)
            near = _tile_side(now, "b").join(_tile_side(probes, "a"), "tile").where("ca != cb and " + _FITS).selectExpr(*_PAIR).distinct()
            links = _links(docs, near, classes)
            before = outside.select("cls").distinct().count()
            labels = _relabel(labels, links)
            found = links.count()
            discard(links)
            discard(tiles)
            tiles = now.select("tile", "cls", "n", "p", "w").join(probes.select("tile", "cls"), ["tile", "cls"], "left_anti")
            if found * 10 >= before:
                tiles = stored(tiles, "tiles")
                discard(now)
                continue
            now = _placed(tiles, labels)
            outside = now.where("comp != main")
            alone = outside.count()
        if alone <= SENT_ROWS:
            if (some := _across(now, outside, classes, PICKED)) is not None:
                links = _links(docs, some.distinct(), classes)
                labels = _relabel(labels, links)
                discard(links)
                before, now = now, _placed(now.select("tile", "cls", "n", "p", "w"), labels)
                discard(before)
                outside = now.where("comp != main")
            left = _across(now, outside, classes)
        else:
            left = _tile_side(now, "b").join(_tile_side(outside, "a"), "tile").where("ca != cb and " + _FITS).selectExpr(*_PAIR)
        return labels, left.distinct()


def join(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the least doc_id that links reach)."""
    return _components(docs).drop("th")


def _components(docs: DataFrame) -> DataFrame:
    spark: SparkSession = docs.sparkSession
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    count = _sketch(docs)
    ranks = spark.sparkContext.broadcast(np.minimum(255, 6 * np.log2(1 + count.astype(np.float64))).astype(np.uint8))
    hot = spark.sparkContext.broadcast(count > max(HOT, 4 * float(count.mean())))
    parts = max(8, int(count.sum()) * (DEN - NUM) // DEN // POSTINGS_EACH + 1)
    del count
    stats = stored(_stats(docs), "stats")
    valid = stats.where("n > 0 and doc_id is not null")
    candidates = stored(_candidates(docs, ranks, hot, parts), "candidates")
    tiles = candidates.where("tile is not null").select("tile", F.col("a").alias("cls"), "n", "p")
    pairs = stored(candidates.where("tile is null").select("a", "b").distinct(), "pairs")
    used = pairs.select(F.explode(F.array("a", "b")).alias("cls")).unionAll(tiles.select("cls")).distinct()
    held = valid.groupBy("cls").agg(F.min("doc_id").alias("holder"), F.max("n").alias("n"), F.max("bits").alias("bits"))
    classes = stored(held.join(used, "cls", "left_semi"), "classes")

    tiles = stored(tiles.join(tiles.groupBy("cls").agg(F.count("*").alias("w")), "cls"), "tiles")
    near = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    probed = _tile_side(tiles, "b").join(_tile_side(_heaviest(tiles), "a"), "tile").where(_FITS).selectExpr(*_PAIR)
    links = _links(docs, near.unionAll(probed).distinct(), classes)
    labels = _relabel(None, links)
    discard(links)
    labels, left = _tile_rounds(docs, tiles, classes, labels)
    apart = _with_comp(_with_comp(pairs, labels, "a", "ca"), labels, "b", "cb").where("ca != cb").select("a", "b")
    links = _links(docs, (apart if left is None else apart.unionAll(left)).distinct(), classes)
    labels = _relabel(labels, links)
    for done in (links, pairs, candidates, classes):
        discard(done)

    named = _with_comp(stats.select("doc_id", "th", "n", "cls"), labels, "cls", "comp")
    least = named.where("doc_id is not null and n > 0").groupBy("comp").agg(F.min("doc_id").alias("least"))
    out = named.join(least, "comp", "left")
    component = F.expr("case when doc_id is null then null when n = 0 then doc_id else least end")
    return out.select("doc_id", "th", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """All rows but those whose document is linked, directly or not, with one of a smaller doc_id.

    Of repeated rows with one doc_id and one set all stay, as they are one document; so do documents without
    words and rows without doc_id.
    """
    gone = _components(docs).where("component_id < doc_id").select(F.col("doc_id").alias("__gone"), F.col("th").alias("__th")).distinct()
    return docs.join(gone, (docs["doc_id"].cast("long") == gone["__gone"]) & (F.xxhash64(docs["text"]) == gone["__th"]), "left_anti")
