"""Line dedup, shards, token files, SentencePiece, the n-gram join and the pipeline against plain Python."""

import collections
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from paneweave.llm import bytetext as bt
from paneweave.llm import components, line_dedup, ngram_join, queries, sentencepiece_codec, sharding, token_files
from paneweave.llm.wordwise import Wordwise, cuts

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, sources=None):
    return spark.createDataFrame([(i, t, "en", sources[i] if sources else "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


def near_copies(rng, base, n, edits):
    out = []
    for _ in range(n):
        words = base.split(" ")
        for _ in range(edits):
            words[rng.randrange(len(words))] = f"e{rng.randint(0, 10**6)}"
        out.append(" ".join(words))
    return out


def corpus(rng):
    prose = lambda n: " ".join(f"w{int(rng.paretovariate(0.6)) % 4000}" for _ in range(n))
    texts = [None, "", " \n ", "One", "one", "one two", "ONE TWO", "a b c d e", "a b c d e f", "x " * 3000, "é " * 7]
    for _ in range(4):
        base = prose(rng.randint(30, 200))
        texts += [base, base, base.upper(), *near_copies(rng, base, 12, rng.randint(1, 4))]
    shared = prose(60)
    texts += [prose(rng.randint(5, 60)) + " " + shared + " " + prose(rng.randint(5, 60)) for _ in range(15)]
    texts += [prose(rng.randint(1, 80)) for _ in range(30)]
    texts += ["\n".join(prose(rng.randint(1, 12)) for _ in range(6)) for _ in range(10)]
    texts += ["\n".join([texts[40], "A  b\tc d", "a b c d", texts[41]]), "a b c\na b c d\nd c b a"]
    rng.shuffle(texts)
    return texts


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components_of(texts):
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize(("seed", "hot", "small", "few", "sent"), [(1, 1 << 16, 16, 4, 10**6), (2, 0, 1, 0, 10**6), (3, 1 << 16, 2, 10**9, 10**6), (4, 0, 1, 10**9, 0)])
def test_ngram_join_equals_brute_force(spark, monkeypatch, seed, hot, small, few, sent):
    """Pairs at once; tiles in rounds; what is left sent to the tiles; what is left joined by tile."""
    for name, value in (("HOT", hot), ("SMALL", small), ("FEW", few), ("FEW_SENT", few), ("SENT_ROWS", sent), ("EXPAND", 50)):
        monkeypatch.setattr(ngram_join, name, value)
    monkeypatch.setattr(ngram_join, "POSTINGS_EACH", 200)
    texts = corpus(random.Random(seed))
    rows = frame(spark, texts).withColumn("n", F.lit("clash"))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(rows.repartition(3)).collect()}
    assert got == dict(enumerate(components_of(texts)))
    if seed > 1:
        return
    kept = ngram_join.deduplicate(rows)
    assert kept.columns == rows.columns and {r["doc_id"] for r in kept.collect()} == {i for i, (_, c) in enumerate(components_of(texts)) if c == i}


@pytest.mark.parametrize("sent", [1 << 16, 0])
def test_ngram_join_compares_what_may_link_alone(spark, monkeypatch, sent):
    """classes outside a large family's component meet those of its members whose bitmaps are near, or all if they are too many."""
    for name, value in (("SMALL", 4), ("SENT_BITMAPS", sent)):
        monkeypatch.setattr(ngram_join, name, value)
    made, keep = [], ngram_join._across

    def across(*args):
        out = keep(*args)
        if out is not None:
            made.append(out.distinct().count())
        return out

    monkeypatch.setattr(ngram_join, "_across", across)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    edited = lambda k: " ".join(w if i not in gone else f"e{rng.random()}" for gone in [set(rng.sample(range(120), k))] for i, w in enumerate(base))
    texts = [edited(1) for _ in range(40)] + [edited(6) for _ in range(40)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(frame(spark, texts)).collect()}
    assert got == dict(enumerate(components_of(texts)))
    assert made and (not sent or sum(made) < 5 * len(texts))


def test_ngram_join_of_odd_rows(spark):
    rows = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (7, None), (3, "A b C d e f")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.join(rows).collect()), key=repr)
    assert got == sorted([(5, 2, 3), (5, 2, 3), (None, 2, None), (7, 0, 7), (3, 2, 3)], key=repr)
    assert ngram_join.join(rows.limit(0)).count() == 0 and ngram_join.deduplicate(rows.limit(0)).count() == 0
    assert sorted(r[0] or 0 for r in ngram_join.deduplicate(rows).select("doc_id").collect()) == [0, 3, 7]


def test_ngram_join_of_a_null_id_ahead_of_its_copy(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = spark.createDataFrame([(None, text), (5, text), (9, text + " more")], "doc_id long, text string").coalesce(1)
    got = sorted(((r["doc_id"], r["component_id"]) for r in ngram_join.join(rows).collect()), key=repr)
    assert got == sorted([(None, None), (5, 5), (9, 5)], key=repr)
    assert sorted(r[0] or 0 for r in ngram_join.deduplicate(rows).select("doc_id").collect()) == [0, 5]


def test_ngram_join_of_one_id_with_two_texts(spark):
    """Each text stands for itself: a copy of one of them goes, the other one stays."""
    text, other = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    rows = spark.createDataFrame([(1, text), (5, text + " more"), (5, other)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["text"]) for r in ngram_join.deduplicate(rows).collect()) == sorted([(1, text), (5, other)])


def test_bitmaps_bound_the_overlap():
    rng = np.random.default_rng(1)
    for _ in range(50):
        pool = rng.integers(0, 1 << 62, 400, dtype=np.uint64)
        sets = [np.unique(rng.choice(pool, int(rng.integers(1, 300)))) for _ in range(2)]
        bits = []
        for s in sets:
            flags = np.unpackbits(np.frombuffer(ngram_join.parity_bits(s), np.uint8)).astype(bool)
            bits.append(np.packbits(flags).view(np.uint64)[None])
        bound = ngram_join.bitmap_bound(*bits, *(np.array([len(s)]) for s in sets))[0]
        assert bound >= len(np.intersect1d(*sets))


def test_connected_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 140)] + [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(35)] + [(200, 201), (201, 200), (7, 7)]
    root = {x: x for e in edges for x in e}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    for local in (0, 10**6):
        got = {r["node"]: r["root"] for r in components.connected(spark.createDataFrame(edges, "u long, v long"), local).collect()}
        assert got == {x: find(x) for x in root if find(x) != x}


def removed(texts):
    seen, out = [], []
    for t in texts:
        gone = set()
        for i, line in enumerate((t or "").split("\n")):
            w = frozenset(re.sub("[\t\x0b\x0c\r]", " ", line.lower()).split(" ")) - {""}
            if not w:
                continue
            if any(100 * len(w & s) >= 75 * len(w | s) for s in seen):
                gone.add(i)
            seen.append(w)
        out.append(gone)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    lines = [" ".join(f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(rng.randint(0, 14))) for _ in range(60)]
    lines += [x for line in lines[:8] for x in near_copies(rng, line, 6, 1)] + ["", "  ", "A  b\tc", "a b c", "c b a d", "é É", "q " * 2000]
    texts = [None, "", "\n", *("\n".join(rng.choice(lines) for _ in range(rng.randint(1, 7))) for _ in range(60))]
    rows = frame(spark, texts).withColumns({"gone": F.lit("clash"), "id": F.lit("clash"), "line.x": F.lit(1)})
    out = line_dedup.dedup(rows, stats=True)
    assert out.columns == [*rows.columns, "n_lines", "n_removed"]
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in out.collect()}
    for i, (t, gone) in enumerate(zip(texts, removed(texts), strict=True)):
        parts = (t or "").split("\n")
        want = None if t is None else "\n".join(x for k, x in enumerate(parts) if k not in gone)
        assert got[i] == (want, 0 if t is None else len(parts), len(gone))


def test_line_dedup_with_frequent_words_equals_brute_force(spark, monkeypatch):
    """Keys of two words, probes and settled classes: a word of three classes counts as frequent."""
    monkeypatch.setattr(line_dedup, "GROUP", 2)
    monkeypatch.setattr(line_dedup, "FEW", 1)
    rng = random.Random(5)
    lines = [" ".join(f"w{int(rng.paretovariate(0.7)) % 40}" for _ in range(rng.randint(3, 25))) for _ in range(60)]
    lines += [x for line in lines[:6] for x in near_copies(rng, line, 12, 2)]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randint(1, 7))) for _ in range(50)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(frame(spark, texts)).collect()}
    for i, (t, gone) in enumerate(zip(texts, removed(texts), strict=True)):
        assert got[i] == "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)


def test_line_dedup_stores_postings_of_two_words_for_families_only(spark, monkeypatch):
    """words that many classes post, next to which no other word is shared often, leave nothing to store."""
    monkeypatch.setattr(line_dedup, "GROUP", 8)
    rows, keep = {}, line_dedup.stored

    def stored(df, name):
        out = keep(df, name)
        rows[name] = rows.get(name, 0) + (out.count() if name in ("frequent", "followed") else 0)
        return out

    monkeypatch.setattr(line_dedup, "stored", stored)
    texts = [" ".join(f"w{x}" for x in random.Random(i).sample(range(60), 8)) for i in range(200)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(frame(spark, texts)).collect()}
    assert got == dict(enumerate(texts))
    assert rows["frequent"] > 0
    assert rows.get("followed", 0) == 0


def test_line_dedup_compares_a_family_of_near_copies_a_few_times_its_size(spark, monkeypatch):
    """fewer than GROUP near copies of one line aren't compared with each other."""
    pairs, keep = [], line_dedup.stored

    def stored(df, name):
        out = keep(df, name)
        if name == "pairs":
            pairs.append(out.count())
        return out

    monkeypatch.setattr(line_dedup, "stored", stored)
    rng = random.Random(3)
    line = [f"w{i}" for i in range(40)]
    texts = [" ".join(x if i not in gone else f"v{rng.random()}" for i, x in enumerate(line)) for gone in [rng.sample(range(40), 2) for _ in range(80)]]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(frame(spark, texts)).collect()}
    assert [bool(got[i]) for i in range(80)] == [not gone for gone in removed(texts)]
    assert sum(pairs) <= 4 * 80


def test_line_dedup_finds_near_copies_whose_rarest_words_are_new(spark, monkeypatch):
    """lines that each begin with rare words of their own still meet the earliest of their family first."""
    pairs, keep = [], line_dedup.stored

    def stored(df, name):
        out = keep(df, name)
        if name == "pairs":
            pairs.append(out.count())
        return out

    monkeypatch.setattr(line_dedup, "stored", stored)
    texts = [" ".join([f"w{k}" for k in range(80)] + [f"v{i}x{k}" for k in range(6)]) for i in range(60)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(frame(spark, texts)).collect()}
    assert [bool(got[i]) for i in range(60)] == [not gone for gone in removed(texts)]
    assert sum(pairs) <= 3 * 60


def test_line_dedup_joins_a_run_of_common_words_once(spark):
    """two lines that share their words one after the other are one pair of postings, not one at each word."""
    words = [*range(100, 116)]
    row = lambda cls, first: (cls, 60, words, 1, first, cls, 0, 0, 0)
    classes = spark.createDataFrame([row(1, 5), row(2, 6)], "cls long, n int, prefix array<long>, band int, id long, c long, x long, y long, z long")
    classes = classes.withColumns({"settled": F.lit(False), "places": F.lit(None).cast("array<int>")})
    out = line_dedup._pairs(line_dedup._single(classes), 0)
    assert [(r["a"], r["b"]) for r in out.collect()] == [(1, 2)]
    posts = line_dedup._single(classes).where("far = 0").select("key", "cls", "before")
    met = posts.alias("a").join(posts.alias("b"), "key").where("a.cls < b.cls and (a.before != b.before or a.before = 0)")
    assert met.count() == 1


def test_line_dedup_keeps_the_words_levels_out_of_its_plans(spark, monkeypatch):
    """the driver keeps the text of each plan, and a literal of the counters made it a megabyte."""
    sizes, keep = [], line_dedup.stored

    def stored(df, name):
        sizes.append(len(df._jdf.queryExecution().toString()))
        return keep(df, name)

    monkeypatch.setattr(line_dedup, "stored", stored)
    texts = ["a b c d e f", "a b c d e f g", "h i j"]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(frame(spark, texts)).collect()}
    assert got == {0: texts[0], 1: "", 2: texts[2]}
    assert max(sizes) < 200_000


def test_bands_of_sizes_are_neighbours():
    n = np.arange(3, 1_000_000)
    band = lambda x: np.floor(np.log(x) / np.log(100 / 75) + 1e-9)
    assert ((band(n * 100 // 75) - band(n)) <= 1).all()


def test_line_dedup_of_odd_rows(spark):
    rows = spark.createDataFrame([(1, "a b c\nx y z"), (1, "a b c\nx y z"), (None, "x y z"), (2, "a b c")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["text"]) for r in line_dedup.dedup(rows).collect()), key=repr)
    assert got == sorted([(1, "a b c"), (1, "a b c"), (None, "x y z"), (2, "")], key=repr)
    assert line_dedup.dedup(rows.limit(0)).count() == 0


@pytest.mark.parametrize(("n", "shards"), [(0, 40), (1, 40), (7, 40), (500, 40), (503, 7)])
def test_shards_match_the_mixture(spark, n, shards):
    rng = random.Random(n)
    sources = ["hot" if rng.random() < 0.4 else rng.choice(["a", "b", None]) for _ in range(n)]
    rows = frame(spark, [rng.choice([None, "", "é", "text " * rng.randint(0, 9)]) for _ in range(n)], sources or None).withColumn("shard", F.lit("clash"))
    rows = rows.unionAll(rows.limit(5))
    n = rows.count()
    got = sharding.assign(rows, shards, carry={"size": sharding.text_size(F.col("text")), "source": F.col("source")}).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r["doc_id"] for r in rows.collect())
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    assert all(sorted(r["slot"] for r in x) == list(range(len(x))) for x in by.values()) and all(0 <= s < shards for s in by)
    if n:
        sizes = [len(by[s]) for s in range(shards)]
        assert max(sizes) - min(sizes) <= 1
        share = collections.Counter(r["source"] for r in got)
        for x in by.values():
            for s, c in collections.Counter(r["source"] for r in x).items():
                assert abs(c - share[s] * len(x) / n) <= 2
    place = lambda df: sorted(((r["doc_id"], r["shard"], r["slot"]) for r in sharding.assign(df, shards).collect()), key=repr)
    assert place(rows) == place(rows.orderBy(F.desc("doc_id")).repartition(3))


def test_sizes_and_checksums(spark, tmp_path):
    texts = [None, "", "aé日", "x" * 1000]
    path = str(tmp_path / "sf")
    frame(spark, texts).write.parquet(path + "/documents.parquet")
    rows = {r["doc_id"]: r for r in queries.op2_sharding(spark, path).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        assert (rows[i]["size"], rows[i]["text_crc32"], rows[i]["law"], rows[i]["grown_shard"]) == (len(data) + 16, zlib.crc32(data), "rows", None)
    sharding.write_shards(frame(spark, texts), str(tmp_path / "out"), 2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["doc_id"] for r in back.collect()) == [0, 1, 2, 3] and {r["shard"] for r in back.collect()} == {0, 1}


ODD = [None, "", " ", "  a", "a  b", " a b ", "é b", "b é́ x", "日本 語", "a b c", "a ̀b", "tab\tx y\n\nz ", "emoji 😀 x", "\x00\x01 a", "<s> </s> <unk> <0x41>", "a\r\nb", "don't we'll 'tis", "<|endoftext|>", "x" * 3000, "w, " * 500, "%%%a b%%%, c!!", "ß, ñ. É!"]


def fuzz(rng, n=400):
    pieces = ["a", "b", " ", "  ", "\n", " ", "é", " ", "'s", "1", "!", "😀", "̀", "日", "\t", " ", "\u0085", "ß", ",", "The", "×"]
    return ODD + ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_token_files_hold_what_the_library_gives(spark, monkeypatch, tmp_path):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("byte_bpe_50k.json")
    made, untouched = Tokenizer.from_file(path), Tokenizer.from_file(path)
    made.encode_special_tokens = True  # a special token's string in a text is text; elsewhere the flag changes nothing
    texts = [*fuzz(random.Random(1)), "a <|endoftext|>b", "<|endoftext|><|endoftext|>"]
    for t in texts:
        if "<|endoftext|>" not in (t or ""):
            assert made.encode(t or "", add_special_tokens=False).ids == untouched.encode(t or "", add_special_tokens=False).ids
    monkeypatch.setattr(token_files, "ENCODE_BYTES", 900)
    rows = frame(spark, texts).withColumn("start", F.lit("clash"))
    shuffled = rows.orderBy(F.desc("doc_id")).repartition(3)
    files = token_files.write(shuffled, path, str(tmp_path / "files"))
    got = {r["doc_id"]: r for r in token_files.read(spark.newSession(), files).collect()}
    start, freq = 0, collections.Counter()
    for i, t in enumerate(texts):
        ids = [*made.encode(t or "", add_special_tokens=False).ids, token_files.END]
        freq.update(ids)
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), t
        start += len(ids)
    counts = [freq[int(i)] for i in token_files._rank_table(spark, files)]
    assert counts == sorted(counts, reverse=True)
    spark.createDataFrame([(1, 0, bytearray(8))], "version int, crc32 long, ids binary").write.mode("overwrite").parquet(files + "/ranks")
    with pytest.raises(ValueError):
        token_files.read(spark, files)
    odd = spark.createDataFrame([(None, "x"), (2, "y"), (2, "y"), (1, None)], "doc_id long, text string")
    back = token_files.read(spark, token_files.write(odd, path)).orderBy("start").collect()
    assert [r["doc_id"] for r in back] == [None, 1, 2, 2]
    assert token_files.read(spark, token_files.write(odd.limit(0), path)).count() == 0


def test_blocks_round_trip():
    rng = random.Random(2)
    for _ in range(60):
        n = rng.randint(0, 300)
        ranks = np.array([rng.choice([0, 255, 256, 65535, 65536, 1 << 24, 2**32 - 1, rng.randint(0, 50000)]) for _ in range(n)], np.uint32)
        ids, counts, back = token_files.unpack(token_files.pack(np.array([5, -3]), np.array([n, 0]), ranks))
        assert (back == ranks).all() and ids.tolist() == [5, -3] and counts.tolist() == [n, 0]
    with pytest.raises(ValueError):
        token_files.unpack(b"\0" * 40)


def test_forgetting_words_changes_nothing(monkeypatch):
    monkeypatch.setattr("paneweave.llm.wordwise.REMEMBERED", 50)
    plain = Wordwise(lambda ws: [list(w.encode()) for w in ws], np.ones(256, np.int64), punctuation=True)
    texts = fuzz(random.Random(3), 200)
    for _, b in bt.blocks(pa.array(texts), size=500):
        ids, counts = plain.block(b)
        assert bytes(ids.astype(np.uint8)) == b.data.tobytes() and counts.tolist() == np.diff(b.offsets).tolist()
        assert set(b.offsets[:-1][np.diff(b.offsets) > 0].tolist()) <= set(cuts(b).tolist())


def test_sentencepiece_parity_and_round_trip(spark):
    import sentencepiece

    path = queries.tokenizer_path("piece_bpe_32k.model")
    texts = fuzz(random.Random(4))
    wanted = sentencepiece.SentencePieceProcessor(model_file=path).encode([t or "" for t in texts])
    rows = frame(spark, texts).withColumn("ids", F.lit("clash"))
    got = {r["doc_id"]: r for r in sentencepiece_codec.encode(rows, path).collect()}
    for i, (t, ids) in enumerate(zip(texts, wanted, strict=True)):
        assert got[i]["ids"] == ids and got[i]["n_tokens"] == len(ids) and got[i]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes()), t
        assert got[i]["decodes"], t
    codec = sentencepiece_codec.Codec.get(path)
    assert codec.decode(wanted) == [t or "" for t in texts]
    assert sentencepiece_codec.encode(rows.limit(0), path).count() == 0
    broken = sentencepiece_codec.Codec(path)
    broken.model = sentencepiece_codec.Model((("a", 0.0, 1),), 7, False, b"", True, False, 0)
    with pytest.raises(ValueError):
        broken.model.backend()


def test_sentencepiece_remembers_a_bounded_number_of_words():
    """what a worker remembers stands beside its executor's heap."""
    import sentencepiece

    path = queries.tokenizer_path("piece_bpe_32k.model")
    codec = sentencepiece_codec.Codec(path)
    texts = [" ".join(f"{i}x{k}" for k in range(2000)) for i in range(100)]
    got = codec.encode(texts)
    assert len(codec.words.known) <= 150_000
    wanted = sentencepiece.SentencePieceProcessor(model_file=path)
    assert all(got[i] == wanted.encode(texts[i]) for i in (0, 50, 99))


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(9)
    prose = lambda n: " ".join(f"{rng.choice(['to', 'the', 'of'])} wo{rng.randint(0, 9999)}rd" for _ in range(n // 2))
    good = ["\n".join(prose(40) for _ in range(4)) for _ in range(12)]
    item = prose(30)
    words = good[1].split(" ")
    words[20] = "edited"
    texts = [*good, good[0], " ".join(words), "short", None, "", "bad " * 100, good[2] + "\n" + item + " " + prose(40), item * 3]
    path = str(tmp_path / "sf")
    frame(spark, texts).write.parquet(path + "/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(path + "/benchmark.parquet")
    docs = spark.read.parquet(path + "/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "SentencePiece encoding and decoding"]
    now = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, path)
        now.write.parquet(out := str(tmp_path / f"stage{k}"))
        now = spark.read.parquet(out)
        if k < 4:
            assert now.columns == docs.columns and now.dtypes == docs.dtypes
            assert all(r["n_chars"] == len(r["text"]) for r in now.collect())
        if k == 3:
            assert not any(item[:60] in r["text"] for r in now.collect())
    kept = {r["doc_id"] for r in now.collect()}
    assert set(range(12)) <= kept and not kept & {14, 15, 16, 17}
    key = lambda df: sorted((r["doc_id"], r["ids_crc32"]) for r in df.collect())
    assert key(corpus_pipeline.run(spark, path)) == key(now)
    assert corpus_pipeline.ORACLE_SQL is None
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), path).count() == 0
