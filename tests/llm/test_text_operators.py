"""Rules, decontamination, classifiers and extraction against plain Python."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paneweave.llm import bytetext as bt
from paneweave.llm import decontaminate, html_extract, labelled, quality_net, quality_rules, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


def odd_texts(rng, n=60, alphabet=("a", "b", "Bé", "日本", "%%", "|x", "#")):
    out = [None, "", " ", "\n\n", "a", "x " * 4000, "é" * 3000]
    for _ in range(n):
        out.append("".join(rng.choice([*alphabet, " ", " ", "\n", "\t", "\x0b", " "]) for _ in range(rng.randint(0, 200))))
    return out + out[10:20]


def test_blocks_cut_between_texts():
    texts = ["abc", None, "é", "", "x" * 50]
    got = [(at, [b.text(k).decode() for k in range(b.n)]) for at, b in bt.blocks(pa.array(texts), size=6)]
    assert [t for _, ts in got for t in ts] == [t or "" for t in texts] and got[-1] == (len(texts) - 1, ["x" * 50])
    assert list(bt.blocks(pa.array([], pa.string()))) == []
    sliced = pa.array(["no", *texts]).slice(1)
    assert [b.text(k).decode() for _, b in bt.blocks(sliced, size=6) for k in range(b.n)] == [t or "" for t in texts]


def figures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    again = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(again)


def verdict(text):
    n, chars, symbols, dup, again = figures(text)
    text = text or ""
    lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", line)) for line in text.split("\n"))
    upper, letters = len(re.findall("[A-Z]", text)), len(re.findall(r"[A-Za-z\u0080-\U0010ffff]", text))
    bad = 10 * symbols > 3 * n or 2 * upper > letters or 2 * dup > lines or chars < 2 * n or chars > 15 * n or 2 * letters < chars
    return n < 50 or 2 * again > n, bad


def test_quality_rules_equal_brute_force(spark):
    rng = random.Random(3)
    texts = odd_texts(rng) + [" ".join(rng.choice(["word", "longer", "Third", "and", "x%%"]) + str(rng.randint(0, 99)) for _ in range(80)) for _ in range(20)]
    rows = {r["doc_id"]: r for r in quality_rules.judge(docs(spark, texts)).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        failed, bad = verdict(t)
        assert tuple(rows[i][k] for k in quality_rules.FIGURES) == figures(t), t
        assert rows[i]["base_failed"] == failed and rows[i]["kept"] == (not failed and not bad), t


def test_cascade_keeps_the_same_texts_in_any_order(spark):
    rng = random.Random(4)
    texts = odd_texts(rng) + [" ".join(f"w{rng.randint(0, 500)}" for _ in range(70)) for _ in range(10)]
    rows = docs(spark, texts).withColumn("n_words", F.lit("clash"))
    want = {i for i, t in enumerate(texts) if not any(verdict(t))}
    for rules in (quality_rules.BASE_RULES + quality_rules.RULES, (quality_rules.RULES + quality_rules.BASE_RULES)[::-1]):
        out = quality_rules.Cascade(rules).fit(rows, 20).filter(rows)
        assert out.columns == rows.columns and {r["doc_id"] for r in out.collect()} == want
    assert quality_rules.Cascade().fit(rows.limit(0)).filter(rows.limit(0)).count() == 0
    fitted = quality_rules.Cascade().fit(rows)
    pay = [fitted.estimates[r.name][1] / max(fitted.estimates[r.name][0], 1e-9) for r in fitted.rules]
    assert pay == sorted(pay, reverse=True)


def norm(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_hits(texts, items, window):
    table = collections.defaultdict(set)
    for name, t in items:
        w = norm(t)
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            table[tuple(w[i : i + k])].add("" if name is None else str(name))
    out = []
    for t in texts:
        w, hit, found = norm(t), set(), set()
        for k in {len(x) for x in table}:
            for i in range(len(w) - k + 1):
                if got := table.get(tuple(w[i : i + k])):
                    hit |= set(range(i, i + k))
                    found |= got
        out.append((len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_decontamination_equals_brute_force(spark, seed, monkeypatch):
    """With one automaton, and with several that are built, sent out and read one by one."""
    if seed > 1:
        monkeypatch.setattr(decontaminate, "AUTOMATON_BYTES", 60)
    monkeypatch.setattr(decontaminate, "STRETCH_WORDS", 9)
    rng = random.Random(seed)
    words = ["a", "B", "c é", "日", "x1"][: 2 + seed]
    items = [(i, rng.choice([" ", ", ", "\n"]).join(rng.choice(words) for _ in range(rng.randint(0, 14)))) for i in range(12)] + [(99, None), (98, "..."), (0, "a a a"), (0, "a a a"), (None, "a B a B")]
    texts = [None, "", "...", "a " * 3000, *(" ".join(rng.choice([*words, "Q"]) for _ in range(rng.randint(0, 60))) for _ in range(40))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = {r["doc_id"]: r for r in decontaminate.measure(docs(spark, texts), benchmark, 4).collect()}
    for i, (n, hit, found) in enumerate(brute_hits(texts, items, 4)):
        assert (rows[i]["n_words"], rows[i]["n_hit"], rows[i]["n_items"], rows[i]["contaminated"]) == (n, hit, len(found), hit > 0)
        assert rows[i]["items_sha256"] == hashlib.sha256(",".join(found).encode()).hexdigest()
    cleaned = decontaminate.clean(docs(spark, texts).withColumn("item_id", F.lit("clash")), benchmark, 4, 2.0)
    assert "item_id" in cleaned.columns
    after = {r["doc_id"]: r["text"] for r in cleaned.collect()}
    assert len(after) == len(texts)
    assert all(h == 0 for _, h, _ in brute_hits(after.values(), items, 4))
    assert all(after[i] == t for i, (t, (_, h, _)) in enumerate(zip(texts, brute_hits(texts, items, 4))) if not h)


def test_mostly_benchmark_texts_are_left_out(spark):
    item = " ".join(f"w{i}" for i in range(20))
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = docs(spark, [item, "before it. " + item + " and after it, more words follow here to the end of it all", "clean"])
    got = {r["doc_id"]: r["text"] for r in decontaminate.clean(rows, benchmark).collect()}
    assert got == {1: "before it. and after it, more words follow here to the end of it all", 2: "clean"}
    assert decontaminate.measure(rows, benchmark.limit(0)).where("contaminated").count() == 0
    assert decontaminate.measure(rows.limit(0), benchmark).count() == 0


def prose(rng, words=("river", "stone", "walks", "under", "night", "paper", "green", "often", "house", "light"), n=60):
    return " ".join(rng.choice(words) + rng.choice(["", "", ",", "s"]) for _ in range(n))


def sampled(spark, rng, kind):
    texts, y = [], []
    for i in range(240):
        t = prose(rng, n=rng.randint(10, 120))
        bad = i % 4 == 0
        if bad and kind == "toxic":
            for _ in range(3):
                t = t.replace(" ", f" {rng.choice(['gruntoid', 'flimmox'])} ", 1)
        elif bad:
            t = rng.choice([" | ".join(t.split()), "%%% ".join(t.split()), " ".join([t.split()[0]] * 60)])
        texts.append(t)
        y.append(int(bad) if kind == "toxic" else int(not bad))
    labels = spark.createDataFrame([(i, v, v) for i, v in enumerate(y)], "doc_id long, quality int, toxic int")
    return texts, y, labels


@pytest.mark.parametrize("kind", ["toxic", "quality"])
def test_classifiers_learn_from_their_rows_only(spark, kind):
    rng = random.Random(6)
    texts, y, labels = sampled(spark, rng, kind)
    module, modulus, out = (toxicity, 3, 1) if kind == "toxic" else (quality_net, 4, 2)
    more = docs(spark, [*texts, None, "", "z" * 5000, texts[0]]).withColumn("score", F.lit("clash"))
    model = module.train(more, labels, per_class=150)
    rows = {r["doc_id"]: r for r in module.score(more, model).collect()}
    assert len(rows) == len(texts) + 4 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows.values())
    held = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % modulus == out]
    assert {i for i, r in rows.items() if r["held_out"] and i < len(texts)} == set(held)
    right = sum((rows[i]["score"] > 0.5) == bool(y[i]) for i in held) / len(held)
    assert right > 0.9
    assert rows[len(texts)]["score"] == rows[len(texts) + 1]["score"] and rows[len(texts) + 3]["score"] == pytest.approx(rows[0]["score"], abs=1e-5)
    # labels of held-out rows play no part
    flipped = labels.withColumn(kind, F.when(labelled.remainder(modulus) == out, 1 - F.col(kind)).otherwise(F.col(kind)))
    again = module.score(more, module.train(more, flipped, per_class=150))
    assert {r["doc_id"]: r["score"] for r in again.collect()} == pytest.approx({i: r["score"] for i, r in rows.items()}, abs=1e-5)
    assert module.score(more, module.train(more, labels.limit(0))).select("score").distinct().count() == 1
    assert module.score(more.limit(0), model).count() == 0


def test_net_gradients_are_right():
    rng = np.random.default_rng(0)
    net = quality_net.Net()
    for name in net.NAMES:
        setattr(net, name, getattr(net, name).astype(np.float64))
    texts = ["ab | cd " * 40, "x", "hello world " * 90, ""]
    (_, block), = bt.blocks(pa.array(texts))
    data, again, counts = quality_net.chunks(block)
    y, w = np.array([0, 1, 1, 0]), np.array([1.0, 2.0, 1.0, 0.5])

    def loss():
        z = net.logits(net.pooled(data, again), counts)
        return float((w * (np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0) - y * z)).sum() / w.sum())

    grads = net.gradients(data, again, counts, y, w)
    for name in ("filters", "dense", "top", "embed"):
        value = getattr(net, name)
        at = tuple(int(rng.integers(n)) for n in value.shape) if name != "embed" else (ord("c"), 2)
        old = value[at]
        value[at] = old + 1e-3
        up = loss()
        value[at] = old - 1e-3
        down = loss()
        value[at] = old
        assert grads[name][at] == pytest.approx((up - down) / 2e-3, rel=0.05, abs=2e-5), name


def test_chunks_cover_whole_texts():
    texts = ["", "a" * 511, "b" * 512, "c" * 513, "d" * 5000]
    (_, block), = bt.blocks(pa.array(texts))
    data, _, counts = quality_net.chunks(block)
    edge = np.concatenate([[0], np.cumsum(counts)])
    for k, t in enumerate(texts):
        rows = data[edge[k] : edge[k + 1]]
        whole = np.full(len(t) + quality_net.CHUNK, quality_net.PAD)
        for i, row in enumerate(rows):
            part = whole[i * quality_net.STEP : i * quality_net.STEP + quality_net.CHUNK]
            part[:] = row[: len(part)]
        assert (whole[: len(t)] != quality_net.PAD).all()


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header class="site-header">Brand name here</header>
<nav><ul><li><a href="/a">Home</a><li><a href="/b">News of today</a></ul></nav><div class="ad">Buy this now</div><article><h1>A  title &amp; more&copy</h1><p>First <b>bold</b> text<br>goes
on&nbsp;here &lt;ok&gt;.<p>Second one with many words in it, as articles have them.<!-- <p>no</p> --><script>x</script> tail</article>
<div class="comments"><p>reader says a thing</p></div><footer>&copy; somebody 2020</footer>"""


@pytest.fixture(scope="module")
def labeller():
    return html_extract.train()


def test_html_main_text(spark, labeller):
    pages = spark.createDataFrame([(1, "u", PAGE, 5), (2, None, None, 5), (3, "u", "", 5), (4, "u", "<<<>>><p", 5), (1, "u", PAGE, 5), (5, "u", PAGE.replace("Second one", "long " * 20000), 5)], "page_id long, url string, html string, text int")
    rows = html_extract.extract(pages, labeller).collect()
    assert len(rows) == 6
    want = "A title & more©\nFirst bold text goes on here <ok>.\nSecond one with many words in it, as articles have them. tail"
    by = collections.defaultdict(list)
    for r in rows:
        by[r["page_id"]].append(r["text"])
        assert r["n_chars"] == len(r["text"])
    assert by[1] == [want, want] and by[2] == by[3] == [""] and by[5][0].count("long") == 20000
    assert html_extract.extract(pages.limit(0), labeller).count() == 0


def test_labeller_on_pages_it_has_not_seen(labeller):
    rng = np.random.default_rng(4242)
    right = total = 0
    for _ in range(150):
        page, labels = html_extract.sample_page(rng)
        found = html_extract.blocks(page)
        assert len(found) == len(labels)
        right += int((labeller.label([found])[0] == np.array(labels)).sum())
        total += len(labels)
    assert right / total > 0.97


def test_lstm_gradients_are_right():
    rng = np.random.default_rng(2)
    net = html_extract.Lstm()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, mask, y = rng.normal(size=(3, 5, html_extract.DIMS)), np.array([[1, 1, 1, 1, 1], [1, 1, 1, 0, 0], [1, 0, 0, 0, 0]], bool), rng.integers(0, 2, (3, 5)).astype(float)

    def loss():
        z = net.logits(x, mask)
        return float(((np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0) - y * z) * mask).sum() / mask.sum())

    grads = net.gradients(x, mask, y)
    for name, value in net.p.items():
        at = tuple(int(rng.integers(n)) for n in value.shape)
        old = value[at]
        value[at] = old + 1e-3
        up = loss()
        value[at] = old - 1e-3
        down = loss()
        value[at] = old
        assert grads[name][at] == pytest.approx((up - down) / 2e-3, rel=0.05, abs=2e-5), name
