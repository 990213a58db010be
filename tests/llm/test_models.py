"""The classifiers' and the labeller's scores against plain Python loops, and the operators' SQL."""

import math
import random
import re
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from paneweave.llm import bytetext as bt
from paneweave.llm import html_extract, queries, quality_net, toxicity

SF = Path("/root/testdata/sf0.001")


def texts(rng, n=25):
    out = [None, "", "a", "Ab", "hello world foo", "hello world foo", "é日" * 30, "ab " * 400, "x" * 1500]
    return out + ["".join(rng.choice("aB é\n,#x1日") for _ in range(rng.randint(0, 1400))) for _ in range(n)]


def in_blocks(rows, size, lower=False):
    return [b for _, b in bt.blocks(pa.array(rows, pa.large_string()), lower=lower, size=size)]


def sigmoid(z):
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, z))))


def toxic_score(model, text):
    data = b" " + re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode() + b" "
    found = set()
    for size in toxicity.NGRAMS:
        for i in range(len(data) - size + 1):
            h = 0
            for byte in data[i : i + size]:
                h = (h * 0x01000193 + int(toxicity._CODE[byte])) & 0xFFFFFFFF
            h = ((h ^ (h >> 15)) * (0x2C1B3C6D + 2 * size)) & 0xFFFFFFFF
            found.add((h ^ (h >> 12)) >> (32 - toxicity.BITS))
    return sigmoid(model.intercept + math.fsum(float(model.weights[x]) for x in found))


@pytest.mark.parametrize("size", [1, 700, 1 << 20])
def test_toxicity_scores_equal_brute_force(size):
    rows = texts(random.Random(1))
    model = toxicity.Model(0.3)
    model.weights[:] = np.random.default_rng(2).normal(0, 0.05, len(model.weights))
    got = np.concatenate([model.scores(b) for b in in_blocks(rows, size, lower=True)])
    assert np.allclose(got, [toxic_score(model, t) for t in rows], atol=1e-9)


def net_score(net, text):
    """Chunk by chunk, filter by filter, in 64 bits."""
    data = (text or "").encode()
    again = [False] * len(data)
    for lag in quality_net.LAGS:
        for i in range(lag + quality_net.RUN - 1, len(data)):
            if all(data[j] == data[j - lag] for j in range(i - quality_net.RUN + 1, i + 1)):
                again[i - quality_net.RUN + 1] = True
    features = []
    begin = 0
    while True:
        part = data[begin : begin + quality_net.CHUNK]
        x = np.zeros((quality_net.CHUNK, quality_net.CHANNELS + 1))
        for i in range(quality_net.CHUNK):
            x[i, :-1] = net.embed[part[i] if i < len(part) else quality_net.PAD]
            x[i, -1] = again[begin + i] if i < len(part) else 0
        places = max((len(part) - quality_net.WIDTH) // quality_net.STRIDE + 1, 1)
        active = np.array([np.maximum(x[k * quality_net.STRIDE : k * quality_net.STRIDE + quality_net.WIDTH].ravel() @ net.filters + net.offset, 0) for k in range(places)])
        features.append(np.tanh(np.concatenate([active.max(0), active.mean(0)]) @ net.dense + net.bias))
        if begin + quality_net.CHUNK >= len(data):
            break
        begin += quality_net.STEP
    f = np.array(features)
    return sigmoid(float(np.concatenate([f.max(0), f.mean(0)]) @ net.top + net.base[0]))


@pytest.mark.parametrize("size", [1, 900, 1 << 20])
def test_net_scores_equal_brute_force(size):
    """In any batching: what a text repeats is looked for in the text itself alone."""
    rows = texts(random.Random(3))
    net = quality_net.Net()
    net.top = np.random.default_rng(4).normal(0, 1, net.top.shape).astype(np.float32)
    got = np.concatenate([net.scores(b) for b in in_blocks(rows, size)])
    assert np.allclose(got, [net_score(net, t) for t in rows], atol=2e-5)
    assert got[4] == got[5]


def lstm_logits(p, x):
    """One page, one step, one unit at a time."""
    H = html_extract.HIDDEN
    sides = []
    for d in "fb":
        h, c, out = np.zeros(H), np.zeros(H), {}
        for t in range(len(x)) if d == "f" else reversed(range(len(x))):
            z = x[t].astype(float) @ p["x" + d] + h @ p["h" + d] + p["c" + d]
            new_h, new_c = np.zeros(H), np.zeros(H)
            for k in range(H):
                i, f, o = (sigmoid(z[k + j * H]) for j in range(3))
                new_c[k] = f * c[k] + i * math.tanh(z[k + 3 * H])
                new_h[k] = o * math.tanh(new_c[k])
            h, c = new_h, new_c
            out[t] = h
        sides.append(out)
    return [float(np.concatenate([sides[0][t], sides[1][t]]) @ p["out"] + p["base"][0]) for t in range(len(x))]


@pytest.mark.parametrize("steps", [1, 60, 1 << 15])
def test_labels_equal_brute_force(monkeypatch, steps):
    monkeypatch.setattr(html_extract, "STEPS_AT_ONCE", steps)
    rng = np.random.default_rng(6)
    pages = [html_extract.blocks(html_extract.sample_page(rng)[0]) for _ in range(12)] + [[], html_extract.blocks("<p>one</p>" * 90)]
    model = html_extract.Lstm(seed=8)
    for got, page in zip(model.label(pages), pages, strict=True):
        want = lstm_logits(model.p, html_extract.vectors([page]))
        assert len(got) == len(page) and all(abs(z) < 1e-4 or bool(g) == (z > 0) for g, z in zip(got, want, strict=True))


def test_odd_markup_is_read_once():
    texts_of = lambda page: [b[1] for b in html_extract.blocks(page)]
    assert texts_of("<a <a <a " * 30_000)[0].startswith("<a <a")
    assert texts_of("<p \">z</p><p>y") == ["z", "y"]
    assert texts_of("<p title='a>b'>t</p>") == ["t"]
    assert texts_of("<p>x <!-- y") == ["x"] and texts_of("<p>x<script>y") == ["x"]
    assert texts_of("<p>p<textarea>u</p><p>v") == ["p u", "v"]
    assert texts_of("<p><svg><text>hi</text></svg></p>") == ["hi"]
    assert texts_of("a < b > c") == ["a < b > c"]
    assert len(texts_of("<a '" * 30_001 + "<b>q")) <= 2


@pytest.mark.skipif(not SF.exists(), reason="the tables aren't there")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in SF.glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from read_parquet('{f}')")
    df = queries.QUERIES[name](spark, str(SF))
    rel = con.sql(queries.ORACLES[name])
    columns = sorted(df.columns)
    assert sorted(rel.columns) == columns
    order = [rel.columns.index(c) for c in columns]
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    assert got == sorted((tuple(r[i] for i in order) for r in rel.fetchall()), key=repr) and got
