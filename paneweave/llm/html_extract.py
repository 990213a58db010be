"""Main text of web pages by a recurrent block labeller.

A page is read once into leaf blocks: stretches of text between block-level tags, with the path of
open elements above them.  Each block becomes a vector: hashed tags, classes, ids and roles of its
path, hashed words of its text, and a few figures (length, share of linked text, place).  A
bidirectional LSTM in numpy reads the page's blocks in order, so each block is judged by the whole
page around it, and a logistic output tells main text from the rest.

There are no labelled pages, so the network is fitted on pages that ``sample_page`` writes: random
layouts with known main text, whose menus, headers, sidebars, notices, adverts, forms, footers and
reader comments use the usual tags and class names.  Fitting takes some seconds at each call, has a
fixed seed and a documented size (TRAIN_PAGES), and is the same for any input.

Character references are decoded, white space within a block becomes one space, blocks are trimmed
and joined by one line feed; nothing is cut or capped.  Scripts, styles, templates, frames, text fields,
comments and markup hold no text.  Null and empty pages give an empty text of 0 characters; unclosed and stray tags
close as browsers do for paragraphs, items and cells; repeated rows give the same text; an empty table
gives an empty one; further columns don't matter.
"""

from __future__ import annotations

import html as references
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import bytetext as bt
from .runtime import map_arrow

PATH_DIMS, WORD_DIMS, FIGURES = 48, 16, 4
DIMS = PATH_DIMS + WORD_DIMS + FIGURES
HIDDEN = 16
TRAIN_PAGES = 500
STEPS_AT_ONCE = 1 << 15

# fixed values: elements of the HTML standard by their part in the layout
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style template iframe select textarea".split())
_TO_THE_END = frozenset("script style".split())
_CLOSED_BY = {"li": ("li",), "p": ("p",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_HOLDS = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}

# possessive, so a tag is read once; a quote that nothing closes is a character like any other
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?>[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>|<[!?/][^>]*>", re.S)
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_END_RAW = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in _RAW}


def blocks(page: str) -> list[tuple[tuple[str, ...], str, float]]:
    """(path tokens, text, share of its characters in links) of each leaf block, in page order."""
    out: list[tuple[tuple[str, ...], str, float]] = []
    stack: list[tuple[str, str]] = []  # element, its tokens
    held: list[str] = []
    linked = total = 0
    in_link = 0
    at, size = 0, len(page)
    last = page.rfind(">")  # no tag ends behind it

    def flush() -> None:
        nonlocal linked, total
        if held:
            if text := " ".join("".join(held).split()):
                out.append((tuple(x[1] for x in stack if x[0] not in _INLINE), text, linked / max(total, 1)))
            held.clear()
        linked = total = 0

    def close(names: tuple[str, ...], stops: tuple[str, ...] = ()) -> None:
        nonlocal in_link
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                in_link -= sum(x[0] == "a" for x in stack[i:])
                del stack[i:]
                return
            if stack[i][0] in stops:
                return

    while at < size:
        tag = _TAG.search(page, at) if at <= last else None
        to = tag.start() if tag else page.find("<!--", at) % (size + 1)  # size if there is none
        if to > at:
            held.append(references.unescape(page[at:to]))
            total += to - at
            linked += (to - at) * (in_link > 0)
        if not tag:
            break
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name:
            continue
        inline = name in _INLINE
        if tag[1]:
            if not inline:
                flush()
            close((name,))
            continue
        if name == "br":
            held.append(" ")
            continue
        if name in _RAW:
            if not tag[3].endswith("/"):
                end = _END_RAW[name].search(page, at)
                at = end.end() if end else size if name in _TO_THE_END else at
            held.append(" ")
            continue
        if not inline:
            flush()
            close(_CLOSED_BY.get(name, ("p",)), _HOLDS.get(name, ()) if name in _CLOSED_BY and name != "p" else ("body", "article", "section", "div", "td", "th", "li", "blockquote"))
        if name in _VOID or tag[3].endswith("/"):
            continue
        tokens = name
        if "=" in tag[3] and not inline:
            for m in _NAMED.finditer(tag[3]):
                tokens += "".join(f" {m[1].lower()}:{w}" for w in re.split(r"[\s_-]+", (m[2] or m[3] or m[4] or "").lower()) if w)
        stack.append((name, tokens))
        in_link += name == "a"
    flush()
    return out


_paths: dict[tuple[str, ...], np.ndarray] = {}


def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    if (found := _paths.get(path)) is not None:
        return found
    v = np.zeros(PATH_DIMS, np.float32)
    for element in path:
        for token in element.split(" "):
            h = zlib.crc32(token.partition(":")[2].encode() or token.encode())
            v[h % PATH_DIMS] += 1 if h >> 16 & 1 else -1
            v[(h >> 8) % PATH_DIMS] += 1 if h >> 17 & 1 else -1
    if len(_paths) > 50_000:
        _paths.clear()
    _paths[path] = v
    return v


def vectors(pages: list[list[tuple[tuple[str, ...], str, float]]]) -> np.ndarray:
    """One row for each block of all pages."""
    flat = [b for page in pages for b in page]
    x = np.zeros((len(flat), DIMS), np.float32)
    if not flat:
        return x
    x[:, :PATH_DIMS] = np.stack([_path_vector(b[0]) for b in flat])
    for at, block in bt.blocks(pa.array([b[1] for b in flat], pa.large_string()), lower=True):
        begins, ends = block.spans(bt.NOT_SPACE)
        counts = block.counts(begins)
        place = np.repeat(np.arange(block.n), counts) * WORD_DIMS + (block.hashes(begins, ends) % np.uint64(WORD_DIMS)).astype(np.int64)
        bag = np.bincount(place, minlength=block.n * WORD_DIMS).reshape(block.n, WORD_DIMS)
        x[at : at + block.n, PATH_DIMS : PATH_DIMS + WORD_DIMS] = bag / np.maximum(counts, 1)[:, None]
    x[:, -4] = np.log1p([len(b[1]) for b in flat]) / 5
    x[:, -3] = [b[2] for b in flat]
    sizes = np.fromiter(map(len, pages), np.int64, len(pages))
    nth = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    x[:, -2] = nth / np.repeat(np.maximum(sizes, 1), sizes)
    x[:, -1] = 1
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Lstm:
    """A bidirectional LSTM with a logistic output for each step."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p["x" + d] = rng.normal(0, 0.15, (DIMS, 4 * HIDDEN)).astype(np.float32)
            self.p["h" + d] = rng.normal(0, 0.15, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
            bias = np.zeros(4 * HIDDEN, np.float32)
            bias[HIDDEN : 2 * HIDDEN] = 1
            self.p["c" + d] = bias
        self.p["out"] = rng.normal(0, 0.2, 2 * HIDDEN).astype(np.float32)
        self.p["base"] = np.zeros(1, np.float32)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        """Hidden states of one direction over (pages, steps, dims); padding leaves the state as it is."""
        n, steps, _ = x.shape
        gates = (x.reshape(-1, DIMS) @ self.p["x" + d] + self.p["c" + d]).reshape(n, steps, -1)
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out, tape = np.zeros((n, steps, HIDDEN), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = gates[:, t] + h @ self.p["h" + d]
            i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g, m = np.tanh(z[:, 3 * HIDDEN :]), mask[:, t, None]
            new = f * c + i * g
            s = np.tanh(new)
            if keep:
                tape.append((t, h, c, i, f, o, g, s, m))
            c = np.where(m, new, c)
            h = np.where(m, o * s, h)
            out[:, t] = h
        return out, tape

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(x, mask, d, False)[0] for d in "fb"], 2)
        return both @ self.p["out"] + self.p["base"][0]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss over all steps that aren't padding, back through time."""
        runs = {d: self._run(x, mask, d, True) for d in "fb"}
        both = np.concatenate([runs[d][0] for d in "fb"], 2)
        z = both @ self.p["out"] + self.p["base"][0]
        dz = ((_sigmoid(z) - y) * mask / mask.sum()).astype(np.float32)
        out = {"out": np.einsum("nt,nth->h", dz, both), "base": dz.sum(keepdims=True).reshape(1)}
        for k, d in enumerate("fb"):
            dout = dz[:, :, None] * self.p["out"][k * HIDDEN : (k + 1) * HIDDEN]
            dgates = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            back = np.zeros_like(self.p["h" + d])
            dh, dc = np.zeros((len(x), HIDDEN), np.float32), np.zeros((len(x), HIDDEN), np.float32)
            for t, h, c, i, f, o, g, s, m in reversed(runs[d][1]):
                dh = dh + dout[:, t]
                now, cell = dh * m, dc * m
                cell = cell + now * o * (1 - s * s)
                dgate = np.concatenate([cell * g * i * (1 - i), cell * c * f * (1 - f), now * s * o * (1 - o), cell * i * (1 - g * g)], 1)
                dgates[:, t] = dgate
                back += h.T @ dgate
                dh = np.where(m, dgate @ self.p["h" + d].T, dh)
                dc = np.where(m, cell * f, dc)
            flat = dgates.reshape(-1, 4 * HIDDEN)
            out["x" + d], out["h" + d], out["c" + d] = x.reshape(-1, DIMS).T @ flat, back, flat.sum(0)
        return out

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = 14, batch: int = 25, rate: float = 0.02, seed: int = 9) -> Lstm:
        rng = np.random.default_rng(seed)
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        step, steps = 0, epochs * -(-len(pages) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(pages))
            for i in range(0, len(pages), batch):
                x, mask, y = _padded([pages[k][0] for k in order[i : i + batch]], [pages[k][1] for k in order[i : i + batch]])
                step += 1
                now = rate * (1 - step / (steps + 1))
                for k, g in self.gradients(x, mask, y).items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    self.p[k] = (self.p[k] - now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def label(self, pages: list[list[tuple[tuple[str, ...], str, float]]]) -> list[np.ndarray]:
        """Which blocks of each page are main text; pages of like length run together."""
        x = vectors(pages)
        sizes = np.fromiter(map(len, pages), np.int64, len(pages))
        edge = np.concatenate([[0], np.cumsum(sizes)])
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = [k for k in np.argsort(sizes, kind="stable").tolist() if sizes[k]]
        i = 0
        while i < len(order):  # STEPS_AT_ONCE padded steps, or one page
            to = i + 1
            while to < len(order) and sizes[order[to]] * (to + 1 - i) <= STEPS_AT_ONCE:
                to += 1
            some, i = order[i:to], to
            data, mask, _ = _padded([x[edge[k] : edge[k + 1]] for k in some])
            z = self.logits(data, mask)
            for row, k in enumerate(some):
                out[k] = z[row, : sizes[k]] > 0
        return out


def _padded(xs: list[np.ndarray], ys: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    steps = max(map(len, xs))
    data, mask, y = np.zeros((len(xs), steps, DIMS), np.float32), np.zeros((len(xs), steps), bool), np.zeros((len(xs), steps), np.float32)
    for k, x in enumerate(xs):
        data[k, : len(x)], mask[k, : len(x)] = x, True
        if ys is not None:
            y[k, : len(x)] = ys[k]
    return data, mask, y


# fixed values: usual class names of the parts of a page
_MENU = "nav menu navbar breadcrumb navigation topnav links".split()
_HEAD = "header masthead banner logo topbar site".split()
_SIDE = "sidebar aside related widget trending popular recommended toc".split()
_NOTE = "cookie notice consent alert newsletter subscribe popup modal".split()
_ADS = "ad ads advert sponsored promo banner advertisement".split()
_FOOT = "footer copyright legal colophon bottom".split()
_TALK = "comments comment reply replies discussion disqus responses".split()
_MAIN = "content main article post story entry body text".split()


def sample_page(rng: np.random.Generator) -> tuple[str, list[bool]]:
    """A random page, and for each of its blocks whether it is main text."""
    letters = np.array(list("abcdefghijklmnopqrstuvwxyzéèäöñ"))
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    chance = lambda p: bool(rng.random() < p)
    labels: list[bool] = []

    def words(low: int, high: int) -> str:
        return " ".join("".join(rng.choice(letters, int(rng.integers(1, 11)))) for _ in range(int(rng.integers(low, high + 1))))

    def said(low: int, high: int, main: bool) -> str:
        labels.append(main)
        return words(low, high)

    def named(names: list[str]) -> str:
        return "" if chance(0.15) else f' {pick(["class", "class", "id"])}="{pick(names)}{pick(["", "", "-" + pick(names), " " + pick(names)])}"'

    def linked(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{k}">{said(1, 3, False)}</a></li>' for k in range(n)) + "</ul>"

    def rest(tag: str, names: list[str], low: int = 1, high: int = 25) -> str:
        name = pick([tag, "div", "section"]) if tag != "div" else "div"
        attributes = named(names) if name == tag and tag != "div" else f' class="{pick(names)}"'
        inner = ""
        for _ in range(int(rng.integers(1, 4))):
            kind = int(rng.integers(4))
            inner += linked(int(rng.integers(1, 7))) if kind == 0 else f"<p>{said(low, high, False)}</p>" if kind < 3 else f"<h{rng.integers(2, 5)}>{said(1, 4, False)}</h{rng.integers(2, 5)}>"
        return f"<{name}{attributes}>{inner}</{name}>"

    def short(tag: str, names: list[str]) -> str:
        name = pick([tag, "div"])
        mark = f' class="{pick(names)}"' if name == "div" else named(names)
        return f"<{name}{mark}>{pick(['&copy; ', '', ''])}{said(2, 30, False)}</{name}>"

    def main() -> str:
        inner = f"<h1>{said(2, 12, True)}</h1>" if chance(0.85) else ""
        for _ in range(int(rng.integers(1, 14))):
            kind = int(rng.integers(14))
            if kind < 9:
                inner += f"<p>{said(2, 90, True)}" + pick(["</p>", "</p>", ""])
            elif kind == 9:
                inner += f"<p><b>{said(3, 60, True)}<br>"
            elif kind == 10:
                inner += f"<h{rng.integers(2, 4)}>{said(1, 8, True)}</h2>"
            elif kind == 11:
                inner += "<ul>" + "".join(f"<li>{said(2, 20, True)}</li>" for _ in range(int(rng.integers(1, 5)))) + "</ul>"
            elif kind == 12:
                inner += f"<blockquote><p>{said(4, 40, True)}</p></blockquote>"
            elif chance(0.5):
                inner += f'<div class="{pick(_ADS)}">{said(1, 20, False)}</div>'
            else:
                inner += f"<p>{said(5, 60, True)}</p>"
        name = pick(["article", "article", "main", "div", "section"])
        mark = f' {pick(["class", "id"])}="{pick(_MAIN)}"' if name in ("div", "section") else pick(["", "", f' class="{pick(_MAIN)}"'])
        return f"<{name}{mark}>{inner}</{name}>"

    page = "<!DOCTYPE html><html><head>" + (f"<title>{said(2, 12, False)}</title>" if chance(0.95) else "") + "<style>p{margin:0}</style></head><body>"
    if chance(0.4):
        page += short("header", _HEAD)
    if chance(0.85):
        page += f"<nav{pick(['', '', named(_MENU)])}>" + linked(int(rng.integers(2, 9))) + "</nav>" if chance(0.8) else rest("nav", _MENU, 1, 4)
    if chance(0.25):
        page += rest("div", _NOTE)
    if chance(0.6):
        page += f'<div class="{pick(_ADS)}">{said(1, 30, False)}</div>'
    if chance(0.2):
        page += rest("aside", _SIDE)
    page += main()
    if chance(0.25):
        page += rest("aside", _SIDE)
    if chance(0.25):
        page += rest("div", _TALK, 2, 50)
    if chance(0.15):
        page += f"<form><label>{said(1, 4, False)}</label></form>"
    if chance(0.2):
        page += f'<div class="{pick(_ADS)}">{said(1, 30, False)}</div>'
    if chance(0.9):
        page += short("footer", _FOOT) if chance(0.7) else rest("footer", _FOOT)
    return page + pick(["</body></html>", "</body></html>", ""]), labels


def train(pages: int = TRAIN_PAGES, seed: int = 1) -> Lstm:
    rng = np.random.default_rng(seed)
    parsed, truth = [], []
    while len(parsed) < pages:
        page, labels = sample_page(rng)
        found = blocks(page)
        if len(found) == len(labels):
            parsed.append(found)
            truth.append(np.array(labels, np.float32))
    x = vectors(parsed)
    edge = np.concatenate([[0], np.cumsum([len(p) for p in parsed])])
    return Lstm().fit([(x[edge[k] : edge[k + 1]], truth[k]) for k in range(pages)])


def extract(pages: DataFrame, model: Lstm | None = None) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    held = pages.sparkSession.sparkContext.broadcast(model or train())  # some 40 KB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parsed = [blocks(x.as_py() or "") for x in batch.column(2)]
            texts = ["\n".join(b[1] for b, main in zip(page, labels, strict=True) if main) for page, labels in zip(parsed, held.value.label(parsed), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return map_arrow(pages.select(pages["page_id"].cast("long"), "url", "html"), run, "page_id long, url string, text string, n_chars long")
