"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its text blocks: the leaves between two
boundaries of block elements. Each block is a vector of its tag path (tags, and
the words that classes, ids and roles of its ancestors are made of, hashed), of
its hashed words and of a few figures; a bidirectional LSTM in numpy reads the
sequence both ways and labels every block main text or not, so that each label
rests on the whole page. Blocks labelled main text are joined in page order.

The labeller is trained here, on made-up pages of many layouts (pages.py), whose
maker knows which blocks it meant as main text; parts of the names and of the
words are left out in training, so that labels rest on all of them. The weights
are kept beside this file; python -m causaria.llm.html_extract trains them anew.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape
from pathlib import Path
from typing import NamedTuple
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, memo, only

BLOCK_TAGS = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose content is no text of the page.
RAW_TAGS = frozenset("script style noscript template iframe svg object textarea select".split())
#: Block elements that an open paragraph does not reach beyond.
HOLDERS = BLOCK_TAGS - frozenset("p h1 h2 h3 h4 h5 h6".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: A slash that belongs to an attribute's value and closes nothing.
_UNQUOTED = re.compile(r"""=\s*[^\s"']*/$""")
_SPACE = re.compile(r"[\x20\x09-\x0D]+")


#: Widths of the hashed tag path, of its last two elements, of the hashed words, and the figures.
PATH, NEAR, WORDS, FIGURES = 384, 128, 128, 13
HIDDEN = 32
#: A block whose probability is above this is main text.
KEPT_ABOVE = 0.2
#: Where the production labeller's weights are.
WEIGHTS = Path(__file__).with_name("labeller.npz")

_NAME = re.compile(r"[A-Z]?[a-z\u00e0-\uffff]+|[A-Z]+(?![a-z])|\d+")
_named: dict[str, tuple[int, int]] = memo({})
_paths: dict[tuple[int, int], np.ndarray] = memo({})
_word_memo: dict[str, int] = memo({})


class Block(NamedTuple):
    text: str
    path: int  # bits of hashed names of all elements that it is in
    near: int  # and of the last two
    holder: int  # the number of the block element around its own: siblings share it
    depth: int
    linked: float  # part of its characters in links


def bits(tag: str, attrs: str = "") -> tuple[int, int]:
    """Hashed bits of an element's tag and of the words in its class, id and role: (of PATH, of NEAR). Longer words also give their first four letters."""
    key = tag + attrs
    if (found := _named.get(key)) is None:
        names = [tag]
        for g in _NAMES.findall(attrs) if "=" in attrs else ():
            for w in _NAME.findall("".join(g)):
                names.append("." + w.lower())
                if len(w) > 4:
                    names.append("~" + w[:4].lower())
        path = near = 0
        for n in names:
            h = crc32(n.encode())
            path |= 1 << h % PATH
            near |= 1 << (h >> 12) % NEAR
        found = path, near
        if len(key) < 300:
            if len(_named) > 20_000:
                _named.clear()
            _named[key] = found
    return found


def blocks(html: str | None) -> list[Block]:
    """The text blocks of a page in order; character references decoded, white space collapsed; empty blocks left out.

    An open element keeps a fixed number of bits, whatever it is in: memory and
    time grow with the page's length alone.
    """
    html, out = html or "", []
    stack: list[tuple[str, int, int, int, int, int]] = []  # tag, path, near, own near, number of the innermost block element and of the one around it
    open_: dict[str, int] = {}
    leaves: list[str] = []
    link_chars, pos, at, number = 0, 0, None, 0

    def flush():
        nonlocal leaves, link_chars, at
        if leaves and (text := _SPACE.sub(" ", "".join(leaves)).strip(" ")):
            out.append(Block(text, *at, min(1.0, link_chars / len(text))))
        leaves, link_chars, at = [], 0, None

    def leaf(raw: str):
        nonlocal link_chars, at
        text = unescape(raw) if "&" in raw else raw
        leaves.append(text)
        if at is None and text.strip(" \t\n\v\f\r"):
            at = (stack[-1][1], stack[-1][2], stack[-1][5], len(stack)) if stack else (0, 0, 0, 0)
        if open_.get("a"):
            link_chars += len(text)

    def close(k: int):
        for t, *_ in stack[k:]:
            open_[t] -= 1
        del stack[k:]

    while m := _TAG.search(html, pos):
        if m.start() > pos:
            leaf(html[pos : m.start()])
        pos = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:  # an end tag closes what is open inside too; without a start it closes nothing
            if tag in BLOCK_TAGS:
                flush()
            if open_.get(tag):
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                close(k)
            continue
        attrs = m[3] or m[6] or ""
        if tag == "svg" and attrs.endswith("/") and not _UNQUOTED.search(attrs):  # empty
            continue
        if tag in RAW_TAGS:
            end = re.compile(f"</{tag}[^>]*>", re.I).search(html, pos)
            pos = end.end() if end else len(html)
            continue
        if tag == "br":
            leaves.append(" ")
            continue
        if tag in BLOCK_TAGS:
            flush()
            if open_.get("p") or tag == "li" and open_.get("li"):
                for k in range(len(stack) - 1, -1, -1):  # a block ends an open paragraph, an item an open item
                    if stack[k][0] == "p" or stack[k][0] == tag == "li":
                        close(k)
                        break
                    if stack[k][0] in HOLDERS:
                        break
        if tag not in VOID_TAGS:
            path, own = bits(tag, attrs)
            _, above, _, beside, block, holder = stack[-1] if stack else ("", 0, 0, 0, 0, 0)
            if tag in BLOCK_TAGS:
                number += 1
                block, holder = number, block
            stack.append((tag, above | path, beside | own, own, block, holder))
            open_[tag] = open_.get(tag, 0) + 1
    if pos < len(html):
        leaf(html[pos:])
    flush()
    return out


def spread(path: int, near: int) -> np.ndarray:
    """The bits as 0 and 1."""
    raw = path.to_bytes(PATH // 8, "little") + near.to_bytes(NEAR // 8, "little")
    return np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little").astype(np.float32)


def texts(page: list[Block]) -> np.ndarray:
    """Each block's words (counts by signed hash, over the number of words) and figures."""
    out = np.zeros((len(page), WORDS + FIGURES), np.float32)
    if len(_word_memo) > 200_000:
        _word_memo.clear()
    for i, b in enumerate(page):
        t = b.text
        ws = t.split(" ")
        h = []
        for w in ws:
            if (k := _word_memo.get(w)) is None:
                k = crc32(w.lower().strip(".,;:!?()[]\"'").encode()) & 0xFFFF
                if len(w) < 40:
                    _word_memo[w] = k
            h.append(k)
        h = np.array(h)
        n, chars = len(ws), len(t)
        out[i, :WORDS] = np.bincount(h % WORDS, 1 - 2.0 * ((h >> 8) & 1), WORDS) * (3 / (n + 2))
        out[i, WORDS:] = (
            np.log1p(chars) / 8,
            b.linked,
            t[-1] in ".!?\"'\u201d\u3002\u2026:",
            n < 4,
            min(1.0, (t.count(",") + t.count(". ")) * 8 / (n + 4)),
            min(1.0, sum(map(t.count, "0123456789")) * 4 / chars),
            min(1.0, sum(map(t.count, "|\u00a9\u00bb\u203a\u00b7@/")) * 8 / chars),
            t[0].islower(),
            t[-1] == "?",
            i / len(page),
            min(1.0, b.depth / 16),
            i > 0 and page[i - 1].holder == b.holder,
            i + 1 < len(page) and page[i + 1].holder == b.holder,
        )
    return out


def features(page: list[Block]) -> np.ndarray:
    """All of a page's blocks, as training sees them."""
    if not page:
        return np.zeros((0, PATH + NEAR + WORDS + FIGURES), np.float32)
    return np.hstack([np.array([spread(b.path, b.near) for b in page]), texts(page)])


class Labeller:
    """A bidirectional LSTM with one output per step; weights by name in p."""

    def __init__(self, seed: int = 5, width: int = PATH + NEAR + WORDS + FIGURES, hidden: int = HIDDEN):
        rng = np.random.default_rng(seed)
        self.h = hidden
        self.p = {}
        for d in "fb":
            self.p[f"x{d}"] = rng.normal(0, 0.15, (width, 4 * hidden)).astype(np.float32)
            self.p[f"h{d}"] = rng.normal(0, 0.15, (hidden, 4 * hidden)).astype(np.float32)
            self.p[f"c{d}"] = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)]).astype(np.float32)
        self.p["o"] = rng.normal(0, 0.15, (2 * hidden, 1)).astype(np.float32)
        self.p["oc"] = np.zeros(1, np.float32)

    @staticmethod
    def _sig(x):
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))

    def _run(self, d: str, x: np.ndarray, mask: np.ndarray, keep: bool):
        """x: (steps, pages, 4 hidden), already times the input weights. Padded steps leave the state as it is."""
        steps, n, _ = x.shape
        k, h, c = self.h, np.zeros((n, self.h), np.float32), np.zeros((n, self.h), np.float32)
        out, tape = np.zeros((steps, n, self.h), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = x[t] + h @ self.p[f"h{d}"] + self.p[f"c{d}"]
            i, f, o, g = self._sig(z[:, :k]), self._sig(z[:, k : 2 * k]), self._sig(z[:, 2 * k : 3 * k]), np.tanh(z[:, 3 * k :])
            c2 = f * c + i * g
            tc = np.tanh(c2)
            m = mask[t][:, None]
            if keep:
                tape.append((t, i, f, o, g, c, tc, h, m))
            c, h = np.where(m, c2, c), np.where(m, o * tc, h)
            out[t] = h
        return out, tape

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        return self._labelled({d: x @ self.p[f"x{d}"] for d in "fb"}, mask, keep)

    def _labelled(self, z: dict[str, np.ndarray], mask: np.ndarray, keep: bool = False):
        """z: by direction, (steps, pages, 4 hidden), the blocks' vectors times the input weights."""
        runs = {d: self._run(d, z[d], mask, keep) for d in "fb"}
        both = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
        return self._sig((both @ self.p["o"])[:, :, 0] + self.p["oc"]), both, runs

    def gradients(self, x, mask, y):
        """Of the mean cross entropy over real blocks."""
        p, both, runs = self.forward(x, mask, True)
        dz = ((p - y) * mask / max(mask.sum(), 1)).astype(np.float32)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["o"][:, 0], g["oc"][0] = np.tensordot(both, dz, ((0, 1), (0, 1))), dz.sum()
        d_both, k = dz[:, :, None] * self.p["o"][:, 0], self.h
        for at, d in ((0, "f"), (k, "b")):
            d_out, dh, dc = d_both[:, :, at : at + k], 0.0, 0.0
            d_x = np.zeros((*x.shape[:2], 4 * k), np.float32)
            for t, i, f, o, gg, c, tc, h, m in reversed(runs[d][1]):
                dh = dh + d_out[t]
                dc2 = np.where(m, dc + dh * o * (1 - tc**2), 0)
                zz = np.concatenate([dc2 * gg * i * (1 - i), dc2 * c * f * (1 - f), np.where(m, dh * tc, 0) * o * (1 - o), dc2 * i * (1 - gg**2)], axis=1)
                d_x[t] = zz
                g[f"h{d}"] += h.T @ zz
                dc, dh = np.where(m, dc2 * f, dc), np.where(m, 0, dh) + zz @ self.p[f"h{d}"].T
            g[f"x{d}"] = np.tensordot(x, d_x, ((0, 1), (0, 1)))
            g[f"c{d}"] = d_x.sum((0, 1))
        return g, p

    def projected(self, page: list[Block]) -> np.ndarray:
        """A page's blocks times the input weights of both directions; what a path gives is worked out once and kept."""
        w = np.hstack([self.p["xf"], self.p["xb"]])
        out = texts(page) @ w[PATH + NEAR :]
        if len(_paths) > 10_000:
            _paths.clear()
        for i, b in enumerate(page):
            if (z := _paths.get(b[1:3])) is None:
                _paths[b[1:3]] = z = spread(b.path, b.near) @ w[: PATH + NEAR]
            out[i] += z
        return out

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Whether each block of each page is main text."""
        out: list = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        at, k = 0, 4 * self.h
        while at < len(order):
            to = at + 1  # pages of like length together, 60,000 steps at most
            while to < len(order) and to - at < 256 and len(pages[order[to]]) * (to - at + 1) <= 60_000:
                to += 1
            some = order[at:to]
            z, mask = pad([self.projected(pages[i]) for i in some])
            p = self._labelled({"f": z[:, :, :k], "b": z[:, :, k:]}, mask)[0]
            for n, i in enumerate(some):
                out[i] = p[: len(pages[i]), n] > KEPT_ABOVE
            at = to
        return out


def pad(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x, mask = np.zeros((steps, len(pages), pages[0].shape[1]), np.float32), np.zeros((steps, len(pages)), bool)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, True
    return x, mask


def labelled(html: str, kept: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A made-up page's vectors and labels: the blocks that are, in order, those meant as main text."""
    found, y, at = blocks(html), [], 0
    for b in found:
        y.append(at < len(kept) and b.text == kept[at])
        at += y[-1]
    if at < len(kept):
        raise ValueError(f"{kept[at]!r} is no block of the page")
    return features(found), np.array(y, np.float32)


def train(pages: int = 12_000, epochs: int = 20, seed: int = 11, hidden: int = HIDDEN) -> Labeller:
    """Adam over made-up pages; the same arguments give the same labeller."""
    from .pages import sample_page

    rng = np.random.default_rng(seed)
    data = []
    while len(data) < pages:
        try:
            data.append(labelled(*sample_page(rng)))
        except ValueError:  # loose text that ran into what follows it
            continue
    data.sort(key=lambda d: len(d[0]))
    groups = [data[i : i + 40] for i in range(0, len(data), 40)]
    net = Labeller(seed, hidden=hidden)
    m, v = ({k: np.zeros_like(a) for k, a in net.p.items()} for _ in range(2))
    step = 0
    for epoch in range(epochs):
        for gi in rng.permutation(len(groups)):
            x, mask = pad([d[0] for d in groups[gi]])
            y = np.zeros(mask.shape, np.float32)
            for k, d in enumerate(groups[gi]):
                y[: len(d[1]), k] = d[1]
            # Names or words are left out of some pages, and single entries of all, so that labels rest on what is left.
            n = x.shape[1]
            x[:, :, : PATH + NEAR] *= (rng.random((1, n, PATH + NEAR)) > 0.05) & (rng.random((1, n, 1)) > 0.06)
            x[:, :, PATH + NEAR : PATH + NEAR + WORDS] *= (rng.random((1, n, WORDS)) > 0.05) & (rng.random((1, n, 1)) > 0.15)
            g, _ = net.gradients(x, mask, y)
            size = np.sqrt(sum(float((a**2).sum()) for a in g.values()))
            step += 1
            rate = 0.012 * (1 - 0.95 * epoch / epochs) * min(1.0, 1.0 / size if size > 0 else 1.0)
            for k in net.p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                net.p[k] = (net.p[k] * (1 - 1e-5) - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


@lru_cache(maxsize=1)
def labeller() -> Labeller:
    """The production labeller: its kept weights, as train() gives them."""
    with np.load(WEIGHTS) as kept:
        out = Labeller(hidden=kept["hf"].shape[0])
        out.p = {k: kept[k].astype(np.float32) for k in out.p}
    return out


def main_text(pages: list[str | None], net: Labeller) -> list[str]:
    found = [blocks(p) for p in pages]
    return ["\n".join(b.text for b, k in zip(f, ks, strict=True) if k) for f, ks in zip(found, net.label(found), strict=True)]


def _extracted(net: Labeller):
    def run(batches):
        import pyarrow as pa

        claim(_paths, _word_memo, _named)
        for batch in batches:
            html = batch.column(2).to_pylist()
            text = [t for s in range(0, len(html), 500) for t in main_text(html[s : s + 500], net)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, net: Labeller | None = None) -> DataFrame:
    """page_id, url, text, n_chars (code points of text) for every row of pages.

    A null or empty html, or one without main text, gives an empty text. Null
    ids and urls stay null; rows are treated one by one, so repeated rows
    repeat; an empty table gives none; other columns are not looked at.
    """
    return only(pages, "page_id", "url", "html").select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(_extracted(net or labeller()), "page_id long, url string, text string, n_chars long")


if __name__ == "__main__":
    np.savez_compressed(WEIGHTS, **{k: v.astype(np.float16) for k, v in train().p.items()})
