"""Exact-substring dedup of a whole corpus: a hash-compared suffix sort of what texts share, anchored by winnowing.

A byte goes if a string of `span` bytes that covers it also starts earlier, in
a smaller id or before it in the same text. Four steps, each a Spark job:

1. *Blocks.* Each window of `span` bytes chooses the least-hashed of its
   GRAM-byte strings as its anchor; windows that are equal choose equal
   anchors, so strings that occur twice always meet at one. Neighbouring
   windows of one anchor are a block: some span / 3 of them.
2. *Meeting.* Blocks meet by their anchor's hash. Equal blocks need no look at
   their texts: all but the first go. Where an anchor has different blocks, the
   first of each is a candidate.
3. *Suffix sort.* Candidates' bytes are sorted at their anchor in both
   directions, to the right and to the left: a mergesort (Batcher's odd-even
   one, for many groups at a time) whose comparisons find the common extension
   of two suffixes by binary search over polynomial prefix hashes. Neighbours'
   extensions are verified byte by byte; should hashes have collided, bytes are
   compared instead. Two windows at one distance from an anchor are equal if
   both their sides are, which the extensions of neighbours tell.
4. *Cutting.* What goes is gathered for each text, and cut.

Anchors of very many blocks (HOT of them, or one in a million of all) never
meet in one task: their windows meet one by one, by a digest of 128 bits.
Blocks are told apart by digests of 64 bits beside the anchor's hash of 64.
A task's own repeats are settled before anything is sent.

Texts are UTF-8 bytes; a null text is empty. Ids are whole numbers; a null id
comes last. Rows of one id are one document: of strings that start at the same
place of two of them neither is earlier. Equal rows get equal answers. Texts
shorter than `span` keep everything, and no rows give none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import only, staged

SPAN, GRAM = 100, 32

#: Blocks of one anchor beyond which its windows meet one by one; HOT_SHARE of all blocks if that is more, so that a million anchors at most are told to tasks.
HOT, HOT_SHARE = 4096, 1e-6

#: Bytes hashed together, blocks settled together before they are sent, candidates sorted together.
PIECE, HELD, SORTED = 1 << 20, 400_000, 20_000

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, else any
_LAST = 2**63 - 1
_PLACE = (1 << 24) - 1

ENTRY = "h long, dg long, d long, tag long, at long, upto long"


def _grams(data: np.ndarray) -> np.ndarray:
    """A mixed polynomial hash of the GRAM bytes from each place on, by doubling."""
    h, power = data.astype(np.uint64) + np.uint64(1), _BASE
    n = 1
    while n < GRAM:
        h = h[:-n] * power + h[n:]
        power = power * power
        n *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of `width` keys from each place on."""
    n = 1
    while 2 * n <= width:
        keys = np.minimum(keys[:-n], keys[n:])
        n *= 2
    return np.minimum(keys[: len(keys) - (width - n)], keys[width - n :]) if width > n else keys


def blocks(texts: list[bytes], span: int = SPAN) -> tuple[np.ndarray, ...]:
    """(text, first window, anchor's distance from it, windows less one, anchor's hash) of every block of the texts, which have 2^24 bytes at most together."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    if len(data) < span:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    with np.errstate(over="ignore"):
        h = _grams(data)
    keys = (h & ~np.uint64(_PLACE)) | np.arange(len(h), dtype=np.uint64)  # of equal hashes the first
    anchor = (_least(keys, span - GRAM + 1) & np.uint64(_PLACE)).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    inside = np.arange(len(anchor)) + span <= np.cumsum(sizes)[owner[: len(anchor)]]
    at = np.flatnonzero(inside)
    if not len(at):
        return at, at, at, at, np.zeros(0, np.uint64)
    a, o = anchor[at], owner[at]
    new = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (o[1:] != o[:-1])))
    last = np.append(new[1:] - 1, len(at) - 1)
    base = (np.cumsum(sizes) - sizes)[o[new]]
    return o[new], at[new] - base, a[new] - at[new], last - new, h[a[new]]


class _Held:
    """Blocks that a task has found and not yet sent."""

    def __init__(self, span: int, hot: np.ndarray | None):
        self.span, self.hot, self.parts, self.n = span, hot, [], 0

    def add(self, d: np.ndarray, tag: np.ndarray, offset: np.ndarray, texts: list[bytes]) -> None:
        """Pieces of texts, each of the text of (d, tag) from a place on."""
        o, s, back, n, h = blocks(texts, self.span)
        hot = np.zeros(len(h), bool) if self.hot is None or not len(self.hot) else self.hot[np.minimum(np.searchsorted(self.hot, h), len(self.hot) - 1)] == h
        dg = np.empty(len(h), np.uint64)
        cold = np.flatnonzero(~hot)
        raw = b"".join([blake2b(texts[x][y:z], digest_size=8).digest() for x, y, z in zip(o[cold].tolist(), s[cold].tolist(), (s + n + self.span)[cold].tolist(), strict=True)])
        dg[cold] = np.frombuffer(raw, np.uint64)
        self._keep(h[cold], dg[cold], d[o[cold]], tag[o[cold]], s[cold] + offset[o[cold]], back[cold], n[cold])
        warm = np.flatnonzero(hot)
        if len(warm):  # a block for each window, named by its digest alone
            o, s, n = o[warm], s[warm], n[warm] + 1
            o, s = np.repeat(o, n), np.repeat(s, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            raw = np.frombuffer(b"".join([blake2b(texts[x][y : y + self.span], digest_size=16).digest() for x, y in zip(o.tolist(), s.tolist(), strict=True)]), np.uint64).reshape(-1, 2)
            zero = np.zeros(len(o), np.int64)
            self._keep(raw[:, 0], raw[:, 1], d[o], tag[o], s + offset[o], zero, zero)

    def _keep(self, *columns: np.ndarray) -> None:
        self.parts.append(columns)
        self.n += len(columns[0])

    def sent(self) -> pa.RecordBatch:
        """The first of equal blocks, for others to see, and spans (with an end) of what equals an earlier one here."""
        h, dg, d, tag, s, back, n = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.n = [], 0
        order = np.lexsort((s, d, dg, h))
        h, dg, d, tag, s, back, n = (x[order] for x in (h, dg, d, tag, s, back, n))
        new = np.append(True, (h[1:] != h[:-1]) | (dg[1:] != dg[:-1]))
        first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
        later = (d != d[first]) | (s != s[first])
        at = (s << 16) | (back << 8) | n
        keep = ~later
        ld, lt, start, end = merged(d[later], tag[later], s[later], (s + n + self.span)[later])
        # Spans only pass through the meeting: any key does that spreads them.
        key = (start * 31 + ld).astype(np.uint64) * _BASE
        cat = lambda a, b: pa.array(np.concatenate([a.view(np.int64), b.view(np.int64)]), pa.int64())
        none = np.concatenate([np.ones(keep.sum(), bool), np.zeros(len(ld), bool)])
        upto = pa.array(np.concatenate([np.zeros(keep.sum(), np.int64), end]), pa.int64(), mask=none)
        return pa.RecordBatch.from_arrays([cat(h[keep], key), cat(dg[keep], key), cat(d[keep], ld), cat(tag[keep], lt), cat(at[keep], start << 16), upto], ["h", "dg", "d", "tag", "at", "upto"])


def merged(d: np.ndarray, tag: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans of texts with those that meet or touch made one."""
    if not len(d):
        return d, tag, start, end
    order = np.lexsort((start, tag, d))
    d, tag, start, end = d[order], tag[order], start[order], end[order]
    other = np.append(True, (d[1:] != d[:-1]) | (tag[1:] != tag[:-1]))
    text = np.cumsum(other) - 1
    room = int(end.max()) + 1  # each text's places behind those of the text before
    reach = np.maximum.accumulate(end + text * room)
    new = other | np.append(True, (start + text * room)[1:] > reach[:-1])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(d) - 1)
    return d[new], tag[new], start[new], reach[last] - text[last] * room


def _pieces(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
    """The texts of (d, tag, text) rows, some MB at a time; long ones in pieces that share all but one byte of a window."""
    rows: list[tuple] = []
    held = 0
    flush = lambda: (*(np.array([r[k] for r in rows], np.int64) for k in range(3)), [r[3] for r in rows])
    for b in batches:
        for d, tag, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            t = t.as_py()
            for x in range(0, max(len(t) - span + 1, 0), PIECE):
                piece = t[x : x + PIECE + span - 1]
                if rows and held + len(piece) > PIECE:
                    yield flush()
                    rows, held = [], 0
                rows.append((d, tag, x, piece))
                held += len(piece)
    if rows:
        yield flush()


def hot_anchors(docs: DataFrame, span: int) -> np.ndarray:
    """Hashes of anchors that more than HOT blocks have, or HOT_SHARE of all: at most a million, told by what occurs twice among a task's held blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0

        def out() -> pa.RecordBatch:
            h, count = _counted(np.concatenate(parts))
            often = count > 1
            return pa.RecordBatch.from_arrays([pa.array(np.append(h[often].view(np.int64), 0), pa.int64()), pa.array(np.append(count[often], 0), pa.int64()), pa.array(np.append(np.zeros(often.sum(), np.int64), n), pa.int64())], ["h", "blocks", "all"])

        for _, _, _, texts in _pieces(batches, span):
            h = blocks(texts, span)[4]
            parts.append(h)
            n += len(h)
            if n >= HELD:
                yield out()
                parts, n = [], 0
        if n:
            yield out()

    found = docs.mapInArrow(run, "h long, blocks long, all long").groupBy("h").agg(F.sum("blocks").alias("blocks"), F.sum("all").alias("all"))
    found = staged(found.where(f"blocks > {HOT} OR all > 0"))
    total = found.agg(F.sum("all")).first()[0] or 0
    hot = found.where(F.col("blocks") > max(HOT, int(total * HOT_SHARE))).select("h").toArrow()
    return np.sort(hot.column(0).to_numpy().view(np.uint64))


def _counted(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = np.sort(h)
    at = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    return h[at], np.diff(np.append(at, len(h)))


def entries(docs: DataFrame, hot: np.ndarray, span: int) -> DataFrame:
    """Blocks of (d, tag, text) rows as ENTRY: anchor's hash, digest, text, packed place; and with an end, spans that a task found to go itself."""
    told = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(span, told.value)
        for piece in _pieces(batches, span):
            held.add(*piece)
            if held.n >= HELD:
                yield held.sent()
        if held.n:
            yield held.sent()

    return docs.mapInArrow(run, ENTRY)


# The suffix sort


class Contexts:
    """Byte strings of up to `width` bytes as rows of a matrix, with polynomial hashes of all their prefixes."""

    def __init__(self, data: np.ndarray, sizes: np.ndarray):
        self.data, self.sizes, self.width, self.exact = data, sizes, data.shape[1], False
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.full(self.width, _BASE, np.uint64))
            self.hashes = np.zeros((len(data), self.width + 1), np.uint64)
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers, axis=1, out=self.hashes[:, 1:])

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The length of the longest common prefix of rows a and b, by binary search over prefix hashes."""
        cap = np.minimum(self.sizes[a], self.sizes[b])
        if self.exact:
            return self.compared(a, b, cap)
        flat, w = self.hashes.ravel(), self.width + 1
        found = np.zeros(len(a), np.int64)
        step = 1 << (self.width.bit_length() - 1)
        while step:
            to = found + step
            fit = np.minimum(to, self.width)
            ok = (to <= cap) & (flat[a * w + fit] == flat[b * w + fit])
            found[ok] = to[ok]
            step >>= 1
        return found

    def compared(self, a: np.ndarray, b: np.ndarray, cap: np.ndarray) -> np.ndarray:
        """The same byte by byte."""
        differ = np.ones((len(a), self.width + 1), bool)
        differ[:, :-1] = (self.data[a] != self.data[b]) | (np.arange(self.width) >= cap[:, None])
        return differ.argmax(axis=1)

    def greater(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether row a sorts behind row b; a prefix sorts before what it begins."""
        n = self.common(a, b)
        ended = n >= np.minimum(self.sizes[a], self.sizes[b])
        at = np.minimum(n, self.width - 1)
        return np.where(ended, self.sizes[a] > self.sizes[b], self.data[a, at] > self.data[b, at])

    def sorted(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, sorted within their groups, which stand together; common prefix of each with the one before, 0 at a group's first)."""
        order = self._mergesort(group)
        same = group[order][1:] == group[order][:-1]
        a, b = order[:-1][same], order[1:][same]
        common = self.common(a, b)
        if not self.exact and not self._verified(a, b, common):
            self.exact = True
            return self.sorted(group)
        lcp = np.zeros(len(order), np.int64)
        lcp[1:][same] = common
        return order, lcp

    def _verified(self, a: np.ndarray, b: np.ndarray, common: np.ndarray) -> bool:
        return bool((self.compared(a, b, np.minimum(self.sizes[a], self.sizes[b])) == common).all()) and not self.greater(a, b).any()

    def _mergesort(self, group: np.ndarray) -> np.ndarray:
        begin = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        sizes = np.diff(np.append(begin, len(group)))
        order = np.arange(len(group))
        for bits in np.unique(np.ceil(np.log2(sizes)).astype(int)).tolist():
            if not bits:
                continue
            of = np.flatnonzero(np.ceil(np.log2(sizes)).astype(int) == bits)
            wide = np.arange(1 << bits)
            table = np.where(wide < sizes[of, None], begin[of, None] + wide, -1)  # groups of like sizes, filled up with what sorts last
            for low, high in _network(bits):
                a, b = table[:, low], table[:, high]
                swap = (a < 0) & (b >= 0)
                at = np.nonzero((a >= 0) & (b >= 0))
                swap[at] = self.greater(a[at], b[at])
                table[:, low], table[:, high] = np.where(swap, b, a), np.where(swap, a, b)
            order[np.concatenate([np.arange(x, x + n) for x, n in zip(begin[of].tolist(), sizes[of].tolist(), strict=True)])] = table[table >= 0]
        return order


@cache
def _network(bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Batcher's odd-even mergesort of 2^bits places: rounds of (low, high) places to be put in order."""
    n, rounds = 1 << bits, []
    for p in (1 << b for b in range(bits)):
        k = p
        while k:
            x = np.arange(n - k)
            x = x[(x >= k % p) & ((x - k % p) // k % 2 == 0) & (x // (2 * p) == (x + k) // (2 * p))]
            rounds.append((x, x + k))
            k //= 2
    return rounds


def settled(h: np.ndarray, order: np.ndarray, back: np.ndarray, n: np.ndarray, parts: list[bytes], span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block, first window, last window) of runs of windows that an earlier block of the group has too, windows counted from the anchor.

    h: groups, standing together. order: a number for each block's place in the corpus, equal only for equal places.
    """
    m, wide = len(h), span - GRAM
    cells = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.array([len(p) for p in parts], np.int64)
    anchor = np.cumsum(sizes) - sizes + back
    right, left = sizes - back, back
    take = lambda at, size: np.where(np.arange(at.shape[1]) < size[:, None], cells[np.clip(at, 0, len(cells) - 1)], 0).astype(np.uint8)
    classes = []
    for data, size, width in ((take(anchor[:, None] + np.arange(span), right), right, span), (take(anchor[:, None] - 1 - np.arange(wide), left), left, wide)):
        rows, lcp = Contexts(data, size).sorted(h)
        place = np.empty(m, np.int64)
        place[rows] = np.arange(m)
        classes.append((place, lcp))
    (rp, rl), (lp, ll) = classes
    gone = np.zeros((m, wide + 3), bool)  # window r of block i stands at [i, r + wide + 1]
    for r in range(-wide, 1):
        at = np.flatnonzero((-back <= r) & (r <= n - back))
        if len(at) < 2:
            continue
        first = np.cumsum(rl < span + r)[rp[at]]  # equal to the right, and in one group
        second = np.cumsum(ll < -r)[lp[at]] if r else np.zeros(len(at), np.int64)
        key = first * (m + 1) + second
        by = np.lexsort((order[at], key))
        k, o = key[by], order[at][by]
        new = np.append(True, k[1:] != k[:-1])
        least = o[np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))]
        gone[at[by[o > least]], r + wide + 1] = True
    edge = gone[:, 1:].astype(np.int8) - gone[:, :-1]
    block, start = np.nonzero(edge == 1)
    _, end = np.nonzero(edge == -1)
    return block, start - wide, end - 1 - wide


def _sorter(span: int):
    """Candidates (h, d, tag, at, part), groups standing together, to spans that go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            kept.append(b)
            rows += b.num_rows
            if rows >= SORTED:
                t = pa.Table.from_batches(kept).combine_chunks()
                h = t["h"].to_numpy()
                cut = int(np.flatnonzero(np.append(True, h[1:] != h[:-1]))[-1])  # the last group may go on
                if cut:
                    yield _spans(t.slice(0, cut), span)
                    kept, rows = t.slice(cut).to_batches(), t.num_rows - cut
        if rows:
            yield _spans(pa.Table.from_batches(kept), span)

    return run


def _spans(t: pa.Table, span: int) -> pa.RecordBatch:
    h, d, tag, at = (t[c].to_numpy() for c in ("h", "d", "tag", "at"))
    s, back, n = at >> 16, (at >> 8) & 255, at & 255
    place = s + back
    by = np.lexsort((place, d))
    order = np.empty(len(d), np.int64)
    order[by] = np.cumsum(np.append(True, (d[by][1:] != d[by][:-1]) | (place[by][1:] != place[by][:-1])))
    block, first, last = settled(h, order, back, n, t["part"].to_pylist(), span)
    found = merged(d[block], tag[block], place[block] + first, place[block] + last + span)
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["d", "tag", "start", "end"])


def _cut(key: str, kind: str, span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        for b in batches:
            texts, spans, kept = b.column(1), [], []
            for t, found in zip(texts, b.column(2), strict=True):
                t, at = t.as_py(), 0
                mine, parts = [], []
                if found.is_valid and len(found):
                    v = found.values
                    start, end = v.field(0).to_numpy(), v.field(1).to_numpy()
                    zero = np.zeros(len(start), np.int64)
                    _, _, start, end = merged(zero, zero, start, end)
                    for x, y in zip(start.tolist(), end.tolist(), strict=True):
                        mine.append({"start": x, "end": y})
                        parts.append(t[at:x])
                        at = y
                spans.append(mine)
                kept.append(b"".join([*parts, t[at:]]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(map(len, texts.to_pylist())), pa.int64()), pa.array(spans, pa.list_(pair)), pa.array(kept, pa.binary())], [key, "n_bytes", "spans", "kept"])

    return run


def _identified(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, bool]:
    """((d, tag, text), whether a key occurs twice): a null key's tag is odd; the rest of a tag tells texts of one key apart, and is 0 if none occurs twice."""
    rows = only(docs, key, text).select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))
    null = F.col("k").isNull().cast("long")
    repeated = rows.groupBy("k").count().where("count > 1").limit(1).count() > 0
    tag: Column = F.xxhash64("text").bitwiseAND(F.lit(-2)).bitwiseOR(null) if repeated else null
    return rows.select(F.coalesce("k", F.lit(_LAST)).alias("d"), tag.alias("tag"), "text"), repeated


def removed(docs: DataFrame, span: int = SPAN, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, spans, kept) of every row: its bytes, the maximal stretches that go (start, end), and what is left."""
    if not GRAM < span <= 255:
        raise ValueError(f"strings have more than {GRAM} bytes, at most 255")
    kind = docs.schema[key].dataType.simpleString()
    rows, repeated = _identified(docs, key, text)
    met = entries(rows, hot_anchors(rows, span), span)
    alike, equal = Window.partitionBy("h"), Window.partitionBy("h", "dg")
    where = F.struct("d", F.shiftright("at", 16).alias("s"))
    met = met.withColumn("later", where > F.min(where).over(equal)).withColumn("mixed", F.min("dg").over(alike) < F.max("dg").over(alike))
    met = staged(met.where("upto IS NOT NULL OR later OR mixed"))
    start = F.shiftright("at", 16)
    size = F.col("at").bitwiseAND(255) + span
    gone = met.where("upto IS NOT NULL OR later").select("d", "tag", start.alias("start"), F.coalesce("upto", start + size).alias("end"))
    ask = met.where("upto IS NULL AND NOT later AND mixed").select("h", "d", "tag", "at")
    part = F.substring("text", (F.shiftright("at", 16) + 1).cast("int"), (F.col("at").bitwiseAND(255) + span).cast("int"))
    told = (ask.distinct() if repeated else ask).join(rows.dropDuplicates(["d", "tag"]) if repeated else rows, ["d", "tag"]).select("h", "d", "tag", "at", part.alias("part"))
    more = told.repartition("h").sortWithinPartitions("h").mapInArrow(_sorter(span), "d long, tag long, start long, end long")
    spans = gone.unionByName(more).groupBy("d", "tag").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    out = rows.join(spans, ["d", "tag"], "left").select(F.when(F.col("tag").bitwiseAND(1) == 0, F.col("d")).cast(kind).alias(key), "text", "spans")
    return out.mapInArrow(_cut(key, kind, span), f"`{key}` {kind}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def digests(found: DataFrame) -> DataFrame:
    """What removed() found, in numbers and a digest of what is left."""
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
