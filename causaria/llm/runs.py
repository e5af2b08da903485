"""Periodic runs of words, by the runs theorem, and texts with their repetitions collapsed.

The longest Lyndon word that starts at a position ends before the next smaller
value of the inverse suffix array. Every run (maximal repetition) has a Lyndon
root of its period under the order of words or under its inverse, so the
longest Lyndon words under both orders are all the candidates: at most two a
position. Each is extended to both sides by longest common extensions, which
an LCP array answers with a sparse table of range minima.

Tasks take many texts at a time, laid one behind the other with a sentinel
behind each, as numpy arrays: suffixes are sorted by doubling their compared
length, only those still tied each time, and the ranks of each length give the
LCP array. Memory is some 400 bytes a word of the texts that are taken together;
a text is never cut, so one of ten million words takes a task 4 GB.

Null texts and texts without a word have no words and no runs; repeated rows
are answered one by one. Words are compared byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, only

MIN_LENGTH, MIN_EXPONENT = 6, 4

#: Words that a task takes together, unless one text has more.
BATCH_WORDS = 250_000

RUN = "array<struct<start:long,length:long,period:long>>"


def _ranked(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For pairs of whole numbers: their order, and for each place in it whether a new pair begins there, and where its pair began."""
    order = np.argsort(first * (second.max(initial=0) + 1) + second, kind="stable")
    a, b = first[order], second[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, new, np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))


class Suffixes:
    """The sorted suffixes of many sequences, each closed by a sentinel smaller than what is before it.

    owner: the sequence of each place, rising. word: its word's number, 0 for
    the sentinel. Suffixes of different sequences are never compared.
    """

    def __init__(self, owner: np.ndarray, word: np.ndarray):
        n = len(word)
        self.levels = []  # ranks by 1, 2, 4 .. words: equal ranks, equal words
        order, new, began = _ranked(owner, word)
        rank = np.empty(n, np.int64)
        rank[order] = began
        tied = self._tied(order, new)
        self.levels.append(rank.astype(np.int32))
        h = 1
        while len(tied):  # a tied suffix has h words behind it, so a second half
            sub, new, began = _ranked(rank[tied], rank[tied + h])
            members = tied[sub]
            group = rank[members]  # ties are broken within the places of their group
            first = np.ones(len(sub), bool)
            first[1:] = group[1:] != group[:-1]
            base = np.maximum.accumulate(np.where(first, np.arange(len(sub)), 0))
            rank[members] = group + began - base
            h *= 2
            self.levels.append(rank.astype(np.int32))
            tied = self._tied(members, new)
        self.rank = self.levels[-1]

    @staticmethod
    def _tied(order: np.ndarray, new: np.ndarray) -> np.ndarray:
        last = np.append(new[1:], True)
        return order[~(new & last)]

    def extensible(self) -> Suffixes:
        """Adds the LCP array with its sparse table, and drops what they were made of."""
        n = len(self.rank)
        order = np.empty(n, np.int32)
        order[self.rank] = np.arange(n, dtype=np.int32)
        a, b, lcp = order[:-1].copy(), order[1:].copy(), np.zeros(max(n - 1, 0), np.int32)
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            same = level[a] == level[b]  # never of sentinels, so a and b stay within their sequences
            step = same.astype(np.int32) << k
            lcp += step
            a += step
            b += step
        self.levels = []
        self.table = minima(lcp)
        return self

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words the suffixes at i and at j have in common; i and j differ."""
        a, b = self.rank[i], self.rank[j]
        low, high = np.minimum(a, b), np.maximum(a, b)
        k = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(low), np.int32)
        for level in range(len(self.table)):
            at = np.flatnonzero(k == level)
            t = self.table[level]
            out[at] = np.minimum(t[low[at]], t[high[at] - (1 << level)])
        return out


def minima(values: np.ndarray) -> list[np.ndarray]:
    """The sparse table of range minima: level k has the least of 2^k values from each place on."""
    table = [values]
    while 2 << (len(table) - 1) <= len(values):
        half = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))
    return table


def next_smaller(values: np.ndarray, sentinels: np.ndarray) -> np.ndarray:
    """The place of the next smaller value, or of the sentinel on the way; values differ, and a sentinel's is the least of its sequence.

    Steps double while all values passed are larger, and halve after that: only
    places not yet settled are looked at.
    """
    n = len(values)
    table = minima(values)
    at = np.arange(1, n + 1, dtype=np.int64)
    live = np.flatnonzero(~sentinels)
    at[sentinels] = np.flatnonzero(sentinels)
    fell: list[np.ndarray] = []
    k = 0
    while len(live):
        t = table[k] if k < len(table) else None
        over = np.zeros(len(live), bool)
        if t is not None:
            fit = at[live] < len(t)
            over[fit] = t[at[live[fit]]] > values[live[fit]]
        fell.append(live[~over])
        live = live[over]
        at[live] += 1 << k
        k += 1
    waiting = np.zeros(0, np.int64)
    for k in range(len(fell) - 2, -1, -1):  # who fell at 2^(k+1) has some of 2^k left to try
        waiting = np.concatenate([waiting, fell[k + 1]])
        if k >= len(table):
            continue
        t = table[k]
        fit = waiting[at[waiting] < len(t)]
        over = fit[t[at[fit]] > values[fit]]
        at[over] += 1 << k
    return at


def find(owner: np.ndarray, word: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of every run of at least so many words and periods, by start, then period. Sequences are laid out as Suffixes has them."""
    n = len(word)
    places = np.arange(n)
    ends = word == 0
    sentinel = np.flatnonzero(ends)
    sizes = np.diff(np.append(-1, sentinel))  # with the sentinel
    begin = np.repeat(sentinel - sizes + 1, sizes)
    close = np.repeat(sentinel, sizes)
    forward = Suffixes(owner, word)
    inverse = Suffixes(owner, np.where(ends, 0, word.max(initial=0) + 1 - word))
    roots = []
    for s in (forward, inverse):
        j = next_smaller(s.rank, ends)
        i = np.flatnonzero(~ends & ((j - places) * min_exponent <= close - begin))
        roots.append((i, j[i]))
    del inverse
    i, j = (np.concatenate(x) for x in zip(*roots, strict=True))
    if not len(i):
        return i, i, i
    forward.extensible()
    right = forward.common(i, j)
    del forward
    # To the left: the same of every sequence read backwards. What ends before place x begins at `mirror` of x.
    turned = np.where(ends, places, begin + close - 1 - places)
    backward = Suffixes(owner, word[turned]).extensible()
    mirror = lambda x: begin[x] + close[x] - x
    left = backward.common(mirror(i), mirror(j))
    start, period = i - left, j - i
    length = left + period + right
    keep = (length >= min_length) & (length >= min_exponent * period)
    at, first = np.unique(start[keep] * (n + 1) + period[keep], return_index=True)
    return at // (n + 1), length[keep][first], at % (n + 1)


def _answers(texts: list[list[bytes]], min_length: int, min_exponent: int) -> tuple[list[list[dict]], list[bytes]]:
    """The runs of each text's words, and the words that stay, joined."""
    every = list(chain.from_iterable(texts))
    number = dict(zip(dict.fromkeys(every), count(1)))
    sizes = np.array([len(words) + 1 for words in texts])
    base = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(texts)), sizes)
    word = np.zeros(len(owner), np.int64)
    word[np.delete(np.arange(len(owner)), base + sizes - 1)] = np.fromiter(map(number.__getitem__, every), np.int64, len(every))
    start, length, period = find(owner, word, min_length, min_exponent)
    runs: list[list[dict]] = [[] for _ in texts]
    gone: dict[int, np.ndarray] = {}
    for s, n, p in zip(start.tolist(), length.tolist(), period.tolist(), strict=True):
        t = int(owner[s])
        at = s - int(base[t])
        runs[t].append({"start": at, "length": n, "period": p})
        gone.setdefault(t, np.zeros(len(texts[t]), bool))[at + p : at + n] = True
    stay = [words if (g := gone.get(t)) is None else [w for w, x in zip(words, g.tolist(), strict=True) if not x] for t, words in enumerate(texts)]
    return runs, [b" ".join(words) for words in stay]


def runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, runs, collapsed) of every row: its words' runs by start, then period, and its text without what runs repeat, words joined by one space.

    Of a run's words those after its first period go, whichever other run they are in.
    """
    d = only(docs, key, text).select(key, F.col(text).cast("binary").alias(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, texts, held = [], [], 0

        def out() -> pa.RecordBatch:
            found, stay = _answers(texts, min_length, min_exponent)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            return pa.RecordBatch.from_arrays([pa.array(keys, key_type), pa.array([len(w) for w in texts], pa.int64()), pa.array(found, kind), pa.array(stay, pa.binary()).cast(pa.string())], [key, "n_words", "runs", "collapsed"])

        for b in batches:
            key_type = b.schema.field(0).type
            for k, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = (t.as_py() or b"").split()  # of bytes: splits at the six white-space characters
                if texts and held + len(words) > BATCH_WORDS:
                    yield out()
                    keys, texts, held = [], [], 0
                keys.append(k)
                texts.append(words)
                held += len(words)
        if texts:
            yield out()

    return d.mapInArrow(run, f"`{key}` {d.schema[key].dataType.simpleString()}, n_words long, runs {RUN}, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """documents whose texts, one in ten by crc32 of the id, are made periodic from some word on: what the registered query looks through.

    With h the checksum, g = h div 10, n words, a = g mod n and p = 1 + (n - a) div (3 + g mod 8), word i from a on is word a + (i - a) mod p.
    """
    d = only(docs, "doc_id", "text")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))
    d = d.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("w"))
    d = d.withColumn("n", F.size("w")).withColumn("g", F.floor(F.col("h") / 10))
    d = d.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)) + 1)
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + F.pmod(i - F.col("a"), F.col("p")))
    made = F.array_join(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.element_at("w", (place(i) + 1).cast("int"))), " ")
    return d.select("doc_id", F.when(F.col("n") > 0, made).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """What runs() found, in short: their number, the longest (smallest start, then period), and digests of all of them and of the collapsed text."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    d = found.withColumn("top", longest).withColumn("lines", lines)
    start, length, period = -F.col("top.start"), F.col("top.length"), -F.col("top.period")
    return d.select("doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"), F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
