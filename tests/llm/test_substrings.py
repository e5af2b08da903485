"""Exact-substring dedup against a brute-force search over all windows."""

import random
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from causaria.llm import queries, substrings
from tests.conftest import DATA
from tests.llm.helpers import docs


def plain(rows, span=100):
    """For each (id, text): (bytes, removed stretches, what is left). A window goes if the same stands at a smaller (id, place)."""
    ordered = lambda i: (i is None, i or 0)
    first = {}
    for i, t in rows:
        t = (t or "").encode()
        for k in range(len(t) - span + 1):
            w = t[k : k + span]
            first[w] = min(first.get(w, (ordered(i), k)), (ordered(i), k))
    out = []
    for i, t in rows:
        t = (t or "").encode()
        gone = np.zeros(len(t) + 2, bool)
        for k in range(len(t) - span + 1):
            if first[t[k : k + span]] < (ordered(i), k):
                gone[k + 1 : k + 1 + span] = True
        edge = np.flatnonzero(gone[1:] != gone[:-1]).tolist()
        kept = bytes(c for c, g in zip(t, gone[1:]) if not g)
        out.append((i, len(t), tuple(zip(edge[::2], edge[1::2])), kept))
    return out


def found(df, **options):
    return [(r[0], r.n_bytes, tuple((s.start, s.end) for s in r.spans), bytes(r.kept)) for r in substrings.removed(df, **options).collect()]


def same(a, b):
    key = lambda r: (r[0] is None, *map(str, r))
    return sorted(a, key=key) == sorted(b, key=key)


def corpus(seed, n=60, words=40):
    """Texts with shared passages, near copies, own repeats and periodic stretches."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 9)))
    vocabulary = [word() for _ in range(300)]
    prose = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passages = [prose(rng.randint(12, 40)) for _ in range(6)]
    out = []
    for i in range(n):
        kind = rng.randrange(6)
        t = prose(words)
        if kind == 0 and out:
            t = rng.choice(out)[1]
        elif kind == 1 and out:
            w = rng.choice(out)[1].split(" ")
            w[rng.randrange(len(w))] = word()
            t = " ".join(w)
        elif kind == 2:
            t = prose(10) + " " + rng.choice(passages) + " " + prose(10) + rng.choice(passages)
        elif kind == 3:
            t = t + " " + t[20:180]
        elif kind == 4:
            t = "=" * rng.randint(90, 400) + "ab" * rng.randint(40, 90)
        out.append((i * 3 % n, t))
    return list({i: (i, t) for i, t in out}.values())


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    want = plain(rows)
    assert same(found(docs(spark, rows)), want) and any(r[2] for r in want)


def test_hot_anchors_meet_window_by_window(spark, monkeypatch):
    rows = corpus(3) + [(1000 + i, f"head {i} " * 9 + "one passage that every text has, with some words more than a hundred bytes need, and then some others " + f"tail {i} " * 9) for i in range(40)]
    want = plain(rows)
    monkeypatch.setattr(substrings, "HOT", 6)
    d = docs(spark, rows)
    assert len(substrings.hot_anchors(substrings._identified(d, "doc_id", "text")[0], 100))
    assert same(found(d), want)
    monkeypatch.setattr(substrings, "HELD", 50)
    monkeypatch.setattr(substrings, "SORTED", 7)
    assert same(found(d.repartition(5)), want)


LONG = " ".join(f"w{i % 4999}" for i in range(40_000))
EDGE = [(1, None), (2, ""), (3, "short"), (4, "x" * 99), (5, "x" * 100), (6, "x" * 101), (7, LONG), (7, LONG), (8, LONG[150_000:]), (9, "é" * 80), (9, "é" * 80 + "y"), (None, "é" * 70), (None, "z" + "q" * 120), (2**40, "q" * 110)]


def test_edges_repeated_rows_and_ids(spark):
    assert same(found(docs(spark, EDGE)), plain(EDGE))


def test_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(substrings, "PIECE", 1000)
    rows = [(1, LONG[:9000]), (2, LONG[500:3000] + LONG[:200]), (3, LONG[:20_000])]
    assert same(found(docs(spark, rows)), plain(rows))


def test_other_lengths_and_no_rows(spark):
    rows = corpus(4, 30)
    assert same(found(docs(spark, rows), span=40), plain(rows, 40))
    assert same(found(docs(spark, rows), span=150), plain(rows, 150))
    assert found(docs(spark, []).limit(0)) == []
    with pytest.raises(ValueError):
        substrings.removed(docs(spark, rows), span=20)


def sorted_rows(strings, group, exact=False):
    width = max(map(len, strings), default=1) or 1
    data = np.zeros((len(strings), width), np.uint8)
    for k, s in enumerate(strings):
        data[k, : len(s)] = list(s)
    c = substrings.Contexts(data, np.array([len(s) for s in strings]))
    c.exact = exact
    return c, *c.sorted(np.array(group))


@pytest.mark.parametrize("exact", [False, True])
def test_suffix_sort(exact):
    rng = random.Random(7)
    strings, group = [], []
    for g in range(30):
        for _ in range(rng.choice([1, 2, 3, 7, 33])):
            strings.append(bytes(rng.choice(b"ab") for _ in range(rng.randrange(12))))
            group.append(g)
    _, order, lcp = sorted_rows(strings, group, exact)
    for k, i in enumerate(order):
        assert group[i] == group[k]
        if k and group[order[k - 1]] == group[i]:
            a, b = strings[order[k - 1]], strings[i]
            assert a <= b
            n = next((x for x in range(min(len(a), len(b))) if a[x] != b[x]), min(len(a), len(b)))
            assert lcp[k] == n
        else:
            assert lcp[k] == 0


def test_colliding_hashes_are_noticed():
    strings = [b"abcdx", b"abcdy", b"abzzz", b"abcda"]
    c, _, _ = sorted_rows(strings, [0] * 4)
    assert not c.exact
    width = 5
    data = np.array([list(s) for s in strings], np.uint8)
    c = substrings.Contexts(data, np.full(4, width))
    c.hashes[:] = 0  # every prefix collides
    order, lcp = c.sorted(np.zeros(4, int))
    assert c.exact and [strings[i] for i in order] == sorted(strings) and lcp.tolist() == [0, 4, 4, 2]


def test_windows_choose_alike():
    rng = random.Random(9)
    shared = bytes(rng.choice(b"abcdefgh ") for _ in range(160))
    texts = [bytes(rng.choice(b"abcdefgh ") for _ in range(rng.randrange(200))) + shared for _ in range(5)]
    o, s, back, n, h = substrings.blocks(texts)
    chosen = []
    for x, t in enumerate(texts):
        at = {w: (a - w, k) for i, w0, b, m, k in zip(o, s, back, n, h) if i == x for w in range(w0, w0 + m + 1) for a in [w0 + b]}
        assert sorted(at) == list(range(len(t) - 99))
        chosen.append([at[w] for w in range(len(t) - 160, len(t) - 99)])
    assert all(c == chosen[0] for c in chosen)


def test_query(spark):
    table = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.op13_substrings(spark, f"{DATA}/sf0.001").collect()}
    want = plain([tuple(r) for r in table])
    assert len(got) == len(want)
    for i, n, spans, kept in want:
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, sum(b - a for a, b in spans), len(spans), sha256(kept).hexdigest())
    assert sum(r.n_removed for r in got.values())
