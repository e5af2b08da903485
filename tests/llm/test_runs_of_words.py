"""Periodic runs against a brute-force search."""

import zlib
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from causaria.llm import queries, runs
from tests.conftest import DATA
from tests.llm.helpers import WORD, docs


def plain(w, min_length=6, min_exponent=4):
    """(start, length, period) of every run: for each period the stretches in which words so far apart agree, if no smaller period fits."""
    n, out = len(w), []
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            s = i
            while i + p < n and w[i] == w[i + p]:
                i += 1
            seg = w[s : i + p]
            if len(seg) >= max(min_length, min_exponent * p) and all(seg[q:] != seg[:-q] for q in range(1, p)):
                out.append((s, len(seg), p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, found):
    gone = {x for s, n, p in found for x in range(s + p, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def answer(texts, *limits):
    limits = limits or (6, 4)
    found, stay = runs._answers([[x.encode() for x in t] for t in texts], *limits)
    return [[(r["start"], r["length"], r["period"]) for r in f] for f in found], [s.decode() for s in stay]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from("aab"), max_size=40) | st.lists(st.sampled_from("abcde"), max_size=30), min_size=1, max_size=5))
def test_every_run_is_found(texts):
    for limits in ((6, 4), (2, 2), (1, 3)):
        found, stay = answer(texts, *limits)
        assert found == [plain(t, *limits) for t in texts]
        assert stay == [collapsed(t, f) for t, f in zip(texts, found)]


@pytest.mark.parametrize("w", [list("ab" * 500 + "c"), list("a" * 999), list("abcab" * 200 + "abcba" * 100), ("x y z " * 700 + "q").split(), [f"u{i}" for i in range(2000)] + list("pqr" * 5)])
def test_long_and_periodic_texts(w):
    found, _ = answer([w, w[::-1]])
    assert found == [plain(w), plain(w[::-1])]


def test_the_suffix_structures():
    rng = np.random.default_rng(5)
    word = np.append(rng.integers(1, 3, 200), 0)
    s = runs.Suffixes(np.zeros(201, int), word)
    order = np.argsort(s.rank)
    suffixes = [word[i:].tolist() for i in order]
    assert suffixes == sorted(suffixes)
    s.extensible()
    for i, j in rng.integers(0, 201, (300, 2)):
        if i != j:
            n = 0
            while max(i, j) + n < 200 and word[i + n] == word[j + n]:
                n += 1
            assert s.common(np.array([i]), np.array([j]))[0] == n


EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, "a a a a a"), (5, "a a a a a a"), (5, "a a a a a a"), (6, "b\x0bc\x0cb c b c b c\r\n"), (None, "é é é é é é é"), (7, " ".join(["to be or not"] * 9000)), (8, "one")]


def test_rows_and_digests(spark):
    got = runs.digests(runs.runs(docs(spark, EDGE))).collect()
    assert len(got) == len(EDGE)
    want = []
    for i, t in EDGE:
        w = WORD.findall(t or "")
        found = plain(w) if len(w) < 1000 else [(0, 36000, 4)]
        top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in found)
        want.append((i, len(found), *top, top[1] and 1000 * top[1] // top[2], sha256(lines.encode()).hexdigest(), sha256(collapsed(w, found).encode()).hexdigest()))
    key = lambda r: (r[0] is None, *map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_general_interface_and_limits(spark):
    df = spark.createDataFrame([("k", "x a b a b a b y")], "name string, body string")
    (r,) = runs.runs(df, 2, 3, "name", "body").collect()
    assert (r.name, r.n_words, r.collapsed) == ("k", 8, "x a b y") and [tuple(x) for x in r.runs] == [(1, 6, 2)]
    assert runs.runs(docs(spark, []).limit(0)).count() == 0


def made(i, w):
    h = zlib.crc32(str(i).encode())
    if h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]


def test_query_against_brute_force(spark):
    table = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.op12_runs(spark, f"{DATA}/sf0.001").collect()}
    assert len(got) == len(table)
    planted = 0
    for i, t in table:
        w = made(i, WORD.findall(t or ""))
        planted += zlib.crc32(str(i).encode()) % 10 == 0
        if len(w) > 1500:
            continue
        found = plain(w)
        r = got[i]
        assert r.n_runs == len(found)
        assert r.runs_sha256 == sha256("".join(f"{s},{n},{p}\n" for s, n, p in found).encode()).hexdigest()
        assert r.collapsed_sha256 == sha256(collapsed(w, found).encode()).hexdigest()
        if found:
            s, n, p = min(found, key=lambda r: (-r[1], r[0], r[2]))
            assert (r.start, r.length, r.period, r.exponent_milli) == (s, n, p, 1000 * n // p)
    assert planted and sum(r.n_runs for r in got.values())
