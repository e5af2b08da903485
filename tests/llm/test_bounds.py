"""What must hold at any size: long words, long chains, long attributes, ids that repeat, tables staged on the way."""

import random
import time
from functools import lru_cache

from pyspark.sql import functions as F

from causaria.llm import bpe, chat, common, html_extract, metric_join, toxicity, url_filter
from causaria.llm.queries import vocabulary


def test_rows_of_one_id_and_several_vectors_are_one_node(spark):
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    rows = [(3, a), (5, a), (5, b), (7, b), (8, c), (9, c), (9, a)]
    got = metric_join.links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {(r.vec_id, r.component_id, r.kept) for r in got} == {(i, 3, i == 3) for i in (3, 5, 7, 8, 9)} and len(got) == len(rows)


def test_random_ids_and_vectors_against_a_search(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(25), [float(x == v) for x in range(12)]) for v in (rng.randrange(12) for _ in range(40))]
    parent = {i: i for i, _ in rows}
    root = lambda x: x if parent[x] == x else root(parent[x])
    for i, v in rows:
        for j, w in rows:
            if v == w:
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    got = metric_join.links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert all(r.component_id == root(r.vec_id) for r in got)


def test_the_end_of_a_long_class_counts():
    long = " ".join(f"u-{k}" for k in range(700))
    plain, side = (html_extract.bits("div", f' class="{long} {x}"') for x in ("article", "sidebar"))
    assert plain != side
    began = time.perf_counter()
    html_extract.bits("div", ' class="' + "w " * 500_000 + '"')
    assert time.perf_counter() - began < 20


def test_an_id_that_occurs_often_is_sampled_once(spark):
    docs = spark.range(100_000).select(F.lit(1).alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 7).cast("string")).alias("text")).union(spark.createDataFrame([(2, "bad words"), (3, None)], "doc_id int, text string"))
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 0), (4, 1)], "doc_id long, toxic int")
    got = toxicity.sample(docs, labels, 10)
    assert len(got) == 3 and sum(r.toxic for r in got) == 1


@lru_cache
def tokenizer():
    return bpe.Tokenizer(vocabulary())


def test_one_long_word_keeps_to_the_bound(monkeypatch):
    from tokenizers import Tokenizer

    rng = random.Random(8)
    word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(60_000))
    theirs = Tokenizer.from_file(vocabulary())
    want = theirs.encode(word, add_special_tokens=False).ids
    automaton = tokenizer().automaton
    most = []
    compile_ = type(automaton).compile

    def counted(self, state, byte):
        most.append(self.arcs)
        return compile_(self, state, byte)

    monkeypatch.setattr(type(automaton), "compile", counted)
    monkeypatch.setattr(automaton, "max_arcs", 5000)
    automaton.clear()
    assert automaton.encode_word(word.encode()) == want
    assert max(most) <= 5000 + 1 and len(most) > 10_000 and sum(len(s) for s in automaton.states.values()) <= 5001
    automaton.clear()


def longest(refs):
    """Levels by a loop: 0 without references to what there is, -1 in or behind a cycle."""
    there = {k: [r for r in v if r in refs] for k, v in refs.items()}
    found, left = {}, dict(there)
    while left:
        new = {k: max([found[r] + 1 for r in v], default=0) for k, v in left.items() if all(r in found for r in v)}
        if not new:
            break
        found |= new
        left = {k: v for k, v in left.items() if k not in new}
    return {k: found.get(k, -1) for k in refs}


def test_levels_and_places_of_random_graphs(spark):
    for seed in range(3):
        rng = random.Random(seed)
        n = 60
        refs = {f"c{k}": [f"c{rng.randrange(n)}" for _ in range(rng.choice([0, 1, 1, 1, 1, 2, 3]))] if rng.random() < 0.1 else [f"c{rng.randrange(k)}" for _ in range(rng.choice([0, 1, 1, 1, 1, 1, 2]))] if k else [] for k in range(n)}
        own = {k: (rng.randrange(5), rng.randrange(3)) for k in refs}
        level = longest(refs)
        at = {}
        for k in sorted((k for k in refs if level[k] >= 0), key=level.get):
            at[k] = max([own[k], *[(at[r][0], at[r][1] + 1) for r in refs[k] if r in refs]])
        df = spark.createDataFrame([("x", k, v, own[k]) for k, v in refs.items()], "conv_id string, id string, refs array<string>, at struct<turn:long,place:int>")
        got = {r.id: (r.level, tuple(r.at)) for r in chat.placed(df).collect()}
        assert got == {k: (level[k], at.get(k, own[k])) for k in refs}


def test_a_chain_of_a_thousand_calls(spark):
    n = 1000
    chain = [("x", f"c{k}", [f"c{k - 1}"] if k else []) for k in range(n)]
    loop = [("y", f"c{k}", [f"c{(k + 1) % 50}"]) for k in range(50)] + [("y", "behind", ["c7"])]
    df = spark.createDataFrame(chain + loop, "conv_id string, id string, refs array<string>")
    before, began = common.mark(), time.perf_counter()
    got = {(r.conv_id, r.id): r.level for r in chat.levels(df).collect()}
    assert time.perf_counter() - began < 120
    assert got == {("x", f"c{k}"): k for k in range(n)} | {("y", i): -1 for _, i, _ in loop}
    assert common.mark() - before == 1  # what was staged on the way is gone


def test_listed_domains_are_found_without_a_join(spark):
    rng = random.Random(8)
    label = lambda: rng.choice(["a", "b", "\u00e9\u00e9", "x-1", ""])
    hosts = sorted({".".join(label() for _ in range(rng.randrange(1, 7))) for _ in range(600)}) + ["a" * 50, "." * 40 + "b"]
    for names in (["a.b", "x-1", "\u00e9\u00e9.a", "a" * 50], ["b"], [".", "..b"], [], ["", None], ["q" * 300, "a.b"]):
        listed = spark.createDataFrame([(n,) for n in names + names[:1]], "name string")
        found = url_filter.flagged(spark.createDataFrame([(h,) for h in [*hosts, None]], "key string"), listed)
        assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
        want = {h: any(n and (h == n or h.endswith("." + n)) for n in names) for h in hosts}
        got = {r["key"]: r["listed"] for r in found.collect()}
        assert got == want


def test_a_host_of_very_many_dots(spark):
    long = "x." * 200000
    df = spark.createDataFrame([(1, f"http://{long}spam-farm.com/"), (2, f"http://{long}good.com/"), (3, f"http://{long}")], "page_id int, url string")
    start = time.time()
    assert {r["page_id"]: r["verdict"] for r in url_filter.judge(df, rules=()).collect()} == {1: "block", 2: "allow", 3: "allow"}
    assert time.time() - start < 60


def test_vectors_are_written_once_however_many_blocks_there_are(spark, monkeypatch):
    monkeypatch.setattr(metric_join, "TASK_PAIRS", 64)
    tables, real = [], metric_join._pairs

    def pairs(blocks):
        tables.append(blocks.selectExpr("count(*) AS blocks", "sum(length(ids)) / 8 AS vectors").first())
        joined = real(blocks)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "Exchange" not in plan
        return joined

    monkeypatch.setattr(metric_join, "_pairs", pairs)
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(300)]
    assert metric_join.links(spark.createDataFrame(rows + [(900, rows[7][1])], "vec_id long, embedding array<double>")).count() == 301
    assert tables[0].vectors == 300 and tables[0].blocks > 30
