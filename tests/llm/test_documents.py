"""Mixing, quality rules, MinHash near-dedup, toxicity and BPE."""

import random
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from causaria.llm import bpe, common, minhash, mixing, quality, queries, toxicity
from tests.conftest import DATA
from tests.llm.helpers import WORD, docs, near_duplicates, repeat_words

LONG = " ".join(f"w{i % 9973}" for i in range(60_000))
EDGE = [(1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, "one", "b"), (5, "one", "b"), (5, "one", "b"), (6, LONG, "é"), (7, "A b C d E f", "a"), (8, "a B c D e F", None), (None, "one two three four five six", "a")]


def rows(df):
    return [r.asDict() for r in df.collect()]


# Mixing


def test_the_query_returns_documents_in_training_order(spark):
    from causaria.llm.queries import QUERIES
    from tests.conftest import DATA

    folder = f"{DATA}/sf0.001"
    got = QUERIES["op1_mixing"](spark, folder)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan
    at = [r["first_position"] for r in got.collect()]
    n = sum(x is not None for x in at)
    assert len(at) > n > 100 or len(at) == n
    assert at[:n] == sorted(at[:n]) and not any(x is not None for x in at[n:])
    d = spark.read.parquet(f"{folder}/documents.parquet")
    order = mixing.ordered(mixing.plan(d)).where("copy IS NOT NULL").select("doc_id")
    assert [r[0] for r in order.collect()] == [r[0] for r in mixing.mix(d).select("doc_id").collect()]


def test_mixing_targets_and_edges(spark):
    got = rows(mixing.plan(docs(spark, EDGE)))
    assert len(got) == len(EDGE)
    by = {}
    for r in got:
        by.setdefault(r["source"], []).append(r)
        assert 0 <= r["taken"] <= 3 * r["size"]
    sizes = {s: sum(r["size"] for r in v) for s, v in by.items()}
    assert sum(v[0]["target"] for v in by.values()) == pytest.approx(sum(sizes.values()))
    for s, v in by.items():
        assert v[0]["source_size"] == sizes[s] and v[0]["target"] <= 3 * sizes[s] + 1e-6
        assert abs(sum(r["taken"] for r in v) - v[0]["target"]) < 1
    # ranks by code point, null last: a, b, é, null weigh 5, 2, 1, 5
    assert by["a"][0]["target"] == 3 * sizes["a"] and by[None][0]["target"] == 3 * sizes[None]


def test_mixing_water_filling_against_a_loop(spark):
    rng = random.Random(3)
    sizes = {f"s{k:02d}": rng.randint(1, 500) for k in range(12)}
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    weights = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(sorted(sizes))}
    capped: set = set()
    while True:
        rest, w = sum(sizes.values()) - sum(3 * sizes[s] for s in capped), sum(weights[s] for s in sizes if s not in capped)
        over = {s for s in sizes if s not in capped and weights[s] * rest / w > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    want = {s: 3 * sizes[s] if s in capped else weights[s] * rest / w for s in sizes}
    assert got == pytest.approx(want)


def test_mixing_reruns_agree_whatever_the_partitions(spark):
    d = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    f = lambda x: sorted(tuple(r) for r in mixing.plan(x).collect())
    assert f(d.repartition(1)) == f(d.repartition(5, "text"))


def test_mix_is_the_plan_in_order(spark):
    d = docs(spark, [r for r in EDGE if r[0] != 6])
    p = {(r["doc_id"], r["source"]): r["copies"] for r in mixing.plan(d).where("copies > 0").collect()}
    out = mixing.mix(d)
    assert out.columns == d.columns
    found = {}
    for r in out.collect():
        found[r["doc_id"], r["source"]] = found.get((r["doc_id"], r["source"]), 0) + 1
    twice = found.pop((5, "b"))
    assert p.pop((5, "b")) * 2 in (twice, twice + 1, twice - 1) and found == p
    assert mixing.mix(d.limit(0)).count() == 0 and mixing.plan(d.limit(0)).count() == 0


def test_one_id_may_hold_most_rows(spark, monkeypatch):
    """Rows alike beyond REPEATS: numbered in parts, and no plan or row lost."""
    text = "a b c d e f g"
    table = [(None, text, "a")] * 90 + [(7, text, "a")] * 40 + [(k, f"x{k} y z", "b") for k in range(100, 130)]
    d = docs(spark, table).repartition(3)
    whole = sorted((r["doc_id"] or 0, r["source"], r["start"], r["taken"], r["copies"]) for r in mixing.plan(d).collect())
    count = lambda x: sorted(((r["doc_id"] or 0, r["source"]), r["count"]) for r in common.only(x, "doc_id", "source").groupBy("doc_id", "source").count().collect())
    mixed = count(mixing.mix(d))
    monkeypatch.setattr(mixing, "REPEATS", 25)
    assert sorted((r["doc_id"] or 0, r["source"], r["start"], r["taken"], r["copies"]) for r in mixing.plan(d).collect()) == whole and len(whole) == len(table)
    assert count(mixing.mix(d)) == mixed
    assert dict(mixed)[0, "a"] == sum(c for i, s, _, _, c in whole if (i, s) == (0, "a"))
    numbered = mixing.placed(common.only(d, "doc_id").select(F.coalesce("doc_id", F.lit(-1)).alias("k")), "k").groupBy("k").agg(F.count_distinct("__place").alias("n"), F.max("__place").alias("top")).collect()
    assert all(r["n"] == r["top"] + 1 for r in numbered) and {r["k"]: r["n"] for r in numbered}[-1] == 90


def test_schedule_inverse_against_integration(spark):
    for knots in (*mixing.SCHEDULES, ((0.0, 0.0), (0.3, 2.0), (1.0, 0.0))):
        t = np.linspace(0, 1, 200_001)
        w = np.interp(t, *zip(*knots, strict=True))
        done = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2)])
        done /= done[-1]
        shares = [0.0, 0.01, 0.2, 0.5, 0.77, 0.999, 1.0]
        df = spark.createDataFrame([(s,) for s in shares], "s double")
        got = [r[0] for r in df.select(mixing.inverse(F.col("s"), knots)).collect()]
        assert got == pytest.approx(np.interp(shares, done, t), abs=1e-3)
    with pytest.raises(ValueError):
        mixing.segments(((0, 1), (0, 2)))


# Quality


def test_quality_measures_against_brute_force(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdef") for _ in range(n)) for n in (4, 6, 9, 12, 40, 200)] + ["x y z\nx y z\n\nx y z # | é", " a\xa0b c", "A\x0bB\x0cC", None, "", LONG + " " + LONG]
    got = {r["doc_id"]: r for r in rows(quality.measure(docs(spark, list(enumerate(texts)))))}
    for i, t in enumerate(texts):
        w = WORD.findall(t or "")
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)))
        assert r["n_repeat_words"] == repeat_words(w)
        assert r["base_failed"] == (len(w) < 10 or 100 * r["n_repeat_words"] > 20 * len(w)) and not (r["base_failed"] and r["kept"])


def test_cascade_order_changes_no_verdict():
    doc = [quality.Doc(t) for t in ("a b", "### " * 40, "fine words that nobody has said twice in this short text of ours today", "UP UP " * 20)]
    verdicts = {tuple(quality.passes(d, o) for d in doc) for o in (quality.RULES, quality.RULES[::-1])}
    assert len(verdicts) == 1


def test_cascade_goes_by_rejection_per_cost_among_what_is_left():
    work = lambda n: sum(range(n))
    rules = [
        quality.Rule("dear", lambda d: work(40_000) and d.text < "8"),  # rejects most, at a high cost
        quality.Rule("cheap", lambda d: work(400) and d.text < "5"),
        quality.Rule("same", lambda d: work(2000) and d.text < "5"),  # good alone, rejects nothing after cheap
        quality.Rule("never", lambda d: False),
    ]
    order, found = quality.cascade([str(k % 10) for k in range(100)], rules)
    assert [r.name for r in order] == ["cheap", "dear", "never", "same"]
    assert [round(e.rejected, 2) for e in found] == [0.5, 0.6, 0.0, 0.0]
    # Words are worked out by the first rule that needs them and cost the next one nothing.
    text = " ".join(f"w{k}" for k in range(20_000))
    first, second = quality.cascade([text] * 5, [quality.Rule("a", lambda d: d.n_words < 3), quality.Rule("b", lambda d: d.n_words < 2)])[1]
    assert first.seconds > 20 * second.seconds
    assert quality.cascade([], quality.RULES)[0]


def test_cascade_evaluates_nothing_beyond_the_first_failure():
    seen = []
    rules = [quality.Rule("x", lambda d: seen.append("x") or True), quality.Rule("y", lambda d: seen.append("y") or True)]
    assert not quality.passes(quality.Doc("t"), rules) and seen == ["x"]
    d = quality.Doc("word " * 40)
    order = [r for r in quality.RULES if r.name == "repeated_passages"] + [r for r in quality.RULES if r.name != "repeated_passages"]
    assert not quality.passes(d, order) and not {"n_symbols", "lines", "n_dup_lines", "n_stutters", "n_upper", "word_chars"} & set(d.__dict__)
    rest = [r for r in quality.RULES if r.name not in quality.BASE]
    d = quality.Doc("word " * 40)
    assert quality.measured(d) and not {"n_stutters", "n_upper"} & set(d.__dict__)
    assert len(rest) == len(quality.RULES) - 2 and all(r.rejects(quality.Doc("a b")) for r in quality.RULES if r.name == "too_short")


def test_quality_sample_is_the_same_whatever_the_partitions(spark):
    d = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    assert quality.sample(d, 20) == quality.sample(d.repartition(7), 20) and len(quality.sample(d, 20)) == 20
    same = spark.range(5000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("x").alias("text"))
    assert quality.sample(same, 20) == ["x"] * 20 and quality.sample(d.limit(0)) == []


def test_quality_filter_keeps_columns_and_clean_rows(spark):
    d = docs(spark, [*EDGE, (20, "some words in a row that are all fine and well to keep here")])
    out = quality.filtered(d)
    assert out.columns == d.columns and 20 in {r["doc_id"] for r in out.collect()} and quality.filtered(d.limit(0)).count() == 0
    labels = spark.read.parquet(f"{DATA}/sf0.01/labels.parquet")
    found = quality.measure(spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")).where("NOT base_failed").join(labels, "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in found}
    assert n.get((1, False), 0) == 0 and n[0, False] > 5 * n.get((0, True), 1)


# MinHash


def _edited(rng, words, share):
    return [f"e{rng.random()}" if rng.random() < share else w for w in words]


def test_groups_against_brute_force(spark):
    rng = random.Random(8)
    texts, n = {}, 0
    for _ in range(25):
        base = [f"v{rng.randint(0, 400)}" for _ in range(rng.randint(5, 300))]
        for share in (0.0, 0.0, 0.01, 0.02, 0.03, 0.05):
            texts[n] = " ".join(_edited(rng, base, share))
            n += 1
    texts |= {n: "One  Two", n + 1: "one two", n + 2: "two one", n + 3: "", n + 4: None, n + 5: "é É", n + 6: "É é", n + 7: "é é", n + 8: LONG, n + 9: LONG + " more"}
    sets, comp = near_duplicates(texts)
    got = {r["doc_id"]: r for r in rows(minhash.groups(docs(spark, list(texts.items()))))}
    assert {i: r["component_id"] for i, r in got.items()} == comp
    assert all(r["n_shingles"] == len(sets[i]) and r["kept"] == (comp[i] == i) for i, r in got.items())


def test_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", -1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        d = docs(spark, EDGE)
        got = minhash.groups(d)
        assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
        assert sorted(tuple(r) for r in got.dropna().collect()) == sorted((i, n, c, k) for i, n, c, k in ((1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (5, 1, 4, False), (6, len(minhash.shingles(LONG)), 6, True), (7, 2, 7, True), (8, 2, 7, False)))
        assert minhash.filtered(d).count() == 7 and mixing.plan(d).count() == len(EDGE)
        assert mixing.mix(docs(spark, [r for r in EDGE if r[0] != 6])).count() > 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_a_chain_and_a_star_are_whole():
    """Links that exist only through a middle text: all of them, and no more."""
    rng = random.Random(2)
    base = [f"v{k}" for k in range(400)]
    star = [base, *[[f"s{j}" if i // 9 == j else w for i, w in enumerate(base)] for j in range(12)]]
    sets = [minhash.shingles(" ".join(w)) for w in star]
    rng.shuffle(sets)
    found = list(minhash.links(list(range(13)), sets))
    assert len(found) == 12


def test_large_groups_are_cut_and_stay_whole(spark, monkeypatch):
    monkeypatch.setattr(minhash, "GROUP_ROWS", 8)
    rng = random.Random(4)
    base = [f"v{k}" for k in range(200)]
    texts = {k: " ".join(_edited(rng, base, 0.008)) for k in range(60)}
    for k in range(60, 140):  # chains of chance ties: half of the words are the base's, none is linked but to its own few copies
        own = base[:120] + [f"o{k // 3}x{j}" for j in range(60)]
        texts[k] = " ".join(_edited(rng, own, 0.01))
    _, comp = near_duplicates(texts)
    assert {r["doc_id"]: r["component_id"] for r in rows(minhash.groups(docs(spark, list(texts.items()))))} == comp


@pytest.mark.parametrize("percent", [60, 85])
def test_buckets_of_many_components(spark, monkeypatch, percent):
    """All that large groups go through: blocks, buckets that stay mixed, and texts met by a bitmap."""
    monkeypatch.setattr(minhash, "GROUP_ROWS", 4)
    monkeypatch.setattr(minhash, "FIRST_BANDS", 2)
    monkeypatch.setattr(minhash, "BITMAP", 3)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 5)
    rng = random.Random(percent)
    base = [f"v{k}" for k in range(150)]
    texts = {}
    for k in range(70):
        at = rng.randint(0, 70)
        texts[k] = " ".join(_edited(rng, [*base[:at], *(f"n{k % 9}x{j}" for j in range(150 - at))], 0.004))
    _, comp = near_duplicates(texts, percent)
    assert 2 < len(set(comp.values())) < 60
    assert {r["doc_id"]: r["component_id"] for r in rows(minhash.groups(docs(spark, list(texts.items())), percent))} == comp


def test_a_repeated_row_is_compared_once(spark):
    d = docs(spark, [(1, "a b c d e f g h", "x")] * 300 + [(2, "a b c d e f g h", "x")] * 3 + [(3, "a b c d e f g i", "x")])
    seen = minhash.verified(common.only(d, "doc_id", "text").select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("text")), spark.createDataFrame([(1, 1, 9), (3, 3, 9)], "id long, label long, part long"), 50)
    assert [tuple(r) for r in seen.collect()] == [(1, 3)]
    (batch,) = list(minhash._sets(iter([pa.RecordBatch.from_pydict({"id": [1] * 300, "text": [b"a b"] * 300})])))
    assert batch.num_rows == 1


def test_groups_edges(spark):
    got = rows(minhash.groups(docs(spark, EDGE)))
    assert len(got) == len(EDGE)
    assert [r["component_id"] for r in got if r["doc_id"] in (4, 5)] == [4, 4, 4] and [r["component_id"] for r in got if r["doc_id"] in (7, 8)] == [7, 7]
    assert all(r["kept"] and r["n_shingles"] == 0 for r in got if r["doc_id"] in (1, 2, 3))
    assert [r["kept"] for r in got if r["doc_id"] is None] == [True]
    assert minhash.groups(docs(spark, []).limit(0)).count() == 0
    left = minhash.filtered(docs(spark, EDGE))
    assert sorted(r["doc_id"] or 0 for r in left.collect()) == [0, 1, 2, 3, 4, 6, 7] and left.columns == docs(spark, EDGE).columns


def test_rows_of_one_id_share_a_verdict(spark):
    w = [f"w{k}" for k in range(200)]
    a, b, c = " ".join(w), " ".join(f"x{x}" for x in w), " ".join([*(f"x{x}" for x in w[:-1]), "end"])
    table = [(3, a, "a"), (5, a, "a"), (5, b, "a"), (7, c, "a"), (8, "", "a"), (9, None, "a"), (10, b, "a"), (10, "", "a"), (11, "a lone text of its own words", "a"), (11, "", "a")]
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in rows(minhash.groups(docs(spark, table)))}
    assert got == {(3, 3, True), (5, 3, False), (7, 3, False), (8, 8, True), (9, 9, True), (10, 3, False), (11, 11, True)}


def test_bands_and_threshold(spark):
    assert all((1 - (p / 100) ** minhash.ROWS) ** minhash.bands(p) <= minhash.MISSED for p in (70, 80, 85, 95))
    base = [f"v{k}" for k in range(100)]
    texts = {0: " ".join(base), 1: " ".join([*base[:90], *[f"x{k}" for k in range(9)]])}  # 86 of 105
    assert [sum(r["kept"] for r in rows(minhash.groups(docs(spark, list(texts.items())), p))) for p in (80, 85)] == [1, 2]


def test_signature_estimates_jaccard():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = np.unique(pool[:2000]), np.unique(pool[500:2500])
    with np.errstate(over="ignore"):
        same = np.mean(minhash.signature(a, 2000) == minhash.signature(b, 2000))
    assert abs(same - 1500 / 2500) < 0.05


def test_components_of_long_chains(spark, monkeypatch):
    monkeypatch.setattr(common, "SMALL_EDGES", 3)
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 102), (200, 200), (7, 3)]
    df = spark.createDataFrame([*edges, (None, 5)], "a long, b long")
    got = {r["id"]: r["component"] for r in common.components(df).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100, 200: 200}
    assert common.components(df.limit(0)).count() == 0


# Toxicity


def test_toxicity_on_held_out_rows(spark):
    d, lab = (spark.read.parquet(f"{DATA}/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(10))
    m = toxicity.train(d, lab.where(fold < 7))
    scored = toxicity.score(d, m).withColumnRenamed("toxic", "found").join(lab.where(fold >= 7), "doc_id")
    n = {(r["toxic"], r["found"]): r["count"] for r in scored.groupBy("toxic", "found").count().collect()}
    assert n[1, True] / (n[1, True] + n.get((1, False), 0)) > 0.85 and n[0, False] / (n[0, False] + n.get((0, True), 0)) > 0.95
    mean = {r["toxic"]: r["m"] for r in scored.groupBy("toxic").agg(F.avg("expected_severity").alias("m")).collect()}
    assert mean[1] > 3 * mean[0]


def _toy(texts):
    """A model of texts among words of their own."""
    filler = lambda k: " ".join(f"f{k}x{j}" for j in range(12))
    return toxicity.fit([toxicity.Row.of(f"{t} {filler(k)}", y) for k, (t, y) in enumerate([*texts, ("mild", 0), ("soft", 0)] * 50)])


def test_toxicity_ordinal_form():
    model = _toy([("calm words here", 0), ("you idiot", 1), ("idiot idiot moron scum", 1)])
    assert all(np.diff(model.thresholds) > 0)
    p = model.above("you idiot")
    assert all(np.diff(p) <= 0) and p[0] > 0.5 and model.above("calm")[0] < 0.5
    assert model.above("idiot idiot moron scum").sum() > p.sum()
    assert toxicity.fit([]).above("idiot")[0] < 0.5 and toxicity.fit([toxicity.Row.of("x", True)]).above("x")[0] < 0.5


def _plain_loss(words, thresholds, rows_, y, weight):
    """Mean weighted minus log likelihood of a cumulative-link model, row by row."""
    import math

    sig = lambda x: 1 / (1 + math.exp(-x))
    total = 0.0
    for r, grade, k in zip(rows_, y, weight, strict=True):
        z = sum(words.get(int(h), 0.0) * (1 + math.log(c)) for h, c in zip(r.words, r.counts, strict=True))
        above = [1.0, *(sig(z - t) for t in thresholds), 0.0]
        total -= k * math.log(above[grade] - above[grade + 1])
    return total / len(rows_) + 0.5e-4 * sum(w * w for w in words.values())


def test_the_fit_is_the_best_by_a_second_likelihood():
    """No small step of any weight or threshold from the fitted model lowers a loss that is worked out plainly; the penalty alone keeps weights finite."""
    rng = random.Random(7)
    bad = ["idiot", "scum", "moron", "creep", "filth"]
    made = [toxicity.Row.of(" ".join([f"f{k}x{j}" for j in range(15)] + [rng.choice(bad) for _ in range(rng.randint(1, 5) if k % 3 == 0 else rng.random() < 0.08)]), k % 3 == 0) for k in range(300)]
    model = toxicity.fit(made, steps=3000)
    words = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))
    y = toxicity.grades(made, toxicity.select_features(made))
    share = toxicity.shares(made)
    toxic = np.array([r.toxic for r in made])
    weight = share * np.where(toxic, toxicity.TOXIC_WEIGHT / share[toxic].sum(), (1 - toxicity.TOXIC_WEIGHT) / share[~toxic].sum()) * len(made)
    assert len(words) >= 4 and set(y) == {0, 1, 2, 3} and (y > 0).tolist() == toxic.tolist()
    best = _plain_loss(words, model.thresholds, made, y, weight)
    for step in (0.05, -0.05):
        for h in words:
            assert _plain_loss(words | {h: words[h] + step}, model.thresholds, made, y, weight) > best - 1e-5
        for k in range(3):
            moved = model.thresholds.copy()
            moved[k] += step
            assert _plain_loss(words, moved, made, y, weight) > best - 1e-5


def test_thresholds_order_held_out_rows(spark):
    """Grades 1 to 3 stand for how much of the toxic words a text holds: rows of labels not fitted on rise with them in severity, and each threshold is passed by fewer rows than the one before."""
    d, lab = (spark.read.parquet(f"{DATA}/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(10))
    model = toxicity.train(d, lab.where(fold < 7))
    held = toxicity.sample(d, lab.where(fold >= 7), 2000)
    grade = toxicity.grades(held, model.features)
    severity = np.array([model.above_counts(dict(zip(r.words.tolist(), r.counts.tolist(), strict=True))).sum() for r in held])
    mean = [severity[grade == k].mean() for k in range(4)]
    assert mean[0] < 0.3 and all(a < b for a, b in zip(mean, mean[1:], strict=False))
    above = np.array([model.above_counts(dict(zip(r.words.tolist(), r.counts.tolist(), strict=True))) for r in held])
    assert all((above[:, k] >= above[:, k + 1]).all() for k in range(2)) and len({int((above[:, k] > 0.5).sum()) for k in range(3)}) == 3


def test_toxicity_sample_is_full_with_repeated_labels(spark):
    d = docs(spark, [(i, f"word{i} text", "a") for i in range(100)])
    labels = spark.range(4000).selectExpr("id % 100 AS doc_id", "CAST(id % 2 AS int) AS toxic")
    assert len(toxicity.sample(d, labels, 30)) == 30


def test_toxicity_edges(spark):
    model = _toy([("calm words", 0), ("idiot scum", 1)])
    d = docs(spark, [*EDGE, (30, "an IDIOT, a scum")])
    got = rows(toxicity.score(d, model))
    assert len(got) == len(EDGE) + 1 and {r["doc_id"] for r in got if r["toxic"]} == {30} and all(r["kept"] != r["toxic"] for r in got)
    left = toxicity.filtered(d, model)
    assert left.columns == d.columns and left.count() == len(EDGE) and toxicity.filtered(d.limit(0), model).count() == 0
    lab = spark.createDataFrame([(30, 1), (30, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    assert [(r.toxic) for r in toxicity.sample(d, lab)] == [True]


# BPE


@pytest.fixture(scope="module")
def vocabulary():
    pytest.importorskip("public_tokenizers")
    return queries.vocabulary()


@pytest.fixture(scope="module")
def theirs(vocabulary):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary)


def test_bpe_equals_the_library(vocabulary, theirs):
    t = bpe.Tokenizer(vocabulary)
    rng = random.Random(6)
    texts = ["", " ", "<|endoftext|>", "a<|endoftext|> b\n\n <|endoftext|>", "a" * 300, "  x\x85y\x1c z　", "日本語😀é́‍", "I'll we've 12345 --- ===\t\t\n", LONG[:5000]]
    texts += ["".join(rng.choice("abcdehinorst 0.-='é\n") for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    for x, e in zip(texts, theirs.encode_batch(texts, add_special_tokens=False), strict=True):
        assert t.encode(x) == e.ids, x
        assert t.decode(e.ids) == theirs.decode(e.ids, skip_special_tokens=False)
    assert t.decode(t.encode(texts[6])) == texts[6] and t.decode([220, 171]) == theirs.decode([220, 171], skip_special_tokens=False)


def test_every_token_is_its_own_encoding(vocabulary):
    a = bpe.Tokenizer(vocabulary).automaton
    assert all(a.encode_word(b) == [t] for b, t in a.by_bytes.items())


def merge_loop(merges, vocab, word):
    parts = [bytes([b]) for b in word]
    for u, v in merges:
        i = 0
        while i < len(parts) - 1:
            if parts[i] == u and parts[i + 1] == v:
                parts[i : i + 2] = [u + v]
            i += 1
    return [vocab[p] for p in parts]


def random_merges(rng, letters, n):
    """Merges of tokens there are, each to a new token; some can never be reached."""
    tokens, merges = [bytes([b]) for b in letters], []
    while len(merges) < n:
        u, v = rng.choice(tokens), rng.choice(tokens)
        if u + v not in tokens and len(u + v) < 8:
            merges.append((u, v))
            tokens.append(u + v)
    return merges


def test_small_automata_against_the_merge_loop(monkeypatch):
    rng = random.Random(1)
    first = [(b"a", b"a"), (b"aa", b"b"), (b"b", b"a"), (b"a", b"ba"), (b"aa", b"a"), (b"ba", b"ba")]
    for k, merges in enumerate([first, *(random_merges(rng, b"abc"[: 2 + k % 2], 3 + k % 12) for k in range(60))]):
        monkeypatch.setattr(bpe, "FEW", (0, 2, 24)[k % 3])
        vocab = {bytes([b]): b for b in range(256)} | {u + v: 256 + k for k, (u, v) in enumerate(merges)}
        a = bpe.Automaton(vocab, merges, 40 if k % 4 else 10**6)  # a table that is full now and then
        for _ in range(300):
            w = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 14)))
            assert a.encode_word(w) == merge_loop(merges, vocab, w), (merges, w)


def test_one_transition_a_byte_and_none_undone(vocabulary):
    """Each state reached holds the last token of the prefix's own encoding: nothing that a later byte could undo. The table has one next state for a state and a byte."""
    a, rng = bpe.Tokenizer(vocabulary).automaton, random.Random(3)
    for _ in range(400):
        w = bytes(rng.choice(b"abcdehinorst 0-=\xc3\xa9") for _ in range(rng.randint(1, 40)))
        path = a.run(w)
        assert len(path) == len(w)
        for k, s in enumerate(path):
            assert s.last == a.encode_word(w[: k + 1])[-1] and len(a.labels[s.last]) == s.size
        before = a.arcs
        assert all(x is y for x, y in zip(a.run(w), path, strict=True)) and a.arcs == before  # compiled once
    assert a.arcs == sum(map(len, a.states.values()))


def test_long_words_and_full_tables_stay_bounded(vocabulary, theirs, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_BYTES", 20_000)
    t, rng = bpe.Tokenizer(vocabulary), random.Random(4)
    t.automaton.max_arcs = 2000
    texts = ["".join(rng.choice("abcdefghijklmnop") for _ in range(n)) for n in (50_000, 20_000)] + [" ".join("".join(rng.choice("aeiourst") for _ in range(7)) for _ in range(400)) for _ in range(20)]
    for x, e in zip(texts, theirs.encode_batch(texts, add_special_tokens=False), strict=True):
        assert t.encode(x) == e.ids
        assert t.kept <= 21_000 and sum(map(len, t.memo)) < 21_000 and all(len(v[1]) <= bpe.LONGEST_WORD for v in t.memo.values())


def test_bpe_digests_and_round_trip(spark, vocabulary, theirs):
    d = docs(spark, EDGE)
    got = sorted(rows(bpe.digests(d, vocabulary)), key=str)
    want = []
    for i, text, *_ in EDGE:
        ids = theirs.encode(text or "", add_special_tokens=False).ids
        want.append({"doc_id": i, "n_tokens": len(ids), "ids_sha256": sha256(",".join(map(str, ids)).encode()).hexdigest(), "decoded_sha256": sha256((text or "").encode()).hexdigest()})
    assert got == sorted(want, key=str) and bpe.digests(d.limit(0), vocabulary).count() == 0
    back = bpe.decode(bpe.encode(d, vocabulary), vocabulary)
    assert sorted((tuple(r) for r in back.collect()), key=str) == sorted(((i, t) for i, t, *_ in EDGE), key=str)
