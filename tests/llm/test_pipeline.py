"""The corpus pipeline against its stages done plainly."""

from collections import Counter
from hashlib import sha256

import corpus_pipeline
from causaria.llm import common, mixing, quality, toxicity
from causaria.llm.queries import table
from tests.conftest import DATA
from tests.llm.helpers import near_duplicates

SF = f"{DATA}/sf0.001"


def test_run_equals_plain_stages(spark):
    from tokenizers import Tokenizer

    docs = table(spark, SF, "documents")
    model = toxicity.train(docs, table(spark, SF, "labels"))
    kept = [r for r in docs.collect() if model.above(r["text"])[0] <= toxicity.TOXIC_ABOVE]
    kept = [r for r in kept if quality.passes(quality.Doc(r["text"]), quality.RULES)]
    comp = near_duplicates({r["doc_id"]: r["text"] for r in kept}, 80)[1]
    kept = [r for r in kept if comp[r["doc_id"]] == r["doc_id"]]
    copies = {r["doc_id"]: r["copies"] for r in mixing.plan(spark.createDataFrame(kept, docs.schema)).collect()}
    theirs, want = Tokenizer.from_file(corpus_pipeline.vocabulary()), Counter()
    for r in kept:
        ids = theirs.encode(r["text"], add_special_tokens=False).ids
        want[r["doc_id"], len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256(r["text"].encode()).hexdigest()] += copies[r["doc_id"]]
    got = Counter(map(tuple, corpus_pipeline.run(spark, SF).collect()))
    assert got == +want and len(got) > 50


def test_run_drops_what_it_staged(spark, monkeypatch):
    """After a run only its last stage's input is left, and, staged for the last stage, what it reads."""
    monkeypatch.setattr(common, "_staged", [])
    out = corpus_pipeline.run(spark, SF)
    assert len(common._staged) == 1 and out.count() > 50


def test_stages_keep_the_columns_and_shrink_or_repeat(spark):
    docs = table(spark, SF, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_dedup", "mixing", "bpe"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_stages_take_empty_tables_and_nulls(spark):
    odd = docs([(None, None, None), (1, None, "a"), (2, "", None), (3, "one", "a"), (3, "one", "a"), (4, " ".join(f"w{k}" for k in range(30)), "b")])(spark)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), SF).count() == 0, name
        kept = sorted(r["doc_id"] or 0 for r in stage(spark, odd, SF).collect())
        if name == "mixing":
            assert set(kept) == {3, 4}
        else:
            assert kept == {"toxicity": [0, 1, 2, 3, 3, 4], "quality": [4], "near_dedup": [0, 1, 2, 3, 3, 4], "bpe": [0, 1, 2, 3, 3, 4]}[name]


def docs(rows):
    return lambda spark: spark.createDataFrame([(i, t, None, s, None) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_mixed_rows_follow_their_positions(spark):
    docs = table(spark, SF, "documents")
    out = mixing.mix(docs).collect()
    first = {r["doc_id"]: r["first_position"] for r in mixing.plan(docs).where("copies > 0").collect()}
    seen = []
    for r in out:
        if r["doc_id"] not in seen:
            seen.append(r["doc_id"])
    assert set(seen) == set(first) and [first[i] for i in seen] == sorted(first.values())
