"""Toxicity by cumulative-link ordinal regression.

P(grade > k | x) = sigmoid(w . x - t_k): one weight vector w serves every
threshold t_0 < t_1 < ..., so a word that moves a text over the first threshold
moves it towards the others by the same amount. The output is the expected
severity, the sum over k of P(grade > k).

Features are sparse: 1 + log(count) of a text's hashed lower-cased words and
word stems, over those whose presence surely tells toxic texts from the rest.

What the grades can mean: the labels say toxic or not, and no table grades
toxicity. Grade 0 is a row that is labelled not toxic. Toxic rows are dealt to
grades 1 to GRADES - 1 in equal parts by how much they hold of the words that the
sample ties to toxicity. So the first threshold rests on labels alone, and it
alone decides a verdict; the higher ones order toxic texts by the density of
such words, and an expected severity of 2 says no more than that. With graded
labels, fit() takes them in place of grades().
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, first_by_hash, memo, only, rows_by

#: Labelled rows that the model is fitted on at most, the first by hash of doc_id.
SAMPLE_ROWS = 8000
#: Words (features) the model keeps, by falling association with toxic rows.
FEATURES = 512
#: Severity grades 0 .. GRADES - 1; 0 is not toxic.
GRADES = 4
#: Hashed words: 2^30 of them, so that a clash of a kept word with another is rare.
HASH_BITS = 30
#: The toxic rows' part of all weight when fitting.
TOXIC_WEIGHT = 0.3
#: A text is toxic if its probability of a grade above 0 exceeds this.
TOXIC_ABOVE = 0.5


#: Lengths of the stems that are features beside the whole word: abuse takes endings and compounds.
STEMS = (4, 5, 6, 7)
#: A feature is kept if its log odds of toxicity exceed LEAST_ODDS by SURE standard errors.
LEAST_ODDS, SURE = 1.0, 2.5

#: Words a worker keeps, when scoring and when hashing the sample (where each takes some 380 bytes); when full, the table starts anew.
MEMO_WORDS, SAMPLE_WORDS = 200_000, 60_000
_memo: dict[str, tuple[int, ...]] = memo({})
_kept_memo: dict[str, tuple[int, ...]] = memo({})


def parts(word: str) -> tuple[int, ...]:
    """Hashes of a word and its stems."""
    from zlib import crc32

    return tuple(crc32(x.encode()) >> (32 - HASH_BITS) for x in [word, *(f"{word[:k]}-" for k in STEMS if k < len(word))])


def word_counts(text: str | None):
    import re
    from collections import Counter

    return Counter(re.findall(r"\w+", (text or "").lower())).items()


def hashed(text: str | None) -> dict[int, int]:
    """Hashed lower-cased words (letters and digits) and stems of a text with their counts."""
    if len(_memo) > SAMPLE_WORDS:
        _memo.clear()
    out: dict[int, int] = {}
    for w, n in word_counts(text):
        if (hs := _memo.get(w)) is None:
            _memo[w] = hs = parts(w)
        for h in hs:
            out[h] = out.get(h, 0) + n
    return out


@dataclass(frozen=True)
class Model:
    features: np.ndarray  # hashed words, rising
    weights: np.ndarray
    thresholds: np.ndarray  # rising

    def above(self, text: str | None) -> np.ndarray:
        """P(grade > k) for each threshold k."""
        kept, seen = self._table, _kept_memo
        if len(seen) > MEMO_WORDS:
            seen.clear()
        counts: dict[int, int] = {}
        for w, n in word_counts(text):
            if (hs := seen.get(w)) is None:
                seen[w] = hs = tuple(h for h in parts(w) if h in kept)
            for h in hs:
                counts[h] = counts.get(h, 0) + n
        return self.above_counts(counts)

    def above_counts(self, counts: dict[int, int]) -> np.ndarray:
        kept = self._table
        z = sum(kept[h] * (1 + np.log(counts[h])) for h in sorted(counts) if h in kept)
        return 1 / (1 + np.exp(np.clip(self.thresholds - z, -40, 40)))

    @property
    def _table(self) -> dict[int, float]:
        """Weights by hash. A worker's words seen are those of one model: a new one empties them."""
        if (t := self.__dict__.get("_t")) is None:
            t = dict(zip(self.features.tolist(), self.weights.tolist(), strict=True))
            object.__setattr__(self, "_t", t)
            _kept_memo.clear()
        return t

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_t"}


def _lists(batches):
    import pyarrow as pa

    claim(_memo)
    for batch in batches:
        found = [hashed(t) for t in batch.column(0).to_pylist()]
        raw = lambda x: np.fromiter(x, np.int32).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([raw(x.keys()) for x in found], pa.binary()), pa.array([raw(x.values()) for x in found], pa.binary()), batch.column(1)], ["words", "counts", "toxic"])


@dataclass(frozen=True)
class Row:
    """A labelled text: its hashed words, their counts, its label."""

    words: np.ndarray
    counts: np.ndarray
    toxic: bool

    @classmethod
    def of(cls, text: str | None, toxic: bool) -> Row:
        h = hashed(text)
        return cls(np.array(list(h), np.int32), np.array(list(h.values()), np.int32), bool(toxic))


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> list[Row]:
    """Up to rows labelled documents as (words, counts, toxic): a bounded number of rows, whole texts, by hash of doc_id.

    The labels are cut to the bound first, so that documents are only filtered
    by a broadcast of at most that many ids. Null labels and ids are left out;
    an id labelled twice counts once, as toxic if any label says so; an id that
    occurs twice gives one of its texts.
    """
    labels = only(labels, "doc_id", "toxic")
    ids = labels.select(F.col("doc_id").cast("long").alias("__id"), F.col("toxic").cast("int").alias("toxic")).dropna().groupBy("__id").agg(F.max("toxic").alias("toxic"))
    ids = first_by_hash(ids, "__id", rows, ids.count())
    one = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("__id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "__id")
    # One row an id, however often it occurs: of its texts that of the smallest hash.
    one = one.groupBy("__id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("toxic").alias("toxic"))
    found = one.select("text", "toxic").mapInArrow(_lists, "words binary, counts binary, toxic int").toLocalIterator()
    out = [Row(np.frombuffer(bytes(r[0]), np.int32), np.frombuffer(bytes(r[1]), np.int32), r[2] > 0) for r in found]
    return sorted(out, key=lambda r: (len(r.words), r.words.tobytes(), r.toxic))  # sums in one order, so that reruns agree


def shares(rows: list[Row]) -> np.ndarray:
    """1 over the number of rows whose word sets have the same three MinHash values: near copies count as one text, about."""
    signs = np.zeros((len(rows), 3), np.uint32)
    for i, r in enumerate(rows):
        if len(r.words):
            for k, m in enumerate((2654435761, 2246822519, 3266489917)):
                x = r.words.astype(np.uint32) * np.uint32(m)
                signs[i, k] = (x ^ x >> np.uint32(15)).min()
    _, at, n = np.unique(signs, axis=0, return_inverse=True, return_counts=True)
    return 1 / n[at.ravel()]


def select_features(rows: list[Row], n: int = FEATURES) -> np.ndarray:
    """Hashed words whose log odds of presence are surely high, the first n by odds times the toxic rows that hold them."""
    share, toxic = shares(rows), np.array([r.toxic for r in rows])
    sizes = [len(r.words) for r in rows]
    words, at = np.unique(np.concatenate([r.words for r in rows]), return_inverse=True)
    weight, of_toxic = np.repeat(share, sizes), np.repeat(toxic, sizes)
    pos, neg = (np.bincount(at, weight * k, len(words)) for k in (of_toxic, ~of_toxic))
    n_pos, n_neg = share[toxic].sum(), share[~toxic].sum()
    odds = np.log((pos + 0.5) / (n_pos + 1)) - np.log((neg + 0.5) / (n_neg + 1))
    sure = odds - SURE * np.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5)) > LEAST_ODDS
    best = np.lexsort((words[sure], -(pos * odds)[sure].round(9)))[:n]
    return np.sort(words[sure][best]).astype(np.int64)


def grades(rows: list[Row], features: np.ndarray, n_grades: int = GRADES) -> np.ndarray:
    """0 where not toxic; toxic rows rise by thirds (n_grades - 1 parts) of how much of the kept words they hold."""
    y = np.array([int(r.toxic) for r in rows])
    much = np.array([(1 + np.log(r.counts[np.isin(r.words, features)])).sum() for r in rows])
    if y.any() and n_grades > 2:
        cuts = np.quantile(much[y > 0], np.arange(1, n_grades - 1) / (n_grades - 1))
        y = np.where(y > 0, 1 + (much[:, None] > cuts).sum(1), 0)
    return y


def fit(rows: list[Row], n_features: int = FEATURES, n_grades: int = GRADES, steps: int = 400, penalty: float = 1e-4, graded: np.ndarray | None = None) -> Model:
    """Maximum likelihood of the cumulative-link model by gradient steps (Adam); thresholds stay ordered as sums of exponentials. graded: the rows' grades, where labels have them.

    rows that are empty or of one class alone give a model that calls nothing toxic.
    """
    y01 = [r.toxic for r in rows]
    if not rows or not any(y01) or all(y01):
        return Model(np.zeros(0, np.int64), np.zeros(0), np.full(n_grades - 1, 40.0) + np.arange(n_grades - 1))
    features = select_features(rows, n_features)
    if not len(features):
        return Model(features, np.zeros(0), np.full(n_grades - 1, 40.0) + np.arange(n_grades - 1))
    y = grades(rows, features, n_grades) if graded is None else np.asarray(graded)
    sizes = [len(r.words) for r in rows]
    every, count = np.concatenate([r.words for r in rows]), np.concatenate([r.counts for r in rows])
    held = np.isin(every, features)
    r_ix, c_ix, val = np.repeat(np.arange(len(rows)), sizes)[held], np.searchsorted(features, every[held]), 1 + np.log(count[held])
    n, k = len(rows), n_grades - 1
    balance = shares(rows)  # near copies share one text's weight, and toxic rows weigh TOXIC_WEIGHT of all
    balance = balance * np.where(y > 0, TOXIC_WEIGHT / balance[y > 0].sum(), (1 - TOXIC_WEIGHT) / balance[y == 0].sum()) * len(rows)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    # theta: weights, first threshold, logs of the gaps
    theta = np.concatenate([np.zeros(len(features)), [1.0], np.zeros(k - 1)])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, t = theta[: len(features)], theta[len(features)] + np.concatenate([[0.0], np.cumsum(np.exp(theta[len(features) + 1 :]))])
        z = np.bincount(r_ix, w[c_ix] * val, n)
        over = np.hstack([np.ones((n, 1)), sig(z[:, None] - t), np.zeros((n, 1))])  # P(grade > k - 1)
        p = np.maximum(over[np.arange(n), y] - over[np.arange(n), y + 1], 1e-12)
        slope = over * (1 - over)
        lo, hi = slope[np.arange(n), y], slope[np.arange(n), y + 1]
        dz = -balance * (lo - hi) / p / n
        g_w = np.bincount(c_ix, dz[r_ix] * val, len(features)) + penalty * w
        g_t = np.zeros(k)
        has_lo, has_hi = y > 0, y < k
        np.add.at(g_t, y[has_lo] - 1, (balance * lo / p / n)[has_lo])
        np.add.at(g_t, y[has_hi], -(balance * hi / p / n)[has_hi])
        g = np.concatenate([g_w, [g_t.sum()], np.exp(theta[len(features) + 1 :]) * (g_t[::-1].cumsum()[::-1][1:])])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        theta[: len(features)] = np.maximum(theta[: len(features)], 0)  # features were chosen as signs of toxicity
    w, t = theta[: len(features)], theta[len(features)] + np.concatenate([[0.0], np.cumsum(np.exp(theta[len(features) + 1 :]))])
    used = np.abs(w) > 1e-6
    return Model(features[used], w[used], t)


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    return fit(sample(docs, labels, rows))


SCORES = "doc_id long, expected_severity double, grade int, toxic boolean, kept boolean"


def _scored(model: Model):
    def run(batches):
        import pyarrow as pa

        claim(_kept_memo)
        for batch in batches:
            p = np.array([model.above(t) for t in batch.column(1).to_pylist()]).reshape(-1, len(model.thresholds))
            toxic = p[:, 0] > TOXIC_ABOVE
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p.sum(1).round(9)), pa.array((p > 0.5).sum(1).astype(np.int32)), pa.array(toxic), pa.array(~toxic)], ["doc_id", "expected_severity", "grade", "toxic", "kept"])
        claim()

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Expected severity, the median grade and the verdict for every row of docs (see SCORES).

    A null or empty text has no features: its severity is that of the
    thresholds alone, and it isn't toxic. Rows are judged one by one; repeated
    rows repeat, an empty table gives none, other columns are not looked at.
    """
    return only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_scored(model), SCORES)


def _clean(model: Model, at: int):
    def run(batches):
        import pyarrow as pa

        claim(_kept_memo)
        for batch in batches:
            yield batch.filter(pa.array([bool(model.above(t)[0] <= TOXIC_ABOVE) for t in batch.column(at).to_pylist()], pa.bool_()))
        claim()

    return run


def filtered(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that aren't toxic, with docs' own columns, whatever they are. Null and empty texts stay."""
    return rows_by(docs, _clean(model, docs.columns.index("text")))
