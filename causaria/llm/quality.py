"""Quality rules as a short-circuit cascade.

The cascade is built on a bounded sample, rule by rule: the next one is the rule
that rejects most per cost among the documents that those before it let pass,
where what they have worked out already (words, lines, repeats) costs nothing
any more. In the run, a document's first failed rule ends its evaluation, and
nothing that only later rules ask of it is worked out. The verdict is that no
rule rejects, so it doesn't depend on the order; only the time does.

measure() returns the base measures of every document and so works them out
first; its cascade holds the rules that base_failed hasn't decided, for the
documents that it let pass. filtered() leaves everything to the cascade.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, rows_by

#: What separates words, and the characters that count as symbols.
SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
#: Documents that costs and selectivities are estimated on, the first by a hash of doc_id and text.
SAMPLE_ROWS = 200


class Doc:
    """A text and what rules ask of it, each worked out at most once."""

    def __init__(self, text: str | None):
        self.text = text or ""

    def copy(self) -> Doc:
        """The text with all that has been worked out so far."""
        out = Doc(None)
        out.__dict__.update(self.__dict__)
        return out

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode().split()  # bytes.split() splits at SPACES

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, SPACES))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(SPACES)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        return repeat_words(self.words)

    @cached_property
    def n_upper(self) -> int:
        """Words of two letters or more that have capitals only."""
        return sum(w.isupper() and len(w) > 1 for w in b" ".join(self.words).decode().split(" "))

    @cached_property
    def n_stutters(self) -> int:
        """Words equal to the word before."""
        return sum(map(bytes.__eq__, self.words[1:], self.words))

    @cached_property
    def base_failed(self) -> bool:
        return self.n_words < 10 or 100 * self.n_repeat_words > 20 * self.n_words


def repeat_words(words: list) -> int:
    """Words in 5-word windows that are found twice or more in the text, the first included."""
    import numpy as np

    n = len(words)
    if n < 6:
        return 0
    seen: dict = {}
    number = seen.setdefault
    ids = np.fromiter([number(w, len(seen)) for w in words], np.int64, n)
    v = len(seen)
    if v == n:
        return 0
    if v < 6000:  # five numbers below it fit a 64-bit code
        code = (((ids[:-4] * v + ids[1:-3]) * v + ids[2:-2]) * v + ids[3:-1]) * v + ids[4:]
    else:  # pairs are numbered anew, then pairs of pairs
        two = np.unique(ids[:-1] * v + ids[1:], return_inverse=True)[1]
        four = np.unique(two[:-2] * n + two[2:], return_inverse=True)[1]
        code = four[:-1] * v + ids[4:]
    order = np.argsort(code, kind="stable")
    sorted_code = code[order]
    same = sorted_code[1:] == sorted_code[:-1]
    if not same.any():
        return 0
    repeated = np.zeros(n - 4, bool)
    repeated[order[1:][same]] = True
    repeated[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(5):
        covered[k : n - 4 + k] |= repeated
    return int(covered.sum())


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Doc], bool]


#: The production rules, in no order: the cascade finds one. Thresholds leave prose of any language alone.
RULES = (
    Rule("too_short", lambda d: d.n_words < 10),
    Rule("repeated_passages", lambda d: 100 * d.n_repeat_words > 20 * d.n_words),
    Rule("symbols", lambda d: 100 * d.n_symbols > 25 * d.n_words),
    Rule("word_length", lambda d: not 2 * d.n_words <= d.word_chars <= 20 * d.n_words),
    Rule("duplicate_lines", lambda d: d.n_dup_lines >= 3 and 100 * d.n_dup_lines > 30 * len(d.lines)),
    Rule("stutter", lambda d: 100 * d.n_stutters > 30 * d.n_words),
    Rule("shouting", lambda d: 100 * d.n_upper > 50 * d.n_words),
)


#: Rules that base_failed decides.
BASE = ("too_short", "repeated_passages")


@dataclass(frozen=True)
class Estimate:
    """What a rule adds at its place in the cascade: seconds a document that gets there, and the share of those that it rejects."""

    name: str
    seconds: float
    rejected: float

    @property
    def gain(self) -> float:
        return self.rejected / max(self.seconds, 1e-9)


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS) -> list[str | None]:
    """Up to rows texts, the first by a hash of doc_id and text: the same whatever the partitions."""
    found = only(docs, "doc_id", "text").select(F.xxhash64(F.col("doc_id").cast("string"), F.col("text").cast("string")).alias("h"), F.col("text").cast("string").alias("text"))
    n = docs.count()
    if n > 20 * rows:  # most rows can't be among them: fewer texts to sort
        few = found.where(F.col("h") <= int(-(2**63) + 2**64 * 4 * rows / n)).orderBy("h").limit(rows).collect()
        if len(few) == rows:
            return [r["text"] for r in few]
    return [r["text"] for r in found.orderBy("h").limit(rows).collect()]


def cascade(texts: list[str | None], rules=RULES, prepare: Callable[[Doc], object] | None = None) -> tuple[tuple[Rule, ...], list[Estimate]]:
    """The rules in order, and what each was estimated at when it was chosen.

    prepare works out what is at hand before the cascade begins. Among rules
    that reject nothing more, the cheapest is first; ties go by name.
    """
    left, order, found = list(rules), [], []
    here = [Doc(t) for t in texts]
    if prepare:
        here = [d for d in here if not prepare(d)]
    while left:
        best = None
        for rule in left:
            after = [d.copy() for d in here]
            began = time.perf_counter()
            hits = [bool(rule.rejects(d)) for d in after]
            spent = (time.perf_counter() - began) / max(len(after), 1)
            e = Estimate(rule.name, spent, sum(hits) / max(len(after), 1))
            if best is None or (-e.gain, e.seconds, e.name) < (-best[1].gain, best[1].seconds, best[1].name):
                best = rule, e, [d for d, hit in zip(after, hits, strict=True) if not hit]
        left.remove(best[0])
        order.append(best[0])
        found.append(best[1])
        here = best[2] or here
    return tuple(order), found


def passes(doc: Doc, rules) -> bool:
    return not any(r.rejects(doc) for r in rules)


def measured(doc: Doc) -> bool:
    """Works out the base measures; whether they reject the document."""
    _ = doc.word_chars, doc.n_symbols, doc.n_dup_lines
    return doc.base_failed


MEASURES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def _measured(rules):
    def run(batches):
        import pyarrow as pa

        names = [x.split()[0] for x in MEASURES.split(", ")]
        for batch in batches:
            cols: list[list] = [[] for _ in names[1:]]
            for text in batch.column(1).to_pylist():
                d = Doc(text)
                failed = measured(d)
                row = (d.n_words, d.word_chars, d.n_symbols, d.n_dup_lines, d.n_repeat_words, failed, not failed and passes(d, rules))
                for c, x in zip(cols, row, strict=True):
                    c.append(x)
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names)

    return run


def measure(docs: DataFrame, rules=RULES) -> DataFrame:
    """Measures and verdict for every row of docs (see MEASURES).

    A null text counts as empty: all measures 0, base_failed, not kept. Rows
    are judged one by one, so repeated rows repeat; an empty table gives no
    rows; columns other than doc_id and text are not looked at.
    """
    rules, _ = cascade(sample(docs), [r for r in rules if r.name not in BASE], measured)
    return only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_measured(rules), MEASURES)


def _kept(rules, at: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield batch.filter(pa.array([passes(Doc(t), rules) for t in batch.column(at).to_pylist()], pa.bool_()))

    return run


def filtered(docs: DataFrame, rules=RULES) -> DataFrame:
    """The rows of docs that no rule rejects, with docs' own columns, whatever they are; rows with null or empty text go."""
    rules, _ = cascade(sample(docs), rules)
    return rows_by(docs, _kept(rules, docs.columns.index("text")))
