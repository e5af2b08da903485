"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Two permutations of a universe of 2^32 make every signature coordinate: sigma
scatters the shingles once, and coordinate k is the minimum over the set of
pi(sigma(x) + k), the second permutation circularly shifted by k.

1. One pass over the texts keeps, per document, the size of its shingle set,
   a 128-bit fingerprint of it and the band keys. Sets themselves aren't kept.
2. Documents of one fingerprint are one class; its smallest id stands for it.
3. In each band bucket every representative is tied to the bucket's smallest:
   as many ties as members, never pairs. Connected ties form candidate groups;
   all candidate pairs lie within one. The texts of candidates, and only they,
   are read again, and pairs are compared on full sets.
4. A group of up to GROUP_ROWS is compared whole: each set is sent once.
5. Larger ones are either many near copies or chains of chance ties, which grow
   with the corpus. They aren't compared as groups, but bucket by bucket, each
   set of members once: first, in a few bands, blocks of a bucket's members
   among themselves and with its smallest, which connects near copies at a cost
   that is linear in their number; then in all bands those buckets that still
   hold several components, their largest component's members against the
   others alone. So every pair of a bucket is compared or already connected,
   and no task sees more than GROUP_ROWS rows or GROUP_SHINGLES shingles beyond
   two single sets.

With R rows in each of B bands, a pair of Jaccard similarity s shares a bucket
with probability 1 - (1 - s^R)^B. bands() chooses B so that a pair at the
threshold misses all of them with a probability below one in a million.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import claim, components, memo, numbered, only, small, staged

ROWS, MISSED = 6, 1e-6
SHINGLE = 5
#: A link needs this many percent of the union in common.
PERCENT = 85
#: What one task may compare. Larger groups are compared by buckets, and large buckets in blocks.
GROUP_ROWS, GROUP_SHINGLES = 512, 3_000_000
#: Bands that large groups are first connected by.
FIRST_BANDS = 6
#: Longs of the bitmap that texts are filtered by where candidates are too many to broadcast.
BITMAP = 1_000_000

_A, _B, _C = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)


class _Words(dict):
    """64-bit hash of each word seen; starts anew when full."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 250_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_words = memo(_Words())


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Rising 64-bit hashes of a text's distinct shingles; with fewer words the whole sequence as one, without any none."""
    raw = (text or b"") if not isinstance(text, str) else text.encode()
    words = raw.lower().split()  # of bytes: A-Z alone, split at ASCII white space alone
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = min(size, len(words))
    last = len(h) - n + 1
    x = h[:last] + np.uint64(n)
    for j in range(1, n):
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[j : last + j]
    x = mix64(x)
    x.sort()
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) > 1 else x


def bands(percent: int = PERCENT) -> int:
    """Bands of ROWS rows that lose fewer than MISSED of the pairs at the threshold."""
    return int(np.ceil(np.log(MISSED) / np.log1p(-((percent / 100) ** ROWS))))


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a shingle set."""
    a, b = mix64(s + np.uint64(0x1234567)).sum(dtype=np.uint64), mix64(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    return int(np.array(a).view(np.int64)), int(np.array(b).view(np.int64))


def signature(s: np.ndarray, n: int) -> np.ndarray:
    """n coordinates of a non-empty set: minima of the second permutation under circular shifts."""
    x = (mix64(s) >> np.uint64(32)).astype(np.uint32)  # sigma
    shift = np.arange(n, dtype=np.uint32)[:, None]
    out = np.full(n, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 512):
        y = x[None, at : at + 512] + shift
        y *= _A
        y ^= y >> np.uint32(16)
        y *= _B
        y ^= y >> np.uint32(15)
        y *= _C
        np.minimum(out, y.min(axis=1), out=out)
    return out


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    parts = sig.reshape(-1, rows).astype(np.uint64)
    key = np.arange(1, len(parts) + 1, dtype=np.uint64)
    for j in range(rows):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, j])
    return key.view(np.int64)


def _signed(n_bands: int):
    def run(batches):
        import pyarrow as pa

        claim(_words)
        none, seen = np.zeros(0, np.int64), {}
        for batch in batches:
            n, prints, found = [], [], []
            with np.errstate(over="ignore"):
                for text in batch.column(1).to_pylist():
                    s = shingles(text)
                    f = fingerprint(s)
                    if (keys := seen.get(f)) is None:
                        if len(seen) > 20_000:
                            seen.clear()
                        seen[f] = keys = band_keys(signature(s, ROWS * n_bands)) if len(s) else none
                    n.append(len(s))
                    prints.append(f)
                    found.append(keys)
            ends = np.concatenate([[0], np.cumsum([len(k) for k in found])]).astype(np.int32)
            hi, lo = (pa.array([f[k] for f in prints], pa.int64()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), hi, lo, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([none, *found])))], ["doc_id", "n", "hi", "lo", "bands"])
        claim()  # hashing words anew costs less than the memory that an idle worker would hold

    return run


def _sets(batches):
    """The last column, texts, as sets. Rows of one id and text (the first column) that follow in a task are one: none is sent on twice, or hardly."""
    import pyarrow as pa

    claim(_words)
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        texts = batch.column(batch.num_columns - 1).to_pylist()
        new = []
        for i, t in zip(batch.column(0).to_pylist(), texts, strict=True):
            row = i, hash(t)
            new.append(row not in seen)
            if len(seen) > 50_000:
                seen.clear()
            seen.add(row)
        with np.errstate(over="ignore"):
            found = [shingles(t).tobytes() for t, n in zip(texts, new, strict=True) if n]
        kept = batch.filter(pa.array(new))
        yield pa.RecordBatch.from_arrays([*kept.columns[:-1], pa.array(found, pa.binary())], [*batch.schema.names[:-1], "set"])
    claim()


def links(ids: list[int], sets: list[np.ndarray], percent: int = PERCENT, labels: list[int] | None = None):
    """Links (smaller id, larger id) that connect exactly what all pairs' links would connect.

    A pair already connected, by links found here or by equal labels, isn't compared. Each row in turn marks its
    shingles and meets all later rows that aren't connected to it at once.
    """
    m, sizes = len(ids), np.array([len(s) for s in sets])
    where = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(sizes)
    starts = ends - sizes
    mark = np.zeros(int(where.max()) + 1, np.int32)
    label = np.arange(m) if labels is None else np.unique(labels, return_inverse=True)[1]
    for p in range(m - 1):
        rest = p + 1 + np.flatnonzero(label[p + 1 :] != label[p])
        rest = rest[(100 * sizes[rest] >= percent * sizes[p]) & (100 * sizes[p] >= percent * sizes[rest])]
        if not len(rest):
            continue
        own = where[starts[p] : ends[p]]
        mark[own] = 1
        if len(rest) < (m - p) // 4 or m < 4:
            common = np.array([mark[where[starts[q] : ends[q]]].sum() for q in rest])
        else:
            common = np.add.reduceat(mark[where[starts[p + 1] :]], starts[p + 1 :] - starts[p + 1])[rest - p - 1]
        mark[own] = 0
        for q in rest[100 * common >= percent * (sizes[p] + sizes[rest] - common)]:
            if label[q] != label[p]:
                label[label == label[q]] = label[p]
                yield min(ids[p], ids[q]), max(ids[p], ids[q])


def _verified(percent: int):
    """Rows sorted by part: (part, id, label, set) -> links (a, b)."""

    def run(batches):
        import pyarrow as pa

        def flush(ids, labels, sets):
            found = list(links(ids, sets, percent, labels)) if len(ids) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

        now, ids, labels, sets, last = None, [], [], [], None
        for batch in batches:
            for part, i, label, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != now:
                    if len(ids) > 1:
                        yield flush(ids, labels, sets)
                    now, ids, labels, sets, last = part, [], [], [], None
                if len(raw) and (i, raw) != last:
                    ids.append(i)
                    labels.append(label)
                    sets.append(np.frombuffer(raw, np.uint64))
                    last = i, raw
        yield flush(ids, labels, sets)

    return run


def only_of(docs: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """docs whose key (a long) may be among ids: all that are, and few others, without a shuffle of docs.

    One hash of each id sets a bit of BITMAP longs; the longs are broadcast,
    BITMAP rows at most.
    """
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(BITMAP * 64))
    words = ids.select(bit("id").alias("h")).groupBy(F.expr("h div 64").alias("__word")).agg(F.expr("bit_or(shiftleft(1L, CAST(h % 64 AS INT)))").alias("__bits"))
    marked = docs.withColumn("__h", bit(key)).join(F.broadcast(words), F.expr("__h div 64") == F.col("__word"))
    return marked.where(F.expr("shiftright(__bits, CAST(__h % 64 AS INT)) & 1L = 1L")).drop("__h", "__word", "__bits")


def verified(docs: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """parts (id, label, part): links (a, b) found by comparing, in each part, all rows of different labels on their full sets.

    docs: (id, text). An id's parts are gathered into one row, so that its text
    is joined and its set worked out once.
    """
    parts = staged(parts)
    dealt = staged(parts.groupBy("id").agg(F.min("label").alias("label"), F.collect_list("part").alias("parts")))
    n = parts.count()
    texts = docs if n <= common.BROADCAST_ROWS else only_of(docs, "id", dealt)
    sets = texts.join(small(dealt, n), "id").select("id", "label", "parts", "text").mapInArrow(_sets, "id long, label long, parts array<long>, set binary")
    rows = sets.select(F.explode("parts").alias("part"), "id", "label", "set")
    return rows.repartition("part").sortWithinPartitions("part", "id", "set").mapInArrow(_verified(percent), "a long, b long")


def in_buckets(docs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Links among members (id, n, bands), found bucket by bucket. docs: (id, text)."""
    m = staged(members.select("id", "n", F.posexplode("bands").alias("band", "key")))
    load = lambda rows, total: F.greatest(F.col(rows) / GROUP_ROWS, F.col(total) / GROUP_SHINGLES)
    x = [F.bit_xor(F.xxhash64("id", F.lit(k))).alias(f"x{k}") for k in (1, 2)]
    buckets = m.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("total"), F.min(F.struct("band", "key")).alias("one"), F.min("id").alias("hub"), *x).where("rows > 1")
    # Buckets that hold the same members are one.
    buckets = buckets.groupBy("rows", "total", "hub", "x1", "x2").agg(F.min("one").alias("one")).select("one.*", "rows", "total", "hub")
    buckets = staged(buckets.withColumn("blocks", F.greatest(F.lit(1), F.ceil(load("rows", "total"))).cast("int")))
    block = F.when(F.col("id") == F.col("hub"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")))
    first = m.drop("band").join(buckets.where(F.col("band") < FIRST_BANDS), "key").select("id", F.col("id").alias("label"), "key", F.explode(block).alias("block"))
    found = staged(verified(docs, first.select("id", "label", F.xxhash64("key", "block").alias("part")), percent))
    done = components(found)
    known = m.drop("band").join(buckets.where((F.col("band") >= FIRST_BANDS) | (F.col("blocks") > 1)).select("key"), "key")
    known = staged(known.join(small(done, done.count()), "id", "left").select("id", "n", "key", F.coalesce("component", "id").alias("label")))
    per = known.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    heads = per.groupBy("key").agg(F.count(F.lit(1)).alias("labels"), F.max(F.struct("c", "s", "label")).alias("main"), F.sum("c").alias("rows"), F.sum("s").alias("total")).where("labels > 1")
    heads = heads.select("key", F.col("main.label").alias("main"), load("rows", "total").alias("whole"), F.col("main.c").alias("mc"), F.col("main.s").alias("ms"), (F.col("rows") - F.col("main.c")).alias("rc"), (F.col("total") - F.col("main.s")).alias("rs"))
    cut = lambda rows, total: F.when(F.col("whole") <= 1, 1).otherwise(F.ceil(2 * load(rows, total))).cast("int")
    heads = heads.select("key", "main", cut("mc", "ms").alias("mains"), cut("rc", "rs").alias("others"))
    rows = known.join(heads, "key").withColumns({"b": F.pmod(F.xxhash64("id"), F.col("mains")).cast("int"), "i": F.pmod(F.xxhash64("id"), F.col("others")).cast("int")})
    # A block of the main component meets each block of others, and those meet each other.
    of_main = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda i: F.col("b") * F.col("others") + i)
    of_other = F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda b: b * F.col("others") + F.col("i"))
    among = F.when(F.col("others") > 1, F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda j: F.col("mains") * F.col("others") + F.least("i", j) * F.col("others") + F.greatest("i", j))).otherwise(F.array().cast("array<int>"))
    dealt = F.when(F.col("label") == F.col("main"), of_main).otherwise(F.concat(of_other, among))
    rest = rows.select("id", "label", "key", F.explode(dealt).alias("block")).select("id", "label", F.xxhash64("key", "block", F.lit("rest")).alias("part"))
    return found.union(verified(docs, rest, percent))


def groups(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs; links need percent of the union in common.

    A null or empty text, or one of white space, has no shingles and is linked
    with nothing, not even with its like. Rows of one doc_id are one document:
    it links to what any of its texts links to, and all its rows share a
    verdict. A null doc_id is linked with nothing: its component is null and it
    is kept. An empty table gives no rows; other columns are not looked at.
    """
    docs = only(docs, "doc_id", "text")
    signed = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(_signed(bands(percent)), "doc_id long, n long, hi long, lo long, bands array<long>"))
    classes = signed.where("n > 0 AND doc_id IS NOT NULL").groupBy("hi", "lo", "n").agg(F.min("doc_id").alias("rep"))
    classes = staged(classes)
    tagged = staged(signed.join(small(classes, classes.count()), ["hi", "lo", "n"], "left").select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("rep")).alias("rep"), F.when(F.col("doc_id") == F.col("rep"), F.col("bands")).alias("bands")))
    keyed = tagged.where("bands IS NOT NULL").select("rep", F.explode("bands").alias("key"))
    buckets = staged(keyed.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("top")).where("hub < top").select("key", "hub"))
    ties = keyed.join(small(buckets, buckets.count()), "key").where("rep > hub").select(F.col("hub").alias("a"), F.col("rep").alias("b"))
    candidates = components(ties)
    reps = tagged.where("bands IS NOT NULL").select(F.col("rep").alias("id"), "n", "bands").dropDuplicates(["id"])
    sized = staged(candidates.join(reps, "id"))
    large = sized.groupBy("component").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("total")).where(f"rows > {GROUP_ROWS} OR total > {GROUP_SHINGLES}").select("component")
    large = staged(large)
    n_large = large.count()
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").cast("binary").alias("text"))
    whole = sized.join(small(large, n_large), "component", "left_anti")
    linked = verified(texts, whole.select("id", F.col("id").alias("label"), F.col("component").alias("part")), percent)
    if n_large:
        linked = linked.union(in_buckets(texts, sized.join(small(large, n_large), "component", "left_semi").select("id", "n", "bands"), percent))
    # A doc_id whose rows stand for several classes, or for one and an empty text, ties them together.
    stands = tagged.select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep"))
    several = staged(stands.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").select("doc_id"))
    if n_several := several.count():
        linked = linked.union(stands.where("rep <> doc_id").join(small(several, n_several), "doc_id").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct())
    found = components(linked)
    out = stands.select("doc_id", F.col("n").alias("n_shingles"), "rep").join(small(found.select(F.col("id").alias("rep"), "component"), found.count()), "rep", "left")
    component = F.coalesce("component", "rep")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def filtered(docs: DataFrame, percent: int = 80) -> DataFrame:
    """docs without the rows whose document isn't its group's smallest, at a similarity of 0.8 or more; docs' own columns."""
    gone = staged(groups(docs, percent).where("NOT kept").select(F.col("doc_id").alias("__gone")).distinct())
    d = numbered(docs)
    return d.join(small(gone, gone.count()), F.col(f"__c{docs.columns.index('doc_id')}").cast("long") == F.col("__gone"), "left_anti").toDF(*docs.columns)
