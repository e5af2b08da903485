"""Embedding near-duplicates by an exact metric range join.

Unit vectors with cosine >= c are those within r = sqrt(2 - 2c) of each other.
Pivots cut the sphere into cells, each vector at home with its nearest pivot.
If y is within r of x and x's home is cell i, then by the triangle inequality
d(y, p_i) <= d(x, p_i) + r <= d(x, p_j) + r <= d(y, p_j) + 2r for y's own home
j: so y is copied to every cell i for which that holds, and, tighter, whose
bisecting plane with its home is within r of y. Each home vector then finds all
its partners in its own cell, and cells join independently.

Equal vectors are one node with a multiplicity. Nothing is copied, though: a
cell's vectors are packed into blocks, each written once with the cells that
any of its vectors would be copied to, and a join takes pairs of blocks of one
cell, or of two that each hold a vector for the other's. Of two cells' blocks
only such vectors are compared. Every task of the join reads two parts of the
table of blocks and streams their pairs, so disk grows with the vectors alone,
and memory is bounded by a part. Links are counted, not listed: a task emits a
count for each vector that has any, and links enough to connect what it saw.

How many pivots pay is estimated on the sample. Vectors spread evenly over a
sphere of many dimensions lie near every bisecting plane: there each further
pivot moves more than it saves, and few or one is the estimate's choice.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import components, dropped, first_by_hash, mark, only, small, staged

COSINE = 0.95
#: Vectors that pivots are chosen on, by hash of the id, and pivots at most. Both only steer cost.
SAMPLE_ROWS, MAX_PIVOTS = 4096, 1024
#: Comparisons of one pair of blocks, about, and blocks of one file of them.
TASK_PAIRS, FILE_BLOCKS = 4096**2, 2
#: What the estimate of cost takes a comparison of 64 components and a row that moves to a task to cost, in seconds.
PAIR_COST, ROW_COST = 6e-9, 2e-6
#: Added to the radius, so that rounding loses no link.
SLACK = 1e-9


def unit(rows: list, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors in double precision, which are valid); null, zero, or with null or non-finite components: not valid."""
    out, ok = np.zeros((len(rows), dims)), np.zeros(len(rows), bool)
    for i, r in enumerate(rows):
        if r and None not in r:
            out[i, : len(r)] = r
            ok[i] = True
    with np.errstate(over="ignore", invalid="ignore"):
        top = np.abs(out).max(axis=1, initial=0)
        ok &= np.isfinite(top) & (top > 0)
        out[~ok] = 0
        out[ok] /= top[ok][:, None]  # keeps squares of very large and very small components in range
        out[ok] /= np.sqrt((out[ok] ** 2).sum(axis=1))[:, None]
    return out, ok


def _valid(dims: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(unit(batch.column(1).to_pylist(), dims)[1])], ["vec_id", "hi", "lo", "ok"])

    return run


def choose_pivots(sample: np.ndarray, n: int, radius: float) -> np.ndarray:
    """Cluster centres of one half of the sample, as many as make the cost least that the other half leads to expect: a half's own centres lie nearer to it."""
    if len(sample) < 2:
        return sample[:1]
    fit, sample = sample[::2], sample[1::2]
    rng, best = np.random.default_rng(7), None
    for k in (1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024):
        if k > min(MAX_PIVOTS, max(1, len(fit) // 2)):
            break
        p = fit[rng.choice(len(fit), k, replace=False)].copy()
        for _ in range(8):
            home = (fit @ p.T).argmax(1)
            for c in range(k):
                centre = fit[home == c].sum(0)
                if (size := np.linalg.norm(centre)) > 0:
                    p[c] = centre / size
        home, copies = cells(sample, p, radius)
        own = np.bincount(home, minlength=k) * (n / len(sample))
        # How many of each cell's vectors the others' may meet.
        reach = (home == np.arange(k)[:, None]).astype(np.float32) @ copies.astype(np.float32) * (n / len(sample))
        blocks, meet = np.array([n_blocks(x) for x in own]), (reach > 0) & (reach.T > 0) | np.eye(k, dtype=bool)
        cost = ((own**2).sum() + (reach * reach.T).sum()) / 2 * PAIR_COST + (meet * np.outer(own, blocks)).sum() * ROW_COST + 2 * n * k * PAIR_COST
        if best is None or cost < 0.95 * best[0]:
            best = (cost, p)
    return best[1]


def n_blocks(own: float) -> int:
    """Blocks of a cell of so many vectors."""
    return max(1, int(np.ceil(own / np.sqrt(TASK_PAIRS))))


def cells(x: np.ndarray, pivots: np.ndarray, radius: float, at: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(home cell of each unit vector, whether it is copied to each other cell). at: where all of them have been found to be at home, as rounding may tell a tie otherwise."""
    d2 = np.maximum((x**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * x @ pivots.T, 0)
    home = d2.argmin(1) if at is None else np.full(len(x), at)
    own = d2[np.arange(len(x)), home][:, None]
    apart = np.sqrt(np.maximum((pivots**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * pivots @ pivots.T, 0))[home]
    reach = radius + SLACK
    copied = (np.sqrt(d2) - np.sqrt(own) <= 2 * reach) & (d2 - own <= 2 * apart * reach + SLACK)
    copied[np.arange(len(x)), home] = False
    return home, copied


def _homes(pivots: np.ndarray, radius: float):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x, _ = unit(batch.column(0).to_pylist(), pivots.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(cells(x, pivots, radius)[0].astype(np.int32))], ["home"])

    return run


def _dealt(pivots: np.ndarray, radius: float, blocks: dict[int, int]):
    """Every vector to a block of its home cell: (id, mult, embedding) -> also block, in front."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x, _ = unit(batch.column(2).to_pylist(), pivots.shape[1])
            home = cells(x, pivots, radius)[0]
            n = np.array([blocks.get(c, 1) for c in home.tolist()], np.uint64)
            dealt = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)
            yield pa.RecordBatch.from_arrays([pa.array((home << 32) + (dealt % n).astype(np.int64)), *batch.columns], ["block", *batch.schema.names])

    return run


def _packed(pivots: np.ndarray, radius: float):
    """Rows sorted by block -> one row a block: its cell, the other cells that it may hold a vector for, and its vectors."""

    def run(batches):
        import pyarrow as pa

        def row(block, held):
            ids, mult, x = (np.concatenate(c) for c in zip(*held, strict=True))
            near = np.flatnonzero(cells(x, pivots, radius, block >> 32)[1].any(0)).tolist()
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([block >> 32], pa.int32()), pa.array([near], pa.list_(pa.int32())), *[pa.array([c.tobytes()], pa.binary()) for c in (ids, mult, x)]], ["block", "cell", "near", "ids", "mult", "units"])

        block, held = None, []
        for batch in batches:
            of, ids, mult = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            x, _ = unit(batch.column(3).to_pylist(), pivots.shape[1])
            cuts = np.flatnonzero(of[1:] != of[:-1]) + 1
            for at, to in zip([0, *cuts], [*cuts, len(of)], strict=True):
                if at == to:
                    continue
                if of[at] != block:
                    if held:
                        yield row(block, held)
                    block, held = int(of[at]), []
                held.append((ids[at:to].copy(), mult[at:to].copy(), x[at:to]))
        if held:
            yield row(block, held)

    return run


class _Block:
    """A block's vectors, and how many links each has found."""

    def __init__(self, cell: int, ids, mult, units, dims: int):
        self.cell, self.ids, self.mult, self.x = cell, ids, mult, units.reshape(-1, dims)
        self.x32, self.counts = self.x.astype(np.float32), np.zeros(len(ids), np.int64)


def _meet(a: _Block, b: _Block, rows, cols, least: float):
    """Counts the links between these rows of a and columns of b; returns links enough to connect what they connect.

    Single precision finds who may be near, double precision decides.
    """
    out, label = [], np.arange(len(rows))
    x32 = a.x32[rows]
    for s in range(0, len(cols) if len(rows) else 0, 512):
        some = cols[s : s + 512]
        near = x32 @ b.x32[some].T >= np.float32(least - 1e-4)
        at = np.flatnonzero(near.any(0))
        if not len(at):
            continue
        mine = np.flatnonzero(near[:, at].any(1))
        hit = (a.x[rows[mine]] @ b.x[some[at]].T >= least) & near[np.ix_(mine, at)]
        hit &= a.ids[rows[mine]][:, None] != b.ids[some[at]]
        a.counts[rows[mine]] += (hit * b.mult[some[at]]).sum(1)
        if a is not b:
            b.counts[some[at]] += (hit * a.mult[rows[mine]][:, None]).sum(0)
        for j in np.flatnonzero(hit.any(0)):
            linked = mine[hit[:, j]]
            labels, first = np.unique(label[linked], return_index=True)
            out += [(i, int(b.ids[some[at[j]]])) for i in a.ids[rows[linked[first]]].tolist()]
            if len(labels) > 1:  # vectors that were apart meet through this one
                label[np.isin(label, labels)] = labels[0]
    return out


def _joined(least: float, pivots: np.ndarray, radius: float):
    """Pairs of blocks -> (a, b, n): counts have b null, links n null. A task holds the vectors of one block and, of all it reads, ids and counts."""
    dims = pivots.shape[1]

    def run(batches):
        import pyarrow as pa

        def table(a, b, n):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (a, b, n)], ["a", "b", "n"])

        def read(batch, at, k, known):
            name = batch.column(at)[k].as_py()
            if known is not None and known[0] == name:
                return known
            cell, ids, mult, units = (batch.column(at + c)[k] for c in (1, 2, 3, 4))
            block = _Block(cell.as_py(), *[np.frombuffer(c.as_buffer(), t).copy() for c, t in ((ids, np.int64), (mult, np.int64), (units, np.float64))], dims)
            block.counts = counts.setdefault(name, (block.ids, block.counts))[1]
            return name, block

        def root(i):
            while (up := parent.setdefault(i, i)) != i:
                parent[i] = i = parent[up]
            return i

        counts, parent, held = {}, {}, None
        for batch in batches:
            for k in range(batch.num_rows):
                held = read(batch, 0, k, held)
                a, b = held[1], read(batch, 5, k, held)[1]
                rows, cols = np.arange(len(a.ids)), np.arange(len(b.ids))
                if a.cell != b.cell:
                    rows, cols = (np.flatnonzero(cells(u.x, pivots[[u.cell, v.cell]], radius, 0)[1].any(1)) for u, v in ((a, b), (b, a)))
                links = []
                for i, j in _meet(a, b, rows, cols, least):
                    u, v = root(i), root(j)
                    if u != v:
                        parent[max(u, v)] = min(u, v)
                        links.append((i, j))
                if links:
                    yield table(*zip(*links, strict=True), [None] * len(links))
        for ids, n in counts.values():
            some = np.flatnonzero(n)
            if len(some):
                yield table(ids[some], [None] * len(some), n[some])

    return run


def _pairs(blocks: DataFrame) -> DataFrame:
    """Every pair of blocks that may hold a link, once, and every block with itself: a join that reads the table of blocks and shuffles nothing.

    Which of two comes first is by their sum's parity, so that all tasks have as many pairs.
    """
    one, other = (blocks.select(*[F.col(c).alias(f"{side}_{c}") for c in ("block", "cell", "ids", "mult", "units", "near")]) for side in "ab")
    order = F.expr("a_block = b_block OR ((a_block + a_cell + b_block + b_cell) % 2 = 0) = (a_block < b_block)")
    near = F.expr("a_cell = b_cell OR array_contains(a_near, b_cell) AND array_contains(b_near, a_cell)")
    return one.hint("shuffle_replicate_nl").join(other, order & near).drop("a_near", "b_near")


def links(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding).

    Vectors that aren't valid (see unit) have no links, and so make a component
    of their own; shorter vectors count as padded with zeros. Rows of one
    vec_id and one vector count each other as equal copies; rows of one vec_id
    and different vectors are one node of the components. A row with a null
    vec_id has no links, a null component and is kept. An empty table gives no
    rows; other columns are not looked at.
    """
    if not 0 < cosine <= 1:
        raise ValueError(f"cosine must be in (0, 1]: {cosine}")
    radius = float(np.sqrt(max(2 - 2 * cosine, 0)))
    spark, raw = vectors.sparkSession, only(vectors, "vec_id", "embedding")
    # Rows move as they came: floats take half of what doubles do.
    kept = "array<float>" if raw.schema["embedding"].dataType == ArrayType(FloatType()) else "array<double>"
    raw = raw.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kept).alias("embedding"))
    dims = max(1, raw.agg(F.max(F.size("embedding"))).first()[0] or 0)
    wide = F.col("embedding").cast("array<double>")
    raw = raw.select("vec_id", "embedding", F.xxhash64(wide, F.lit(1)).alias("hi"), F.xxhash64(wide, F.lit("b")).alias("lo"))
    base = staged(raw.mapInArrow(_valid(dims), "vec_id long, hi long, lo long, ok boolean"))
    valid = base.where("ok AND vec_id IS NOT NULL")
    classes = staged(valid.groupBy("hi", "lo").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("mult")))
    n = classes.count()
    one = raw.join(small(classes, n), ["hi", "lo"]).where("vec_id = rep").select(F.col("rep").alias("id"), "mult", "embedding", "hi", "lo")
    if valid.join(small(classes, n), ["hi", "lo"]).where("vec_id = rep").count() > n:  # rows that are alike
        one = one.dropDuplicates(["id", "hi", "lo"])
    some = first_by_hash(classes.select(F.col("rep").alias("id"), "hi", "lo"), "id", SAMPLE_ROWS, n)
    sample, _ = unit([r[0] for r in one.join(F.broadcast(some), ["id", "hi", "lo"]).orderBy(F.xxhash64("id"), "id", "hi", "lo").select("embedding").collect()], dims)
    pivots = choose_pivots(sample, n, radius) if len(sample) else np.zeros((1, dims))
    own = {0: n} if len(pivots) == 1 else {r["home"]: r["count"] for r in one.select("embedding").mapInArrow(_homes(pivots, radius), "home int").groupBy("home").count().collect()}  # a row a pivot
    blocks = {c: n_blocks(k) for c, k in own.items()}
    dealt = one.select("id", "mult", "embedding").mapInArrow(_dealt(pivots, radius, blocks), f"block long, id long, mult long, embedding {kept}")
    packed = dealt.repartition(max(1, -(-sum(blocks.values()) // FILE_BLOCKS)), "block").sortWithinPartitions("block", "id")
    since = mark()
    packed = staged(packed.mapInArrow(_packed(pivots, radius), "block long, cell int, near array<int>, ids binary, mult binary, units binary"))
    name, few = "spark.sql.execution.arrow.maxRecordsPerBatch", "2"  # pairs of blocks are some MB each
    before = spark.conf.get(name)
    spark.conf.set(name, few)
    try:
        found = staged(_pairs(packed).mapInArrow(_joined(cosine, pivots, radius), "a long, b long, n long"))
    finally:
        spark.conf.set(name, before)
    dropped(spark, since, since + 1)
    counts = found.where("n IS NOT NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    linked = found.where("b IS NOT NULL").select("a", "b")
    # A vec_id whose rows stand for several classes ties them together.
    stands = valid.join(small(classes, n), ["hi", "lo"]).select("vec_id", "rep")
    several = staged(stands.groupBy("vec_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").select("vec_id"))
    if n_several := several.count():
        linked = linked.union(stands.where("rep <> vec_id").join(small(several, n_several), "vec_id").select(F.col("rep").alias("a"), F.col("vec_id").alias("b")).distinct())
    edges = components(linked)
    nodes = staged(counts.join(edges.select(F.col("id").alias("rep"), "component"), "rep", "full"))
    of = classes.join(small(nodes, n), "rep", "left").select("hi", "lo", (F.col("mult") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    out = base.join(small(of, n), ["hi", "lo"], "left")
    linked = F.col("ok") & F.col("vec_id").isNotNull()
    component = F.when(linked, F.col("component")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.when(linked, F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
