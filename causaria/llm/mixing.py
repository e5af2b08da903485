"""Mixing sources to target weights, as a time-varying curriculum.

Each source has a piecewise linear weight schedule over training time 0..1.
Its integral, scaled to the source's target, is the source's cumulative token
demand; the documents of a source are laid end to end in a keyed order, once
per epoch, and a copy's training position is the time at which demand reaches
its first word. Range-sorting copies by position gives the training order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, numbered, only, small, staged

#: Weights of sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: No source and no document is taken more than this many times its size.
MAX_EPOCHS = 3
#: For each weight class: (time, weight) knots of its schedule. Heavy sources fade out, light ones fade in.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 0.75), (1.0, 2.0)))
#: Documents that one slice of a source holds, about; slices are cut by the order's leading hex digits.
SLICE_ROWS = 5000
#: Documents alike (of one doc_id, source and size) that one task may handle together.
REPEATS = 10_000


def words(text: Column) -> Column:
    """Number of words of a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def segments(knots) -> list[tuple[float, float, float, float, float]]:
    """(t0, t1, w0, w1, integral before t0) of each piece, the whole integral scaled to 1."""
    if len(knots) < 2 or any(a[0] >= b[0] for a, b in zip(knots, knots[1:], strict=False)) or any(w < 0 for _, w in knots):
        raise ValueError(f"a schedule needs two or more rising times and no negative weight: {knots}")
    whole = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False))
    if whole <= 0:
        raise ValueError(f"a schedule must have a positive integral: {knots}")
    out, done = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        out.append((t0, t1, w0 / whole, w1 / whole, done))
        done += (t1 - t0) * (w0 + w1) / 2 / whole
    return out


def inverse(share: Column, knots) -> Column:
    """Training time at which a schedule's cumulative demand reaches the share (0..1)."""
    out = None
    for t0, t1, w0, w1, done in reversed(segments(knots)):
        slope, rest = (w1 - w0) / (t1 - t0), F.greatest(share - F.lit(done), F.lit(0.0))
        # rest = w0 x + slope x^2 / 2, in the form that stays exact for small slopes
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * rest, F.lit(0.0)))
        at = F.least(F.lit(t1), F.lit(t0) + F.coalesce(F.try_divide(2 * rest, F.lit(w0) + root), F.lit(0.0)))
        out = at if out is None else F.when(share >= F.lit(done_next), out).otherwise(at)
        done_next = done
    return out


def targets(stats: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> also rank, weight and target.

    Water filling without a loop: sources are capped in rising order of
    cap over weight, as long as the share of what is left would exceed the cap.
    One row per source; the windows below see that table alone.
    """
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    out = stats.withColumn("rank", F.row_number().over(rank) - 1)
    out = out.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long"))
    out = out.withColumn("cap", F.col("source_size") * max_epochs)
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.partitionBy()
    out = out.withColumn("left", F.sum("source_size").over(everyone) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    out = out.withColumn("left_weight", F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    # Capped sources come first in this order; the first that isn't sets the level for all after it.
    out = out.withColumn("capped", F.col("cap") / F.col("weight") < F.col("left") / F.col("left_weight")).withColumn("n", F.row_number().over(order))
    out = out.withColumn("first", F.min(F.when(~F.col("capped"), F.struct("n", "left", "left_weight"))).over(everyone))
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("first.left") / F.col("first.left_weight"))
    return out.select("source", "source_size", "rank", "weight", target.cast("double").alias("target"))


def laid(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per (doc_id, source, size): n documents alike, the offset of the first in its source's order, and the source's figures.

    Documents that agree in all three are interchangeable for the mix: they are
    counted first, so that however often one is repeated, it is one row here.
    A hot source is cut into slices by the leading hex digits of the order key;
    slices are summed first, so that no task holds a whole source.
    """
    narrow = only(docs, "doc_id", "source", "text").select("doc_id", "source", words(F.col("text")).alias("size"))
    narrow = staged(narrow.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n")))
    narrow = narrow.withColumn("key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    n_rows = narrow.count()
    digits = 2
    while 16**digits * SLICE_ROWS < n_rows and digits < 8:
        digits += 1
    narrow = narrow.withColumns({"slice": F.substring("key", 1, digits), "whole": F.col("size") * F.col("n")})
    slices = staged(narrow.groupBy("source", "slice").agg(F.sum("whole").alias("slice_size")))
    sources = targets(slices.groupBy("source").agg(F.sum("slice_size").alias("source_size")), weights, max_epochs)
    ahead = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("ahead", F.coalesce(F.sum("slice_size").over(ahead), F.lit(0))).join(small(sources, slices.select("source").distinct().count()).withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s", "slice_size")
    # Two joins on the same keys as the window below: one exchange of the narrow rows serves both.
    within = Window.partitionBy("source", "slice").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    out = narrow.withColumn("inside", F.coalesce(F.sum("whole").over(within), F.lit(0)))
    slices = slices.withColumnRenamed("slice", "sl").withColumnRenamed("source", "so")
    out = out.join(slices, (F.col("slice") == F.col("sl")) & F.col("source").eqNullSafe(F.col("so")))
    return out.select("doc_id", "source", "size", "n", "source_size", "target", "rank", (F.col("ahead") + F.col("inside")).alias("first"))


def each(groups: DataFrame) -> DataFrame:
    """Rows of laid() as one row per document: place (0 .. n - 1) among those alike, and its own start.

    A row that stands for many becomes blocks of REPEATS first, which are dealt
    to all tasks, so that none makes all of them.
    """
    blocks = groups.where(F.col("n") > REPEATS).withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / REPEATS))))
    blocks = blocks.repartition(F.col("first") + F.col("block")).withColumn("places", F.sequence(F.col("block") * REPEATS, F.least(F.col("n"), (F.col("block") + 1) * REPEATS) - 1)).drop("block")
    few = groups.where(F.col("n") <= REPEATS).withColumn("places", F.sequence(F.lit(0).cast("long"), F.col("n") - 1))
    out = few.unionByName(blocks).withColumn("place", F.explode("places")).drop("places")
    return out.withColumn("start", F.col("first") + F.col("place") * F.col("size"))


def plan(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, schedules=SCHEDULES) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, start, copies, first_position.

    start is the document's offset in its source's order, in words. Copy e
    (0 .. max_epochs - 1) begins at word e * source_size + start of the
    source's demand; taken sums, over copies, the words below the target, so
    that a source's taken words equal its target rounded down. copies counts
    the copies of which at least one word is taken.

    Null and empty texts have size 0 and are never taken; a null source is a
    source of its own, ranked last; repeated rows are documents of their own,
    numbered by place; an empty table gives no rows. Other columns of docs are
    not looked at.
    """
    rows = each(laid(docs, weights, max_epochs))
    demand = F.floor("target")
    from_word = lambda e: F.lit(e) * F.col("source_size") + F.col("start")
    copy = [F.greatest(F.lit(0), F.least("size", demand - from_word(e))).cast("long") for e in range(max_epochs)]
    taken, copies = copy[0], F.when(copy[0] > 0, 1).otherwise(0)
    for c in copy[1:]:
        taken, copies = taken + c, copies + F.when(c > 0, 1).otherwise(0)
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "start", copies.cast("int").alias("copies"), F.when(copy[0] > 0, position(F.col("start"), schedules)).alias("first_position"), "rank", "place", "n")


def position(word: Column, schedules=SCHEDULES) -> Column:
    """Training time at which the demand of the row's source (rank, target) reaches the word."""
    share, out = F.coalesce(F.try_divide(word.cast("double"), F.col("target")), F.lit(0.0)), None
    for k, knots in enumerate(schedules):
        at = inverse(share, knots)
        out = F.when(F.col("rank") % len(schedules) == k, at) if out is None else out.when(F.col("rank") % len(schedules) == k, at)
    return out


def ordered(rows: DataFrame, schedules=SCHEDULES) -> DataFrame:
    """Rows of plan() in training order: a row for each copy (copy, from 0, and position), range-sorted by position; a document without copies is one row of neither, at the end."""
    out = rows.withColumn("copy", F.explode_outer(F.when(F.col("copies") > 0, F.expr("sequence(0, copies - 1)"))))
    at = F.when(F.col("copy").isNotNull(), position(F.col("source_size") * F.col("copy") + F.col("start"), schedules))
    return out.withColumn("position", at).sort(F.col("position").asc_nulls_last(), "doc_id", "source", "start")


def placed(rows: DataFrame, key: str) -> DataFrame:
    """rows with __place, their number (from 0) among those of one key, however many: rows are written with an id first, and counted within the parts of the table and over parts."""
    rows = staged(rows.withColumn("__row", F.monotonically_increasing_id()))
    ids = rows.select(key, "__row", F.shiftright("__row", 33).alias("__part"))
    counts = staged(ids.groupBy(key, "__part").agg(F.count(F.lit(1)).alias("n")))
    ahead = counts.select(key, "__part", F.coalesce(F.sum("n").over(Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    inside = ids.withColumn("inside", F.row_number().over(Window.partitionBy(key, "__part").orderBy("__row")) - 1)
    at = inside.join(ahead, [key, "__part"]).select(F.col("__row").alias("__r"), (F.col("ahead") + F.col("inside")).alias("__place"))
    return rows.join(at, F.col("__row") == F.col("__r")).drop("__row", "__r")


def mix(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, schedules=SCHEDULES) -> DataFrame:
    """The training order: docs' own rows, each as often as copies are taken, range-sorted by position.

    A copy that the target cuts is returned whole: rows aren't cut. Columns are
    those of docs, in order. Rows that agree in (doc_id, size, source) are
    interchangeable for the mix: they are numbered, and take the plans of the
    documents of those places. Up to REPEATS of them meet in one task; beyond
    that they are numbered in parts, and meet their plans one by one.
    """
    names = docs.columns
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\\"))
    match = F.concat_ws("\x1f", part("doc_id"), part("size"), part("source"))
    p = staged(plan(docs, weights, max_epochs, schedules).where("copies > 0").select(match.alias("__k"), "n", "place", "start", "copies", "source_size", "target", "rank"))
    hot = staged(p.where(F.col("n") > REPEATS).select("__k").distinct())
    at = {n: F.col(f"__c{names.index(n)}") for n in ("doc_id", "source", "text")}
    rows = numbered(docs).withColumns({"doc_id": at["doc_id"], "source": at["source"], "size": words(at["text"])})
    rows = rows.withColumn("__k", match).drop("doc_id", "source", "size")
    own = [f"__c{i}" for i in range(len(names))]
    figures = ["start", "copies", "source_size", "target", "rank"]
    few = p.where(F.col("n") <= REPEATS).groupBy("__k").agg(F.array_sort(F.collect_list(F.struct(*figures))).alias("__plans"))
    # The window's key is the join's: no further exchange.
    out = rows.join(few, "__k").withColumn("__n", F.row_number().over(Window.partitionBy("__k").orderBy("__k"))).where("__n <= size(__plans)")
    out = out.withColumn("__p", F.expr("__plans[__n - 1]")).select(*own, "__p.*")
    if n_hot := hot.count():
        many = placed(rows.join(small(hot, n_hot), "__k", "left_semi"), "__k")
        plans = p.where(F.col("n") > REPEATS).withColumnRenamed("place", "__place")
        out = out.unionByName(many.join(plans, ["__k", "__place"]).select(*own, *figures))
    out = out.withColumn("__e", F.explode(F.expr("sequence(0, copies - 1)"))).withColumn("__w", F.col("source_size") * F.col("__e") + F.col("start"))
    return out.sort(position(F.col("__w"), schedules), f"__c{names.index('doc_id')}").select(*own).toDF(*names)
