"""Cancellations: which sale each one reverses, its mirrored lines, and the gate on both.

Matching has three phases: an explicit valid link; else the k-th unclaimed
cancellation of a customer and line count takes the k-th unclaimed sale of
theirs, by date; else any unclaimed sale, the rest of one list against the rest
of the other, again by rank. Ranks within a customer are windows; leftovers
are ranked by buckets of the date, so that no task holds them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .compose import ordinal
from .gates import gate


def match(cancellations: DataFrame, sales: DataFrame, leftovers: bool = True) -> DataFrame:
    """(cancel_id, sale_id, phase). Both sides: id, customer, day, lines; cancellations also link (null: none).

    A sale is taken once; of several cancellations linked to one sale the first
    by (day, id) keeps it. Cancellations that find no sale are left out.
    """
    ids = sales.select(F.col("id").alias("sale_id"))
    first = Window.partitionBy("link").orderBy("day", "id")
    linked = cancellations.where("link IS NOT NULL").join(ids, F.col("link") == F.col("sale_id"), "left_semi").withColumn("r", F.row_number().over(first)).where("r = 1").select(F.col("id").alias("cancel_id"), F.col("link").alias("sale_id"), F.lit(1).alias("phase"))
    free_c = cancellations.join(linked.select(F.col("cancel_id").alias("id")), "id", "left_anti")
    free_s = sales.join(linked.select(F.col("sale_id").alias("id")), "id", "left_anti")
    rank = F.row_number().over(Window.partitionBy("customer", "lines").orderBy("day", "id"))
    c = free_c.select(F.col("id").alias("cancel_id"), "customer", "lines", rank.alias("r"))
    s = free_s.select(F.col("id").alias("sale_id"), "customer", "lines", rank.alias("r"))
    same = c.join(s, ["customer", "lines", "r"]).select("cancel_id", "sale_id", F.lit(2).alias("phase"))
    found = linked.unionByName(same)
    if not leftovers:
        return found
    rest_c = ordinal(free_c.join(same.select(F.col("cancel_id").alias("id")), "id", "left_anti").withColumn("__d", F.unix_date(F.to_date("day"))).select("__d", "id"), ["__d", "id"], "r").select(F.col("id").alias("cancel_id"), "r")
    rest_s = ordinal(free_s.join(same.select(F.col("sale_id").alias("id")), "id", "left_anti").withColumn("__d", F.unix_date(F.to_date("day"))).select("__d", "id"), ["__d", "id"], "r").select(F.col("id").alias("sale_id"), "r")
    return found.unionByName(rest_c.join(rest_s, "r").select("cancel_id", "sale_id", F.lit(3).alias("phase")))


def mirror(matched: DataFrame, lines: DataFrame, order: str, number: str, amounts: list[str]) -> DataFrame:
    """A line of each cancellation for each of its sale's: cancel_id, sale_id, the line's number, and amounts as negative values."""
    return matched.select("cancel_id", "sale_id").join(lines, F.col("sale_id") == lines[order]).select("cancel_id", "sale_id", F.col(number), *[(-F.abs(lines[a])).alias(a) for a in amounts])


def totals(mirrored: DataFrame, amounts: list[str]) -> DataFrame:
    return mirrored.groupBy("cancel_id", "sale_id").agg(F.count(F.lit(1)).alias("lines"), *[F.sum(a).alias(a) for a in amounts])


def coherence(name: str, cancellations: DataFrame, sales: DataFrame, cancel_lines: DataFrame, sale_lines: DataFrame, cents: float = 0.005) -> DataFrame:
    """Each cancellation links a sale of the same customer, not later; each of its lines links a sale's line and negates its quantity and sign. None at all fails.

    cancellations: id, link, customer, day; sales: id, customer, day;
    cancel_lines: order, line, quantity, amount; sale_lines the same.
    """
    s = sales.select(F.col("id").alias("sid"), F.col("customer").alias("sc"), F.col("day").alias("sd"))
    heads = cancellations.join(s, F.col("link") == F.col("sid"), "left")
    bad_head = F.col("sid").isNull() | ~F.col("customer").eqNullSafe(F.col("sc")) | (F.col("day") < F.col("sd"))
    h = heads.select(F.lit(1).alias("n"), F.coalesce(bad_head, F.lit(True)).alias("bad"))
    l2 = sale_lines.select(F.col("order").alias("so"), F.col("line").alias("sl"), F.col("quantity").alias("sq"), F.col("amount").alias("sa"))
    lined = cancel_lines.join(cancellations.select(F.col("id").alias("order"), "link"), "order").join(l2, (F.col("link") == F.col("so")) & (F.col("line") == F.col("sl")), "left")
    bad_line: Column = F.col("so").isNull() | (F.abs(F.col("quantity") + F.col("sq")) > cents) | (F.col("amount") * F.col("sa") > 0)
    ln = lined.select(F.lit(0).alias("n"), F.coalesce(bad_line, F.lit(True)).alias("bad"))
    both, bad = h.union(ln).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if("bad").alias("bad")), F.col("bad")
    return both.select(*gate(name, "reversal", (F.col("n") > 0) & (bad == 0), F.col("n"), "0 incoherent, at least 1", bad))
