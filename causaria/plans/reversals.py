"""Cancellations of a dataset made whole: each linked to a sale that nothing else reverses, its lines the sale's with their signs turned.

An entity whose rows can reverse others has a field ReversesOrderHeaderID, and
one of their lines ReversesOrderLineID. A row is a cancellation if its
OrderType says so (Cancellation, Return) or it has a link; a sale if it is
neither and, where the entity has such fields, its OrderType is Sale and its
Status Confirmed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import cycle_field, day
from ..functions.keys import filled, norm, uuid5
from ..model import Domain, Entity
from ..operators import reversal
from ..streaming.simulate import saved

HEAD_LINK, LINE_LINK = "ReversesOrderHeaderID", "ReversesOrderLineID"

#: A line's and a header's amounts, whose signs a cancellation turns.
LINE_AMOUNTS = ("Quantity", "ExtendedPrice", "NetAmount", "GrossAmount", "Amount", "LineTotal")
HEAD_AMOUNTS = ("TotalAmount",)

#: Days behind the sale at which a cancellation that is dated before it is put.
LATER = 7


def parts(domain: Domain, data: dict[str, DataFrame]) -> tuple[Entity, Entity] | None:
    """The entities of headers and of lines, if there are any rows of both."""
    has = lambda field: next((e for e in domain.entities.values() if e.name in data and field in data[e.name].columns and field in [f.name for f in e.fields]), None)
    head, line = has(HEAD_LINK), has(LINE_LINK)
    return (head, line) if head and line else None


def cohered(domain: Domain, data: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """data with its cancellations matched to sales (see reversal.match), and each that found one made its mirror: customer and other keys, date not before the sale's, lines, amounts. A cancellation that finds none keeps its fields but for a link that leads nowhere."""
    found = parts(domain, data)
    if found is None:
        return data
    head, line = found
    h, ln = data[head.name], data[line.name]
    key, line_key = head.primary[0], line.primary[0]
    to = next(k.field for k in line.foreign_keys if k.entity == head.name and k.field != HEAD_LINK)
    shared = [k.field for k in head.foreign_keys if k.field != HEAD_LINK]  # what a cancellation shares with its sale
    on = cycle_field(h.schema, head.cycle_field)
    kind = F.col("OrderType") if "OrderType" in h.columns else F.lit(None).cast("string")
    cancels = F.coalesce(kind.isin("Cancellation", "Return"), F.lit(False)) | filled(F.col(HEAD_LINK).cast("string")).isNotNull()
    sells = ~cancels
    sells = sells & F.coalesce(kind == "Sale", F.lit(False)) if "OrderType" in h.columns else sells
    sells = sells & F.coalesce(F.col("Status") == "Confirmed", F.lit(False)) if "Status" in h.columns else sells
    sizes = ln.groupBy(norm(to).alias("id")).agg(F.count(F.lit(1)).alias("lines"))
    customer = norm(shared[0]) if shared else F.lit("")
    rows = h.select(norm(key).alias("id"), customer.alias("customer"), day(F.col(on)).alias("day"), norm(HEAD_LINK).alias("link"), cancels.alias("__c"), sells.alias("__s")).join(sizes, "id", "left").fillna(0, ["lines"])
    rows = saved(rows)
    matched = saved(reversal.match(rows.where("__c").drop("__c", "__s"), rows.where("__s").drop("__c", "__s", "link")))
    sale = h.select(norm(key).alias("__sale"), F.col(key).alias("__link"), F.col(on).alias("__on"), *[F.col(f).alias(f"__of_{f}") for f in (*shared, *[a for a in HEAD_AMOUNTS if a in h.columns])])
    pairs = matched.select(F.col("cancel_id").alias("__cancel"), F.col("sale_id").alias("__sale")).join(sale, "__sale")
    hit = F.col("__cancel").isNotNull()
    out = h.withColumn("__c", cancels).join(pairs, norm(key) == F.col("__cancel"), "left")
    late = F.when(day(F.col(on)) >= day(F.col("__on")), F.col(on)).otherwise(F.date_add(day(F.col("__on")), LATER).cast(h.schema[on].dataType))
    changes = {HEAD_LINK: F.when(hit, F.col("__link")).when(F.col("__c"), F.lit(None)).otherwise(F.col(HEAD_LINK)), on: F.when(hit, late).otherwise(F.col(on))}
    changes |= {f: F.when(hit, F.col(f"__of_{f}")).otherwise(F.col(f)) for f in shared}
    changes |= {a: F.when(hit, -F.abs(F.col(f"__of_{a}"))).otherwise(F.col(a)) for a in HEAD_AMOUNTS if a in h.columns}
    changes |= {f: F.when(hit, F.lit(v)).otherwise(F.col(f)) for f, v in (("OrderType", "Cancellation"), ("Status", "Confirmed")) if f in h.columns}
    heads = out.withColumns(changes).select(*h.columns)
    raw = h.select(norm(key).alias("__cancel"), F.col(key).alias("__own"))
    of = matched.select(F.col("cancel_id").alias("__cancel"), F.col("sale_id").alias("__sale")).join(raw, "__cancel")
    mirrored = ln.join(of, norm(to) == F.col("__sale"))
    turned = {a: -F.abs(F.col(a)) for a in LINE_AMOUNTS if a in ln.columns}
    own_key = uuid5(domain.namespace, F.concat_ws(":", F.lit("reversal"), F.col("__own").cast("string"), F.col(line_key).cast("string")))
    columns = {**turned, to: F.col("__own"), LINE_LINK: F.col(line_key), line_key: own_key}
    mirrored = mirrored.select(*[columns.get(c, F.col(c)).cast(ln.schema[c].dataType).alias(c) for c in ln.columns])
    rest = ln.join(of.select("__cancel"), norm(to) == F.col("__cancel"), "left_anti")
    return {**data, head.name: heads, line.name: rest.unionByName(mirrored)}
