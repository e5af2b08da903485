"""More operators over the driver's tables, each with its SQL: keys, dates, generators, heroes, ladders, outcomes, reports, files."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import dates, keys, rng, scalars
from .model import Arrow, Composition, Domain, Entity, Factor, Field, ForeignKey, Hero, Ladder, Motif, State
from .operators import calibrate, features, gates, generate, heroes, rules
from .queries import FKS, GATE, NAMESPACE, SEED, Tables, query, sql_fnv, sql_keyed, sql_uniform
from .sources import appending, host, records
from .streaming import accumulate, ladders, simulate

#: The query's own literals.
START, END = datetime.date(1996, 3, 1), datetime.date(1996, 9, 1)


@query("SELECT o_orderkey FROM orders WHERE o_orderdate::DATE > DATE '1996-03-01' AND o_orderdate::DATE <= DATE '1996-09-01'")
def cycle_window(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("d"), F.lit(START).alias("s"), F.lit(END).alias("e"))
    return o.where(dates.in_cycle("d", "s", "e")).select("o_orderkey")


@query(f"SELECT o_orderkey, o_orderdate::DATE + (floor({sql_keyed('o_orderkey::VARCHAR', 'day:')} * 30) + 1)::INT AS day FROM orders")
def date_in_window(t: Tables) -> DataFrame:
    d = F.to_date("o_orderdate")
    return t.orders.select("o_orderkey", dates.in_window(rng.keyed(SEED, F.col("o_orderkey").cast("string"), 1, "day:"), d, F.date_add(d, 30)).alias("day"))


_REL = f"xor({SEED}, {sql_fnv('c_custkey::VARCHAR', 'born:')})"


@query(f"SELECT c_custkey, least(make_date(2024 - 30, (floor({sql_uniform(_REL, 11)} * 12) + 1)::INT, (floor({sql_uniform(_REL, 12)} * 28) + 1)::INT), DATE '1993-06-15') AS born FROM customer")
def relative_dates(t: Tables) -> DataFrame:
    """A birth 30 years before, and 31 at least."""
    s = rng.stream(SEED, F.col("c_custkey").cast("string"), "born:")
    return t.customer.select("c_custkey", dates.relative_date(F.lit("2024-06-15").cast("date"), s, lambda _: F.lit(30.0), 31).alias("born"))


@query("SELECT o_orderkey, (date_diff('day', o_orderdate::DATE, DATE '2002-01-01') // 7)::BIGINT AS weeks, datesub('month', o_orderdate::DATE, DATE '2002-01-01')::BIGINT AS months, (datesub('month', o_orderdate::DATE, DATE '2002-01-01') // 12)::BIGINT AS years FROM orders")
def tenures(t: Tables) -> DataFrame:
    d, at = F.to_date("o_orderdate"), F.lit("2002-01-01").cast("date")
    return t.orders.select("o_orderkey", dates.tenure("week", d, at).alias("weeks"), dates.tenure("month", d, at).alias("months"), dates.tenure("year", d, at).alias("years"))


@query("SELECT p_partkey, regexp_replace(lower(trim('  ' || p_name || '.. ')), '\\.+$', '') AS clean, CASE WHEN lower(split_part(p_name, ' ', 1)) IN ('red', 'blue') THEN 'Female' WHEN lower(split_part(p_name, ' ', 1)) IN ('green', 'blue') THEN 'Male' ELSE 'Unknown' END AS gender FROM part")
def names_and_genders(t: Tables) -> DataFrame:
    first = F.split("p_name", " ").getItem(0)
    return t.part.select("p_partkey", scalars.clean_name(F.concat(F.lit("  "), "p_name", F.lit(".. "))).alias("clean"), scalars.gender_of(first, ["Red", "blue"], ["GREEN", "blue"]).alias("gender"))


@query("SELECT c_custkey, (('0x' || left(md5(c_name), 8))::BIGINT % 7)::BIGINT AS bucket FROM customer")
def hex_buckets(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", keys.hex_bucket(F.md5("c_name"), 7).alias("bucket"))


@query("SELECT c_custkey, n_name AS condition FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def condition_of_parent(t: Tables) -> DataFrame:
    return generate.condition_value(t.customer, "parent.n_name", [("c_nationkey", t.nation, "n_nationkey")], "condition").select("c_custkey", "condition")


_BUCKETS = {"BUILDING": ["ash", "beech", "cedar"], "default": ["moss", "fern"]}


@query(f"SELECT c_custkey, CASE WHEN lower(c_mktsegment) = 'building' THEN ['ash', 'beech', 'cedar'][(floor({sql_keyed('c_custkey::VARCHAR', 'tree:')} * 3) + 1)::INT] ELSE ['moss', 'fern'][(floor({sql_keyed('c_custkey::VARCHAR', 'tree:')} * 2) + 1)::INT] END AS entry FROM customer")
def catalogue_lookup(t: Tables) -> DataFrame:
    u = rng.keyed(SEED, F.col("c_custkey").cast("string"), 1, "tree:")
    return t.customer.select("c_custkey", generate.from_catalogue(u, F.col("c_mktsegment"), _BUCKETS).alias("entry"))


@query("SELECT n_nationkey, w.k AS season, w.s AS begins FROM nation, (VALUES (1, '2024-01-01'), (2, '2024-07-01')) w(k, s)")
def scheduled_windows(t: Tables) -> DataFrame:
    return generate.scheduled(t.nation.select("n_nationkey"), [{"season": 1, "begins": "2024-01-01"}, {"season": 2, "begins": "2024-07-01"}])


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem WHERE {sql_keyed('l_orderkey::VARCHAR', 'thin:')} < 0.4")
def thinned_rows(t: Tables) -> DataFrame:
    return generate.thinned(t.lineitem, "l_orderkey", 0.4, SEED, "thin").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@query("SELECT o_orderkey, coalesce(round(s, 2), 0) AS total FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey")
def rolled_up_totals(t: Tables) -> DataFrame:
    return generate.rolled_up(t.orders.select("o_orderkey"), "o_orderkey", t.lineitem, "l_orderkey", "l_extendedprice", "total")


_HEROES = [Hero("five", "customer", {"c_custkey": 5}), Hero("builder", "customer", {"c_custkey": 7, "c_mktsegment": "BUILDING"}), Hero("nobody", "customer", {"c_name": "nobody"})]


@query("SELECT c_custkey, CASE WHEN c_custkey = 5 THEN 'five' WHEN c_custkey = 7 AND c_mktsegment = 'BUILDING' THEN 'builder' WHEN c_name = 'nobody' THEN 'nobody' END AS hero FROM customer")
def hero_match(t: Tables) -> DataFrame:
    return heroes.match(t.customer, _HEROES).select("c_custkey", "hero")


@query("SELECT n_nationkey, n_name FROM nation UNION ALL VALUES (100, 'ATLANTIS'), (101, 'LEMURIA')")
def hero_rows(t: Tables) -> DataFrame:
    return simulate.inject(t.nation.select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name"), [{"n_nationkey": 100, "n_name": "ATLANTIS"}, {"n_nationkey": 101, "n_name": "LEMURIA"}])


_LADDER = Ladder("tier", "customer", (State("Trial", 2, stored="T"), State("Active", 4), State("Gone", 9, stored="X")))


def _tiers(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").cast("string").alias("key"), F.lit("tier").alias("ladder"), ladders.closed_form(_LADDER, (F.col("c_custkey") % 17).cast("int")).alias("state"))


_TIER = "CASE WHEN c_custkey % 17 < 2 THEN 'Trial' WHEN c_custkey % 17 < 6 THEN 'Active' WHEN c_custkey % 17 < 15 THEN 'Gone' END"


@query(f"SELECT 'tier' AS ladder, {_TIER} AS state, count(*)::BIGINT AS count FROM customer GROUP BY 2")
def state_occupancy(t: Tables) -> DataFrame:
    return ladders.occupancy(_tiers(t))


@query(f"SELECT c_custkey, CASE {_TIER} WHEN 'Trial' THEN 'T' WHEN 'Gone' THEN 'X' WHEN 'Active' THEN 'Active' ELSE c_mktsegment END AS c_mktsegment, {_TIER} IS NOT NULL AS fixed FROM customer")
def state_binding(t: Tables) -> DataFrame:
    out = ladders.bind(t.customer.select("c_custkey", "c_mktsegment"), "c_custkey", _tiers(t), _LADDER, "c_mktsegment", {"fixed": True})
    return out.select("c_custkey", "c_mktsegment", F.coalesce("fixed", F.lit(False)).alias("fixed"))


@query(f"SELECT c_custkey, {_TIER} AS state, CASE {_TIER} WHEN 'Trial' THEN 'T' WHEN 'Gone' THEN 'X' ELSE {_TIER} END AS stored FROM customer")
def stored_states(t: Tables) -> DataFrame:
    """A state's stored value, and the state read back from it."""
    s = ladders.closed_form(_LADDER, (F.col("c_custkey") % 17).cast("int"))
    stored = ladders.stored(_LADDER, s)
    return t.customer.select("c_custkey", ladders.state_of(_LADDER, stored).alias("state"), stored.alias("stored"))


@query("SELECT user_id, event_type, cycle, (SELECT min(b.cycle) FROM h b WHERE b.user_id = h.user_id AND b.cycle > h.cycle)::INT AS exit_cycle FROM h".join(["WITH h AS (SELECT user_id, min(event_type) AS event_type, day(ts)::INT AS cycle FROM events GROUP BY user_id, day(ts)) ", ""]))
def ladder_intervals(t: Tables) -> DataFrame:
    h = t.events.groupBy(F.col("user_id").alias("key"), F.dayofmonth("ts").alias("enter_cycle")).agg(F.min("event_type").alias("state")).withColumn("ladder", F.lit("l"))
    return ladders.intervals(h).select(F.col("key").alias("user_id"), F.col("state").alias("event_type"), F.col("enter_cycle").alias("cycle"), "exit_cycle")


@query(f"SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY {sql_keyed('c_custkey::VARCHAR', 'ladder:tier:')}, c_custkey) AS r, count(*) OVER () AS n FROM customer) WHERE r <= floor(n * 0.3 + 0.5)")
def cohort_share(t: Tables) -> DataFrame:
    """Exactly the share of those who start on a ladder."""
    ladder = Ladder("tier", "customer", _LADDER.states, 0.3)
    return ladders.enrol(t.customer, "c_custkey", ladder, 2020, SEED).select(F.col("key").alias("c_custkey"))


_FACTOR = Factor("pays", "customer", 0.5, 0.1, {"from": "self", "where": {"c_mktsegment": "BUILDING", "active": True}, "otherwise": {"c_mktsegment": "OTHER"}}, (Arrow(0.5, "balance"), Arrow(-1.5, None, {"from": "self"}, "nation")))


@query("SELECT c_custkey, round(0.5 * (c_acctbal / 1000) - 1.5 * (c_nationkey / 25.0), 6) AS score FROM customer")
def linear_scores(t: Tables) -> DataFrame:
    rows = t.customer.withColumns({"balance": F.col("c_acctbal") / 1000, "__n": F.col("c_nationkey") / 25.0})
    return rows.select("c_custkey", F.round(simulate.score(_FACTOR, {("pays", 1): F.col("__n")}), 6).alias("score"))


def _outcomes(t: Tables) -> DataFrame:
    """Last year's payers: a customer's outcome by balance, a year earlier by nation."""
    c = t.customer
    return c.select(F.lit(2001).alias("cycle"), F.lit("pays").alias("factor"), F.col("c_custkey").alias("key"), (F.col("c_acctbal") > 4000).alias("outcome")).union(c.where("c_nationkey < 10").select(F.lit(2000), F.lit("pays"), "c_custkey", F.col("c_nationkey") > 4))


@query("SELECT c_custkey, CASE WHEN c_custkey = 5 THEN c_mktsegment WHEN c_acctbal > 4000 THEN 'BUILDING' ELSE 'OTHER' END AS c_mktsegment, c_acctbal > 4000 AS active FROM customer")
def written_back(t: Tables) -> DataFrame:
    """Outcomes of the last cycle in the fields of a conjunction; a hero's fixed field stays."""
    rows = t.customer.select("c_custkey", "c_mktsegment", F.lit(None).cast("boolean").alias("active"))
    fixed = t.spark.createDataFrame([("5", ["c_mktsegment"])], "key string, fixed array<string>")
    return simulate.written_back(rows, "c_custkey", _outcomes(t), _FACTOR, {}, fixed)


@query("SELECT cycle, 'pays' AS factor, (count(*) FILTER (WHERE o))::BIGINT AS positives, count(*)::BIGINT AS population FROM (SELECT 2001 AS cycle, c_acctbal > 4000 AS o FROM customer UNION ALL SELECT 2000, c_nationkey > 4 FROM customer WHERE c_nationkey < 10) GROUP BY cycle")
def outcome_snapshot(t: Tables) -> DataFrame:
    return simulate.snapshot(_outcomes(t))


@query("SELECT round(covar_pop(c_acctbal / 1000, y) / var_pop(c_acctbal / 1000) / (avg(y) * (1 - avg(y))), 6) AS beta FROM (SELECT c_acctbal, (c_nationkey % 3 = 0)::INT AS y FROM customer)")
def recovered_beta(t: Tables) -> DataFrame:
    return t.customer.agg(F.round(calibrate.recovered_beta(t.customer, F.col("c_acctbal") / 1000, (F.col("c_nationkey") % 3 == 0).cast("int")), 6).alias("beta"))


_SHIFTED = "(1 / (1 + exp(-(ln(0.3 / 0.7) + 0.4))))"


@query(f"SELECT c_custkey, {sql_keyed('c_custkey::VARCHAR || chr(58) || 3 || chr(58) || chr(112) || chr(97) || chr(121) || chr(115)', 'intake:')} < {_SHIFTED} AS outcome FROM customer")
def intake_outcomes(t: Tables) -> DataFrame:
    f = Factor("pays", "customer", 0.3, 0.1, {"from": "self"})
    return simulate.intake_draws(t.customer, "c_custkey", f, SEED, 3, 0.4).select("c_custkey", "outcome")


@query(f"SELECT key, cycle, unnest(range(1, n + 1))::INT AS place FROM (SELECT c_custkey AS key, cycle, floor((floor({sql_keyed('c_custkey::VARCHAR || chr(58) || chr(111) || chr(58) || cycle', 'child:')} * 4) + 1) * m + 0.5)::INT AS n FROM customer, (VALUES (2020, 1.0), (2021, 0.5)) c(cycle, m) WHERE c_nationkey = 3)")
def motif_children(t: Tables) -> DataFrame:
    people = t.customer.withColumn("motif", F.when(F.col("c_nationkey") == 3, "m"))
    return simulate.motif_children(people, "c_custkey", Motif("m", "customer", 1, children={"o": (1, 4)}), "o", [2020, 2021], SEED, {2021: 0.5})


@query("SELECT 'titles' AS name, (count(*) FILTER (WHERE g <> s)) = 0 AS passed, count(*)::BIGINT AS population_count, (count(*) FILTER (WHERE g <> s))::VARCHAR AS actual FROM (SELECT CASE c_mktsegment WHEN 'BUILDING' THEN 'Male' WHEN 'MACHINERY' THEN 'Female' END AS g, CASE WHEN c_nationkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS s FROM customer) WHERE g IS NOT NULL")
def titles_and_gender(t: Tables) -> DataFrame:
    rows = t.customer.withColumn("title", F.when(F.col("c_mktsegment") == "BUILDING", " Mr.").when(F.col("c_mktsegment") == "MACHINERY", "LADY").otherwise("Dr."))
    return gates.words_of_gender("titles", rows, "title", F.when(F.col("c_nationkey") % 2 == 0, "Female").otherwise("male"), gates.TITLES).select(*GATE)


@query("SELECT 'pronouns' AS name, (count(*) FILTER (WHERE p <> g)) = 0 AS passed, count(*)::BIGINT AS population_count, (count(*) FILTER (WHERE p <> g))::VARCHAR AS actual FROM (SELECT CASE o_orderstatus WHEN 'F' THEN 'Female' WHEN 'O' THEN 'Male' END AS p, CASE WHEN c_nationkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS g FROM orders JOIN customer ON o_custkey = c_custkey) WHERE p IS NOT NULL")
def pronouns_and_parent(t: Tables) -> DataFrame:
    """Pronouns against the gender of the row that the first key leads to."""
    people = t.customer.withColumn("Gender", F.when(F.col("c_nationkey") % 2 == 0, "Female").otherwise("Male"))
    rows = features.path(t.orders.withColumn("pronoun", F.when(F.col("o_orderstatus") == "F", "She/Her").when(F.col("o_orderstatus") == "O", "he/him ").otherwise("they/them")), [("o_custkey", people, "c_custkey")], "Gender", "__gender", raw=True)
    return gates.words_of_gender("pronouns", rows, "pronoun", F.col("__gender"), gates.PRONOUNS).select(*GATE)


_KEYS = (("orders", "o_orderkey"), ("lineitem", "l_orderkey, l_linenumber"), ("customer", "c_custkey"))
_KEYED = " UNION ALL ".join(f"SELECT (SELECT count(*) FROM {t})::BIGINT AS n, (SELECT count(*) FROM (SELECT 1 FROM {t} GROUP BY {k} HAVING count(*) > 1)) = 0 AS ok" for t, k in _KEYS)


@query(f"SELECT (count(*) FILTER (WHERE ok))::BIGINT AS passed, (count(*) FILTER (WHERE NOT ok))::BIGINT AS failed, sum(n)::BIGINT AS examined FROM ({_KEYED})")
def gate_report(t: Tables) -> DataFrame:
    """The key gates of three tables rolled up."""
    found = [gates.schema_gates(n, df, k) for n, df, k in (("orders", t.orders, ["o_orderkey"]), ("lineitem", t.lineitem, ["l_orderkey", "l_linenumber"]), ("customer", t.customer, ["c_custkey"]))]
    return gates.report(gates.all_gates(found))


@query("SELECT 'customer' AS entity, count(*)::BIGINT AS n, count(DISTINCT c_custkey)::BIGINT AS active FROM customer UNION ALL SELECT 'lineitem', count(*), (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) FROM lineitem UNION ALL SELECT 'orders', count(*), count(DISTINCT o_orderkey) FROM orders")
def entity_counts(t: Tables) -> DataFrame:
    """What a checkpoint holds of each entity: its rows, and its ids, each once."""
    keys_ = {"customer": ["c_custkey"], "lineitem": ["l_orderkey", "l_linenumber"], "orders": ["o_orderkey"]}
    return accumulate.counted({"customer": t.customer, "lineitem": t.lineitem, "orders": t.orders}, keys_)


@query("SELECT n_nationkey, (SELECT count(*) FROM (SELECT c_custkey FROM customer WHERE c_nationkey = n_nationkey UNION SELECT c_custkey FROM customer WHERE (c_custkey * 7) % 25 = n_nationkey))::BIGINT AS linked FROM nation")
def children_by_two_keys(t: Tables) -> DataFrame:
    """Children that point to a parent by either of two keys, each once."""
    child = t.customer.withColumn("second", (F.col("c_custkey") * 7) % 25)
    return features.children(t.nation, child, "n_nationkey", ["c_nationkey", "second"], {"linked": {"aggregation": "count"}}).select("n_nationkey", "linked")


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey DESC LIMIT 10")
def last_rows(t: Tables) -> DataFrame:
    return features.last_rows(t.customer, ["c_acctbal", "c_custkey"], 10).select("c_custkey", "c_acctbal")


@query("SELECT o_orderstatus, count(*)::BIGINT AS violations, array_to_string(list_sort(list(o_orderkey))[1:3], ' ') AS examples FROM orders WHERE o_totalprice > 300000 GROUP BY 1")
def violation_examples(t: Tables) -> DataFrame:
    judged = t.orders.withColumn("violated", F.col("o_totalprice") > 300000)
    return features.examples(judged, "o_orderkey", 3, ["o_orderstatus"]).withColumn("examples", F.array_join("examples", " "))


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def wrapped_round_trip(t: Tables) -> DataFrame:
    """Customers written as files of wrapped records with their sidecar, and read back."""
    df = t.customer.select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    path = simulate.fresh(t.spark, "wrapped")
    records.write_wrapped(df, path, "Customer", ["c_custkey"])
    return records.read_wrapped(t.spark, path, df.schema, ["c_custkey"], "Customer")


def _shop(t: Tables) -> Domain:
    """Customers whose orders live inside them."""
    of = lambda df: tuple(Field(f.name) for f in df.schema)
    held = (Composition("collection", "Order", "o_custkey"),)
    customer = Entity("Customer", (Field("c_custkey", primary=True), *of(t.customer.select("c_name", "c_acctbal"))), (), ("c_custkey",), held)
    order = Entity("Order", (Field("o_orderkey", primary=True), *of(t.orders.select("o_custkey", "o_totalprice"))), (ForeignKey("o_custkey", "Customer", "c_custkey"),), ("o_orderkey",))
    return Domain("shop", NAMESPACE, {"Customer": customer, "Order": order})


_NEWCOMER = "c_mktsegment = 'MACHINERY'"


@query(
    "SELECT 'customer' AS kind, c_custkey::BIGINT AS id, NULL::BIGINT AS parent, CASE WHEN c_acctbal < 0 AND c_mktsegment <> 'MACHINERY' THEN 0 ELSE c_acctbal END AS value FROM customer "
    "UNION ALL SELECT 'order', o_orderkey, o_custkey, o_totalprice FROM orders"
)
def wrapped_append(t: Tables) -> DataFrame:
    """Customers with their orders before 1999 as committed files; then those of one segment appended, later orders put into committed and new customers alike, and overdrawn balances of committed ones set to 0; all read back."""
    d, path = _shop(t), simulate.fresh(t.spark, "appended")
    c = t.customer.select("c_custkey", "c_name", "c_acctbal", F.expr(_NEWCOMER).alias("__new"))
    o = t.orders.select("o_orderkey", "o_custkey", "o_totalprice", F.col("o_orderdate").alias("__d")).join(c.select(F.col("c_custkey").alias("o_custkey"), "__new"), "o_custkey")
    late = F.col("__new") | (F.col("__d") >= "1999-01-01")
    row = lambda df: df.select("o_orderkey", "o_custkey", "o_totalprice")
    records.write(d, {"Customer": c.where("NOT __new").drop("__new"), "Order": row(o.where(~late))}, path, json=True)
    paid = c.where("NOT __new AND c_acctbal < 0").select("c_custkey", "c_name", F.lit(0.0).alias("c_acctbal"))
    appending.append(t.spark, d, path, {"Customer": c.where("__new").drop("__new"), "Order": row(o.where(late))}, {"Customer": paid})
    kinds = {"Customer": c.drop("__new").schema, "Order": row(o).schema}
    found = appending.read(t.spark, d, path, kinds)
    customers = found["Customer"].select(F.lit("customer").alias("kind"), F.col("c_custkey").cast("long").alias("id"), F.lit(None).cast("long").alias("parent"), F.col("c_acctbal").alias("value"))
    return customers.unionByName(found["Order"].select(F.lit("order").alias("kind"), F.col("o_orderkey").cast("long").alias("id"), F.col("o_custkey").cast("long").alias("parent"), F.col("o_totalprice").alias("value")))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01' UNION ALL SELECT o_orderkey, 'N' FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01'")
def prior_and_new(t: Tables) -> DataFrame:
    """Committed rows with a cycle's new files beside them."""
    path, d = simulate.fresh(t.spark, "appended"), Domain("shop", NAMESPACE, {"orders": Entity("orders", (Field("o_orderkey", primary=True), Field("o_orderstatus")))})
    o = t.orders.select("o_orderkey", "o_orderstatus", "o_orderdate")
    old = {"orders": o.where("o_orderdate < '2000-01-01'").select("o_orderkey", "o_orderstatus")}
    records.write(d, old, path)
    records.append(d, path, {"orders": o.where("o_orderdate >= '2000-01-01'").select("o_orderkey", F.lit("N").alias("o_orderstatus"))}, old)
    return records.read(t.spark, d, path)["orders"]


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def childless_rows(t: Tables) -> DataFrame:
    """Parents that the coverage gate counts as without a child."""
    return t.orders.join(gates.keys_of(t.lineitem, F.col("l_orderkey")), F.col("o_orderkey") == F.col("__t"), "left_anti").select("o_orderkey", "o_custkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, NOT (l_shipdate::DATE BETWEEN o_orderdate::DATE AND o_orderdate::DATE + 90) AS violated FROM lineitem JOIN orders ON l_orderkey + 0 = o_orderkey")
def linked_date_window(t: Tables) -> DataFrame:
    """The window of what a link table says a row belongs to."""
    link = t.lineitem.select(F.col("l_orderkey").alias("line"), F.col("l_orderkey").alias("order")).distinct()
    rows = t.lineitem.join(link, F.col("l_orderkey") == F.col("line"))
    d = F.to_date("o_orderdate")
    return rules.date_window(rows, F.to_date("l_shipdate"), "order", t.orders, "o_orderkey", d, F.date_add(d, 90), require=True).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "violated")


@query(f"SELECT c_custkey, 'https://faces.example/toon/svg?seed=' || c_custkey || CASE WHEN c_nationkey % 2 = 0 THEN '&hair=long%2Cbob' ELSE '&beard=true' END || '&backgroundColor=ffeecc' AS url FROM customer")
def avatar_addresses(t: Tables) -> DataFrame:
    trait = F.when(F.col("c_nationkey") % 2 == 0, "Female").otherwise("Unknown")
    return t.customer.select("c_custkey", scalars.avatar_url("c_custkey", "toon", "https://faces.example/", trait, {"female": {"hair": ["long", "bob"]}, "male": {"beard": True}}, "male", "#ffeecc").alias("url"))


@query(f"SELECT event_id, user_id FROM events WHERE ts::DATE > DATE '2024-01-10' AND ts::DATE <= DATE '2024-01-20' AND event_id NOT IN (SELECT min(event_id) FROM events GROUP BY user_id, ts::DATE) ORDER BY ts, event_id LIMIT 25")
def first_undecided(t: Tables) -> DataFrame:
    """The first of a window's events that nothing has decided: each user's first event of a day is."""
    decided = t.events.groupBy("user_id", F.to_date("ts").alias("d")).agg(F.min("event_id").alias("event_id"))
    return accumulate.undecided(t.events, "event_id", "ts", datetime.date(2024, 1, 10), datetime.date(2024, 1, 20), decided, "event_id", 25).select("event_id", "user_id")


_SQUARES = " || ".join(f"CASE WHEN substr(h, {3 * r + x + 1}, 1) >= '8' THEN 'M{x} {r}h1v1h-1z{'' if x == 2 else f'M{4 - x} {r}h1v1h-1z'}' ELSE '' END" for r in range(5) for x in range(3))
_GLYPH = f"""'<svg xmlns="http://www.w3.org/2000/svg" viewBox="-1 -1 7 7"><path d="M-1-1h7v7h-7z" fill="#' || translate(substr(h, 22, 3), '0123456789ab', 'cdefcdefcdef') || '"/><path d="' || {_SQUARES} || '" fill="#' || substr(h, 16, 6) || '"/></svg>'"""


@query(f"SELECT c_custkey, 'data:image/svg+xml;base64,' || to_base64(encode({_GLYPH})) AS image FROM (SELECT c_custkey, md5(lower(c_name)) AS h FROM customer)")
def avatar_glyphs(t: Tables) -> DataFrame:
    """Each customer's drawing, made here."""
    return t.customer.select("c_custkey", scalars.glyph("c_name").alias("image"))


@query("SELECT 'event images' AS name, count(DISTINCT user_id) >= 0.99 * count(*) AS passed, count(*)::BIGINT AS population_count, round(count(DISTINCT user_id) / count(*), 6)::DOUBLE AS share FROM events UNION ALL SELECT 'customer images', count(DISTINCT c_custkey) >= 0.99 * count(*), count(*), round(count(DISTINCT c_custkey) / count(*), 6) FROM customer")
def glyph_distinctness(t: Tables) -> DataFrame:
    """The gate on images by their decoded content: events show their users', customers their own."""
    drawn = [gates.distinctness("event images", t.events.select(scalars.glyph("user_id").alias("image")), "image"), gates.distinctness("customer images", t.customer.select(scalars.glyph("c_name").alias("image")), "image")]
    return gates.all_gates(drawn).select("name", "passed", "population_count", F.col("actual").cast("double").alias("share"))


_PROFILED = {"customer": ("c_custkey", "c_name*", "c_nationkey", "c_acctbal", "c_mktsegment*"), "documents": ("doc_id", "text*", "lang*", "source*", "n_chars"), "orders": ("o_orderkey", "o_custkey", "o_orderstatus*", "o_totalprice", "o_orderdate", "o_orderpriority*")}


@query(" UNION ALL ".join(f"SELECT '{t}' AS entity, {i} AS place, '{c.rstrip('*')}' AS name, count(*)::BIGINT AS rows, count(*) FILTER (WHERE {c.rstrip('*')} IS NULL)::BIGINT AS nulls, {f'max(length({c[:-1]}))::BIGINT' if c.endswith('*') else 'NULL::BIGINT'} AS longest FROM {t}" for t, cs in _PROFILED.items() for i, c in enumerate(cs)))
def profiled_fields(t: Tables) -> DataFrame:
    """Fields of three tables as a host's metadata would list them: nulls and longest texts by one reading of each."""
    return host.profile({n: t[n] for n in _PROFILED}).select("entity", "place", "name", "rows", "nulls", "longest")


@query(" UNION ALL ".join(f"SELECT '{c}' AS entity, '{f}' AS field, '{p}' AS target, '{k}' AS target_field, count(*)::BIGINT AS examined, (count(*) FILTER (WHERE {f} NOT IN (SELECT {k} FROM {p})))::BIGINT AS dangling FROM {c}" for c, f, p, k in FKS))
def found_links(t: Tables) -> DataFrame:
    """Fields that are called like another table's key, and how many of their values are none: foreign keys found in data."""
    names = {n: t[n] for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")}
    return host.links(names, {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey"})


_OVERDRAWN = "SELECT c_custkey FROM customer WHERE c_acctbal >= 0"
_CHEAP = "SELECT p_partkey FROM part WHERE p_size <= 45"


def _sql_closure(name: str, child: str, field: str, pool: str) -> str:
    bad = f"SELECT {field}::VARCHAR AS k, count(*) AS n FROM {child} WHERE {field} NOT IN ({pool}) GROUP BY 1"
    return f"SELECT '{name}' AS name, (SELECT count(*) FROM ({bad})) = 0 AS passed, (SELECT count(*) FROM {child})::BIGINT AS population_count, '{name}: ' || coalesce((SELECT sum(n) FROM ({bad})), 0)::BIGINT || ' dangling' || coalesce((SELECT ', such as ' || array_to_string(list_sort(list(k))[1:3], ', ') FROM (SELECT min(k) AS k FROM ({bad}) GROUP BY left(md5(k), 3)) HAVING count(*) > 0), '') AS message"


@query(f"{_sql_closure('lineitem.l_partkey', 'lineitem', 'l_partkey', _CHEAP)} UNION ALL {_sql_closure('lineitem.l_orderkey', 'lineitem', 'l_orderkey', 'SELECT o_orderkey FROM orders')} UNION ALL {_sql_closure('orders.o_custkey', 'orders', 'o_custkey', _OVERDRAWN)}")
def closure_examples(t: Tables) -> DataFrame:
    """Closure gates, one reading for both keys of a line; those that fail name three values that lead nowhere."""
    lines = [("lineitem.l_partkey", "l_partkey", t.part.where("p_size <= 45"), "p_partkey", False), ("lineitem.l_orderkey", "l_orderkey", t.orders, "o_orderkey", False)]
    found = [gates.closure_gates(t.lineitem, lines), gates.closure_gates(t.orders, [("orders.o_custkey", "o_custkey", t.customer.where("c_acctbal >= 0"), "c_custkey", False)])]
    return gates.all_gates(found).select("name", "passed", "population_count", "message")


_REPEATED = "SELECT k, count(*) AS n FROM (SELECT o_custkey::VARCHAR || '|' || o_orderpriority AS k FROM orders) GROUP BY 1"
_LONG = "SELECT l, count(*) AS n FROM (SELECT o_custkey::VARCHAR || '|' || o_orderpriority AS l FROM orders WHERE length(o_orderpriority) > 8) GROUP BY 1"


@query(
    f"SELECT 'orders: primary key' AS name, max(n) = 1 AS passed, sum(n)::BIGINT AS population_count, 'orders: primary key: 0 missing, ' || (sum(n) - count(*))::BIGINT || ' duplicate' || coalesce((SELECT ', such as ' || array_to_string(list_sort(list(k))[1:3], ', ') FROM (SELECT min(lower(k)) AS k FROM ({_REPEATED}) WHERE n > 1 GROUP BY left(md5(lower(k)), 3)) HAVING count(*) > 0), '') AS message FROM ({_REPEATED}) "
    f"UNION ALL SELECT 'orders.o_orderpriority: length', count(*) = 0, (SELECT count(*) FROM orders), 'orders.o_orderpriority: length: ' || coalesce(sum(n), 0)::BIGINT || coalesce((SELECT ', such as ' || array_to_string(list_sort(list(k))[1:3], ', ') FROM (SELECT min(l) AS k FROM ({_LONG}) GROUP BY left(md5(l), 3)) HAVING count(*) > 0), '') FROM ({_LONG})"
)
def schema_examples(t: Tables) -> DataFrame:
    """A customer and priority as the key of orders, and priorities of at most 8 characters: both fail, and name some that do."""
    return gates.schema_gates_with_examples("orders", t.orders, ["o_custkey", "o_orderpriority"], [], {"o_orderpriority": 8}).select("name", "passed", "population_count", "message")
