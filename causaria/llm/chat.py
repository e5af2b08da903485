"""Chat formatting with tool-call linking, in DataFrame operations alone.

Calls and results are hash-joined by (conversation, identifier); calls that
refer to other calls' results ({"$ref": id} among their arguments) get levels
by rounds of joins, which is their topological order; arguments are validated
against the tools' schemas; and every message, call and result becomes one line
of canonical JSON: keys sorted, no white space, absent values left out.

Lines are rows: a conversation is never gathered, so its length isn't bounded.
(conv_id, order_turn, order_index, order_phase) sorts lines so that a result
follows its call, and a call whatever it refers to and the results of that: a
call's turn and index are its own place in the conversation, moved back where
it refers to what comes later. Calls in or behind a cycle stay where they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, mark, only, staged

#: Argument types of schemas and the variant types that fit them.
TYPES = {"string": r"^STRING$", "integer": r"^BIGINT$", "number": r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "boolean": r"^BOOLEAN$", "array": r"^ARRAY<.*$", "object": r"^OBJECT<.*$"}


def canonical(json: Column) -> Column:
    """JSON text with sorted keys and no white space; null where it isn't JSON."""
    return F.to_json(F.try_parse_json(json))


#: An argument that stands for another call's result, whatever its type.
REFERENCE = r"^OBJECT<`?\$ref`?: STRING>$"


def argument_errors(name: Column, arguments: Column, schemas: dict[str, dict[str, tuple[str, bool]]]) -> Column:
    """Sorted problems of a call. schemas: tool -> argument -> (type of TYPES, whether it is required); other arguments are errors.

    {"$ref": id} fits any type: what it stands for is known only when the call is made.
    """
    value = F.try_parse_json(arguments)
    kind = F.schema_of_variant(value)
    per_tool = None
    for tool, fields in sorted(schemas.items()):
        found = []
        for f, (type_, required) in sorted(fields.items()):
            at = F.try_variant_get(value, f"$.{f}", "variant")
            there = F.array_contains(F.coalesce(F.json_object_keys(arguments), F.array().cast("array<string>")), f)
            bad = F.when(there & ~F.coalesce(F.schema_of_variant(at), F.lit("VOID")).rlike(f"{TYPES[type_]}|{REFERENCE}"), F.lit(f"type of {f}"))
            found.append(F.when(~there, F.lit(f"missing {f}")).otherwise(bad) if required else bad)
        extra = F.transform(F.array_except(F.json_object_keys(arguments), F.array(*map(F.lit, sorted(fields))).cast("array<string>")), lambda k: F.concat(F.lit("unknown "), k))
        errors = F.array_sort(F.concat(F.array_compact(F.array(*found)), F.coalesce(extra, F.array().cast("array<string>"))))
        per_tool = F.when(name == tool, errors) if per_tool is None else per_tool.when(name == tool, errors)
    none = F.array(F.lit("unknown tool"))
    per_tool = none if per_tool is None else per_tool.otherwise(none)
    return F.when(value.isNull() | ~F.coalesce(kind, F.lit("")).startswith("OBJECT"), F.array(F.lit("not a JSON object"))).otherwise(per_tool)


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, id, refs array<string>) -> (conv_id, id, level): 0 without references, else 1 above the highest; -1 in or behind a cycle.

    References to calls that don't exist count for nothing.
    """
    return placed(calls.select("conv_id", "id", "refs", F.struct(F.lit(0).cast("long").alias("turn"), F.lit(0).alias("place")).alias("at"))).drop("at")


def placed(calls: DataFrame) -> DataFrame:
    """(conv_id, id, refs, at struct<turn, place>) -> (conv_id, id, at, level as of levels()).

    A call's at is its own (the least of an id), or, where that isn't behind
    all it refers to, one place behind the last of those; in or behind a cycle
    it stays. Calls that refer to one other make chains, which are shortened
    first (see shortened): what a chain of n calls needs is log2 n joins. The
    calls that are left, with none or several references, get their places in
    rounds, each a join of what the round before placed alone.
    """
    began = mark()
    spark = calls.sparkSession
    known = staged(calls.groupBy("conv_id", "id").agg(F.min("at").alias("at")))
    edges = calls.select("conv_id", "id", F.explode(F.array_distinct("refs")).alias("ref")).join(known.select("conv_id", F.col("id").alias("ref")), ["conv_id", "ref"], "left_semi")
    edges = staged(edges.distinct())
    degree = edges.groupBy("conv_id", "id").agg(F.count(F.lit(1)).alias("refs"), F.max("ref").alias("to"))
    chained = shortened(known.join(degree.where("refs = 1"), ["conv_id", "id"]).select("conv_id", "id", "to", "at"))
    # Several references: each leads, past its chain, to a call that isn't in one.
    many = degree.where("refs > 1").select("conv_id", "id", "refs")
    by = chained.select("conv_id", F.col("id").alias("ref"), "to", "at", "steps")
    ways = edges.join(many, ["conv_id", "id"]).join(by, ["conv_id", "ref"], "left")
    ways = staged(ways.select("conv_id", "id", "refs", F.coalesce("to", "ref").alias("to"), "at", (F.coalesce("steps", F.lit(0)) + 1).alias("steps")))
    front = staged(known.join(degree.select("conv_id", "id"), ["conv_id", "id"], "left_anti").withColumn("level", F.lit(0)))
    rounds, waiting = [front], None
    deep = not ways.isEmpty()
    while deep:
        met = ways.join(front.select("conv_id", F.col("id").alias("to"), F.col("at").alias("of"), "level"), ["conv_id", "to"])
        met = met.select("conv_id", "id", "refs", F.lit(1).alias("seen"), F.greatest(behind("at", 1), behind("of", "steps")).alias("at"), (F.col("level") + F.col("steps")).alias("level"))
        met = met if waiting is None else met.union(waiting)
        met = staged(met.groupBy("conv_id", "id", "refs").agg(F.sum("seen").alias("seen"), F.max("at").alias("at"), F.max("level").alias("level")))
        front = staged(met.where("seen = refs").join(known.withColumnRenamed("at", "own"), ["conv_id", "id"]).select("conv_id", "id", F.greatest("own", "at").alias("at"), "level"))
        waiting = met.where("seen < refs")
        deep = not front.isEmpty()
        rounds.append(front)
    done = rounds[0]
    for r in rounds[1:]:
        done = done.union(r)
    done = staged(done) if len(rounds) > 1 else done
    ends = done.select("conv_id", F.col("id").alias("to"), F.col("at").alias("of"), "level")
    along = chained.join(ends, ["conv_id", "to"]).select("conv_id", "id", F.greatest("at", behind("of", "steps")).alias("at"), (F.col("level") + F.col("steps")).alias("level"))
    done = done.union(along)
    out = staged(known.withColumnRenamed("at", "own").join(done, ["conv_id", "id"], "left").select("conv_id", "id", F.coalesce("at", "own").alias("at"), F.coalesce("level", F.lit(-1)).cast("int").alias("level")))
    dropped(spark, began, mark() - 1)
    return out


def behind(at: str, steps: str | int) -> Column:
    """The place so many steps behind a place; null of null."""
    n = F.lit(steps) if isinstance(steps, int) else F.col(steps)
    return F.when(F.col(at).isNotNull(), F.struct(F.col(f"{at}.turn").alias("turn"), (F.col(f"{at}.place") + n).cast("int").alias("place")))


def shortened(one: DataFrame) -> DataFrame:
    """(conv_id, id, to, at) of calls that refer to one other -> (conv_id, id, to, at, steps): where their chain ends, in a call that isn't among them.

    A call's place is the later of at and steps behind the end's place. Pointers
    are doubled until a round brings none to an end; those that still lead to a
    chained call then go round in a cycle, and are left out.
    """
    chains = staged(one.withColumn("steps", F.lit(1)))
    while True:
        on = chains.select("conv_id", F.col("id").alias("to"), F.col("to").alias("next"), F.col("at").alias("of"), F.col("steps").alias("more"))
        both = chains.join(on, ["conv_id", "to"], "left")
        # The next call's place, as far as its own chain tells, and this one's steps behind it.
        at = F.greatest("at", F.when(F.col("next").isNotNull(), behind("of", "steps")))
        new = staged(both.select("conv_id", "id", F.coalesce("next", "to").alias("to"), at.alias("at"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("next").isNotNull().alias("open")))
        open_ = new.where("open").count()
        if not open_:
            return chains
        ends = new.join(chains.select("conv_id", F.col("id").alias("to")), ["conv_id", "to"], "left_anti")
        arrived = ends.where("open").limit(1).count()
        if not arrived:
            return ends.drop("open")
        chains = new.drop("open")


def lines(messages: DataFrame, schemas: dict[str, dict[str, tuple[str, bool]]]) -> DataFrame:
    """One row per message, call and result, with its canonical JSON.

    messages: conv_id, turn, role, text, calls array<struct<id, name,
    arguments>> (null: none), answers string (the id of the call that the
    message is the result of; null: none). Rows returned: conv_id, order_turn,
    order_index, order_phase, kind (message, call, result), call_id, status,
    level, errors, json.

    Status of a call: answered, unanswered, or repeated for the second and
    later calls of one id (by turn and place), which nothing links to; its
    errors are those of its arguments. Status of a result: linked or orphan;
    an orphan stands at its own turn. A text beside calls is the content of the
    first of them; a message that answers and also calls gives a result, which
    has its text, and its calls. Null turns count as before all others;
    a null conversation is one of its own; null and empty texts are kept, null
    as an absent key; repeated rows repeat; an empty table gives no rows; other
    columns are not looked at.
    """
    m = only(messages, "conv_id", "turn", "role", "text", "calls", "answers").select("conv_id", F.coalesce("turn", F.lit(-1)).cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"), "calls", "answers")
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit("\x00"))
    plain = m.where("answers IS NULL AND (calls IS NULL OR size(calls) = 0)")
    beside = F.when((F.col("place") == 0) & F.col("answers").isNull(), F.col("text"))
    sent = m.where("size(calls) > 0").select("conv_id", conv.alias("conv"), "turn", "role", "text", "answers", F.posexplode("calls").alias("place", "c")).select("conv_id", "conv", "turn", "role", beside.alias("beside"), "place", "c.id", "c.name", "c.arguments")
    got = m.where("answers IS NOT NULL").select("conv_id", conv.alias("conv"), "turn", "role", "text", F.col("answers").alias("id"))
    firsts = sent.groupBy("conv", "id").agg(F.min(F.struct("turn", "place")).alias("first"))
    answered = got.groupBy("conv", "id").agg(F.count(F.lit(1)).alias("results"))
    keys = firsts.join(answered, ["conv", "id"], "left")
    refs = F.regexp_extract_all("arguments", F.lit(r'\{\s*"\$ref"\s*:\s*"([^"]*)"\s*\}'), F.lit(1))
    with_refs = staged(sent.where(F.col("arguments").contains('"$ref"')).select(F.col("conv").alias("conv_id"), "id", refs.alias("refs")))
    n_refs = with_refs.count()
    calls = sent.join(keys, ["conv", "id"], "left")
    at = F.struct("turn", "place")
    own = F.col("first") == at
    if n_refs:
        # An id stands for its first call; the others, which nothing refers to, refer under names of their own.
        node = F.when(own, F.col("id")).otherwise(F.concat(F.lit("\x00"), F.coalesce("id", F.lit("")), F.lit("\x00"), F.concat_ws("\x00", "turn", "place")))
        calls = calls.withColumn("node", node)
        found = staged(placed(calls.select(F.col("conv").alias("conv_id"), F.col("node").alias("id"), F.coalesce(refs, F.array().cast("array<string>")).alias("refs"), at.alias("at"))).withColumnRenamed("conv_id", "conv"))
        calls = calls.join(found.withColumnRenamed("id", "node"), ["conv", "node"], "left")
        keys = keys.join(found, ["conv", "id"], "left")
    else:
        calls = calls.withColumns({"at": at, "level": F.lit(0)})
        keys = keys.withColumns({"at": F.col("first"), "level": F.lit(0)})
    call_json = F.to_json(F.struct(F.coalesce(canonical(F.col("arguments")), F.to_json(F.struct(F.col("arguments").alias("invalid")))).alias("arguments"), F.col("beside").alias("content"), F.col("conv_id"), F.col("id"), F.col("name"), F.col("role"), F.lit("call").alias("type")))
    calls = calls.select("conv_id", F.col("at.turn").alias("order_turn"), F.col("at.place").alias("order_index"), F.lit(0).alias("order_phase"), F.lit("call").alias("kind"), F.col("id").alias("call_id"), F.when(own, F.when(F.col("results") > 0, "answered").otherwise("unanswered")).otherwise("repeated").alias("status"), F.coalesce("level", F.lit(0)).alias("level"), argument_errors(F.col("name"), F.col("arguments"), schemas).alias("errors"), call_json.alias("json"))
    linked = got.join(keys.select("conv", "id", "first", "at", "level"), ["conv", "id"], "left")
    result_json = F.to_json(F.struct(F.col("text").alias("content"), F.col("conv_id"), F.col("id"), F.col("role"), F.lit("result").alias("type")))
    results = linked.select("conv_id", F.coalesce("at.turn", "turn").alias("order_turn"), F.coalesce("at.place", F.lit(0)).alias("order_index"), F.when(F.col("first").isNull(), 0).otherwise(1).alias("order_phase"), F.lit("result").alias("kind"), F.col("id").alias("call_id"), F.when(F.col("first").isNull(), "orphan").otherwise("linked").alias("status"), F.coalesce("level", F.lit(0)).alias("level"), F.array().cast("array<string>").alias("errors"), result_json.alias("json"))
    json = F.to_json(F.struct(F.col("text").alias("content"), F.col("conv_id"), F.col("role"), F.col("turn"), F.lit("message").alias("type")))
    none = F.lit(None).cast("string")
    rest = plain.select("conv_id", F.col("turn").alias("order_turn"), F.lit(0).alias("order_index"), F.lit(0).alias("order_phase"), F.lit("message").alias("kind"), none.alias("call_id"), none.alias("status"), F.lit(0).alias("level"), F.array().cast("array<string>").alias("errors"), json.alias("json"))
    return rest.unionByName(calls).unionByName(results)


#: The tool that every user turn of the driver's conversations calls, for want of tool calls in the table.
REPLY = {"reply": {"after": ("string", False), "text": ("string", True), "turn": ("integer", True)}}
#: Calls refer to the user's call before them, but for the first and every CHAIN-th one.
CHAIN = 4
#: A text of fewer characters gets an argument that the schema doesn't have.
SHORT = 60


def as_calls(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) as messages for lines().

    A user's turn t calls reply with its text, which moves into the arguments,
    and an assistant's turn t answers turn t - 1. So that all of the operator
    has work, calls refer to the call two turns before ({"$ref": id}), but for
    every CHAIN-th; every fifth turn is given as text, and short texts get an
    argument "short", which are errors by the schema.
    """
    c = only(conversations, "conv_id", "turn", "role", "text").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    id_ = lambda t: F.concat_ws("-", F.lit("call"), F.col("conv_id").cast("string"), t.cast("string"))
    turn = F.col("turn")
    after = F.when((turn >= 2) & (F.floor(turn / 2) % CHAIN != 0), F.struct(id_(turn - 2).alias("$ref")))
    number = F.when(turn % 5 == 4, F.concat(F.lit('"'), turn.cast("string"), F.lit('"'))).otherwise(turn.cast("string"))
    rest = F.to_json(F.struct(after.alias("after"), F.when(F.length("text") < SHORT, F.lit(True)).alias("short"), F.col("text")))
    # The turn is a number in one call and a text in another: joined to the rest as JSON.
    arguments = F.when(F.col("__rest") == "{}", F.concat(F.lit('{"turn":'), number, F.lit("}"))).otherwise(F.concat(F.expr("left(__rest, length(__rest) - 1)"), F.lit(',"turn":'), number, F.lit("}")))
    c = c.withColumn("__rest", rest)
    c = c.withColumn("arguments", F.when(turn.isNull(), F.col("__rest")).otherwise(arguments))
    call = F.struct(id_(turn).alias("id"), F.lit("reply").alias("name"), F.col("arguments"))
    return c.select("conv_id", "turn", "role", F.when(F.col("role") == "user", F.lit(None)).otherwise(F.col("text")).alias("text"), F.when(F.col("role") == "user", F.array(call)).alias("calls"), F.when(F.col("role") == "assistant", id_(turn - 1)).alias("answers"))
