"""State ladders: ordered states with durations, prerequisites, capacities and effects on dials.

Without capacities and exit effects an entity's progress depends on its own row
alone, and `closed_form` gives any cycle's state as one expression. With them
the order of entities matters: an exit frees a place for a later entity of the
same cycle. `kernel` says so row by row; `step` gives the same by a scan over
stretches of that order, in parallel (see admitted).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Ladder, State


def enrol(entities: DataFrame, key: str, ladder: Ladder, cycle: int, seed: int) -> DataFrame:
    """(key, ladder, state, tenure, enter_cycle, born) for the share of entities that start on the ladder: exactly round(n x share), by keyed order."""
    from .simulate import quota_sample

    n = entities.count()
    chosen = quota_sample(entities, key, int(n * ladder.share + 0.5), seed, f"ladder:{ladder.id}") if ladder.share < 1 else entities
    return chosen.select(F.col(key).alias("key"), F.lit(ladder.id).alias("ladder"), F.lit(ladder.states[0].name).alias("state"), F.lit(0).alias("tenure"), F.lit(cycle).alias("enter_cycle"), F.lit(cycle).alias("born"))


def force(states: DataFrame, keys: DataFrame, ladder: str, state: str, cycle: int) -> DataFrame:
    """states with the given keys put into a state now; those not enrolled are enrolled."""
    k = keys.select(F.col(keys.columns[0]).alias("key")).distinct()
    rest = states.join(k, "key", "left_anti").unionByName(states.where(F.col("ladder") != ladder).join(k, "key", "left_semi"))
    born = states.where(F.col("ladder") == ladder).select("key", "born")
    return rest.unionByName(k.join(born, "key", "left").select("key", F.lit(ladder).alias("ladder"), F.lit(state).alias("state"), F.lit(0).alias("tenure"), F.lit(cycle).alias("enter_cycle"), F.coalesce("born", F.lit(cycle)).alias("born")))


def closed_form(ladder: Ladder, cycles: Column) -> Column:
    """The state of an entity that many cycles after it enrolled, without capacities and prerequisites; null after the last."""
    end, out = 0, None
    for s in ladder.states:
        end += s.duration
        out = F.when(cycles < end, F.lit(s.name)) if out is None else out.when(cycles < end, F.lit(s.name))
    return out


def allowed(s: State, state: str, born: int, cycle: int, dials: dict[str, float]) -> bool:
    """Whether an entity meets a state's prerequisites; a dial it lacks fails a bound on it."""
    if s.prior and state not in s.prior or s.min_cycles is not None and cycle - born < s.min_cycles:
        return False
    return all((v := dials.get(d)) is not None and (low is None or v >= low) and (high is None or v <= high) for d, (low, high) in s.dials.items())


def kernel(ladder: Ladder, cycle: int, step: int = 1, occupied: dict[str, int] | None = None):
    """(enrolled rows as dicts with dials, in order) -> rows after the cycle; a generator that holds one row and a count per state.

    occupied counts entities in each state before the cycle. Tenure grows by
    step; a row whose tenure reaches its state's duration moves on if the next
    state lets it in and has room, and leaves the ladder after the last.
    """
    place = {s.name: i for i, s in enumerate(ladder.states)}
    room = dict(occupied or {})

    def run(rows):
        for r in rows:
            i, dials = place[r["state"]], dict(r["dials"] or {})
            s, tenure, prior = ladder.states[i], r["tenure"] + step, r["state"]
            out = {**r, "tenure": tenure, "from_state": prior, "exited": False, "dials": dials}
            if tenure >= s.duration:
                nxt = ladder.states[i + 1] if i + 1 < len(ladder.states) else None
                if nxt is None or allowed(nxt, prior, r["born"], cycle, dials) and (nxt.capacity is None or room.get(nxt.name, 0) < nxt.capacity):
                    room[prior] = room.get(prior, 0) - 1
                    for d, x in s.exit_effects.items():
                        dials[d] = dials.get(d, 0.0) + x
                    if nxt is None:
                        out |= {"exited": True}
                    else:
                        room[nxt.name] = room.get(nxt.name, 0) + 1
                        for d, x in nxt.effects.items():
                            dials[d] = dials.get(d, 0.0) + x
                        out |= {"state": nxt.name, "tenure": 0, "enter_cycle": cycle}
            yield out

    return run


def lets_in(s: State, state: Column, born: Column, cycle: int, dials: Column) -> Column:
    """allowed() as a column."""
    ok = F.lit(True)
    if s.prior:
        ok = ok & state.isin(list(s.prior))
    if s.min_cycles is not None:
        ok = ok & (F.lit(cycle) - born >= s.min_cycles)
    for d, (low, high) in s.dials.items():
        v = dials[d]
        ok = ok & v.isNotNull() & (F.lit(True) if low is None else v >= low) & (F.lit(True) if high is None else v <= high)
    return F.coalesce(ok, F.lit(False))


#: Candidates that one task of a capacity's scan replays.
SCANNED = 100_000


def fills(events: Iterable[bool], occupied: int, capacity: int) -> Iterator[bool]:
    """Whether each event is a success: True is an arrival, which succeeds while there is room, False a departure."""
    for arrives in events:
        if not arrives:
            occupied -= 1
            yield True
        elif occupied < capacity:
            occupied += 1
            yield True
        else:
            yield False


def summary(events: Iterable[bool], capacity: int) -> tuple[int, int]:
    """(a, c): what a stretch of events makes of an occupancy x that isn't above the capacity, min(x + a, c)."""
    a, c = 0, 1 << 60
    for arrives in events:
        a, c = (a + 1, min(c + 1, capacity)) if arrives else (a - 1, c - 1)
    return a, c


def admitted(due: DataFrame, ladder: Ladder, occupied: dict[str, int]) -> DataFrame:
    """(n, place): of those that are due to move, by their place in the order of enrolment, those that do.

    due: n, place (of the state they are in), all that time and prerequisites
    let go. Whether one leaves a state doesn't depend on who enters it, so the
    states are taken from the last to the first: who leaves the next state is
    known then, and in the order of enrolment arrivals meet the room that
    departures before them have left. A stretch of that order acts on an
    occupancy as min(x + a, c), and such functions compose: stretches of
    SCANNED candidates are summed up in parallel, chained on the driver, a pair
    of numbers each, and replayed in parallel. A state above its capacity lets
    nobody in until so many have left that it isn't.
    """
    last = len(ladder.states) - 1
    moved = due.where(F.col("place") == last).select("n", "place")  # off the ladder's end, whoever is there
    out = moved
    for place in range(last, 0, -1):
        s = ladder.states[place]
        arrive = due.where(F.col("place") == place - 1).select("n", "place")
        if s.capacity is not None:
            arrive = _through(arrive, moved, s.capacity, occupied.get(s.name, 0))
        moved = arrive
        out = out.unionByName(moved)
    return out


def _through(arrive: DataFrame, leave: DataFrame, capacity: int, occupied: int) -> DataFrame:
    """The arrivals that find room."""
    import pandas as pd

    from ..operators.compose import ordinal
    from .simulate import saved

    events = arrive.withColumn("arrives", F.lit(True)).unionByName(leave.withColumn("arrives", F.lit(False))).withColumn("chunk", F.floor(F.col("n") / SCANNED))
    events = saved(events)
    over = max(0, occupied - capacity)
    begin = -1
    if over:  # the departure that makes it just full
        gone = ordinal(events.where("NOT arrives").select("n"), ["n"], "k").where(F.col("k") == over).first()
        if gone is None:
            return arrive.limit(0)
        begin = gone["n"]
    open_ = events.where(F.col("n") > begin)

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        a, c = summary(pdf.sort_values("n")["arrives"].tolist(), capacity)
        return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1], "a": [a], "c": [c]})

    x, at = min(occupied, capacity), {}
    for r in sorted(open_.groupBy("chunk").applyInPandas(sums, "chunk long, a long, c long").collect()):
        at[r["chunk"]] = x
        x = min(x + r["a"], r["c"])

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n")
        done = list(fills(pdf["arrives"].tolist(), at[int(pdf["chunk"].iloc[0])], capacity))
        return pdf[pd.Series(done, index=pdf.index) & pdf["arrives"]][["n", "place"]]

    return saved(open_.groupBy("chunk").applyInPandas(replay, "n long, place int"))


def step(states: DataFrame, ladder: Ladder, cycle: int, by: int = 1, order: str = "key") -> DataFrame:
    """states (with dials map<string,double>) of one ladder after a cycle; see kernel() for the rules.

    Tenure grows by `by`; who has stayed a state's duration moves on if the
    next state lets it in and has room, in order of enrolment (born, then key).
    All but room is a matter of the row alone.
    """
    from ..operators.compose import ordinal

    own = states.where(F.col("ladder") == ladder.id)
    cols = [F.col("key").cast("string").alias("key"), "ladder", "state", F.col("tenure").cast("int").alias("tenure"), F.col("enter_cycle").cast("int").alias("enter_cycle"), F.col("born").cast("int").alias("born"), F.coalesce("dials", F.create_map().cast("map<string,double>")).alias("dials")]
    own = own.select(*cols)
    place, due = F.lit(None).cast("int"), F.lit(False)
    for i, s in enumerate(ladder.states):
        here = F.col("state") == s.name
        place = F.when(here, F.lit(i)).otherwise(place)
        nxt = ladder.states[i + 1] if i + 1 < len(ladder.states) else None
        goes = F.lit(True) if nxt is None else lets_in(nxt, F.col("state"), F.col("born"), cycle, F.col("dials"))
        due = F.when(here, (F.col("tenure") + by >= s.duration) & goes).otherwise(due)
    own = own.withColumns({"place": place, "due": due, "tenure": F.col("tenure") + by})
    if any(s.capacity is not None for s in ladder.states):
        counts = {r["state"]: r["count"] for r in own.groupBy("state").count().collect()}
        ranked = ordinal(own, ["born", order], "n")
        found = admitted(ranked.where("due").select("n", "place"), ladder, counts).select(F.col("n").alias("__n")).withColumn("__moves", F.lit(True))
        own = ranked.join(found, F.col("n") == F.col("__n"), "left").withColumn("moves", F.coalesce("__moves", F.lit(False)))
    else:
        own = own.withColumn("moves", F.col("due"))
    return own.select(*_moved(ladder, cycle))


def _moved(ladder: Ladder, cycle: int) -> list[Column]:
    """The columns of a step: where a row moves, its next state's, with what leaving and entering do to its dials."""
    last = len(ladder.states) - 1
    moves, ends = F.col("moves"), F.col("moves") & (F.col("place") == last)
    on = moves & ~ends
    dials = F.col("dials")
    for effects in (lambda i: ladder.states[i].exit_effects, lambda i: ladder.states[i + 1].effects if i < last else {}):
        for i in range(last + 1):
            if effects(i):
                change = F.create_map(*[F.lit(x) for d, v in effects(i).items() for x in (d, float(v))])
                sum_ = F.map_zip_with(dials, change, lambda _, a, b: F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0)))
                dials = F.when(moves & (F.col("place") == i), sum_).otherwise(dials)
    names = F.array(*[F.lit(s.name) for s in ladder.states])
    return [
        F.col("key"),
        F.col("ladder"),
        F.when(on, F.element_at(names, F.least(F.col("place") + 2, F.lit(last + 1)))).otherwise(F.col("state")).alias("state"),
        F.when(on, F.lit(0)).otherwise(F.col("tenure")).cast("int").alias("tenure"),
        F.when(on, F.lit(cycle)).otherwise(F.col("enter_cycle")).cast("int").alias("enter_cycle"),
        F.col("born"),
        F.col("state").alias("from_state"),
        ends.alias("exited"),
        dials.alias("dials"),
    ]


def occupancy(states: DataFrame) -> DataFrame:
    return states.groupBy("ladder", "state").count()


def intervals(history: DataFrame) -> DataFrame:
    """(key, ladder, state, enter_cycle) -> also exit_cycle: when the next state was entered; null while it lasts."""
    from pyspark.sql import Window

    return history.withColumn("exit_cycle", F.lead("enter_cycle").over(Window.partitionBy("key", "ladder").orderBy("enter_cycle")))


def stored(ladder: Ladder, state: Column) -> Column:
    """The value a state is stored as."""
    out = state
    for s in ladder.states:
        if s.stored is not None:
            out = F.when(state == s.name, F.lit(s.stored)).otherwise(out)
    return out


def state_of(ladder: Ladder, value: Column) -> Column:
    """The state a stored value means; by name, case aside, where no state is stored so."""
    out = F.lit(None).cast("string")
    for s in reversed(ladder.states):
        out = F.when(F.lower(value) == s.name.lower(), F.lit(s.name)).otherwise(out)
    for s in reversed(ladder.states):
        if s.stored is not None:
            out = F.when(value == s.stored, F.lit(s.name)).otherwise(out)
    return out


def bind(rows: DataFrame, key: str, states: DataFrame, ladder: Ladder, field: str, fixed: dict | None = None) -> DataFrame:
    """rows with their state written to a field, and fixed fields beside it, where they are on the ladder."""
    s = states.where(F.col("ladder") == ladder.id).select(F.col("key").alias("__key"), stored(ladder, F.col("state")).alias("__state"))
    out = rows.join(s, rows[key].cast("string") == F.col("__key"), "left")
    on = F.col("__state").isNotNull()
    out = out.withColumn(field, F.coalesce("__state", F.col(field)) if field in rows.columns else F.col("__state"))
    for f, v in (fixed or {}).items():
        out = out.withColumn(f, F.when(on, F.lit(v)).otherwise(F.col(f)) if f in rows.columns else F.when(on, F.lit(v)))
    return out.drop("__key", "__state")


def processor(ladder: Ladder):
    """A stateful processor for streams of (key, cycle): emits each key's state as cycles arrive. For ladders without capacities."""
    if any(s.capacity is not None for s in ladder.states):
        raise ValueError(f"{ladder.id}: capacities need the batch kernel")
    from pyspark.sql.streaming import StatefulProcessor

    class Progress(StatefulProcessor):
        def init(self, handle) -> None:
            self.state = handle.getValueState("progress", "born int")

        def handleInputRows(self, key, rows, timerValues):
            import pandas as pd

            cycles = sorted(int(c) for pdf in rows for c in pdf["cycle"])
            born = self.state.get()[0] if self.state.exists() else cycles[0]
            self.state.update((born,))
            out = []
            for c in cycles:
                age, end = c - born, 0
                name = None
                for s in ladder.states:
                    end += s.duration
                    if age < end:
                        name = s.name
                        break
                out.append((str(key[0]), c, name))
            yield pd.DataFrame(out, columns=["key", "cycle", "state"])

        def close(self) -> None:
            pass

    return Progress
