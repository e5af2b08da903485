"""Ordering of entities and nodes; driver-side, over declarations only."""

from __future__ import annotations

import heapq
from collections.abc import Iterable
from dataclasses import dataclass, field

from ..model import Domain


class GraphError(ValueError):
    pass


@dataclass(frozen=True)
class Node:
    name: str
    consumes: tuple[str, ...] = ()
    produces: tuple[str, ...] = ()


@dataclass
class _Degrees:
    waits: dict[str, set[str]] = field(default_factory=dict)

    def ordered(self) -> tuple[list[str], list[str]]:
        """(names so that each follows what it waits for, earlier ones first; names in cycles)."""
        place = {n: k for k, n in enumerate(self.waits)}
        left = {n: set(w) for n, w in self.waits.items()}
        ready = [(place[n], n) for n, w in left.items() if not w]
        heapq.heapify(ready)
        out = []
        while ready:
            _, n = heapq.heappop(ready)
            out.append(n)
            for other, w in left.items():
                if n in w:
                    w.discard(n)
                    if not w:
                        heapq.heappush(ready, (place[other], other))
        return out, [n for n in left if n not in set(out)]


def resolve(nodes: Iterable[Node]) -> list[Node]:
    """Nodes so that producers come first. Two producers of one thing, a missing one, a node that feeds itself and cycles are errors."""
    nodes = list(nodes)
    maker: dict[str, str] = {}
    for n in nodes:
        for p in n.produces:
            if p in maker:
                raise GraphError(f"{p} is produced by {maker[p]} and {n.name}")
            maker[p] = n.name
    waits: dict[str, set[str]] = {}
    for n in nodes:
        waits[n.name] = set()
        for c in n.consumes:
            if c not in maker:
                raise GraphError(f"nothing produces {c}, which {n.name} consumes")
            if maker[c] == n.name:
                raise GraphError(f"{n.name} consumes what it produces: {c}")
            waits[n.name].add(maker[c])
    order, stuck = _Degrees(waits).ordered()
    if stuck:
        raise GraphError(f"cycle among {', '.join(stuck)}")
    by = {n.name: n for n in nodes}
    return [by[x] for x in order]


def entity_order(domain: Domain) -> list[str]:
    """Entities after those they point to and those of packs theirs depends on; entities in cycles come last, as declared."""
    waits: dict[str, set[str]] = {n: set() for n in domain.entities}
    for e in domain.entities.values():
        waits[e.name] |= {k.entity for k in e.foreign_keys if k.entity in domain.entities and k.entity != e.name}
        waits[e.name] |= {o.name for o in domain.entities.values() if e.pack and o.pack in domain.packs.get(e.pack, ())}
        for c in e.compositions:
            if c.kind == "isA":
                waits[c.entity].add(e.name)
    order, stuck = _Degrees(waits).ordered()
    return order + stuck


def composed(domain: Domain) -> set[str]:
    """Entities that live inside others and have no directory of their own."""
    return {c.entity for e in domain.entities.values() for c in e.compositions}


def directories(domain: Domain) -> list[str]:
    inside = composed(domain)
    return [n for n in entity_order(domain) if n not in inside]


def held_loops(domain: Domain) -> list[list[str]]:
    """Loops of entities that hold one another, from their first by name and back to it: at least one of every knot. A collection of one's own kind is a tree of rows and no loop."""
    found, done = [], set()
    for start in sorted(domain.entities):
        path, todo = [], [(start, False)]
        while todo:
            n, left = todo.pop()
            if left:
                done.add(path.pop())
            elif n in path:
                ring = path[path.index(n) :]
                least = ring.index(min(ring))
                found.append([*ring[least:], *ring[:least], min(ring)])
            elif n not in done and n in domain.entities:
                path.append(n)
                todo.append((n, True))
                todo += [(c.entity, False) for c in domain.entities[n].compositions if (c.kind, c.entity) != ("collection", n)]
    return [loop for i, loop in enumerate(found) if loop not in found[:i]]


def ancestors(domain: Domain, name: str) -> set[str]:
    """All entities reached by foreign keys."""
    out: set[str] = set()
    todo = [name]
    while todo:
        for k in domain.entity(todo.pop()).foreign_keys:
            if k.entity in domain.entities and k.entity not in out:
                out.add(k.entity)
                todo.append(k.entity)
    return out


def insert_directory(order: list[str], domain: Domain, name: str) -> list[str]:
    """order with a new directory right behind the last one it points to."""
    if name in order:
        return order
    above = ancestors(domain, name)
    at = max((k + 1 for k, n in enumerate(order) if n in above), default=0)
    return [*order[:at], name, *order[at:]]


def lineage(domain: Domain, name: str) -> list[str]:
    """The entity and what it is a kind of, upwards; a loop is an error."""
    out = [name]
    while parent := next((e.name for e in domain.entities.values() for c in e.compositions if c.kind == "isA" and c.entity == out[-1]), None):
        if parent in out:
            raise GraphError(f"{' is a '.join([*out, parent])}")
        out.append(parent)
    return out


def common_scope(domain: Domain, a: str, b: str, hops: int = 3) -> tuple[str, list[str], list[str]] | None:
    """The nearest entity both reach, with the foreign keys to it from each: fewest hops in all, ties by declaration."""

    def reach(start: str) -> dict[str, list[str]]:
        seen, level = {start: []}, [start]
        for _ in range(hops):
            nxt = []
            for n in level:
                for k in domain.entity(n).foreign_keys:
                    if k.entity in domain.entities and k.entity not in seen:
                        seen[k.entity] = [*seen[n], k.field]
                        nxt.append(k.entity)
            level = nxt
        return seen

    ra, rb = reach(a), reach(b)
    both = [n for n in domain.entities if n in ra and n in rb]
    best = min(both, key=lambda n: len(ra[n]) + len(rb[n]), default=None)
    return None if best is None else (best, ra[best], rb[best])
