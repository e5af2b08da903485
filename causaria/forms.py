"""The forms that projects declare things in, brought to the one that model.py reads.

Factors may be a list or a map under effects, with arrows as a list or a map;
names of things may be key or, say, motifKey; and so on. Whatever is neither
known nor known to mean nothing is an error, told with all others.
"""

from __future__ import annotations

from collections.abc import Mapping

#: Parts of a ruleset module that carry something, and those that carry nothing here.
PARTS = ("factors", "effects", "dials", "eras", "heroes", "motifs", "ladders", "params")
SILENT = ("$schema", "name", "domain", "description", "version", "catalog", "mixes", "scenarios")
RULES = ("path-match", "date-window", "text-contains-path", "outcome-derived-from-ballots")


def first(d: Mapping, *names: str, default=None):
    """The value of the first name that d has."""
    return next((d[n] for n in names if n in d), default)


def unknown(d: Mapping) -> list[str]:
    return [f"unknown part {k!r}" for k in d if k not in PARTS + SILENT]


def factor(f: Mapping, name: str | None = None) -> dict:
    arrows = f.get("arrows") or []
    if isinstance(arrows, Mapping):
        arrows = [{**a, "name": a.get("name", k)} for k, a in arrows.items()]
    return {**f, "id": f.get("id", name), "arrows": [{**a, "feature": feature(a["feature"]) if a.get("feature") else None} for a in arrows], "outcome": feature(f["outcome"])}


def feature(q: Mapping) -> dict:
    """A query's own from, or that of its parts: path, children's entity, self."""
    out = dict(q)
    out.setdefault("from", "self")
    if out.get("path") and out["from"] == "self":
        out["from"] = "path"
    if not isinstance(out.get("otherwise"), Mapping) and out.get("otherwise") is not None and out.get("where"):
        out["otherwise"] = dict.fromkeys(out["where"], out["otherwise"])
    return out


def era(e: Mapping) -> dict:
    return {**e, "name": first(e, "name", "eraKey", default="")}


def pin(p: Mapping) -> dict:
    return {"kind": p["kind"], "cycle": p.get("cycle"), "of": feature(p["feature"]) if p.get("feature") else first(p, "of", "field", "factor"), "op": p.get("op", "eq"), "value": p.get("value")}


def hero(h: Mapping) -> dict:
    stays = [(x["ladderKey"], x["state"], x["enterCycle"], x.get("exitCycle")) for x in h.get("ladderEntries", ())]
    return {**h, "key": first(h, "key", "heroKey"), "match": first(h, "match", "businessKeys", default={}), "dials": first(h, "dials", "latentDials", default={}), "pins": [pin(p) for p in h.get("pins", ())], "ladders": h.get("ladders", stays)}


def motif(m: Mapping) -> dict:
    path = m.get("latentTrajectory")
    rates = m.get("childRates", {})
    if not isinstance(rates, Mapping):
        rates = {r["entity"]: [r["perCycle"]["min"], r["perCycle"]["max"]] if isinstance(r["perCycle"], Mapping) else r["perCycle"] for r in rates}
    over = m.get("factorOverrides", ())
    start = m.get("ladderProgression")
    return {
        **m,
        "id": first(m, "id", "motifKey"),
        "entity": first(m, "entity", "targetEntity"),
        "quota": {**m["quota"], "type": first(m["quota"], "type", "mode", default="count")},
        "dials": first(m, "dials", "latentConstraints", default={}),
        "trajectory": m.get("trajectory", {path["dial"]: path["deltaPerCycle"]} if path else {}),
        "childRates": rates,
        "overrides": m.get("overrides", {o["factor"]: o["probability"] for o in over if o.get("probability") is not None}),
        "betas": m.get("betas", {(o["factor"], o["arrow"]): o["beta"] for o in over if o.get("beta") is not None}),
        "ladder": m.get("ladder", [start["ladderKey"], start["initialState"]] if start else None),
    }


def ladder(x: Mapping) -> dict:
    binding = dict(x.get("binding") or {})
    stored = binding.get("stateValues", {})
    states = []
    for s in x["states"]:
        need = s.get("prerequisites") or {}
        prior = first(need, "priorState", default=s.get("prior", ()))
        effects, by_factor = s.get("effects", {}), s.get("factorEffects", {})
        if not isinstance(effects, Mapping):
            by_factor = {e["factor"]: e["beta"] for e in effects}
            effects = {}
        left = s.get("exitEffects", {})
        states.append(
            {
                **s,
                "duration": first(s, "duration", "durationCycles", default=1),
                "prior": [prior] if isinstance(prior, str) else prior,
                "minCyclesSinceBirth": first(need, "minCyclesSinceBirth", default=s.get("minCyclesSinceBirth")),
                "dials": first(need, "dials", default=s.get("dials", {})),
                "effects": effects,
                "factorEffects": by_factor,
                "exitEffects": left if isinstance(left, Mapping) else {e["dial"]: e["delta"] for e in left},
                "stored": s.get("stored", stored.get(s["name"])),
            }
        )
    return {**x, "id": first(x, "id", "ladderKey"), "share": first(x, "share", "cohortShare", default=1.0), "states": states, "binding": binding or None}


def ruleset(d: Mapping) -> dict:
    factors = [factor(f) for f in d.get("factors", ())]
    effects = d.get("effects") or {}
    factors += [factor(f, k) for k, f in effects.items()] if isinstance(effects, Mapping) else [factor(f) for f in effects]
    out = {"factors": factors, "dials": d.get("dials", ())}
    for kind, one in (("eras", era), ("heroes", hero), ("motifs", motif), ("ladders", ladder)):
        out[kind] = [one(x) for x in d.get(kind) or ()]
    return out


def generator(g) -> dict | None:
    """A field's generator: {type: conditionalDistribution | catalogLookup | relativeDateRange} or {kind: ...}."""
    if not isinstance(g, Mapping) or "kind" in g:
        return g if isinstance(g, Mapping) else None
    kind = g.get("type") or ("relativeDateRange" if "relativeTo" in g else None)
    if kind == "conditionalDistribution":
        return {"kind": "conditional", "on": g["conditionalOn"], "table": {k: dict(zip(v["values"], v.get("weights") or [1.0] * len(v["values"]), strict=True)) for k, v in g["distributions"].items()}}
    if kind == "catalogLookup":
        return {"kind": "catalogue", "name": g["catalog"], "on": g.get("conditionalOn"), "map": g.get("mappingKey")}
    if kind == "relativeDateRange":
        low, high = g.get("minOffsetYears"), g.get("maxOffsetYears")
        mean = g.get("meanOffsetYears", ((low if low is not None else -60.0) + (high if high is not None else -18.0)) / 2)
        flat = g.get("distribution", "normal") == "uniform"
        return {"kind": "relativeDate", "anchor": g.get("anchorField") or g["relativeTo"], "mean": mean, "sd": 0.0 if flat else g.get("stdDevYears", 0.0), "low": low, "high": high, "flat": flat}
    return None


def field(v: Mapping) -> dict:
    out = {**v, "unique": bool(v.get("unique", v.get("uniqueness") == "generated")), "generator": generator(v.get("generator"))}
    if v.get("logo") is not None:
        out["generator"] = {"kind": "monogram", "of": v["logo"].get("nameField", "Name")}
    elif v.get("avatar") is not None:
        a = v["avatar"]
        out["generator"] = {"kind": "avatar", "of": a.get("seedField", "ID"), "style": a.get("style", "toon-head"), "base": a.get("base"), "trait": a.get("traitField"), "traits": a.get("traits"), "default": a.get("defaultTrait"), "background": a.get("backgroundColor")}
    return out


def compositions(entities: Mapping[str, Mapping]) -> dict[str, list[tuple]]:
    """By holder: (kind, entity held, foreign key), of an isA also its selector. An isA may stand with the parent or, naming its parent, with the child."""
    out: dict[str, list[tuple]] = {n: [] for n in entities}
    for name, e in entities.items():
        c = e.get("composition") or {}
        is_a = c.get("isA") or []
        for x in [is_a] if isinstance(is_a, Mapping) else is_a:
            if x.get("parentEntity"):
                out.setdefault(x["parentEntity"], []).append(("isA", name, "ID", x.get("when")))
            else:
                out[name].append(("isA", x["entity"], x.get("field", "ID")))
        for kind, plural in (("collection", "collections"), ("embed", "embeds")):
            held = c.get(plural) or []
            for x in held.values() if isinstance(held, Mapping) and "entity" not in held else [held] if isinstance(held, Mapping) else held:
                fk = first(x, "field", "foreignKey", default="ID")
                keys = entities[x["entity"] if kind == "collection" else name].get("foreignKeys", {}) if x["entity"] in entities else {}
                out[name].append((kind, x["entity"], keys.get(fk, {}).get("fieldName", fk)))
    return out


def hops(path: list, entities: Mapping[str, Mapping], source: str) -> tuple[list[dict], str | None]:
    """'FK:Entity' steps, where FK is a key's name or field, and the last field, if the path ends in one."""
    out, at, end = [], source, None
    for step in path:
        if isinstance(step, Mapping):
            out.append(dict(step))
            at = step["entity"]
            continue
        fk, colon, to = step.partition(":")
        if not colon:
            end = step
            continue
        known = entities.get(at, {}).get("foreignKeys", {}).get(fk, {})
        out.append({"field": known.get("fieldName", fk), "entity": to or known.get("targetEntity"), "key": known.get("targetField", "ID")})
        at = out[-1]["entity"]
    return out, end


def rule(r: Mapping, entities: Mapping[str, Mapping]) -> dict:
    """A relational rule in the form that plans/validate.py reads."""
    if "sourceEntity" not in r:
        return dict(r)
    out = {"kind": r["kind"], "name": r.get("name", r["kind"]), "source": r["sourceEntity"]}
    if r["kind"] == "path-match":
        out["path"], end = hops(r["path"], entities, r["sourceEntity"])
        out |= {"targetField": r.get("targetField") or end, "sourceField": r.get("sourceField")}
        if p := r.get("inclusion"):
            out["inclusion"] = {"entity": p["poolEntity"], "item": p["poolItemField"], "container": p["poolContainerField"], "sourceItem": p["sourceItemField"]}
    elif r["kind"] == "date-window":
        out |= {"dateField": r["dateField"], "key": r.get("linkSourceField") if r.get("linkEntity") else None, "window": r["windowEntity"], "windowKey": r["windowForeignKey"], "startField": r["windowStartField"], "endField": r["windowEndField"], "requireWindow": bool(r.get("requireWindow")), "timing": timing(r.get("timing")), "roleWindows": r.get("roleWindows")}
        if r.get("linkEntity"):
            out["link"] = {"entity": r["linkEntity"], "source": r["linkSourceField"], "target": r["linkTargetField"]}
        out["key"] = r["windowForeignKey"]
    elif r["kind"] == "text-contains-path":
        out["path"], _ = hops(r["path"], entities, r["sourceEntity"])
        out |= {"textField": r["textField"], "targetFields": list(r["targetFields"])}
        if c := r.get("childReferences"):
            out["children"] = {"entity": c["childEntity"], "key": c["foreignKey"], "field": c["childField"]}
    else:
        name = {"supermajority-two-thirds": "two-thirds"}
        out |= {"outcomeField": r["outcomeField"], "ballots": r["ballotEntity"], "decisionField": r["ballotDecisionForeignKey"], "voteField": r["ballotVoteField"], "rule": name.get(r.get("rule", "majority"), r.get("rule", "majority")), "quorum": r.get("quorum", 1), "tie": r.get("tieRule", "Failed"), "countAbstain": r.get("abstainHandling") == "count-toward-quorum", "yes": r.get("positiveVoteValue", "Yes"), "no": r.get("negativeVoteValue", "No"), "abstain": r.get("abstainVoteValue", "Abstain"), "passed": r.get("passedOutcomeValue", "Passed"), "failed": r.get("failedOutcomeValue", "Failed"), "abstainRate": r.get("abstainRate", 0.0), "weights": r.get("categoricalWeights")}
    return out


def timing(t: Mapping | None) -> dict | None:
    """A timing as functions/dates.py reads it."""
    if not t or "kind" in t:
        return dict(t) if t else None
    if t["type"] == "const":
        return {"kind": "const", "days": t["days"]}
    if t["type"] == "uniformDays":
        return {"kind": "uniform", "min": t["min"], "max": t["max"]}
    if t["type"] == "lognormalDays":
        return {"kind": "lognormal", "median": t["medianDays"], "sigma": t["sigma"], **{k: t[j] for k, j in (("min", "minDays"), ("cap", "capDays")) if j in t}}
    return {"kind": "mixture", "parts": [{"weight": w, "timing": timing(x)} for x, w in t["bands"]]}


def named(r: Mapping) -> list[str]:
    """Every entity that a rule speaks of."""
    out = [r["source"], *[h["entity"] for h in r.get("path", ()) if isinstance(h, Mapping)]]
    for k in ("window", "ballots"):
        out += [r[k]] if r.get(k) else []
    for k in ("inclusion", "link", "children"):
        out += [r[k]["entity"]] if r.get(k) else []
    return out
